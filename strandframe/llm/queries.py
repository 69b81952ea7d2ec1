"""All registered text queries."""

from strandframe.llm import queries_corpus, queries_native, queries_rows  # noqa: F401
from strandframe.llm.catalog import QUERIES, SQL  # noqa: F401
