"""Token counts of whole texts by compiled transducers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import text_of
from strandframe.llm.token_machine import machine


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` per input row, for a byte-level BPE file.

    Counts are those of the tokenizers library without begin, end or added special
    tokens; the strings of special tokens inside a text are one token each.  A null text
    is empty and has none.  Rows are independent: repeated ids give one row each, an
    empty table none, other columns are ignored.  No text is moved between tasks.
    """
    picked = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("t").cast(pa.string())
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            counts = machine(tokenizer).token_counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    done = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return done.withColumnRenamed("id", id_col)
