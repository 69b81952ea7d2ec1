"""Queries of the operators that compare documents with the whole corpus."""

from __future__ import annotations

from strandframe.llm.catalog import query
from strandframe.llm.common import table
from strandframe.llm.decontaminate import contaminated
from strandframe.llm.lm_score import score_texts
from strandframe.llm.near_dup import near_duplicates


@query("op4_near_dup")
def op4(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), percent=80, size=4)


@query("op6_decontamination")
def op6(spark, sf):
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_lm_score")
def op2(spark, sf):
    return score_texts(table(spark, sf, "documents"))
