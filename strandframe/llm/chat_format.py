"""Chat formatting with turn spans found by rendering prefixes of the conversation.

The template is a black box from turns to a string.  Rendering one more turn at a time
and comparing consecutive outputs gives the span of each turn; rendering a one-letter
probe in its place gives header and closing, so the loss mask covers the text alone.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
OUT = (
    "conv struct<id:{id}>, formatted string, rewritten_at int,"
    "turns array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"
)


@lru_cache(maxsize=1024)
def escape(text: str) -> str:
    """Backslash before backslashes and before whatever could read as a control string."""
    return re.sub(r"\\|#(?=##)|<(?=/turn>)", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def marked_template(turns: list[Turn]) -> str:
    """``### role: text</turn>`` and a line break per turn."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)}</turn>\n" for role, text in turns)


TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.S)


def read_marked(formatted: str) -> list[Turn]:
    """The turns of a text made by ``marked_template``."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def locate_turns(render: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[list[int]], int]:
    """Formatted text, (start, end, text_start, text_end) per turn, and the first turn that changed what stood before it.

    The last value is -1 for a template that only appends.  A closing that moves to the
    new end (an end-of-text mark) is no change of history.  Once history is rewritten
    the spans of earlier turns mean nothing, so none are returned.
    """
    spans: list[list[int]] = []
    before = render([])
    for k, (role, _) in enumerate(turns):
        now = render(turns[: k + 1])
        same = len(before) if now.startswith(before) else len(os.path.commonprefix([before, now]))
        if spans and same < spans[-1][1]:
            if same < spans[-1][3]:
                return render(turns), [], k
            spans[-1][1] = same
        letter = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in role)
        probe = render([*turns[:k], (role, letter)])
        head = probe.find(letter, same)
        tail = len(probe) - head - 1
        if head < 0 or now[:head] != probe[:head]:
            return render(turns), [], k
        spans.append([same, len(now), head, len(now) - tail])
        before = now
    return before, spans, -1


def format_conversations(
    rows: DataFrame,
    render: Callable[[list[Turn]], str] = marked_template,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_col, formatted, rewritten_at, turns``.

    Turns are in order of ``turn_col`` (null first), then role and text, so ties and
    repeated rows have one order; null role or text is empty; rows without a
    conversation id form one conversation of their own.  Other columns are ignored.  A
    conversation is one output text and so one task's work; rendering all prefixes costs
    turns times its length.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    grouped = rows.groupBy(F.struct(F.col(conv_col).alias("id")).alias("conv")).agg(F.sort_array(F.collect_list(turn)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, these in zip(batch["conv"], batch["rows"]):
                turns = [(r["role"], r["text"]) for r in these]
                formatted, spans, rewritten = locate_turns(render, turns)
                marks = [{"role": role, "start": s[0], "end": s[1], "text_start": s[2], "text_end": s[3]} for (role, _), s in zip(turns, spans)]
                out.append((conv, formatted, rewritten, marks))
            yield pd.DataFrame(out, columns=["conv", "formatted", "rewritten_at", "turns"])

    kind = rows.schema[conv_col].dataType.simpleString()
    done = grouped.select("conv", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows")).mapInPandas(run, OUT.format(id=kind))
    return done.select(F.col("conv.id").alias(conv_col), "formatted", "rewritten_at", "turns")
