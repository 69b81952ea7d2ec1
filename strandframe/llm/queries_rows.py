"""Queries of the operators whose inner step runs in Python on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from strandframe.llm.catalog import query
from strandframe.llm.chat_format import format_conversations, read_marked, unescape
from strandframe.llm.common import settled, shared_folder, table, text_of, words
from strandframe.llm.html_text import extract_main_text
from strandframe.llm.packing import pack
from strandframe.llm.periodic_runs import periodic_runs
from strandframe.llm.token_counts import count_tokens
from strandframe.llm.token_file import read_token_files, write_token_files
from strandframe.llm.whitening import on_grid, whiten


@query("op3_chat_format")
def op3(spark, sf):
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = format_conversations(rows.unionByName(more))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv, formatted, marks in zip(batch["conv_id"], batch["formatted"], batch["turns"]):
                turns = read_marked(formatted)
                every = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(formatted[m["text_start"] : m["text_end"]]) for m in marks if m["role"] == "assistant")
                hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (every, loss)]
                out.append((conv, len(turns), hashes[0], len(loss), hashes[1], len(formatted)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return done.mapInPandas(digest, schema)


@query("op7_token_file")
def op7(spark, sf):
    import public_tokenizers

    path = shared_folder(spark, "token-file")
    write_token_files(table(spark, sf, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    back = read_token_files(spark, path)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op8_best_fit_packing")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    text = text_of("text")
    same = F.when(F.trim(text) != "", F.xxhash64(F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))))
    return pack(docs, F.size(words(text)) + 1, same)


@query("op9_html_text")
def op9(spark, sf):
    return extract_main_text(table(spark, sf, "pages"))


@query("op12_token_counts")
def op12(spark, sf):
    import public_tokenizers

    counted = count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op11_periodic_runs")
def op11(spark, sf):
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    tiled = h % 10 == 0
    docs = settled(table(spark, sf, "documents").select("doc_id", text_of("text").alias("text"), g.alias("g"), F.when(tiled, words(text_of("text"))).alias("w")))
    n = F.size("w")
    a = F.col("g") % n
    parts = settled(docs.select("doc_id", "text", "w", a.alias("a"), (1 + F.floor((n - a) / (3 + F.col("g") % 8))).alias("p")))

    def source(i):
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))

    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.size("w") - F.lit(1).cast("long")), lambda i: F.get("w", source(i).cast("int")))
    made = parts.select("doc_id", F.when(F.size("w") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))

    found = periodic_runs(made)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = settled(found.withColumn("best", F.aggregate("runs", none, better)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_embedding_whitening")
def op13(spark, sf):
    return whiten(on_grid(table(spark, sf, "embeddings")))
