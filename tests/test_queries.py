import duckdb
import pytest

import __spark_entry__ as entry
import check

SAMPLE = [
    "kmer_count_regular", "matrix_stats_columns", "tpm", "count_cuts_in_regions", "covered_bases", "auroc", "bh_adjust",
    "motif_similarity", "strict_runs", "motif_sequence_matrix", "stratified_folds", "read_motifs",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() == 64


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    mine = check.rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(entry.oracle_sql()[name])
    assert mine == check.rows_of([d[0] for d in res.description], res.fetchall())
