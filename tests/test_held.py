import numpy as np
import pytest

from strandframe.operators import cluster as K
from strandframe.operators import held
from strandframe.operators import linkage as L

from test_cluster import chain_merges, naive_labels, points, sets


def tables(monkeypatch):
    """Tables that the rounds of ``linkage`` store from now on."""
    stored, real = [], L.written

    def spied(df):
        stored.append(df)
        return real(df)

    monkeypatch.setattr(L, "written", spied)
    return stored


def rows_of(merges):
    return sorted((r["height"], int(r["a"][1:]), int(r["b"][1:])) for r in merges.collect())


def same(got, want):
    assert [g[1:] for g in got] == [tuple(w[:2]) for w in want]
    assert [g[0] for g in got] == pytest.approx([w[2] for w in want])


@pytest.mark.parametrize("small", [1, held.SMALL])
def test_complete_linkage_does_not_store_tables_every_round(spark, monkeypatch, small):
    monkeypatch.setattr(held, "SMALL", small)  # 1: every search is a job
    monkeypatch.setattr(held, "PART", 2)
    x = np.random.default_rng(3).normal(size=(90, 6))
    d = K.distances(x, x, "correlation")
    stored = tables(monkeypatch)
    same(rows_of(L.merge_table(points(spark, x).selectExpr("'g' AS grp", "id", "vec"), "correlation", "complete", None, 8, 8)), chain_merges(d, "complete"))
    got = K.agglomerative_cluster(points(spark, x), "correlation", "complete", 0.9, local=8).collect()
    assert sets(got) == naive_labels(d, "complete", 0.9)
    assert len(stored) <= 4


def test_average_linkage_searches_few_clusters_again(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(150, 5))
    searched, real = [], held.Rounds.search

    def spied(self, todo, fast):
        searched.append(len(todo))
        return real(self, todo, fast)

    monkeypatch.setattr(held.Rounds, "search", spied)
    p = points(spark, x).selectExpr("'g' AS grp", "id", "vec")
    want = chain_merges(K.distances(x, x, "euclidean"), "average")
    same(rows_of(L.merge_table(p, "euclidean", "average", None, 4, 16)), want)
    assert 150 <= sum(searched) < 400  # each once, every merged one again, and few others
    same(rows_of(L.merge_table(p, "euclidean", "average", None, 60, 64, most=0)), want)  # rounds over tables


def test_copies_and_equal_names_take_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(20, 4)), np.repeat(rng.normal(size=(1, 4)), 40, axis=0), np.ones((12, 4))])
    stored = tables(monkeypatch)
    p = points(spark, x).selectExpr("'g' AS grp", "id", "vec")
    got = L.merge_table(p, "correlation", "average", None, 4, 16).collect()
    assert len(got) == 71 and len(stored) <= 3 and max(r["round"] for r in got) < 30
    want = sorted(h for _, _, h in chain_merges(K.distances(x, x, "correlation"), "average"))
    assert sorted(r["height"] for r in got) == pytest.approx(want)
    leaves = [r["leaf"] for r in K.order_by_hierarchy(points(spark, x), "correlation", local=4).collect()]
    assert sorted(leaves) == list(range(72))
    twice = p.unionByName(p.limit(3))  # rows of one name are one cluster from the start
    assert L.merge_table(twice, "correlation", "average", None, 4, 16).count() == 71


def test_average_of_sums_over_tables(spark):
    x = np.random.default_rng(9).normal(size=(40, 5))
    p = points(spark, x).selectExpr("'g' AS grp", "id", "vec")
    for most in (0, L.HELD):
        same(rows_of(L.merge_table(p, "correlation", "average", None, 16, 16, most=most)), chain_merges(K.distances(x, x, "correlation"), "average"))
