"""Searches by descent and scan against brute force: ties, narrow and whole beams, several blocks, other metrics, large trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.operators import growth, topk
from quiverlake.operators import index as ix
from quiverlake.plans import registry

SMALL = ix.Attributes(dimension=6, leaf_max=8, leaf_min=2, internal_max=4, internal_min=1)


def random_vectors(spark, n, high=9, kind="int", seed=3):
    rows = np.random.default_rng(seed).integers(0, high, (n, 6)).tolist()
    return spark.createDataFrame(list(enumerate(rows)), "id bigint, vec array<int>").withColumn("vec", F.col("vec").cast(f"array<{kind}>"))


def lists(found):
    return sorted((r.qid, r["rank"], r.vec_id, r.distance) for r in found.collect())


@pytest.mark.parametrize("metric,kind", [("l2_int", "int"), ("l2", "double")])
def test_scan_equals_joins(spark, monkeypatch, metric, kind):
    """Small numbers, so that many distances are equal; three levels above the leaves; queries in several blocks."""
    v = random_vectors(spark, 150, 4, kind)
    q = v.where("id % 9 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    index = ix.build(v, ix.Attributes(dimension=6, metric=metric, internal_max=4), 20)
    index = ix.delete(index, v.where("id % 7 = 3").select(F.col("id").alias("vec_id")))
    index = ix.Index(ix.saved(index.members), index.height, index.attributes)
    assert index.height == 4
    monkeypatch.setattr(ix, "FEW", 7)
    for spans in ((1, 1), (2, 3), (100, 100)):
        want = topk.top_k(ix.beam(index, q, 1, *spans, 5).withColumnRenamed("node", "vec_id"), 5)
        found = ix.ann_search(index, q, 5, *spans)
        assert lists(found) == lists(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan  # queries and entries never meet as rows


def test_distances_of_large_integers():
    """Beyond 24 and 53 bits the sums aren't made in floats that would round them."""
    for high in (256, 40_000, 2**26):
        a = np.random.default_rng(1).integers(high // 2, high, (5, 64))
        b = np.random.default_rng(2).integers(-high, high, (7, 64))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, r)) for r in b] for p in a]
        assert ix._pairwise(a, b, True).astype(np.int64).tolist() == want


def test_nearest_pivots_are_exact(spark, monkeypatch):
    """More pivots than a block holds: still the nearest of all."""
    monkeypatch.setattr(ix, "PIVOTS", 4)
    v = random_vectors(spark, 120, 30)
    x = np.array([r.vec for r in v.orderBy("id").collect()])
    want = ((x[:, None] - x[None, ::8]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.id: r.cluster_id for r in ix.assigned(v, 15, "nearest").collect()} == dict(enumerate(want.tolist()))


def embeddings(spark, path, n):
    x = np.random.default_rng(5).uniform(-1, 1, (n, 64)).astype(np.float32)
    spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id bigint, embedding array<float>").withColumn("label", F.lit(0)).coalesce(2).write.parquet(f"{path}/embeddings.parquet")
    return np.floor((x.astype(np.float64) + 1) * 127.5).astype(np.int64)


def test_insert_split_search_of_many_leaves(spark, tmp_path, monkeypatch):
    """More leaves than any fixed beam holds: the answers are still those of an exact search."""
    monkeypatch.setattr(registry, "ATTRIBUTES", ix.Attributes(dimension=64, leaf_max=2, leaf_min=1, internal_max=64))
    x = embeddings(spark, tmp_path, 2600)
    found = {(r.qid, r["rank"]): r.vec_id for r in registry.queries()["insert_split_search"](spark, str(tmp_path)).collect()}
    d = ((x[::100, None] - x[None]) ** 2).sum(axis=2)
    assert found == {(100 * i, k + 1): int(j) for i, row in enumerate(d) for k, j in enumerate(np.argsort(row, kind="stable")[:10])}


def test_round_robin_search(spark, tmp_path):
    """Few leaves of many vectors, of which a query sees some: no more than k rows of a query and task are shuffled."""
    embeddings(spark, tmp_path, 1500)
    v = registry.vectors(spark, str(tmp_path))
    want = topk.top_k(ix.beam(registry.tree(v), registry.queries_of(v), 1, 2, 4, 10).withColumnRenamed("node", "vec_id"), 10)
    found = registry.queries()["ann_search_round_robin"](spark, str(tmp_path))
    assert lists(found) == lists(want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_recall_of_search(spark, tmp_path):
    """Both sides of recall_at_k without joins of queries and entries: what is joined are lists of k."""
    x = embeddings(spark, tmp_path, 700)
    got = registry.queries()["recall_at_k"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2 and len(x) == 700
    assert {r.qid for r in got.collect()} == set(range(0, 700, 100)) and got.where("recall < 0.5").count() == 0


def test_every_level_keeps_its_limit(spark):
    """Clusters far beyond their limit: as many levels as the limits ask for, the root included."""
    index = growth.split_overfull_clusters(ix.build(random_vectors(spark, 900), SMALL, 2))
    held = {(r.level, r.cluster_id): r.live for r in ix.cluster_sizes(index).where("live > 0").collect()}
    assert index.height == 5 and all(n <= (8 if level == 1 else 4) for (level, _), n in held.items())
    for level in range(2, 6):
        assert sum(n for (at, _), n in held.items() if at == level) == sum(at == level - 1 for at, _ in held)
