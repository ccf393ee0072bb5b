"""An index that grows: limits, answers after splits, upkeep, workload, settings."""

import pytest
from pyspark.sql import functions as F

from quiverlake.functions.metrics import comparator
from quiverlake.operators import growth, workload
from quiverlake.operators import index as ix
from quiverlake.sources.config import parse_settings
from quiverlake.sources.snapshot import latest, publish, versions

SMALL = ix.Attributes(dimension=4, leaf_max=8, leaf_min=2, internal_max=4, internal_min=1)


def ramp(spark, n=32):
    return spark.createDataFrame([(r, [4 * r + i for i in (1, 2, 3, 4)]) for r in range(n)], "id bigint, vec array<int>")


def sizes(index):
    return {(r.level, r.cluster_id): r.live for r in ix.cluster_sizes(index).collect() if r.live}


def test_inserts_that_split(spark):
    """32 rows in four batches into an empty index: answers equal an exact search, and every cluster keeps its limit."""
    index = ix.build(ramp(spark, 0), SMALL, 1)
    rows = ramp(spark)
    for i in range(4):
        index = growth.insert(index, rows.where(f"id % 4 = {i}"), 10)
    held = sizes(index)
    assert index.height > 2 and all(n <= (8 if level == 1 else 4) for (level, _), n in held.items())
    assert sum(n for (level, _), n in held.items() if level == 1) == 32 and len([c for level, c in held if level == index.height]) == 1
    q = spark.createDataFrame([(0, [5, 15, 6, 17])], "qid bigint, q array<int>")
    found = ix.ann_search(index, q, 6, 100, 100).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in found] == [(2, 91), (3, 147), (1, 163), (4, 331), (0, 363), (5, 643)]
    # Every cluster is some parent's entry, once.
    below = growth.parents(index).groupBy("level", "cluster_id").count().collect()
    assert {(r.level, r.cluster_id) for r in below} == {x for x in held if x[0] < index.height} and all(r["count"] == 1 for r in below)


def test_policy(spark):
    rows = [(0, 3, 3, 2), (1, 6, 2, 4), (2, 7, 7, 3), (3, 8, 8, 0), (4, 9, 9, 0), (5, 0, 0, 40)]
    got = growth.policy(spark.createDataFrame(rows, "cluster_id bigint, reserved bigint, live bigint, batch bigint"), 8, 2, 2).orderBy("cluster_id").collect()
    assert [(r.action, r.parts) for r in got] == [("append", 1), ("compact", 1), ("split", 2), ("none", 1), ("split", 2), ("split", 5)]
    part = spark.createDataFrame([(20, 8, 4), (20, 8, 2), (3, 8, 2)], "n int, least int, split int").select(ix.part_count(F.col("n"), F.col("least"), F.col("split"))).collect()
    assert [r[0] for r in part] == [3, 2, 2]


def test_migration(spark):
    a = ix.Attributes(dimension=1, leaf_max=4, leaf_min=1, internal_max=8, internal_min=1)
    v = spark.createDataFrame([(i, [x]) for i, x in enumerate([1, 50, 2, 51, 90, 52])], "id bigint, vec array<int>")
    index = ix.build(v, a, 2)  # leaf 0: 1, 2, 90; leaf 1: 50, 51, 52
    moves = spark.createDataFrame([(4, 0, 1)], "vec_id bigint, source bigint, target bigint")
    refused = growth.migrate(index, moves)  # 3 + 1 entries are no room below 4
    assert not growth.migration_verdicts(index, moves).first()["accepted"] and refused.members.where("state = 2").count() == 0
    index = ix.delete(index, spark.createDataFrame([(3,)], "vec_id bigint"))
    moved = growth.migrate(index, moves)  # now a compaction makes room, and the source's id is smaller
    assert [(r.cluster_id, r.state) for r in moved.members.where("child_id = 4 AND level = 1").orderBy("state").collect()] == [(1, 1), (0, 2)]
    q = spark.createDataFrame([(0, [90])], "qid bigint, q array<int>")
    assert [r.vec_id for r in ix.ann_search(moved, q, 10, 9, 9).orderBy("rank").collect()] == [4, 5, 1, 2, 0]  # once each
    with pytest.raises(ix.StaleIndex):
        growth.migrate(moved, moves, expected_version=index.version)
    assert growth.root_of(moved) == (2, 0, moved.version)


def test_upkeep_log(spark):
    index = ix.build(ramp(spark), SMALL, 6)
    log = growth.UpkeepLog()
    gone = index.members.where("level = 1 AND (cluster_id = 5 OR cluster_id = 1 AND entry_offset > 0)").select(F.col("child_id").alias("vec_id"))
    after = growth.maintain(ix.delete(index, gone), spark.createDataFrame([(0, 2)], "a bigint, b bigint"), log)
    done = {(r.action, r.level): (r.clusters, r.entries) for r in log.report(spark).collect()}
    assert done["merge", 1] == (1, 1) and done["prune", 2][0] == 2 and ("compact", 1) in done
    assert all(r.state == 1 for r in after.members.collect()) and ix.size(after).first()["n"] == 32 - gone.count()
    log.stop()
    log.add("merge", 1, 1, 1)
    assert len(log.rows) == len({*log.rows})
    log.clear()
    assert log.report(spark).count() == 0
    log.start()
    assert log.on


def test_clusterings(spark):
    v = ramp(spark, 40)
    with pytest.raises(ValueError):
        ix.clustering("k-means")
    near = {r.id: r.cluster_id for r in ix.assigned(v, 4, "nearest").collect()}
    assert near == {i: min(range(4), key=lambda p: (abs(i - 10 * p), p)) for i in range(40)}
    old, ix.PIVOTS = ix.PIVOTS, 2  # in two steps
    try:
        two = {r.id: r.cluster_id for r in ix.assigned(v, 4, "nearest").collect()}
    finally:
        ix.PIVOTS = old
    assert two.keys() == near.keys() and set(two.values()) == {0, 1, 2, 3}
    assert ix.assigned(v.where("id < 0"), 4, "nearest").count() == 0
    blocks, ix.FEW = ix.FEW, 7  # several blocks of queries
    try:
        q = v.select(F.col("id").alias("qid"), F.col("vec").alias("q"))
        got = {(r.qid, r["rank"]): r.vec_id for r in ix.exact_knn(v, q, 3).collect()}
    finally:
        ix.FEW = blocks
    assert got == {(i, k + 1): x for i in range(40) for k, x in enumerate(sorted(range(40), key=lambda j: (abs(i - j), j))[:3])}


def test_workload(spark):
    w = workload.Workload(ramp(spark), ramp(spark).where("id < 4").select(F.col("id").alias("qid"), F.col("vec").alias("q")), 3, 8, write_percent=60)
    index = w.run(ix.build(ramp(spark, 0), SMALL, 1), 16, 5, 30, 20)
    report = {(r.phase, r.operation): r for r in w.report().collect()}
    assert report["build", "insert"].n == 16 and report["warm-up", "search"].n == 5 and report["warm-up", "search"].errors == 0
    run = {k[1]: r for k, r in report.items() if k[0] == "run"}
    assert sum(r.n for r in run.values()) == 30 and run["search"].avg_distance is not None
    assert ix.size(index).first()["n"] == 16 + run["insert"].n - run["insert"].errors - run["delete"].n + run["delete"].errors


SETTINGS = {k: "1" for k in ("default-leaf-search-span", "default-internal-search-span", "default-k", "num-client-threads", "num-searcher-threads", "num-bg-migrator-threads", "num-bg-merger-threads", "num-bg-compactor-threads", "bench-batch-size", "build-size", "warmup-time", "run-time", "migration-check-trigger-rate", "migration-check-trigger-single-rate")} | {
    "clustering": "round_robin", "leaf-size": ["4", "32"], "internal-size": ["2", "8"], "leaf-split": "2", "internal-split": "2", "use-block-bytes": "false", "leaf-block-size": "64", "internal-block-size": "64",
    "random-rate-base": "80", "write-ratio": "10", "delete-ratio": "50", "collect-build-stats": "true", "collect-warmup-stats": "0", "collect-run-stats": "1", "collect-avg-distances": "false",
}


def test_settings():
    s = parse_settings(SETTINGS, 64)
    assert s["write-ratio"] == 10 and s["collect-build-stats"] and s.attributes.leaf_max == 32 and s["throughput-report-time"] == 0
    for key, value in [("leaf-size", ["4", "8"]), ("leaf-size", "4"), ("write-ratio", "101"), ("default-k", "0"), ("clustering", "k-means"), ("migration-check-trigger-rate", "81"), ("use-block-bytes", "maybe"), ("leaf-block-size", "63"), ("throughput-report-time", "5"), ("bench-batch-size", "0")]:
        with pytest.raises(ValueError, match=None if key in ("clustering", "throughput-report-time") else key):
            parse_settings(SETTINGS | {key: value}, 64)
    for key in SETTINGS:
        with pytest.raises(ValueError):
            parse_settings({k: v for k, v in SETTINGS.items() if k != key}, 64)


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        latest(spark, path)
    one = ix.build(ramp(spark), SMALL, 6)
    publish(one, path)
    two = ix.delete(one, spark.createDataFrame([(3,)], "vec_id bigint"))
    publish(two, path, expected=one.version)
    assert versions(spark, path) == [0, 1] and ix.size(latest(spark, path)).first()["n"] == 31
    for stale, expected in ((one, None), (ix.compact(two), one.version)):
        with pytest.raises(ix.StaleIndex):
            publish(stale, path, expected)
    with pytest.raises(ValueError):
        comparator("cosine")


def test_random_clusters(spark):
    index = ix.build(ramp(spark), SMALL, 6)
    some = [r.cluster_id for r in growth.random_clusters(index, 1, 3, 4, (2,)).collect()]
    assert len(some) == 4 and 2 not in some and some == [r.cluster_id for r in growth.random_clusters(index, 1, 3, 4, (2,)).collect()]
