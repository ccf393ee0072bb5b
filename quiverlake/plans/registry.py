"""Queries over the driver's tables, and the same in SQL.

Vectors are ``embeddings`` with components as integers 0 to 255: distances are exact whatever the order of summing.
Queries are the vectors with ``vec_id % 100 = 0``; deleted ones are where ``vec_id % 7 = 3``; those that arrive late where ``vec_id % 5 = 4``. Two trees are built, once for each
table, and kept as snapshots in the shared folder: one with LEAVES leaves and INNER nodes above, round robin by id; and one
whose clusters hold vectors nearest to a pivot, with FILL vectors in a leaf on average. The latter is for searches: it looks
into SHARE of the leaves, as these vectors have hardly any structure and fewer leaves find fewer than nine of ten neighbours.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import centroids, more_similar, quantised, squared_l2, squared_l2_int
from ..operators import growth, topk, workload
from ..operators import index as ix
from ..sources.scratch import new_path
from ..sources.snapshot import load, save
from ..sources.vector_file import read_vectors, synthetic_vectors, write_vectors
from ..streaming import mutations

K, LEAVES, INNER = 10, 32, 4
FILL, SHARE = 16, 0.6
ATTRIBUTES = ix.Attributes(dimension=64, leaf_max=32, leaf_min=4, internal_max=8)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), quantised("embedding").alias("vec"), "label")


def queries_of(v: DataFrame) -> DataFrame:
    return v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))


#: Snapshots of this process by application, table and kind of tree.
_snapshots: dict[tuple, str] = {}


def kept(v: DataFrame, kind: str, make: Callable[[], ix.Index]) -> ix.Index:
    """The index that ``make`` gives for these vectors: built and saved when it is first asked for, then read."""
    spark = v.sparkSession
    key = (spark.sparkContext.applicationId, tuple(sorted(v.inputFiles())), kind)
    if key not in _snapshots:
        path = new_path(spark, f"index-{kind}")
        save(make(), path)
        _snapshots[key] = path
    return load(spark, _snapshots[key])


def tree(v: DataFrame) -> ix.Index:
    return kept(v, "round-robin", lambda: ix.build(v, ATTRIBUTES, LEAVES))


def near_tree(v: DataFrame) -> ix.Index:
    return kept(v, "nearest", lambda: ix.build(v, ATTRIBUTES, max(1, -(-v.count() // FILL)), "nearest"))


def near_search(v: DataFrame, order: str = "decreasing_similarity") -> DataFrame:
    """Search of the nearest-pivot tree: every inner node, SHARE of the leaves."""
    index = near_tree(v)
    leaves = index.members.where("level = 2").count() if index.height > 1 else 1
    return ix.ann_search(index, queries_of(v), K, leaves, max(1, int(np.ceil(SHARE * leaves))), order)


def with_deleted(i: ix.Index, v: DataFrame) -> ix.Index:
    return ix.delete(i, v.where("id % 7 = 3").select(F.col("id").alias("vec_id")))


def leaf_pairs(v: DataFrame) -> DataFrame:
    spark = v.sparkSession
    return spark.range(LEAVES - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))


def thinned(v: DataFrame) -> ix.Index:
    """The tree after deleting nearly all of every eighth leaf's vectors, and all of leaf 5's."""
    gone = ix.ranked(v.select("id", "vec")).where(f"(place % {LEAVES} % 8 = 1 AND place >= {2 * LEAVES}) OR place % {LEAVES} = 5").select(F.col("id").alias("vec_id"))
    return ix.delete(tree(v), gone)


def _q(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(vectors(spark, sf_dir))


def _partial_lists(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    lists = []
    for low, high in ((0, 300), (200, 10**12)):
        part = v.where((F.col("id") >= low) & (F.col("id") < high))
        lists.append(ix.exact_knn(part, queries_of(v), K))
    return lists[0], lists[1]


def file_round_trip(v: DataFrame) -> DataFrame:
    """Vectors written as one binary file in the shared folder and read again; ids are then places."""
    spark = v.sparkSession
    path = f"{new_path(spark, 'vectors')}.u8bin"
    write_vectors(v.select("id", "vec"), path, "u8")
    total = F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return read_vectors(spark, path, "u8").select("id", total.alias("total"), F.element_at("vec", 1).alias("head"))


def old_tree(v: DataFrame, leaves: int = LEAVES) -> ix.Index:
    """Of the vectors that are there before the others arrive."""
    return kept(v, f"old-{leaves}", lambda: ix.build(v.where("id % 5 <> 4"), ATTRIBUTES, leaves))


def grown(v: DataFrame) -> ix.Index:
    """The later vectors inserted into full leaves: some split."""
    return growth.insert(old_tree(v, 14), v.where("id % 5 = 4"), 2)


def whole_search(i: ix.Index, v: DataFrame) -> DataFrame:
    """Search with a beam that holds every cluster, however many there are."""
    span = i.members.where("level > 1 AND state = 1").groupBy("level").count().agg(F.max("count")).first()[0] or 1
    return ix.ann_search(i, queries_of(v), K, span, span)


def split_all(v: DataFrame) -> ix.Index:
    """A tree of eight leaves far beyond their limit, brought within it."""
    return growth.split_overfull_clusters(kept(v, "overfull", lambda: ix.build(v, ATTRIBUTES, 8)))


def upkeep(v: DataFrame) -> tuple[ix.Index, DataFrame]:
    log = growth.UpkeepLog()
    return growth.maintain(thinned(v), None, log), log.report(v.sparkSession)


def worked(v: DataFrame) -> DataFrame:
    """A build of 400 vectors, 20 searches, and 100 operations of the mix over an index that starts empty."""
    w = workload.Workload(v.select("id", "vec"), queries_of(v), K, 8, write_percent=40)
    w.run(ix.build(v.where("id < 0"), ATTRIBUTES, 1), 400, 20, 100, 400)
    return w.report().select("phase", "operation", "n", "errors")


def mutated(v: DataFrame) -> DataFrame:
    """Live vectors after one batch of a mutation stream: later ids arrive, some earlier ones go; the last operation counts."""
    old, new = v.where("id % 5 <> 4"), v.where("id % 5 = 4").select("id", "vec")
    gone = old.where("id % 7 = 3").select(F.lit(2).cast("bigint").alias("seq"), F.lit("delete").alias("op"), F.col("id").alias("vec_id"), "vec")
    first = new.unionByName(old.where("id % 7 = 3").select("id", "vec")).select(F.lit(1).cast("bigint").alias("seq"), F.lit("insert").alias("op"), F.col("id").alias("vec_id"), "vec")
    return mutations.apply(old_tree(v), first.unionByName(gone), 2).members.where("level = 1 AND state = 1").select(F.col("child_id").alias("vec_id"), F.aggregate("vec", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    live = lambda v: with_deleted(tree(v), v)
    return {
        "exact_knn": _q(lambda v: ix.exact_knn(v, queries_of(v), K)),
        "ann_search": _q(near_search),
        "ann_search_round_robin": _q(lambda v: ix.ann_search(tree(v), queries_of(v), K, 2, 4)),
        "ann_search_past_empty": _q(lambda v: ix.ann_search(thinned(v), queries_of(v), K, 2, 4, past_empty=True)),
        "ann_search_full_beam": _q(lambda v: ix.ann_search(tree(v), queries_of(v), K, INNER, LEAVES)),
        "ann_increasing_similarity": _q(lambda v: near_search(v, "increasing_similarity")),
        "l2_distance_pairs": lambda spark, d: _float_pairs(spark, d),
        "more_similar": _q(lambda v: v.crossJoin(v.where("id = 0").select(F.col("vec").alias("a"))).crossJoin(v.where("id = 1").select(F.col("vec").alias("b"))).select("id", more_similar(squared_l2_int("vec", "a"), squared_l2_int("vec", "b")).alias("closer_to_0"))),
        "centroid_all": _q(lambda v: centroids(v, []).select(F.posexplode("vec").alias("i", "m"))),
        "centroid_valid_only": _q(lambda v: centroids(v.where("id % 7 <> 3"), []).select(F.posexplode("vec").alias("i", "m"))),
        "centroid_per_cluster": _q(lambda v: centroids(v, ["label"]).select("label", "n", F.posexplode("vec").alias("i", "m"))),
        "centroid_with_extra": _q(lambda v: ix.cluster_centroids(ix.delete(t := tree(v), v.where("id % 32 = 5 OR id % 7 = 3").select(F.col("id").alias("vec_id"))), 1, v.where("id % 50 = 0").select((F.col("id") % LEAVES).alias("cluster_id"), "vec")).select("cluster_id", "n", F.posexplode_outer("vec").alias("i", "m"))),
        "topk_merge_dedup": _q(lambda v: topk.merge(*_partial_lists(v), K).select("qid", F.col("rank").cast("int").alias("rank"), "vec_id", "distance")),
        "leaf_scan_topk": _q(lambda v: ix.exact_knn(ix.assigned(v, LEAVES).where("cluster_id = 3 AND id % 7 <> 3"), queries_of(v), K)),
        "internal_scan_latest_version": _q(lambda v: ix.latest_versions(v.select((F.col("id") % 50).alias("child_id"), F.expr("cast(id div 50 as int)").alias("version"), F.when(F.col("id") % 7 == 3, 0).when(F.col("id") % 5 == 1, 3).otherwise(1).alias("state"), "vec")).select("child_id", "version", "state")),
        "insert_target_leaf": _q(lambda v: ix.insert_targets(old_tree(v), v.where("id % 5 = 4"), 2)),
        "insert_batch": _q(lambda v: ix.append(old_tree(v), v.where("id % 5 = 4"), 2).members.where("level = 1").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("entry_offset").alias("last"), F.sum("child_id").alias("ids"))),
        "delete_batch": _q(lambda v: live(v).members.where("level = 1 AND state = 1").select(F.col("child_id").alias("vec_id"), F.col("cluster_id").alias("leaf_id"))),
        "delete_not_found": _q(lambda v: ix.not_found(live(v), v.select((F.col("id") * 2).alias("vec_id")))),
        "compact_cluster": _q(lambda v: ix.compact(live(v)).members.where("level = 1").select("cluster_id", "entry_offset", F.col("child_id").alias("vec_id"))),
        "compaction_candidates": _q(lambda v: ix.compaction_candidates(live(v)).where("level = 1").select("cluster_id", "dead")),
        "insert_policy": _q(lambda v: ix.insert_policy(live(v), v.sparkSession.range(LEAVES).select(F.col("id").alias("cluster_id"), F.col("id").alias("batch")))),
        "round_robin_split": _q(lambda v: ix.assigned(v, LEAVES).select(F.col("id").alias("vec_id"), "cluster_id")),
        "split_part_count": lambda spark, d: spark.range(1, 101).crossJoin(spark.range(2, 6).withColumnRenamed("id", "split")).select("id", "split", ix.part_count(F.col("id"), 8, F.col("split")).alias("parts")),
        "nearest_clustering": _q(lambda v: near_tree(v).members.where("level = 1").select(F.col("child_id").alias("vec_id"), "cluster_id")),
        "split_apply": _q(lambda v: split_all(v).members.where("level = 1 AND state = 1").select(F.col("child_id").alias("vec_id"), "cluster_id", "entry_offset")),
        "split_apply_levels": _q(lambda v: split_all(v).members.where("state = 1").groupBy("level").agg(F.countDistinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("entries"))),
        "insert_split": _q(lambda v: grown(v).members.where("level = 1 AND state = 1").select(F.col("child_id").alias("vec_id"), "cluster_id", "entry_offset")),
        "insert_split_search": _q(lambda v: whole_search(grown(v), v)),
        "maintain_pass": _q(lambda v: upkeep(v)[0].members.where("level = 1").select(F.col("child_id").alias("vec_id"), "cluster_id", "entry_offset")),
        "maintain_log": _q(lambda v: upkeep(v)[1]),
        "migration_limits": _q(lambda v: growth.migration_verdicts(t := with_deleted(tree(v), v), ix.migration_candidates(t, leaf_pairs(v)))),
        "migrate_states": _q(lambda v: growth.migrate(t := with_deleted(tree(v), v), ix.migration_candidates(t, leaf_pairs(v))).members.where("level = 1").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("child_id").alias("ids"))),
        "migration_tasks": _q(lambda v: ix.migration_tasks(v.select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b")))),
        "parent_entries": _q(lambda v: growth.parents(tree(v))),
        "allocate_vector_ids": _q(lambda v: growth.next_ids(v.where("id % 3 = 0").select("id"), v.select("id"), "id")),
        "random_clusters": _q(lambda v: growth.random_clusters(tree(v), 1, 7, 5, (0, 3))),
        "workload_run": _q(worked),
        "split_overfull": _q(lambda v: ix.split_overfull(ix.build(v, ATTRIBUTES, 8)).select(F.col("child_id").alias("vec_id"), "cluster_id", "part", "parts")),
        "expand_tree_levels": _q(lambda v: tree(v).members.groupBy("level").agg(F.countDistinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("entries"))),
        "migration_candidates": _q(lambda v: ix.migration_candidates(tree(v), leaf_pairs(v))),
        "migrate_apply": _q(lambda v: ix.migrate(t := tree(v), ix.migration_candidates(t, leaf_pairs(v))).members.where("level = 1").select(F.col("child_id").alias("vec_id"), "cluster_id")),
        "merge_target": _q(lambda v: ix.merge_targets(thinned(v))),
        "merge_apply": _q(lambda v: ix.merge_small(thinned(v)).members.where("level = 1 AND state = 1").select(F.col("child_id").alias("vec_id"), "cluster_id")),
        "prune_empty": _q(lambda v: ix.prune(thinned(v)).members.where("level = 2").select(F.col("child_id").alias("leaf_id"))),
        "prune_single_child_root": _q(lambda v: ix.prune_root(ix.prune(ix.delete(t := tree(v), t.members.where(f"level = 1 AND cluster_id % {INNER} <> 1").select(F.col("child_id").alias("vec_id"))))).members.groupBy("level").agg(F.countDistinct("cluster_id").alias("clusters"))),
        "prune_decision": _q(lambda v: ix.prune_decisions(thinned(v))),
        "co_visited_pairs": _q(lambda v: ix.co_visited(tree(v), queries_of(v), 2, 4)),
        "index_size": _q(lambda v: ix.size(live(v))),
        "tree_height": _q(lambda v: tree(v).members.agg((F.max("level") + 1).cast("int").alias("height"))),
        "vector_location": _q(lambda v: ix.locations(live(v), v.where("id % 10 = 0").select(F.col("id").alias("vec_id")))),
        "cluster_stats": _q(lambda v: ix.cluster_sizes(live(v)).where("level = 1").select("cluster_id", "reserved", "live", "dead", F.expr("100 * dead div reserved").alias("dead_percent"))),
        "maintenance_stats": _q(lambda v: ix.prune_decisions(thinned(v)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))),
        "avg_search_distance": _q(lambda v: workload.average_distance(ix.exact_knn(v, queries_of(v), K)).select(F.round("avg_distance", 6).alias("avg_distance"), "n")),
        "workload_mix": lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select(workload.operation(F.col("event_id") * 37 % 100, F.col("event_id") * 53 % 100, 10, 50).alias("operation")).groupBy("operation").agg(F.count(F.lit(1)).alias("n")),
        "recall_at_k": _q(lambda v: ix.recall(near_search(v), ix.exact_knn(v, queries_of(v), K), K)),
        "vec_file_roundtrip": lambda spark, d: file_round_trip(vectors(spark, d)),
        "mutation_batch": lambda spark, d: mutated(vectors(spark, d)),
        "synthetic_vectors": lambda spark, d: synthetic_vectors(spark, 1000, 8, alpha=2.0),
    }


def _float_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    a, b = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", squared_l2("x", "y").alias("distance"))


_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INT) AS vec, label FROM embeddings)"
_D = "list_sum(list_transform(list_zip({0}, {1}), lambda x: (x[1]::BIGINT - x[2]::BIGINT) * (x[1]::BIGINT - x[2]::BIGINT)))::BIGINT"


def _tree(source: str = "v", leaves: int = LEAVES) -> str:
    mean = lambda rows, by: f"(SELECT {by}, list(m ORDER BY i) AS vec FROM (SELECT {by}, i, sum(x) // count(*) AS m FROM (SELECT {by}, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {rows}) GROUP BY {by}, i) GROUP BY {by})"
    parts, level, out, rows = leaves, 1, [], f"(SELECT id, vec FROM {source})"
    names = []
    while True:
        out.append(f"l{level} AS (SELECT id AS child_id, vec, ((row_number() OVER (ORDER BY id) - 1) % {parts})::BIGINT AS cluster_id FROM {rows})")
        names.append(f"l{level}")
        if parts == 1:
            return ", ".join(out)
        rows = f"(SELECT cluster_id AS id, vec FROM {mean(f'l{level}', 'cluster_id')})"
        parts, level = -(-parts // ATTRIBUTES.internal_max), level + 1


def _near_tree() -> str:
    """Levels of the nearest-pivot tree of up to FILL * 64 vectors: pivots are every FILL-th, then every eighth row."""
    mean = "(SELECT cluster_id AS id, list(m ORDER BY i) AS vec FROM (SELECT cluster_id, i, sum(x) // count(*) AS m FROM (SELECT cluster_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {0}) GROUP BY cluster_id, i) GROUP BY cluster_id)"
    near = lambda name, rows, step: f"{name}_p AS (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS place FROM {rows}), {name} AS (SELECT id AS child_id, vec, centre AS cluster_id FROM (SELECT a.id, a.vec, b.place // {step} AS centre, row_number() OVER (PARTITION BY a.id ORDER BY {_D.format('a.vec', 'b.vec')}, b.place) AS r FROM {name}_p a JOIN {name}_p b ON b.place % {step} = 0) WHERE r = 1)"
    return f"{near('l1', 'v', FILL)}, {near('l2', mean.format('l1'), ATTRIBUTES.internal_max)}, l3 AS (SELECT id AS child_id, vec, 0::BIGINT AS cluster_id FROM {mean.format('l2')})"


def _beam(width_3: int | str, width_2: int | str, queries: str = "SELECT id AS qid, vec AS q FROM v WHERE id % 100 = 0") -> str:
    step = lambda front, level, width: f"(SELECT qid, q, node FROM (SELECT f.qid, f.q, l.child_id AS node, row_number() OVER (PARTITION BY f.qid ORDER BY {_D.format('l.vec', 'f.q')}, l.child_id) AS r FROM {front} f JOIN l{level} l ON l.cluster_id = f.node) WHERE r <= {width})"
    return f"f3 AS {step(f'(SELECT qid, q, 0 AS node FROM ({queries}))', 3, width_3)}, f2 AS {step('f3', 2, width_2)}"


_FOUND = f"found AS (SELECT * FROM (SELECT f.qid, (row_number() OVER (PARTITION BY f.qid ORDER BY {_D.format('l.vec', 'f.q')}, l.child_id))::INT AS rank, l.child_id AS vec_id, {_D.format('l.vec', 'f.q')} AS distance FROM f2 f JOIN l1 l ON l.cluster_id = f.node) WHERE rank <= {K})"


def _exact(rows: str, name: str = "exact") -> str:
    return f"{name} AS (SELECT * FROM (SELECT q.id AS qid, (row_number() OVER (PARTITION BY q.id ORDER BY {_D.format('d.vec', 'q.vec')}, d.id))::INT AS rank, d.id AS vec_id, {_D.format('d.vec', 'q.vec')} AS distance FROM {rows} d, v q WHERE q.id % 100 = 0) WHERE rank <= {K})"


def oracle_sql() -> dict[str, str]:
    with_tree = f"WITH {_V}, {_tree()}"
    ann = f"WITH {_V}, {_near_tree()}, {_beam('(SELECT count(*) FROM l2)', f'(SELECT ceil({SHARE} * count(*)) FROM l2)')}, {_FOUND}"
    leaf = f"placed AS (SELECT id, vec, place, (place % {LEAVES})::BIGINT AS cluster_id, (place // {LEAVES})::INT AS entry_offset FROM (SELECT id, vec, row_number() OVER (ORDER BY id) - 1 AS place FROM v))"
    gone = f"(place % {LEAVES} % 8 = 1 AND place >= {2 * LEAVES}) OR place % {LEAVES} = 5"
    thin = f"thin AS (SELECT cluster_id, count(*) AS reserved, count(*) FILTER (NOT ({gone})) AS live FROM placed GROUP BY cluster_id)"
    decision = "decided AS (SELECT cluster_id, CASE WHEN live = 0 THEN 'prune' WHEN live < 4 THEN 'merge' WHEN live < reserved THEN 'compact' ELSE 'keep' END AS action FROM thin)"
    mean = "(SELECT {by} list(m ORDER BY i) AS vec FROM (SELECT {by} i, sum(x) // count(*) AS m FROM (SELECT {by} unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM {rows}) GROUP BY {by} i) {group})"
    moves = f"moves AS (SELECT child_id, source, target FROM (SELECT e.child_id, e.cluster_id AS source, o.child_id AS target, row_number() OVER (PARTITION BY e.child_id ORDER BY {_D.format('e.vec', 'o.vec')}, o.child_id) AS r FROM l1 e JOIN l2 c ON c.child_id = e.cluster_id JOIN l2 o ON abs(o.child_id - e.cluster_id) = 1 WHERE {_D.format('e.vec', 'o.vec')} < {_D.format('e.vec', 'c.vec')}) WHERE r = 1)"
    small = f"small AS {mean.format(by='cluster_id,', rows=f'(SELECT p.cluster_id, p.vec FROM placed p JOIN decided d USING (cluster_id) WHERE d.action = $$merge$$ AND NOT ({gone}))', group='GROUP BY cluster_id')}, merges AS (SELECT cluster_id, target FROM (SELECT s.cluster_id, o.child_id AS target, row_number() OVER (PARTITION BY s.cluster_id ORDER BY {_D.format('s.vec', 'o.vec')}, o.child_id) AS r FROM small s JOIN l2 m ON m.child_id = s.cluster_id JOIN l2 o ON o.cluster_id = m.cluster_id AND o.child_id <> s.cluster_id) WHERE r = 1)"
    thinned_ = f"{with_tree}, {leaf}, {thin}, {decision}"
    old = f"WITH {_V}, w AS (SELECT * FROM v WHERE id % 5 <> 4), {_tree('w')}, {_beam(2, 1, 'SELECT id AS qid, vec AS q FROM v WHERE id % 5 = 4')}"
    split = f"WITH {_V}, e AS (SELECT id, place % 8 AS cluster_id, place // 8 AS o FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM v)), sized AS (SELECT cluster_id, CASE WHEN count(*) > 32 THEN greatest(2, CASE WHEN count(*) // 2 < 4 THEN ceil(count(*) / 4) ELSE 2 END, ceil(count(*) / 32)) ELSE 1 END::BIGINT AS parts FROM e GROUP BY cluster_id), counted AS (SELECT *, coalesce(sum(parts - 1) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized), cut AS (SELECT id, cluster_id, o, parts, before, o % parts AS part FROM e JOIN counted USING (cluster_id))"
    grow = f"WITH {_V}, w AS (SELECT * FROM v WHERE id % 5 <> 4), {_tree('w', 14)}, {_beam(2, 1, 'SELECT id AS qid, vec AS q FROM v WHERE id % 5 = 4')}, entries AS (SELECT child_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY late, child_id) - 1 AS place FROM (SELECT child_id, cluster_id, 0 AS late FROM l1 UNION ALL SELECT qid, node, 1 FROM f2)), n AS (SELECT cluster_id, count(*) AS n FROM entries GROUP BY cluster_id), acted AS (SELECT *, CASE WHEN action = 'split' THEN greatest(2, CASE WHEN n // 2 < 4 THEN ceil(n / 4) ELSE 2 END, ceil(n / 32)) ELSE 1 END::BIGINT AS parts FROM (SELECT n.*, CASE WHEN n < 32 OR cluster_id NOT IN (SELECT node FROM f2) THEN 'append' ELSE 'split' END AS action FROM n)), acted_ AS (SELECT 1)"
    grow = grow.replace("acted AS (SELECT *, CASE", "acted0 AS (SELECT *, CASE").replace("acted_ AS (SELECT 1)", "acted AS (SELECT *, coalesce(sum(parts - 1) OVER (ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM acted0)")
    steps = "steps AS (SELECT * FROM merges WHERE target NOT IN (SELECT cluster_id FROM merges))"
    limits = f"{with_tree}, {leaf}, moves AS (SELECT child_id, source, target FROM (SELECT e.child_id, e.cluster_id AS source, o.child_id AS target, row_number() OVER (PARTITION BY e.child_id ORDER BY {_D.format('e.vec', 'o.vec')}, o.child_id) AS r FROM l1 e JOIN l2 c ON c.child_id = e.cluster_id JOIN l2 o ON abs(o.child_id - e.cluster_id) = 1 WHERE e.child_id % 7 <> 3 AND {_D.format('e.vec', 'o.vec')} < {_D.format('e.vec', 'c.vec')}) WHERE r = 1), s AS (SELECT cluster_id AS target, count(*) AS reserved, count(*) FILTER (id % 7 <> 3) AS live FROM placed GROUP BY cluster_id), t AS (SELECT target, count(*) AS batch, max(source) AS last_source FROM moves GROUP BY target), m2 AS (SELECT m.*, reserved + batch < 32 OR (last_source < s.target AND reserved > live AND (live + batch) * 1.15 <= 32) AS accepted FROM moves m JOIN s USING (target) JOIN t USING (target))"
    past_empty = f"{thinned_}, l2_ AS (SELECT * FROM l2 WHERE child_id IN (SELECT cluster_id FROM thin WHERE live > 0)), l1_ AS (SELECT l1.* FROM l1 JOIN placed p ON p.id = l1.child_id WHERE NOT ({gone})), {_beam(2, 4).replace('JOIN l2 l', 'JOIN l2_ l')}, {_FOUND.replace('JOIN l1 l', 'JOIN l1_ l')} SELECT * FROM found"
    hexed = lambda n, seed: f"(('0x' || substr(md5({n} || ':{seed}'), 1, 12))::BIGINT % 100)"
    kind = f"CASE WHEN {hexed('range', 1)} >= 40 THEN 'search' WHEN {hexed('range', 2)} < 50 THEN 'delete' ELSE 'insert' END"
    ops = f"WITH o AS (SELECT 'build' AS phase, 'insert' AS operation FROM range(0, 400) UNION ALL SELECT 'warm-up', 'search' FROM range(400, 420) UNION ALL SELECT 'run', {kind} FROM range(420, 520)) SELECT phase, operation, count(*) AS n, 0::BIGINT AS errors FROM o GROUP BY ALL"
    means = "SELECT {by} i::INT AS i, (sum(x) // count(*))::INT AS m {n} FROM (SELECT {by} unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v {where}) GROUP BY {by} i"
    return {
        "exact_knn": f"WITH {_V}, {_exact('v')} SELECT * FROM exact",
        "vec_file_roundtrip": f"WITH {_V} SELECT row_number() OVER (ORDER BY id) - 1 AS id, list_sum(vec)::BIGINT AS total, vec[1]::INT AS head FROM v",
        "mutation_batch": f"WITH {_V} SELECT id AS vec_id, list_sum(vec)::BIGINT AS total FROM v WHERE id % 5 = 4 OR id % 7 <> 3",
        "ann_search": f"{ann} SELECT * FROM found",
        "ann_search_round_robin": f"{with_tree}, {_beam(2, 4)}, {_FOUND} SELECT * FROM found",
        "ann_search_past_empty": past_empty,
        "ann_search_full_beam": f"WITH {_V}, {_exact('v')} SELECT * FROM exact",
        "ann_increasing_similarity": f"{ann} SELECT qid, (count(*) OVER (PARTITION BY qid) - rank + 1)::INT AS rank, vec_id, distance FROM found",
        "l2_distance_pairs": "SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "more_similar": f"WITH {_V} SELECT v.id, sign({_D.format('v.vec', 'b.vec')} - {_D.format('v.vec', 'a.vec')})::INT AS closer_to_0 FROM v, v a, v b WHERE a.id = 0 AND b.id = 1",
        "centroid_all": f"WITH {_V} " + means.format(by="", n="", where=""),
        "centroid_valid_only": f"WITH {_V} " + means.format(by="", n="", where="WHERE id % 7 <> 3"),
        "centroid_per_cluster": f"WITH {_V} " + means.format(by="label,", n=", count(*) AS n", where=""),
        "centroid_with_extra": f"WITH {_V}, {leaf}, r AS (SELECT cluster_id, vec FROM placed WHERE NOT (id % 32 = 5 OR id % 7 = 3) UNION ALL SELECT id % {LEAVES}, vec FROM v WHERE id % 50 = 0), m AS (SELECT cluster_id, i::INT AS i, (sum(x) // count(*))::INT AS m, count(*) AS n FROM (SELECT cluster_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM r) GROUP BY cluster_id, i) SELECT c.cluster_id, coalesce(n, 0) AS n, i, m FROM (SELECT DISTINCT cluster_id FROM placed) c LEFT JOIN m USING (cluster_id)",
        "topk_merge_dedup": f"WITH {_V}, {_exact('v')} SELECT * FROM exact",
        "leaf_scan_topk": f"WITH {_V}, {leaf}, {_exact('(SELECT * FROM placed WHERE cluster_id = 3 AND id % 7 <> 3)')} SELECT * FROM exact",
        "internal_scan_latest_version": f"WITH {_V}, e AS (SELECT id % 50 AS child_id, (id // 50)::INT AS version, (CASE WHEN id % 7 = 3 THEN 0 WHEN id % 5 = 1 THEN 3 ELSE 1 END)::INT AS state FROM v) SELECT child_id, max(version) AS version, arg_max(state, version) AS state FROM e WHERE state <> 0 GROUP BY child_id",
        "insert_target_leaf": f"{old} SELECT qid AS vec_id, node AS leaf_id FROM f2",
        "insert_batch": f"{old} SELECT cluster_id, count(*) AS n, (count(*) - 1)::INT AS last, sum(id)::BIGINT AS ids FROM (SELECT cluster_id, child_id AS id FROM l1 UNION ALL SELECT node, qid FROM f2) GROUP BY cluster_id",
        "delete_batch": f"WITH {_V}, {leaf} SELECT id AS vec_id, cluster_id AS leaf_id FROM placed WHERE id % 7 <> 3",
        "delete_not_found": f"WITH {_V} SELECT id * 2 AS vec_id FROM v WHERE id * 2 NOT IN (SELECT id FROM v WHERE id % 7 <> 3)",
        "compact_cluster": f"WITH {_V}, {leaf} SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY entry_offset) - 1)::INT AS entry_offset, id AS vec_id FROM placed WHERE id % 7 <> 3",
        "compaction_candidates": f"WITH {_V}, {leaf} SELECT cluster_id, count(*) AS dead FROM placed WHERE id % 7 = 3 GROUP BY cluster_id",
        "insert_policy": f"WITH {_V}, {leaf} SELECT cluster_id, CASE WHEN count(*) + cluster_id < 32 THEN 'append' WHEN count(*) FILTER (id % 7 = 3) > 0 AND (count(*) FILTER (id % 7 <> 3) + cluster_id) * 1.15 <= 32 THEN 'compact' ELSE 'split' END AS action FROM placed GROUP BY cluster_id",
        "round_robin_split": f"WITH {_V}, {leaf} SELECT id AS vec_id, cluster_id FROM placed",
        "split_part_count": "SELECT r.range AS id, s.range AS split, greatest(2, CASE WHEN r.range // s.range < 8 THEN ceil(r.range / 8) ELSE s.range END)::INT AS parts FROM range(1, 101) r, range(2, 6) s",
        "nearest_clustering": f"WITH {_V}, {_near_tree()} SELECT child_id AS vec_id, cluster_id::BIGINT AS cluster_id FROM l1",
        "split_apply": f"{split} SELECT id AS vec_id, (CASE WHEN part = 0 THEN cluster_id ELSE 8 + before + part - 1 END)::BIGINT AS cluster_id, (o // parts)::INT AS entry_offset FROM cut",
        "split_apply_levels": f"{split}, c AS (SELECT count(*) AS n, sum(parts) AS leaves FROM sized), r AS (SELECT leaves, greatest(2, CASE WHEN leaves // 2 < 2 THEN ceil(leaves / 2) ELSE 2 END, ceil(leaves / 8))::BIGINT AS inner_ FROM c) SELECT 1::INT AS level, (SELECT leaves FROM c)::BIGINT AS clusters, (SELECT count(*) FROM v) AS entries UNION ALL SELECT 2::INT, inner_, leaves::BIGINT FROM r UNION ALL SELECT 3::INT, 1, inner_ FROM r",
        "insert_split": f"{grow} SELECT child_id AS vec_id, (CASE WHEN action = 'split' AND place % parts > 0 THEN 14 + before + place % parts - 1 ELSE cluster_id END)::BIGINT AS cluster_id, (CASE WHEN action = 'split' THEN place // parts ELSE place END)::INT AS entry_offset FROM entries JOIN acted USING (cluster_id)",
        "insert_split_search": f"WITH {_V}, {_exact('v')} SELECT * FROM exact",
        "maintain_pass": f"{thinned_}, {small}, {steps}, moved AS (SELECT p.id, coalesce(s.target, p.cluster_id) AS cluster_id, s.target IS NOT NULL AS late, p.entry_offset FROM placed p LEFT JOIN steps s USING (cluster_id) WHERE NOT ({gone})) SELECT id AS vec_id, cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY late, CASE WHEN late THEN id END, entry_offset) - 1)::INT AS entry_offset FROM moved",
        "maintain_log": f"{thinned_}, {small}, {steps}, left_ AS (SELECT p.cluster_id, count(*) FILTER (NOT ({gone})) AS live, count(*) FILTER ({gone}) AS dead FROM placed p GROUP BY p.cluster_id) SELECT 'merge' AS action, 1::INT AS level, 1::BIGINT AS runs, count(*)::BIGINT AS clusters, sum(live)::BIGINT AS entries FROM left_ JOIN steps USING (cluster_id) UNION ALL SELECT 'compact', 1, 1, count(*), sum(dead) FROM left_ WHERE dead > 0 UNION ALL SELECT 'prune', 2, 1, count(*), count(*) FROM left_ WHERE live = 0 OR cluster_id IN (SELECT cluster_id FROM steps)",
        "migration_limits": f"{limits} SELECT child_id AS vec_id, source, target, accepted FROM m2",
        "migrate_states": f"{limits} SELECT state, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT p.id, (CASE WHEN p.id % 7 = 3 THEN 0 WHEN m2.accepted THEN 2 ELSE 1 END)::INT AS state FROM placed p LEFT JOIN m2 ON m2.child_id = p.id UNION ALL SELECT child_id, 1 FROM m2 WHERE accepted) GROUP BY state",
        "migration_tasks": f"WITH {_V} SELECT DISTINCT least(id % 7, id % 5) AS a, greatest(id % 7, id % 5) AS b FROM v WHERE id % 7 <> id % 5",
        "parent_entries": f"{with_tree} SELECT 1::INT AS level, child_id AS cluster_id, cluster_id AS parent, (row_number() OVER (PARTITION BY cluster_id ORDER BY child_id) - 1)::INT AS entry_offset FROM l2 UNION ALL SELECT 2::INT, child_id, cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY child_id) - 1)::INT FROM l3",
        "allocate_vector_ids": f"WITH {_V} SELECT id, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY id) AS vec_id FROM v WHERE id % 3 = 0",
        "random_clusters": f"WITH {_V}, {leaf} SELECT cluster_id FROM (SELECT DISTINCT cluster_id FROM placed WHERE cluster_id NOT IN (0, 3)) ORDER BY md5(cluster_id || ':7'), cluster_id LIMIT 5",
        "workload_run": ops,
        "split_overfull": f"WITH {_V}, e AS (SELECT id, place % 8 AS cluster_id, place // 8 AS o FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM v)), n AS (SELECT cluster_id, count(*) AS n FROM e GROUP BY cluster_id HAVING count(*) > 31) SELECT id AS vec_id, cluster_id::BIGINT AS cluster_id, (o % 2)::INT AS part, 2::INT AS parts FROM e JOIN n USING (cluster_id)",
        "expand_tree_levels": f"{with_tree} " + " UNION ALL ".join(f"SELECT {n}::INT AS level, count(DISTINCT cluster_id) AS clusters, count(*) AS entries FROM l{n}" for n in (1, 2, 3)),
        "migration_candidates": f"{with_tree}, {moves} SELECT child_id AS vec_id, source, target FROM moves",
        "migrate_apply": f"{with_tree}, {moves} SELECT l1.child_id AS vec_id, coalesce(target, cluster_id) AS cluster_id FROM l1 LEFT JOIN moves USING (child_id)",
        "merge_target": f"{thinned_}, {small} SELECT cluster_id, target FROM merges",
        "merge_apply": f"{thinned_}, {small} SELECT p.id AS vec_id, coalesce(m.target, p.cluster_id) AS cluster_id FROM placed p LEFT JOIN (SELECT * FROM merges WHERE target NOT IN (SELECT cluster_id FROM merges)) m USING (cluster_id) WHERE NOT ({gone})",
        "prune_empty": f"WITH {_V}, {leaf}, {thin} SELECT cluster_id AS leaf_id FROM thin WHERE live > 0",
        "prune_single_child_root": f"{with_tree}, kept AS (SELECT * FROM l2 WHERE child_id % 4 = 1) SELECT 1::INT AS level, count(DISTINCT cluster_id) AS clusters FROM l1 UNION ALL SELECT 2::INT, count(DISTINCT cluster_id) FROM kept",
        "prune_decision": f"WITH {_V}, {leaf}, {thin}, {decision} SELECT * FROM decided",
        "co_visited_pairs": f"{with_tree}, {_beam(2, 4)} SELECT x.node AS a, y.node AS b, count(*) AS queries FROM f2 x JOIN f2 y ON x.qid = y.qid AND x.node < y.node GROUP BY x.node, y.node",
        "index_size": "SELECT count(*) AS n FROM embeddings WHERE vec_id % 7 <> 3",
        "tree_height": f"WITH RECURSIVE h AS (SELECT {LEAVES} AS parts, 1 AS level UNION ALL SELECT ceil(parts / {ATTRIBUTES.internal_max})::INT, level + 1 FROM h WHERE parts > 1) SELECT (max(level) + 1)::INT AS height FROM h",
        "vector_location": f"WITH {_V}, {leaf} SELECT id AS vec_id, cluster_id AS leaf_id, entry_offset FROM placed WHERE id % 7 <> 3 AND id % 10 = 0",
        "cluster_stats": f"WITH {_V}, {leaf} SELECT cluster_id, count(*) AS reserved, count(*) FILTER (id % 7 <> 3) AS live, count(*) FILTER (id % 7 = 3) AS dead, 100 * count(*) FILTER (id % 7 = 3) // count(*) AS dead_percent FROM placed GROUP BY cluster_id",
        "maintenance_stats": f"WITH {_V}, {leaf}, {thin}, {decision} SELECT action, count(*) AS n FROM decided GROUP BY action",
        "avg_search_distance": f"WITH {_V}, {_exact('v')} SELECT round(avg(sqrt(distance)), 6) AS avg_distance, count(*) AS n FROM exact",
        "workload_mix": "SELECT CASE WHEN event_id * 37 % 100 >= 10 THEN 'search' WHEN event_id * 53 % 100 < 50 THEN 'delete' ELSE 'insert' END AS operation, count(*) AS n FROM events GROUP BY 1",
        "recall_at_k": f"{ann}, {_exact('v')} SELECT e.qid, count(f.vec_id) / {K}::DOUBLE AS recall FROM exact e LEFT JOIN found f ON f.qid = e.qid AND f.vec_id = e.vec_id GROUP BY e.qid",
    }
