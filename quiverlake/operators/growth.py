"""An index that keeps its limits: batches go where there is room, full clusters split, the root rises, upkeep is logged.

A change works on one level at a time. Clusters that split give their parent the centroids of their parts; the parent marks the
old entry outdated and takes the new ones like any batch, so that it may be compacted or split in turn. A root that splits
gets a new root above it. What moves at a level is written before the next level is looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import centroids
from ..sources.scratch import saved
from . import index as ix
from .index import MAX_LEVELS, MOVED, OUTDATED, SLACK, VALID, Index


def running(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """``before``: the sum of ``amount`` over rows with a smaller ``key``. Ranges of keys are summed, then rows within each range."""
    bounds = rows.agg(F.min(key), F.max(key)).first()
    if bounds[0] is None:
        return rows.withColumn("before", F.lit(0).cast("long"))
    width = max(1, math.ceil((bounds[1] - bounds[0] + 1) / 256))
    df = rows.withColumn("_range", F.floor((F.col(key) - bounds[0]) / width))
    sums = df.groupBy("_range").agg(F.sum(amount).alias("n"))  # 257 rows at most
    starts = sums.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_start"))
    own = F.sum(amount).over(Window.partitionBy("_range").orderBy(key)) - F.col(amount)
    return df.join(F.broadcast(starts), "_range").withColumn("before", (own + F.col("_start")).cast("long")).drop("_range", "_start")


def next_ids(rows: DataFrame, taken: DataFrame, key: str, id_col: str = "vec_id") -> DataFrame:
    """``rows`` with new ids in the order of ``key``, dense from the largest of ``taken`` (a column of ids) on; from 0 where there are none."""
    start = taken.agg(F.max(taken.columns[0])).first()[0]
    return running(rows.withColumn("_one", F.lit(1)), key, "_one").withColumn(id_col, F.col("before") + (0 if start is None else start + 1)).drop("_one", "before")


def policy(sizes: DataFrame, cap: int, least: int, split: int) -> DataFrame:
    """``action`` and ``parts`` for clusters (cluster_id, reserved, live, batch): append, compact, split, or none without a batch."""
    n = F.col("live") + F.col("batch")
    action = (
        F.when((F.col("batch") == 0) & (F.col("reserved") <= cap), "none")
        .when((F.col("batch") > 0) & (F.col("reserved") + F.col("batch") < cap), "append")
        .when((F.col("reserved") > F.col("live")) & (n * SLACK <= cap), "compact")
        .otherwise("split")
    )
    # As many parts as a batch needs, however large it is.
    parts = F.greatest(ix.part_count(n, least, split), F.ceil(n / cap).cast("int"))
    return sizes.withColumn("action", action).withColumn("parts", F.when(action == "split", parts).otherwise(1))


def insert_level(index: Index, level: int, batch: DataFrame, outdated: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The level's members after the batch (cluster_id, child_id, vec), and the parts (old, cluster_id, vec) of clusters that split,
    if any. Entries of ``outdated`` (child_id) are marked before."""
    a = index.attributes
    cap, least = (a.leaf_max, a.leaf_min) if level == 1 else (a.internal_max, a.internal_min)
    old = index.members.where(F.col("level") == level)
    if outdated is not None:
        old = old.join(outdated.withColumn("gone", F.lit(True)), "child_id", "left").withColumn("state", F.when(F.col("gone") & (F.col("state") == VALID), OUTDATED).otherwise(F.col("state"))).select(*index.members.columns)
    sizes = old.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("reserved"), F.count_if(F.col("state") == VALID).alias("live"), F.max("entry_offset").alias("last"))
    sizes = sizes.join(batch.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("batch")), "cluster_id", "full")
    sizes = sizes.select("cluster_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reserved", "live", "batch")], F.coalesce("last", F.lit(-1)).alias("last"))
    sizes = saved(policy(sizes, cap, least, a.split))
    largest, splits = sizes.agg(F.max("cluster_id"), F.count_if(F.col("action") == "split")).first()
    if splits:
        new_ids = running(sizes.where("action = 'split'").withColumn("more", F.col("parts") - 1), "cluster_id", "more").select("cluster_id", (F.col("before") + largest + 1).alias("first_new"))
        sizes = sizes.join(new_ids, "cluster_id", "left")
    else:
        sizes = sizes.withColumn("first_new", F.lit(None).cast("long"))
    rows = old.join(sizes, "cluster_id")
    stay = rows.where("action IN ('none', 'append')").select(*index.members.columns)
    moving = rows.where((F.col("state") == VALID) & F.col("action").isin("compact", "split")).select("cluster_id", F.lit(0).alias("late"), "entry_offset", "child_id", "vec")
    moving = moving.unionByName(batch.select("cluster_id", F.lit(1).alias("late"), F.lit(0).alias("entry_offset"), "child_id", "vec")).join(sizes, "cluster_id")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("late", "entry_offset", "child_id")) - 1
    moving = moving.withColumn("place", place).withColumn("part", F.pmod(F.col("place"), F.col("parts")))
    offset = F.when(F.col("action") == "append", F.col("last") + 1 + F.col("place")).otherwise(F.floor(F.col("place") / F.col("parts")))
    moving = moving.select("action", F.col("cluster_id").alias("old"), F.when(F.col("part") == 0, F.col("cluster_id")).otherwise(F.col("first_new") + F.col("part") - 1).alias("cluster_id"), offset.cast("int").alias("entry_offset"), "child_id", "vec")
    moving = saved(moving)
    arrived = moving.select(F.lit(level).alias("level"), "cluster_id", "entry_offset", "child_id", F.lit(VALID).alias("state"), "vec")
    parts = centroids(moving.where("action = 'split'"), ["old", "cluster_id"], integer=a.metric == "l2_int").select("old", "cluster_id", "vec") if splits else None
    return stay.unionByName(arrived), parts


def insert_entries(index: Index, batch: DataFrame, level: int = 1) -> Index:
    """The index with the batch (cluster_id, child_id, vec) at ``level``, within all limits."""
    first, height, outdated, found = level, index.height, None, []
    while True:
        now, parts = insert_level(index, level, batch, outdated)
        found.append(now)
        if parts is None:
            break
        if level == MAX_LEVELS:
            raise ValueError("too many levels")
        level += 1
        if level > index.height:  # the root has split: a new one above it
            height, outdated = level, None
            batch = parts.select(F.lit(0).cast("long").alias("cluster_id"), F.col("cluster_id").alias("child_id"), "vec")
            continue
        parents = index.members.where((F.col("level") == level) & (F.col("state") == VALID)).select(F.col("child_id").alias("old"), F.col("cluster_id").alias("parent"))
        batch = parts.join(parents, "old").select(F.col("parent").alias("cluster_id"), F.col("cluster_id").alias("child_id"), "vec")
        outdated = parts.select(F.col("old").alias("child_id")).distinct()
    members = index.members.where((F.col("level") < first) | (F.col("level") > level))
    for rows in found:
        members = members.unionByName(rows)
    return ix.changed(index, members=saved(members), height=height)


def insert(index: Index, vectors: DataFrame, span: int) -> Index:
    """New vectors (id, vec) go to their leaves: appended, with compaction, or with a split that may go up to the root."""
    targets = ix.insert_targets(index, vectors, span)
    batch = vectors.join(targets, vectors["id"] == targets["vec_id"]).select(F.col("leaf_id").alias("cluster_id"), F.col("id").alias("child_id"), "vec")
    if index.height > 1:
        return insert_entries(index, saved(batch))
    return insert_entries(index, saved(batch.withColumn("cluster_id", F.lit(0).cast("long"))))


def split_overfull_clusters(index: Index) -> Index:
    """Every cluster beyond its limit split, level by level, as after a bulk build."""
    for level in range(1, MAX_LEVELS):
        if level > index.height:
            break
        none = index.members.where("level < 0").select("cluster_id", "child_id", "vec")
        index = insert_entries(index, none, level)
    return index


# --- migration ---------------------------------------------------------------------------------------------------


def migration_verdicts(index: Index, moves: DataFrame) -> DataFrame:
    """moves (vec_id, source, target) with ``accepted``: a target takes all that is to come if it has room, or would have after a
    compaction, which only sources with smaller ids than the target's may ask for; else the moves are rolled back."""
    cap = index.attributes.leaf_max
    come = moves.groupBy("target").agg(F.count(F.lit(1)).alias("batch"), F.max("source").alias("last_source"))
    sizes = ix.cluster_sizes(index).where("level = 1").select(F.col("cluster_id").alias("target"), "reserved", "live", "dead").join(come, "target")
    room = F.col("reserved") + F.col("batch") < cap
    compacted = (F.col("last_source") < F.col("target")) & (F.col("dead") > 0) & ((F.col("live") + F.col("batch")) * SLACK <= cap)
    return moves.join(sizes.select("target", (room | compacted).alias("accepted")), "target").select("vec_id", "source", "target", "accepted")


def migrate(index: Index, moves: DataFrame, expected_version: int | None = None) -> Index:
    """Accepted entries are valid at their targets' ends and stay, as moved, where they were until compaction; the others change nothing.

    With ``expected_version``, an index that has changed since is refused."""
    if expected_version is not None:
        ix.check_version(index, expected_version)
    taken = saved(migration_verdicts(index, moves).where("accepted").select("vec_id", "target"))
    mine = taken.select(F.col("vec_id").alias("child_id"), F.lit(1).alias("level"), F.lit(True).alias("gone"))
    left = index.members.join(mine, ["child_id", "level"], "left").withColumn("state", F.when(F.col("gone") & (F.col("state") == VALID), MOVED).otherwise(F.col("state"))).select(*index.members.columns)
    last = index.members.where("level = 1").groupBy("cluster_id").agg(F.max("entry_offset").alias("last"))
    come = index.members.where((F.col("level") == 1) & (F.col("state") == VALID)).join(taken.withColumnRenamed("vec_id", "child_id"), "child_id").select("child_id", "vec", F.col("target").alias("cluster_id"))
    offset = F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("cluster_id").orderBy("child_id"))
    come = come.join(last, "cluster_id", "left").select(F.lit(1).alias("level"), "cluster_id", offset.cast("int").alias("entry_offset"), "child_id", F.lit(VALID).alias("state"), "vec")
    return ix.changed(index, members=saved(left.unionByName(come)), doubled=True)


# --- upkeep ------------------------------------------------------------------------------------------------------


@dataclass
class UpkeepLog:
    """Counts of what upkeep has done: rows (action, level, clusters, entries), kept while ``on``."""

    on: bool = True
    rows: list[tuple[str, int, int, int]] = field(default_factory=list)

    def start(self) -> None:
        self.on = True

    def stop(self) -> None:
        self.on = False

    def clear(self) -> None:
        self.rows.clear()

    def add(self, action: str, level: int, clusters: int, entries: int) -> None:
        if self.on:
            self.rows.append((action, level, clusters, entries))

    def report(self, spark) -> DataFrame:
        """action, level, runs, clusters, entries."""
        df = spark.createDataFrame(self.rows, "action string, level int, clusters bigint, entries bigint")
        return df.groupBy("action", "level").agg(F.count(F.lit(1)).alias("runs"), F.sum("clusters").alias("clusters"), F.sum("entries").alias("entries"))


def maintain(index: Index, pairs: DataFrame | None = None, log: UpkeepLog | None = None) -> Index:
    """One pass of upkeep: migration between the pairs (a, b) of leaves, merges of small leaves, compaction, pruning, and a lower root."""
    log = log or UpkeepLog(on=False)
    if pairs is not None:
        verdicts = saved(migration_verdicts(index, ix.migration_candidates(index, pairs)))
        for name, what in (("migrate", "accepted"), ("roll back", "NOT accepted")):
            n = verdicts.where(what).agg(F.countDistinct("source", "target"), F.count(F.lit(1))).first()
            log.add(name, 1, *n)
        index = migrate(index, verdicts.drop("accepted"), index.version)
        index = replace(index, members=index.members.where(F.col("state") != MOVED), doubled=False)
    if index.height > 1:
        to = saved(ix.merge_steps(index))
        live = index.members.where((F.col("level") == 1) & (F.col("state") == VALID))
        log.add("merge", 1, to.count(), live.join(to, "cluster_id", "left_semi").count())
        index = replace(index, members=saved(ix.merge_small(index, to).members))
    dead = ix.cluster_sizes(index).where("dead > 0").groupBy("level").agg(F.count(F.lit(1)), F.sum("dead")).collect()
    for level, clusters, entries in sorted(tuple(r) for r in dead):
        log.add("compact", level, clusters, entries)
    before = {r[0]: r[1] for r in index.members.where(F.col("state") == VALID).groupBy("level").count().collect()}
    index = replace(index, members=saved(ix.prune(ix.compact(index)).members))
    after = {r[0]: r[1] for r in index.members.groupBy("level").count().collect()}
    for level in sorted(before):
        if (gone := before[level] - after.get(level, 0)) > 0:
            log.add("prune", level, gone, gone)
    lower = ix.prune_root(index)
    if lower.height < index.height:
        log.add("lower root", lower.height, index.height - lower.height, 0)
    return replace(lower, version=index.version + 1)


# --- look-ups ----------------------------------------------------------------------------------------------------


def parents(index: Index) -> DataFrame:
    """(level, cluster_id, parent, entry_offset) of every cluster below the root: where its centroid is."""
    return index.members.where((F.col("level") > 1) & (F.col("state") == VALID)).select((F.col("level") - 1).alias("level"), F.col("child_id").alias("cluster_id"), F.col("cluster_id").alias("parent"), "entry_offset")


def root_of(index: Index) -> tuple[int, int, int]:
    """Level, cluster and version of the root."""
    return index.height, 0, index.version


def random_clusters(index: Index, level: int, seed: int, n: int = 1, exclude: tuple[int, ...] = ()) -> DataFrame:
    """(cluster_id) of n clusters of a level that hold live entries, in an order drawn by the seed, the same in every run."""
    rows = index.members.where((F.col("level") == level) & (F.col("state") == VALID)).select("cluster_id").distinct()
    rows = rows.where(~F.col("cluster_id").isin(*exclude)) if exclude else rows
    return rows.orderBy(F.md5(F.concat_ws(":", F.col("cluster_id").cast("string"), F.lit(str(seed)))), "cluster_id").limit(n)



