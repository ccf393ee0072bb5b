"""Workload runs: build, warm-up and a mix of searches, insertions and deletions, with their metrics.

A run goes in batches: the operations of a batch see the index as the batches before have left it, insertions and deletions are
applied together after its searches. What an operation is and what it picks are drawn from hashes of its number.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from . import growth
from . import index as ix


def operation(draw: Column, second: Column, write_percent: int, delete_percent: int) -> Column:
    """search, insert or delete from two draws in 0..99."""
    return F.when(draw >= write_percent, "search").when(second < delete_percent, "delete").otherwise("insert")


def run_metrics(log: DataFrame) -> DataFrame:
    """operation, n, errors, and n a second over the log's span, from log (operation, ok, at seconds)."""
    span = log.agg((F.max("at") - F.min("at")).alias("span"))
    sums = log.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("errors"))
    return sums.crossJoin(F.broadcast(span)).select("operation", "n", "errors", (F.col("n") / F.greatest("span", F.lit(1e-9))).alias("per_second"))


def average_distance(neighbours: DataFrame) -> DataFrame:
    return neighbours.agg(F.avg(F.sqrt("distance")).alias("avg_distance"), F.count(F.lit(1)).alias("n"))


def draw(number: Column | str, seed: int, below: int = 100) -> Column:
    """A number in 0..below-1 from the MD5 of an operation's number and a seed: the same in every engine."""
    number = F.col(number) if isinstance(number, str) else number
    return (F.conv(F.substring(F.md5(F.concat_ws(":", number.cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long") % below).cast("int")


def live_ids(index: ix.Index) -> DataFrame:
    return index.members.where((F.col("level") == 1) & (F.col("state") == ix.VALID)).select(F.col("child_id").alias("vec_id"))


def pick_live(index: ix.Index, n: int, seed: int) -> DataFrame:
    """(vec_id) of n live vectors, in an order drawn by the seed."""
    return live_ids(index).orderBy(F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit(str(seed)))), "vec_id").limit(n)


@dataclass
class Workload:
    """Vectors still to come (id, vec), queries (qid, q), and the ratios of the mix."""

    vectors: DataFrame
    queries: DataFrame
    k: int
    span: int
    write_percent: int = 10
    delete_percent: int = 50
    seed: int = 1
    taken: int = 0
    log: list[tuple] = field(default_factory=list)

    def _note(self, phase: str, operation: str, n: int, errors: int, seconds: float, distance: float = 0.0, found: int = 0) -> None:
        if n:
            self.log.append((phase, operation, n, errors, seconds, distance, found))

    def insert(self, index: ix.Index, n: int, phase: str = "run") -> ix.Index:
        """The next n vectors in the order of their ids; too few left are errors."""
        began = time.monotonic()
        last = F.row_number().over(Window.orderBy("id"))
        # Only ids are ordered in one place, and only as many as have been taken; their vectors are joined in.
        ids = self.vectors.select("id").orderBy("id").limit(self.taken + n).withColumn("n", last).where(F.col("n") > self.taken).select("id")
        new = saved(self.vectors.select("id", "vec").join(ids, "id", "left_semi"))
        got = new.count()
        self.taken += got
        index = growth.insert(index, new, self.span) if got else index
        self._note(phase, "insert", n, n - got, time.monotonic() - began)
        return index

    def delete(self, index: ix.Index, n: int, seed: int, phase: str = "run") -> ix.Index:
        began = time.monotonic()
        ids = saved(pick_live(index, n, seed))
        got = ids.count()
        index = ix.delete(index, ids) if got else index
        self._note(phase, "delete", n, n - got, time.monotonic() - began)
        return index

    def search(self, index: ix.Index, numbers: DataFrame, phase: str = "run") -> None:
        """For each operation (number) a query drawn from the queries; one without an answer is an error."""
        began = time.monotonic()
        queries = self.queries.select("qid", "q").withColumn("place", F.row_number().over(Window.orderBy("qid")) - 1)
        total = self.queries.count()
        ops = numbers.select(F.col("number").alias("op"), draw("number", self.seed + 2, max(total, 1)).alias("place"))
        found = ix.ann_search(index, ops.join(queries, "place").select(F.col("op").alias("qid"), "q"), self.k, self.span, self.span, past_empty=True)
        got = found.agg(F.countDistinct("qid"), F.count(F.lit(1)), F.sum(F.sqrt("distance"))).first()
        n = numbers.count()
        self._note(phase, "search", n, n - got[0], time.monotonic() - began, got[2] or 0.0, got[1])

    def run(self, index: ix.Index, build: int, warm_up: int, mixed: int, batch: int) -> ix.Index:
        """Three phases of so many operations: insertions only, searches only, then the mix."""
        spark = self.vectors.sparkSession
        done = 0
        for phase, n in (("build", build), ("warm-up", warm_up), ("run", mixed)):
            for lo in range(done, done + n, batch):
                numbers = spark.range(lo, min(lo + batch, done + n)).withColumnRenamed("id", "number")
                if phase == "build":
                    index = self.insert(index, numbers.count(), phase)
                    continue
                kind = F.lit("search") if phase == "warm-up" else operation(draw("number", self.seed), draw("number", self.seed + 1), self.write_percent, self.delete_percent)
                ops = saved(numbers.withColumn("operation", kind))
                counts = {r[0]: r[1] for r in ops.groupBy("operation").count().collect()}
                if counts.get("search"):
                    self.search(index, ops.where("operation = 'search'"), phase)
                if counts.get("delete"):
                    index = self.delete(index, counts["delete"], lo, phase)
                if counts.get("insert"):
                    index = self.insert(index, counts["insert"], phase)
                index = ix.changed(index, members=saved(index.members))
            done += n
        return index

    def report(self) -> DataFrame:
        """phase, operation, n, errors, per_second, avg_distance (of what searches found)."""
        rows = self.vectors.sparkSession.createDataFrame(self.log, "phase string, operation string, n bigint, errors bigint, seconds double, distance double, found bigint")
        sums = rows.groupBy("phase", "operation").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "seconds", "distance", "found")])
        return sums.select("phase", "operation", "n", "errors", (F.col("n") / F.greatest("seconds", F.lit(1e-9))).alias("per_second"), F.try_divide("distance", F.col("found").cast("double")).alias("avg_distance"))
