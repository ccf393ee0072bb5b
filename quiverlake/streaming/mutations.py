"""A stream of mutations (seq, op, vec_id, vec) applied batch by batch: the last operation of each id counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.growth import insert
from ..operators.index import Index, compact, delete
from ..sources.snapshot import load, save


def last_operations(batch: DataFrame) -> DataFrame:
    return batch.groupBy("vec_id").agg(F.max_by(F.struct("op", "vec"), "seq").alias("x")).select("vec_id", "x.op", "x.vec")


def apply(index: Index, batch: DataFrame, span: int) -> Index:
    """Deletions and replaced vectors first, then insertions."""
    ops = last_operations(batch)
    index = compact(delete(index, ops.select("vec_id")))
    return insert(index, ops.where("op = 'insert'").select(F.col("vec_id").alias("id"), "vec"), span)


def start(stream: DataFrame, path: str, checkpoint: str, span: int = 4):
    """Snapshot n + 1 is written beside snapshot n under ``path``; a batch run twice writes the same snapshot again."""

    def each(batch: DataFrame, number: int) -> None:
        save(apply(load(batch.sparkSession, f"{path}/{number}"), batch, span), f"{path}/{number + 1}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
