"""Index snapshots as Parquet, partitioned by level, so that a search reads only the levels that it walks."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from ..operators.index import Attributes, Index, StaleIndex


def save(index: Index, path: str) -> None:
    index.members.write.partitionBy("level").mode("overwrite").parquet(f"{path}/members")
    spark = index.members.sparkSession
    spark.createDataFrame([(index.height, index.version, index.doubled, json.dumps(asdict(index.attributes)))], "height int, version int, doubled boolean, attributes string").coalesce(1).write.mode("overwrite").parquet(f"{path}/head")


def load(spark: SparkSession, path: str) -> Index:
    head = spark.read.parquet(f"{path}/head").first()
    members = spark.read.parquet(f"{path}/members").select("level", "cluster_id", "entry_offset", "child_id", "state", "vec")
    return Index(members, head["height"], Attributes(**json.loads(head["attributes"])), head["version"], head["doubled"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions published whole under ``path``, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [x.getPath().getName() for x in system.listStatus(folder)]
    whole = [x for x in names if x.isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/head/_SUCCESS"))]
    return sorted(map(int, whole))


def publish(index: Index, path: str, expected: int | None = None) -> None:
    """The index as its version's folder under ``path``, beside older ones that readers may still hold.

    Refused unless it is newer than the last version there, and that is the ``expected`` one, where given."""
    there = versions(index.members.sparkSession, path)
    last = there[-1] if there else None
    if expected != last and expected is not None or last is not None and index.version <= last:
        raise StaleIndex(f"version {last} is there, {expected} expected, {index.version} to be published")
    save(index, f"{path}/{index.version}")


def latest(spark: SparkSession, path: str) -> Index:
    there = versions(spark, path)
    if not there:
        raise FileNotFoundError(f"no version under {path}")
    return load(spark, f"{path}/{there[-1]}")
