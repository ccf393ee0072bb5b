"""Shared plumbing: tables, shared scratch storage, Arrow batch splitting."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes handled at once by the vectorised operators; a longer text is handled alone.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written, and those of them that are tables in the catalog, of this process; see ``release``.
_written: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``. Where that is unset, one of this machine, if the executors are on it too (tests); else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so that lost executors cost nothing twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _written[path] = None
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bucketed(df: DataFrame, column: str) -> DataFrame:
    """The same, bucketed by ``column`` into as many buckets as a shuffle has partitions: joins by it move no rows."""
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/table-{name}"
    _written[path] = name
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name)


def _delete(spark: SparkSession, path: str) -> None:
    if name := _written.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the ``stored`` tables that ``df`` reads, and nothing else reads any more."""
    names = {x.rpartition("/")[0].rpartition("/")[2] for x in df.inputFiles()}
    for path in [x for x in _written if x.rpartition("/")[2] in names]:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete every stored table of this process; what was built on them can't be read after. Also done when the process ends."""
    for path in list(_written):
        _delete(spark, path)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # Spark may have gone before
        if _written and (spark := SparkSession.getActiveSession()) is not None:
            release(spark)


atexit.register(_at_exit)


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that each slice holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        start, held = 0, 0
        for i, n in enumerate(sizes.to_pylist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
