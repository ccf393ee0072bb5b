"""Binary vector files: unsigned 32-bit count and dimension, then count * dimension little-endian elements, row by row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element kind: numpy type, Spark type.
KINDS = {"u8": ("<u1", "int"), "u16": ("<u2", "int"), "u32": ("<u4", "bigint"), "f32": ("<f4", "float"), "f64": ("<f8", "double")}
HEADER = 8
#: Bytes that a task reads at once.
SPLIT = 32 << 20


def _kind(kind: str) -> tuple[np.dtype, str]:
    if kind not in KINDS:
        raise ValueError(f"unknown element kind: {kind}; known: {sorted(KINDS)}")
    return np.dtype(KINDS[kind][0]), KINDS[kind][1]


def read_vectors(spark: SparkSession, path: str, kind: str, dimension: int | None = None, split: int = SPLIT) -> DataFrame:
    """(id, vec) from any file system that Spark knows. Ranges of whole rows are read side by side through Hadoop's streams
    of fixed-length records; the header's row is cut off by its length. A short last batch is read as it is."""
    dtype, spark_type = _kind(kind)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.open(hadoop)
    try:
        head = bytes(stream.readNBytes(HEADER))
    finally:
        stream.close()
    count, width = (int(x) for x in np.frombuffer(head, "<u4"))
    if dimension is not None and dimension != width:
        raise ValueError(f"dimension mismatch: the file has {width}, {dimension} expected")
    row = width * dtype.itemsize
    length = system.getFileStatus(hadoop).getLen()
    if length < HEADER + count * row:
        raise ValueError("the file is shorter than its header says")
    # Records of gcd(header, row) bytes tile the file whatever the header's length; rows are put together again by place.
    record = math.gcd(HEADER, row) if row % HEADER or row == 0 else HEADER
    per_row, skip = row // record, HEADER // record
    conf = {"fixedlengthinputformat.record.length": str(record), "mapreduce.input.fileinputformat.split.maxsize": str(max(row, split // record * record))}
    data = spark.sparkContext.newAPIHadoopFile(path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    parts = data.map(lambda kv: ((kv[0] // record - skip) // per_row, (kv[0] // record - skip) % per_row, bytes(kv[1]))).filter(lambda x: 0 <= x[0] < count)
    df = spark.createDataFrame(parts, "id bigint, part bigint, bytes binary")
    whole = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "bytes"))).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(b"".join(p["bytes"] for p in x), dtype) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() for r in rows], pa.list_({"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[spark_type]))], ["id", "vec"])

    return whole.mapInArrow(decode, f"id bigint, vec array<{spark_type}>")


def write_vectors(vectors: DataFrame, path: str, kind: str) -> None:
    """One file from (id, vec), ordered by id. The rows are encoded side by side; the driver only passes on their bytes, range
    by range, as the format is one stream."""
    dtype, _ = _kind(kind)
    shape = vectors.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if shape[1] != shape[2]:
        raise ValueError("vectors differ in length")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["bytes"])

    spark = vectors.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(np.array([shape[0], shape[1] or 0], "<u4").tobytes()))
        for row in vectors.orderBy("id").select("vec").mapInArrow(encode, "bytes binary").toLocalIterator(prefetchPartitions=True):
            out.write(bytearray(row[0]))
    finally:
        out.close()


def synthetic_vectors(spark: SparkSession, count: int, dimension: int, mean: float = 0.0, stddev: float = 1.0, alpha: float = 0.0, seed: int = 1) -> DataFrame:
    """(id, vec) of skew-normal components: mean + stddev * (d |u| + sqrt(1 - d^2) v), d = alpha / sqrt(1 + alpha^2)."""
    if not 1 <= dimension <= 256 or not -10 <= alpha <= 10:
        raise ValueError("dimension must be 1 to 256, alpha -10 to 10")
    d = alpha / math.sqrt(1 + alpha * alpha)
    # Normal draws from hashes (Box-Muller), so that a rerun of a task draws the same.
    unit = lambda i, k: (F.pmod(F.xxhash64("id", i, F.lit(seed), F.lit(k)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    normal = lambda i, k: F.sqrt(-2.0 * F.log(unit(i, k))) * F.cos(2 * math.pi * unit(i, k + 1))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: (mean + stddev * (d * F.abs(normal(i, 0)) + math.sqrt(1 - d * d) * normal(i, 2))).cast("float"))
    return spark.range(count).select("id", vec.alias("vec"))
