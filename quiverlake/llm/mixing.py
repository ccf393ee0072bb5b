"""Mixing sources to target weights by fixed-length blocks.

Each source's texts stand end to end, in an order given by hashes, and are cut into blocks of ``BLOCK`` words. A target
of words becomes a number of slots; output shards of equal size (``SHARD_SLOTS`` slots at most, ``SHARDS`` of them at least) draw their slots' sources multinomially from what is
still due, so that the sums come out exactly. The k-th slot of a source is block ``p(k mod n)``, where p is a
pseudorandom permutation of its n blocks (a Feistel network, walked until inside), another one for each round of n slots.
Slots and pieces of documents meet by block index. As a target is at most three times its source's size, no block is
taken more than three times.

Sources are ordered by code point, null last, and weigh 1, 2, 3 in turn. A null text has no words and is never taken, as
is an empty one. Repeated rows stand in the mix once each. The sources' totals (one row for each source) are collected:
they are the mix's configuration, and broadcast. Other columns are ignored, or kept by ``mixed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table
from .textvec import SPACED, Words, flat

BLOCK = 128
WEIGHTS = (1.0, 2.0, 3.0)
#: A target's limit, in sizes of its source.
MOST = 3
SHARDS, SHARD_SLOTS = 64, 1 << 20
#: Parts of a source in which running sums are made side by side.
PARTS = 4096
SEED = 20240607
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float]) -> list[float]:
    """Shares of sum(sizes) by weight, at most MOST times each size; the excess is shared anew until none is above."""
    total, fixed = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > MOST * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else rest * weights[i] / weight for i in range(len(sizes))]
        fixed |= {i: float(MOST * sizes[i]) for i in over}


def shard_counts(slots: list[int], seed: int = SEED) -> np.ndarray:
    """(shard, source) slots: multinomial draws for each shard by what is still due; columns sum to ``slots``."""
    rng, due = np.random.default_rng(seed), np.array(slots, np.int64)
    shards = max(SHARDS, -(-int(due.sum()) // SHARD_SLOTS))
    out, total = np.zeros((shards, len(slots)), np.int64), int(due.sum())
    for k in range(shards):
        n = total * (k + 1) // shards - total * k // shards
        while n:
            drawn = np.minimum(rng.multinomial(n, due / due.sum()), due)
            out[k] += drawn
            due -= drawn
            n -= int(drawn.sum())
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, at the given places."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little") | 1) for i in range(4)]
    x = x.astype(np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for r in rounds:
            a, b = b, a ^ ((((b + np.uint64(1)) * r) >> np.uint64(23)) & mask)
        return (a << np.uint64(half)) | b

    x = once(x)
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def placed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``src`` (null-safe key), ``size`` and ``start``: each row's place among its source's words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*[F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row")], F.struct(F.col("source").alias("s")).alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", "text").alias("h"))
    df = stored(df.withColumn("part", F.pmod(F.col("h"), F.lit(PARTS)).cast("int")))
    within = Window.partitionBy("src", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("src", "part").agg(F.sum("size").alias("words"))
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("src").alias("src_"), F.col("part").alias("part_"), "before")
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    df = df.join(before, (df["part"] == before["part_"]) & df["src"].eqNullSafe(before["src_"]))
    return df.select("row", "src", "size", (F.col("before") + F.col("inside")).alias("start"))


def plan(rows: DataFrame) -> list[dict]:
    """One entry for each source, in order: name, size, target, blocks, slots."""
    found = rows.groupBy("src").agg(F.sum("size").alias("size")).collect()
    found = sorted(((r["src"]["s"], r["size"]) for r in found), key=lambda x: (x[0] is None, x[0] if x[0] is None else str(x[0])))
    if not found:
        return []
    want = targets([n for _, n in found], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(found))])
    out = []
    for (name, size), t in zip(found, want, strict=True):
        blocks = -(-size // BLOCK)
        out.append({"source": name, "size": size, "target": t, "blocks": blocks, "slots": min(MOST * blocks, round(t * blocks / size)) if size else 0})
    return out


def slots(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """(source index, block, times): the drawn blocks of all shards."""
    counts = shard_counts([x["slots"] for x in sources])
    first = np.vstack([np.zeros(len(sources), np.int64), np.cumsum(counts, axis=0)])
    rows = [(k, i, int(first[k, i]), int(counts[k, i]), sources[i]["blocks"]) for k in range(len(counts)) for i in range(len(sources)) if counts[k, i]]
    due = spark.createDataFrame(rows, "shard int, source int, first bigint, n bigint, blocks bigint").repartition(len(counts), "shard")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for lo in range(r["first"], r["first"] + r["n"], 1 << 18):
                    at = np.arange(lo, min(lo + (1 << 18), r["first"] + r["n"]))
                    block = np.empty(len(at), np.int64)
                    turns = at // r["blocks"]
                    for turn in np.unique(turns):
                        now = turns == turn
                        block[now] = permuted(at[now] % r["blocks"], r["blocks"], SEED + 1009 * r["source"] + int(turn))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r["source"], np.int32)), pa.array(block)], ["index", "block"])

    return due.mapInArrow(draw, "index int, block bigint").groupBy("index", "block").agg(F.count(F.lit(1)).alias("times"))


def taken_pieces(rows: DataFrame, sources: list[dict]) -> DataFrame:
    """(index, start, from, words, times) of every piece of a document in a drawn block; from counts the document's words."""
    # Both sides grow with the documents: they are merged, never broadcast.
    spark = rows.sparkSession
    names = spark.createDataFrame([((x["source"],), i) for i, x in enumerate(sources)], f"name {rows.schema['src'].dataType.simpleString()}, index int")
    at = rows.where("size > 0").join(F.broadcast(names), rows["src"].eqNullSafe(names["name"])).select("index", "start", "size")
    at = at.select("*", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))).alias("block"))
    lo, hi = F.greatest(F.col("start"), F.col("block") * BLOCK), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return at.join(slots(spark, sources).hint("merge"), ["index", "block"]).select("index", "start", (lo - F.col("start")).alias("from"), (hi - lo).alias("words"), "times")


def source_table(rows: DataFrame, sources: list[dict]) -> DataFrame:
    return rows.sparkSession.createDataFrame([((x["source"],), i, x["size"], float(x["target"])) for i, x in enumerate(sources)], f"name {rows.schema['src'].dataType.simpleString()}, index int, source_size bigint, target double")


def mix(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """All rows with struct ``row`` of ``keep``, size, source_size, target, index and start; and the taken pieces."""
    rows = stored(placed(docs, keep))
    sources = plan(rows)
    names = source_table(rows, sources)
    out = rows.join(F.broadcast(names), rows["src"].eqNullSafe(names["name"])).select("row", "index", "start", "size", "source_size", "target")
    return out, taken_pieces(rows, sources) if sources else None


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for the words taken once at least, another for those taken twice, a third for
    those taken three times. A text all of whose words are in the row is whole; else its runs are joined by line ends."""
    columns = docs.columns
    rows, pieces = mix(docs, columns)
    if pieces is None:
        return docs.limit(0)
    by_doc = pieces.groupBy("index", "start").agg(F.sort_array(F.collect_list(F.struct("from", "words", "times"))).alias("pieces"))
    df = rows.where("size > 0").join(by_doc.hint("merge"), ["index", "start"]).select("row", "size", "pieces")
    df = df.select("row", "size", "pieces", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("pieces", lambda p: p["times"])).cast("int"))).alias("copy"))
    df = df.select("row", "size", F.transform(F.filter("pieces", lambda p: p["times"] >= F.col("copy")), lambda p: F.struct(p["from"].alias("a"), (p["from"] + p["words"]).alias("b"))).alias("cuts"))
    text = docs.schema["text"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, size, cuts in zip(b.column("t").to_pylist(), b.column("size").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                if sum(c["b"] - c["a"] for c in cuts) < size:
                    data, offsets = flat(pa.array([t]))
                    w, runs = Words(data, offsets, SPACED), []
                    for c in cuts:
                        if runs and runs[-1][1] == c["a"]:
                            runs[-1][1] = c["b"]
                        else:
                            runs.append([c["a"], c["b"]])
                    t = "\n".join(bytes(data[w.start[x] : w.end[y - 1]]).decode() for x, y in runs)
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, b.schema.field("t").type)], ["row", "t"])

    out = df.select("row", F.col("row")["text"].alias("t"), "size", "cuts").mapInArrow(cut, f"row {rows.schema['row'].dataType.simpleString()}, t {text}")
    new = {"text": F.col("t"), "n_chars": F.length("t")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in columns])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, pieces = mix(docs, ["doc_id"])
    columns = ["row.doc_id", "size", "source_size", "target"]
    if pieces is None:
        return rows.select(*columns, F.lit(0).cast("long").alias("taken"))
    words = pieces.groupBy("index", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # Rows without words share a start with the next one and are never taken.
    words = words.withColumn("some", F.lit(True))
    out = rows.withColumn("some", F.col("size") > 0).join(words.hint("merge"), ["index", "start", "some"], "left")
    return out.select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
