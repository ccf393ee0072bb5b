"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

1. Equal texts are one (by SHA-256); everything below works on different texts.
2. A shingle is five words in a row, A-Z lower-cased; a shorter text is one shingle. Its weight is its count times the
   root of the inverse document frequency of its bucket among ``BUCKETS`` hash buckets (feature hashing): counts cover all
   texts, and what is broadcast has a fixed size. Texts that share a bucket only make it look more frequent.
3. Each of ``BANDS * ROWS`` samples picks a shingle with probability by weight, the same in two texts with a probability
   equal to their weighted Jaccard similarity. Texts whose samples agree in a whole band are candidates.
4. In each bucket of a band every text is compared with the bucket's smallest (a star). Then buckets that still hold
   several components are dealt out in blocks, of bounded number and size of texts, and all pairs across components are
   compared block against block unless already joined: one text with all others at once, exactly. So no pairs are
   emitted, and no candidate link that could join two components is left out.
5. A link needs a weighted Jaccard similarity of at least ``SIMILARITY`` on the whole texts. Components of links are the
   classes; the smallest doc_id stands for its class.

A null text is in a class of its own, as is a text without words unless equal to another. Rows with the same text are in
one class. A row without doc_id is kept only where its class has no doc_id. Other columns are ignored, or kept by
``without_copies``. Very long texts count in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, drop_stored, stored, stored_bucketed, table
from .components import components, joined
from .textvec import LOWER, SPACED, Words, flat, mixed, windows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
BUCKETS = 1 << 18
#: Texts and bytes in a block (one text at least), and texts compared with one copy of a star's centre.
BLOCK, BLOCK_BYTES, FAN = 256, 1 << 23, 512

K = BANDS * ROWS
_rng = np.random.default_rng(0x1C35)
_SEEDS = _rng.integers(1, 1 << 63, K, dtype=np.uint64)
#: Quantiles of Gamma(2, 1) and logarithms of them, looked up by 16 bits of a hash: the samplers' r and ln c.
_STEPS = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """x with 1 - exp(-x) (1 + x) = (i + 1/2) / steps, by bisection."""
    u = (np.arange(_STEPS) + 0.5) / _STEPS
    lo, hi = np.zeros(_STEPS), np.full(_STEPS, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_R = _gamma_quantiles()
_LN_C = np.log(_R)


class Shingles:
    """Distinct shingles of some texts: hash and count, text after text; first has each text's first index, with the total last."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        words = Words(LOWER[data], offsets, SPACED)
        h, start = windows(words, SHINGLE)
        doc = words.doc[start]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        self.hash, self.doc = h[at], doc[at]
        self.count = np.diff(np.append(at, len(h)))
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))

    def weights(self, idf: np.ndarray) -> np.ndarray:
        return self.count * idf[(self.hash & np.uint64(BUCKETS - 1)).astype(np.int64)]


def samples(s: Shingles, weight: np.ndarray, n: int) -> np.ndarray:
    """(n, K) sample codes; texts without shingles have zeros."""
    out = np.zeros((n, K), np.uint32)
    if not len(weight):
        return out
    have = np.flatnonzero(np.diff(s.first))
    starts = s.first[have]
    sizes = np.diff(s.first)[have]
    lnw = np.log(weight)
    for k in range(K):
        x = mixed(s.hash ^ _SEEDS[k])
        r = _R[(x & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (x >> np.uint64(32)).astype(np.float64) * 2.0**-32
        t = np.floor(lnw / r + beta)
        score = _LN_C[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + 1.0)
        least = np.minimum.reduceat(score, starts)
        hit = np.flatnonzero(score == np.repeat(least, sizes))
        _, which = np.unique(s.doc[hit], return_index=True)
        hit = hit[which]
        out[have, k] = (mixed(s.hash[hit] + t[hit].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of the bands' samples and numbers."""
    x = np.zeros((len(sample), BANDS), np.uint64)
    for b in range(BANDS):
        y = np.full(len(sample), b + 1, np.uint64)
        for i in range(ROWS):
            y = mixed(y * np.uint64(0x9E3779B97F4A7C15) + sample[:, b * ROWS + i])
        x[:, b] = y
    return x


def jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets: sum of minima over sum of maxima."""
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    same = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
    low = float(np.minimum(w1[same], w2[at[same]]).sum())
    total = float(w1.sum() + w2.sum()) - low
    return low / total if total else 0.0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Texts in which each bucket occurs, and all texts. BUCKETS rows at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in chunks(batches, "text"):
            s = Shingles(b.column(0))
            bucket = (s.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
            total += np.bincount(np.unique(s.doc * BUCKETS + bucket) & (BUCKETS - 1), minlength=BUCKETS)
            n += b.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bucket", "n"])

    got = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    df = np.zeros(BUCKETS, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    """Root of the inverse document frequency ln((1 + n) / (1 + df)) + 1.

    The root, as a large group of near copies lowers the weight of its own shingles: with the logarithm itself, the few
    words changed in each copy would outweigh the rest and the group fall apart."""
    return np.sqrt(np.log((1.0 + n) / (1.0 + np.minimum(df, n))) + 1.0)


def compared(pairs: DataFrame, idf) -> DataFrame:
    """The rows (a, b) of (a, b, text_a, text_b), best ordered by a, whose similarity suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = idf.value
        for b in chunks(batches, "text_b"):
            a = b.column(0).to_pylist()
            new = [i for i in range(len(a)) if not i or a[i] != a[i - 1]]
            left, right = Shingles(b.column(2).take(pa.array(new))), Shingles(b.column(3))
            wl, wr = left.weights(weight), right.weights(weight)
            which = np.searchsorted(new, np.arange(len(a)), "right") - 1
            keep = []
            for i, k in enumerate(which.tolist()):
                x, y = slice(left.first[k], left.first[k + 1]), slice(right.first[i], right.first[i + 1])
                keep.append(jaccard(left.hash[x], wl[x], right.hash[y], wr[y]) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def within_blocks(groups, idf) -> DataFrame:
    """Links that join components, from blocks (band, i, j) of rows (key, label, bands, text, side)."""

    def run(group: pa.Table) -> pa.Table:
        t = group.sort_by([("key", "ascending"), ("side", "ascending")])
        keys, labels, side = t.column("key").to_pylist(), t.column("label").to_pylist(), t.column("side").to_numpy()
        band = t.column("band")[0].as_py()
        across = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        codes = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        component = np.array([number[x] for x in labels])
        s, out = None, []
        for x in range(len(keys)):
            if across and side[x] == 1:
                continue
            other = np.flatnonzero(side == 1) if across else np.arange(x + 1, len(keys))
            other = other[component[other] != component[x]]
            # A pair belongs to the first band that it shares.
            shared = codes[other] == codes[x]
            other = other[codes[x][shared.argmax(axis=1)] == band] if len(other) else other
            if not len(other):
                continue
            if s is None:
                s = Shingles(t.column("text").combine_chunks())
                w = s.weights(idf.value)
                different, at = np.unique(s.hash, return_inverse=True)
                own, total = np.zeros(len(different)), np.add.reduceat(w, s.first[:-1])
            mine = slice(s.first[x], s.first[x + 1])
            own[at[mine]] = w[mine]
            low = np.add.reduceat(np.minimum(own[at], w), s.first[:-1])
            own[at[mine]] = 0.0
            similar = low[other] >= SIMILARITY * (total[x] + total[other] - low[other])
            for y in other[similar].tolist():
                if component[y] != component[x]:
                    out.append((keys[x], keys[y]))
                    component[component == component[y]] = component[x]
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return groups.applyInArrow(run, "a binary, b binary")


def text_key(text: str = "text"):
    return F.substring(F.unhex(F.sha2(F.col(text).cast("string"), 256)), 1, 16)


def links(docs: DataFrame) -> DataFrame:
    """(node, root) keys of texts that have near copies among other texts."""
    texts = docs.where(F.col("text").isNotNull()).select(text_key().alias("key"), F.col("text").cast("string").alias("text")).dropDuplicates(["key"])
    # Bucketed by key, so that the joins below move no texts but those that they are about.
    written = stored_bucketed(texts, "key")
    try:
        return _links(docs.sparkSession, written)
    finally:
        drop_stored(written)


def _links(spark: SparkSession, texts: DataFrame) -> DataFrame:
    df, n = document_frequencies(texts)
    idf = spark.sparkContext.broadcast(inverse(df, n))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s = Shingles(b.column(1))
            x = samples(s, s.weights(idf.value), b.num_rows)
            some = pa.array(np.diff(s.first) > 0)
            keys = band_keys(x).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            sizes = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, bands], ["key", "size", "bands"]).filter(some)

    sketches = stored(texts.select("key", "text").mapInArrow(sketch, "key binary, size bigint, bands array<bigint>"))
    rows = sketches.select("key", "size", F.explode("bands").alias("band"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    full = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks"), F.min("key").alias("centre")).where("n > 1")
    rows = stored(rows.join(full, "band").select("band", "key", "blocks", "centre"))

    # Stars: every text of a bucket with its smallest. A centre with many texts is dealt out in copies.
    pairs = stored(rows.where("key != centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct())
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("copies"))
    centres = copies.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    others = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    others = others.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    found = stored(compared(others.join(centres, ["a", "copy"]), idf))
    labels = components(found)

    # Buckets that hold several components yet.
    labelled = rows.join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "blocks", F.coalesce("root", "key").alias("label"))
    labelled = stored(labelled)
    open_ = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("band")
    left = labelled.join(open_, "band")
    left = left.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    left = left.select("band", "key", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left = left.select("band", "key", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    left = left.join(sketches.select("key", "bands"), "key").join(texts.select("key", "text"), "key")
    more = stored(within_blocks(left.groupBy("band", "i", "j"), idf))
    return joined(labels, more)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept (doc_id = class_id), one row for each row."""
    roots = links(docs)
    rows = docs.select("doc_id", text_key().alias("key"))
    rows = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", F.coalesce("root", "key").alias("root"))
    rows = stored(rows)
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    out = rows.join(least, "root", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each class (one with the smallest doc_id, also where that row is repeated), and all rows with null text, with all columns."""
    roots = links(docs)
    rows = docs.select("doc_id", text_key().alias("key")).where("key IS NOT NULL").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "key", "n", F.coalesce("root", "key").alias("root"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "key", "n")).alias("x")).select(F.col("x.doc_id").alias("doc_id_"), F.col("x.key").alias("key_"), F.col("x.n").alias("n"))
    first = stored(first)
    # Apart, as they are few: only repeated rows need to be brought together.
    again = stored(first.where("n > 1"))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id_"), text_key().alias("key"))
    chosen = lambda x: keyed.join(x, keyed["key"].eqNullSafe(x["key_"]) & keyed["id_"].eqNullSafe(x["doc_id_"]), "left_semi").where("key IS NOT NULL")
    kept = chosen(first.where("n = 1")).unionByName(chosen(again).dropDuplicates(["key"])).unionByName(keyed.where("key IS NULL"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
