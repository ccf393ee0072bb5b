"""Suffix-array deduplication: bytes covered by a long string that also starts anywhere else are removed.

Sorting every suffix of a corpus would move hundreds of bytes for each byte of text, so suffixes that cannot be repeated,
and whole extents of copies, are settled first:

1. Each window of ``LENGTH`` bytes has an anchor: its smallest hashed ``GRAM``-byte string, leftmost on ties. Equal windows
   have equal anchors at the same place. Neighbouring windows share anchors, so a text is a row of segments (the windows
   of one anchor), about one for 85 bytes.
2. Segments are grouped by their anchor's hash. Alone in its group, a segment holds no repeated window. If all segments
   of a group are the same string, all their windows are repeated. Only windows of mixed groups are left in doubt.
3. These are grouped once more, in cells: up to ``CELL`` neighbouring windows at the same distance from their anchor share
   all but their outer bytes. Again a cell whose shared bytes occur once is done, and so are cells that are all equal.
4. The suffixes that start in mixed cells are sorted. A cell is one row: its suffixes' common bytes as a 128-bit hash (the
   leading token), and the outer bytes themselves. Splitters sampled by Spark's range partitioner deal the rows out by leading
   token; in each bucket every suffix of every row is put in order by multikey quicksort (ties of one token are sorted
   by the next), neighbours are compared, and a row's repeated suffixes leave as runs, not one by one.
5. A leading token shared by more than ``HOT_GROUP`` rows is hot: its suffixes are dealt out singly, also by their outer bytes
   and text, so that they straddle buckets. Those that a task holds ``HOT`` times are settled before, and go on as one row.
   Each bucket gives its outermost hot suffixes, which are compared across the boundaries.

Equality of what steps 2 and 3 settle, and of a cell's shared bytes, is equality of two 64-bit hashes, not of bytes.

Texts are UTF-8 bytes; a null is empty. Matches never cross texts. Overlaps count, in one text too, and all is judged on
the input. Rows are told apart by themselves, whatever their doc_id: repeated rows repeat each other. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, stored, stored_bucketed, table
from .textvec import BASE, INVERSE, flat, hashes, mixed, powers, prefix

LENGTH, GRAM = 200, 32
#: Neighbouring windows settled together where possible.
CELL = 16
#: Suffixes held by a task before it settles those repeated within, and in a bucket.
HELD, BUCKET = 1 << 19, 1 << 20
#: A suffix that a task holds this often is settled there; rows of one leading token that one task may sort.
HOT, HOT_GROUP = 8, 2048
#: A group is joined in parts if it holds more than this share of all rows, so there are few such groups.
LARGE = 1 / 1024
#: The low bits of a packed anchor are its place in the chunk.
PLACE = 26
BASE_2 = 0xD1342543DE82EF95
INVERSE_2 = pow(BASE_2, -1, 1 << 64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, w)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def gram_hashes(sums: np.ndarray, start: np.ndarray | slice, length: int, n: int) -> np.ndarray:
    ends = sums[length : n + 1] if isinstance(start, slice) else sums[start + length]
    begins = sums[: n + 1 - length] if isinstance(start, slice) else sums[start]
    scale = powers(INVERSE, n + 1)
    return mixed((ends - begins) * (scale[: n + 1 - length] if isinstance(start, slice) else scale[start]))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """doc, first (window's start in its text), windows, place (anchor's, in its text), anchor (hash) and content (hash) of every segment."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return {"doc": none, "first": none, "windows": none, "place": none, "anchor": none.view(np.uint64), "content": none.view(np.uint64)}
    sums = prefix(data)
    g = gram_hashes(sums, slice(None), gram, n)
    low = np.uint64((1 << PLACE) - 1)
    packed = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    anchor = (sliding_min(packed, length - gram + 1) & low).astype(np.int64)
    at = np.arange(len(anchor))
    if n > 1 << PLACE:
        anchor = at + ((anchor - at) & ((1 << PLACE) - 1))
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + length <= offsets[doc + 1]
    at, anchor, doc = at[inside], anchor[inside], doc[inside]
    if not len(at):
        return segments(data[:0], offsets, length, gram)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(at)))
    first = at[s]
    content = hashes(data, first, first + count + length - 1, sums) ^ mixed((anchor[s] - first + 1).astype(np.uint64))
    return {"doc": doc[s], "first": first - offsets[doc[s]], "windows": count, "place": anchor[s] - offsets[doc[s]], "anchor": g[anchor[s]], "content": content}


def second_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """A hash of data[start:start + length] that is independent of ``hashes``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE_2, len(data)), out=sums[1:])
    return mixed((sums[start + length] - sums[start]) * powers(INVERSE_2, len(data) + 1)[start])


def expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``count`` windows from ``first``: the run and the start of each window."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[which]


def outer_bytes(data: np.ndarray, core: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(n, 2 CELL - 2) bytes before and after each core of LENGTH - CELL + 1 bytes; zeros beyond ``left`` and ``right`` of them."""
    o = np.arange(2 * CELL - 2) - (CELL - 1)
    at = core[:, None] + np.where(o < 0, o, o + LENGTH - CELL + 1)
    inside = (-o <= left[:, None]) & (o < right[:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], np.uint8(0))


def outer_keys(outer: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers from the bytes of the windows that begin ``e`` bytes before their core, without the core."""
    key = np.zeros((len(e), 16), np.uint8)
    key[:, : CELL - 1] = np.take_along_axis(outer, (CELL - 1 - e)[:, None] + np.arange(CELL - 1), axis=1)
    key[:, CELL - 1] = e
    both = key.view(">u8").astype(np.uint64)
    return both[:, 0], both[:, 1]


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by several keys, and whether each place holds the same as the one before. Only ties go on to the next key."""
    order = np.argsort(keys[0], kind="quicksort")
    x = keys[0][order]
    same = np.zeros(len(order), bool)
    same[1:] = x[1:] == x[:-1]
    for key in keys[1:]:
        tied = np.flatnonzero(same | np.append(same[1:], False))
        if not len(tied):
            break
        group = np.cumsum(~same)[tied]
        inner = np.lexsort((key[order[tied]], group))
        order[tied] = order[tied][inner]
        y = key[order]
        same[1:] &= y[1:] == y[:-1]
    return order, same


def repeated(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask (in input order) of the rows that have an equal, and of one row of each group of equals."""
    both = np.zeros(len(order), bool)
    both[order] = same | np.append(same[1:], False)
    first = np.zeros(len(order), bool)
    first[order] = ~same
    return both, first


def runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, to) of the bytes of windows at sorted (row, at)."""
    if not len(row):
        return row, at, at
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + LENGTH)
    s = np.flatnonzero(new)
    last = np.append(s[1:], len(row)) - 1
    return row[s], at[s], at[last] + LENGTH


def unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, first, windows, place and hot of each element of the second column."""
    found = b.column(1)
    parts = found.flatten()
    return np.repeat(np.arange(b.num_rows), found.value_lengths().to_numpy()), *(parts.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))


def grouped(rows: DataFrame, hot_group: int) -> DataFrame:
    """Rows whose core occurs elsewhere, without core and content; mixed: not all rows with this core are equal; hot: more than ``hot_group`` rows."""
    n = F.col("n")
    groups = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).where("n > 1")
    groups = stored(groups.select("core", (F.col("lo") != F.col("hi")).alias("mixed"), "n"))
    # Large groups are joined in as many parts as there are partitions; by their share, there are 1 / LARGE of them at most.
    limit = max(hot_group, int((groups.agg(F.sum("n")).first()[0] or 0) * LARGE))
    large = [r["core"] for r in groups.where(n > limit).select("core").collect()]
    groups = groups.select("core", "mixed", (n > hot_group).alias("hot"))
    rows, on = rows.drop("content"), ["core"]
    if large:
        parts, on = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["core", "salt"]
        rows = rows.withColumn("salt", F.when(F.col("core").isin(large), F.pmod(F.xxhash64("id", "first"), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
        groups = groups.withColumn("salt", F.explode(F.when(F.col("core").isin(large), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return stored(rows.join(groups, on).drop(*on))


def find_repeats(texts: DataFrame, hot_group: int = HOT_GROUP) -> DataFrame:
    """(id, from, to) byte ranges, not merged, of repeated strings in texts(id, text)."""

    schema = "id bigint, first int, windows int, place int, core bigint, content bigint"
    cell_schema = "id bigint, first int, windows int, e int, core bigint, core2 bigint, tie bigint, who bigint, outer binary"
    cell_names = [x.split()[0] for x in cell_schema.split(", ")]
    range_names = ["id", "from", "to", "core", "core2", "one", "two"]

    def rows_of(ids, first, windows, place, core, content) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x.astype(np.int32)) for x in (first, windows, place)], pa.array(core.view(np.int64)), pa.array(content.view(np.int64))], ["id", "first", "windows", "place", "core", "content"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            s = segments(*flat(b.column(1)))
            yield rows_of(b.column(0).to_numpy()[s["doc"]], s["first"], s["windows"], s["place"], s["anchor"], s["content"])

    def cells_of(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """doc, cell number q, first and last window, anchor's place and hot of every cell of the segments or cells beside a text."""
        doc, first, windows, place, hot = unpacked(b)
        near, far = place - first - windows + 1, place - first  # distances from the last and the first window
        cells = far // CELL - near // CELL + 1
        which, q = expanded(near // CELL, cells)
        lo = place[which] - np.minimum(q * CELL + CELL - 1, far[which])
        hi = place[which] - np.maximum(q * CELL, near[which])
        return doc[which], q, lo, hi, place[which], hot[which]

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(2))
            doc, q, lo, hi, place, _ = cells_of(b)
            if not len(doc):
                continue
            at, sums = offsets[doc], prefix(data)
            core = at + place - q * CELL
            core = mixed(hashes(data, core, core + LENGTH - CELL + 1, sums) + q.astype(np.uint64))
            content = hashes(data, at + lo, at + hi + LENGTH, sums) ^ mixed((place - lo + 1).astype(np.uint64))
            yield rows_of(b.column(0).to_numpy()[doc], lo, hi - lo + 1, place, core, content)

    def beside_text(rows: DataFrame) -> DataFrame:
        by_text = rows.where("mixed").groupBy("id").agg(F.collect_list(F.struct("first", "windows", "place", "hot")).alias("found"))
        return by_text.join(texts.select("id", "text"), "id").select("id", "found", "text")

    first = grouped(texts.select("id", "text").mapInArrow(cut, schema), hot_group)
    second = grouped(beside_text(first).mapInArrow(finer, schema), hot_group)
    sure = first.unionByName(second).where("NOT mixed").select("id", F.col("first").alias("from"), (F.col("first") + F.col("windows") + LENGTH - 1).alias("to"))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out(ids, first, windows, e, core, core2, tie, who, outer) -> pa.RecordBatch:
            outer = pa.Array.from_buffers(pa.binary(outer.shape[1]), len(outer), [None, pa.py_buffer(np.ascontiguousarray(outer))]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(x.astype(np.int32)) for x in (first, windows, e)], *[pa.array(x.view(np.int64)) for x in (core, core2, tie)], pa.array(who), outer], cell_names)

        def settled() -> Iterator[pa.RecordBatch]:
            """Hot suffixes: those held often leave as known runs, with one of them as a witness for others."""
            ids, at, e, core, core2, outer = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            one, two = outer_keys(outer, e)
            order, same = multikey_order([core, core2, one, two])
            _, first = repeated(order, same)
            start = np.flatnonzero(~same)
            count = np.diff(np.append(start, len(order)))
            often = np.zeros(len(order), bool)
            often[order] = np.repeat(count >= HOT, count)
            r, a, z = runs(ids[often], at[often])
            none = np.zeros(len(r), np.uint64)
            yield out(r, a, z - a - LENGTH + 1, np.full(len(r), -1), none, none, none, none.view(np.int64), np.zeros((len(r), outer.shape[1]), np.uint8))
            on = np.flatnonzero((first & often) | ~often)
            ids = np.where(often, -1, ids)[on]
            tie = mixed(one[on] + mixed(two[on] + core2[on]))
            yield out(ids, at[on], np.ones(len(on)), e[on], core[on], core2[on], tie, np.where(ids < 0, at[on], ids), outer[on])

        n = 0
        for b in chunks(batches, "text"):
            data, offsets = flat(b.column(2))
            doc, q, lo, hi, place, hot = cells_of(b)
            if not len(doc):
                continue
            ids, core = b.column(0).to_numpy()[doc], offsets[doc] + place - q * CELL
            e = place - lo - q * CELL
            outer = outer_bytes(data, core, e, CELL - 1 - (place - hi - q * CELL))
            token = mixed(hashes(data, core, core + LENGTH - CELL + 1) + q.astype(np.uint64)), second_hashes(data, core, LENGTH - CELL + 1)
            cold = np.flatnonzero(hot == 0)
            none = np.zeros(len(cold), np.uint64)
            yield out(ids[cold], lo[cold], (hi - lo + 1)[cold], e[cold], token[0][cold], token[1][cold], none, none.view(np.int64), outer[cold])
            warm = np.flatnonzero(hot)
            if len(warm):
                which, at = expanded(lo[warm], (hi - lo + 1)[warm])
                which = warm[which]
                held.append((ids[which], at, e[which] - (at - lo[which]), token[0][which], token[1][which], outer[which]))
                n += len(which)
                if n >= HELD:
                    yield from settled()
                    n = 0
        if held:
            yield from settled()

    cells = stored(beside_text(second).mapInArrow(suffixes, cell_schema))
    todo = cells.where("e >= 0")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(todo.agg(F.sum("windows")).first()[0] or 0) // BUCKET))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        get = lambda c: t.column(c).to_numpy()
        ids, first, tie = get("id"), get("first").astype(np.int64), get("tie")
        outer = flat(t.column("outer"))[0].reshape(len(ids), -1)
        which, at = expanded(first, get("windows").astype(np.int64))
        one, two = outer_keys(outer[which], get("e").astype(np.int64)[which] - (at - first[which]))
        core, core2 = get("core")[which], get("core2")[which]
        order, same = multikey_order([core, core2, one, two])
        both, head = repeated(order, same)
        mark = both & (ids[which] >= 0)
        # A text may stand in several rows of a group: windows go together by row, as a row's are neighbours.
        r, a, z = runs(which[mark], at[mark])
        none = pa.nulls(len(r), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), none, none, none, none], range_names)
        # Rows come in the buckets' order only by range: the outermost hot tokens may go on in the next bucket.
        hot = np.flatnonzero(head & (tie[which] != 0))
        if len(hot):
            by_range = np.lexsort((tie[which[hot]], core[hot]))
            token = lambda i: (core[hot] == core[hot[i]]) & (tie[which[hot]] == tie[which[hot[i]]])
            ends = hot[token(by_range[0]) | token(by_range[-1])]
            known = both[ends] | (ids[which][ends] < 0)
            lone = np.where(known, -1, ids[which][ends])
            yield pa.RecordBatch.from_arrays([pa.array(lone), pa.array(at[ends].astype(np.int32)), pa.array((at[ends] + LENGTH).astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (core[ends], core2[ends], one[ends], two[ends])]], range_names)

    dealt = todo.repartitionByRange(parts, "core", "tie", "who").mapInArrow(bucket, "id bigint, from int, to int, core bigint, core2 bigint, one bigint, two bigint")
    dealt = stored(dealt)
    found = dealt.where("one IS NULL").select("id", "from", "to")
    edges = dealt.where("one IS NOT NULL").groupBy("core", "core2", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", "from", "to")).alias("x"))
    edges = edges.where("n > 1").select(F.explode("x").alias("x")).select("x.id", "x.from", "x.to").where("id >= 0")
    known = cells.where("e < 0").select("id", F.col("first").alias("from"), (F.col("first") + F.col("windows") + LENGTH - 1).alias("to"))
    return sure.unionByName(known).unionByName(found).unionByName(edges)


def cleaned(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans array<struct<start, end>> (maximal removed runs) and ``kept`` (bytes left)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.col("text").cast("string").alias("text")).repartition(n, "id")
    texts = stored_bucketed(rows, "id")  # so that the texts are moved once only
    ranges = find_repeats(texts).groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in chunks(batches, "text"):
            removed, spans, kept = [], [], []
            for t, found in zip(b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                t, merged = t or b"", []
                for a, z in sorted((x["from"], x["to"]) for x in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], z)
                    else:
                        merged.append([a, z])
                at, left = 0, []
                for a, z in merged:
                    left.append(t[at:a])
                    at = z
                kept.append(b"".join([*left, t[at:]]))
                removed.append(sum(z - a for a, z in merged))
                spans.append([{"start": a, "end": z} for a, z in merged])
            sizes = [r + len(k) for r, k in zip(removed, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.join(ranges, "id", "left").select("doc_id", "text", "ranges").mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of each text; windows at places of equal bytes mark what they cover.
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + {LENGTH} - 1]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {LENGTH} + 2)) AS i FROM d)),
twice AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
marks AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH}, true) AS fresh FROM twice),
runs AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS z FROM (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM marks) GROUP BY r, g),
gaps AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS a, a AS z FROM runs UNION ALL SELECT r, max(z), NULL FROM runs GROUP BY r),
kept AS (SELECT r, string_agg(hex(b[g.a:coalesce(g.z, octet_length(b) + 1) - 1]), '' ORDER BY g.a) AS x FROM gaps g JOIN d USING (r) WHERE g.a < coalesce(g.z, octet_length(b) + 1) GROUP BY r),
gone AS (SELECT r, sum(z - a) AS n, count(*) AS spans FROM runs GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       CASE WHEN gone.r IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(x, ''))) END AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
