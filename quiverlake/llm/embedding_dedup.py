"""Near-duplicate vectors: epsilon grid order join.

Unit vectors with a cosine of at least ``COSINE`` are at most ``sqrt(2 - 2 COSINE)`` apart. Vectors are projected on the
leading principal axes (of the covariance over all vectors) and sorted by group, then grid cells of that side, lexicographically. The sorted
sequence is cut into blocks with bounding boxes; long intervals of blocks that share or neighbour a cell of the first axis are
joined first, then blocks, and pairs provably too distant are skipped. For each pair of near intervals, one's blocks are
held and the other's stream past them; two blocks are joined by recursive halving, again skipping distant parts, down
to small matrix products in double precision.

Vectors are compared only with equal labels (and lengths). A vector that is null, of zeros, or holds null, NaN or an
infinity, or whose label is null, links with nothing. Equal vectors are joined once and counted as often as they occur.
Repeated rows are vectors of their own. A null vec_id takes part; it is a class's id only where no other is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

COSINE = 0.93
#: Leading axes; components beyond AXES_FROM aren't used to find axes (distances can only shrink by that).
AXES, AXES_FROM = 8, 256
#: Vectors in a block, blocks in an interval (fewer if their vectors would take more bytes), vectors below which parts are multiplied at once.
BLOCK, INTERVAL, INTERVAL_BYTES, LEAF = 512, 32, 1 << 27, 128
#: Parts in which a group's intervals are compared.
SALTS = 8


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, cut or padded with zeros to ``width``."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.maximum(np.abs(out).max(axis=1, initial=0.0), 1e-300)[:, None]  # squares of huge values would overflow
    out /= np.sqrt((out * out).sum(axis=1))[:, None]
    return out[:, :width]


def axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Leading principal axes, from sums over all vectors; width + 1 rows of width numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = _matrix(b.column(0).slice(lo, 4096), width)
                x = np.hstack([x, np.ones((len(x), 1))])
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "x"])

    rows = nodes.select("v").mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    m = np.zeros((width + 1, width + 1))
    m[rows.column("i").to_numpy(), rows.column("j").to_numpy()] = rows.column("x").to_numpy()
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :-1] / n
    values, vectors = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    return vectors[:, np.argsort(-values)[:AXES]]


def _apart(lo1, hi1, lo2, hi2) -> np.ndarray:
    """Least squared distance of boxes."""
    gap = np.maximum(0.0, np.maximum(lo1 - hi2, lo2 - hi1))
    return (gap * gap).sum(axis=-1)


def grid_join(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, limit: float, cosine: float, same: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(offset in x, offset in y, boolean matrix) of linked pairs; in one sequence (same) with the later part as y, or both the same."""
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if a == b or c == d or same and c < a:
            continue
        if _apart(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0)) > limit:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            hit = x[a:b] @ y[c:d].T >= cosine
            if hit.any():
                yield a, c, hit
        elif same and (a, b) == (c, d):
            m = (a + b) // 2
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    vector = F.col(vector_col)
    fine = vector.isNotNull() & F.col(label_col).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), F.struct(F.col(label_col).alias("label"), vector.alias("v"))).alias("key"))
    nodes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = stored(nodes.select(F.monotonically_increasing_id().alias("node"), "least", "n", "key"))
    longest = nodes.agg(F.max(F.size("key.v"))).first()[0] or 1
    width, interval = min(AXES_FROM, longest), max(1, min(INTERVAL, INTERVAL_BYTES // (8 * BLOCK * longest)))
    basis = axes(nodes.select("key.v"), width)
    limit = 2.0 - 2.0 * cosine
    side, slack = limit**0.5, limit + 1e-9

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b.column(3), width) @ basis
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(z.ravel())) for z in (np.floor(p / side).astype(np.int32), p)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *lists, b.column(3)], ["node", "n", "g", "cell", "p", "v"])

    keyed = nodes.select("node", "n", F.struct("key.label", F.size("key.v").alias("d")).alias("g"), "key.v")
    g_type, v_type = keyed.schema["g"].dataType.simpleString(), keyed.schema["v"].dataType.simpleString()
    placed = keyed.mapInArrow(cells, f"node bigint, n bigint, g {g_type}, cell array<int>, p array<double>, v {v_type}")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "g", "cell", "node").sortWithinPartitions("g", "cell", "node")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        names = ["block", "interval", "g", "lo", "hi", "node", "n", "p", "v"]

        def out(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            p = np.array(t.column("p").to_pylist())
            one = [pa.array([x]) for x in (number, number // interval)]
            number += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in ("node", "n", "p", "v")]
            return pa.RecordBatch.from_arrays([*one, t.column("g").combine_chunks().slice(0, 1), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]), *lists], names)

        def cut(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for lo in range(0, t.num_rows, BLOCK):
                yield out(t.slice(lo, BLOCK))

        now = None
        for b in batches:
            g = b.column(b.schema.get_field_index("g")).to_pylist()
            edges = [0, *[i for i in range(1, len(g)) if g[i] != g[i - 1]], len(g)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held and g[lo] != now:
                    yield from cut(pa.Table.from_batches(held))
                    held = []
                now = g[lo]
                held.append(b.slice(lo, hi - lo))
                if sum(x.num_rows for x in held) >= 16 * BLOCK:
                    t = pa.Table.from_batches(held)
                    whole = t.num_rows // BLOCK * BLOCK
                    yield from cut(t.slice(0, whole))
                    held = t.slice(whole).to_batches()
        if held and sum(x.num_rows for x in held):
            yield from cut(pa.Table.from_batches(held))

    table_ = stored(ordered.select("node", "n", "g", "cell", "p", "v").mapInArrow(blocks, f"block bigint, interval bigint, g {g_type}, lo array<double>, hi array<double>, node array<bigint>, n array<bigint>, p array<array<double>>, v array<{v_type}>"))

    # Intervals of blocks that may meet, then blocks that may meet. An interval holds at most INTERVAL blocks of one group.
    box = table_.select("block", "interval", "g", "lo", "hi")
    bounds = [f(F.get(c, i)).alias(f"{c}{i}") for i in range(basis.shape[1]) for f, c in ((F.min, "lo"), (F.max, "hi"))]
    spans = box.groupBy("g", "interval").agg(*bounds)
    spans = spans.select("g", "interval", F.array(*[f"lo{i}" for i in range(basis.shape[1])]).alias("lo"), F.array(*[f"hi{i}" for i in range(basis.shape[1])]).alias("hi"))

    def meeting(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        gap = F.zip_with(F.zip_with("lo", "hi_", lambda a, b: a - b), F.zip_with("lo_", "hi", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b))
        return left.join(right, on).where(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= slack)

    # Near intervals' first-axis cells are the same or neighbours; a pair meets in the first that both hold. Compared in SALTS parts.
    cells_of = lambda name, by: [F.floor(F.get(name, 0) / side).cast("int") + by]
    reach = lambda by: F.explode(F.sequence(cells_of("lo", -by)[0], cells_of("hi", by)[0])).alias("c")
    mine = spans.select("g", "interval", "lo", "hi", F.pmod("interval", F.lit(SALTS)).cast("int").alias("salt"), cells_of("lo", -1)[0].alias("first"), reach(1))
    other = spans.select("g", F.col("interval").alias("interval_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), cells_of("lo", 0)[0].alias("first_"), reach(0))
    other = other.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    far = meeting(mine, other, ["g", "c", "salt"]).where("interval <= interval_ AND c = greatest(first, first_)").select("g", "interval", "interval_")
    near = box.join(far, ["g", "interval"]).select("g", "interval_", "block", "lo", "hi")
    near = meeting(near, box.select("g", F.col("interval").alias("interval_"), F.col("block").alias("block_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_")), ["g", "interval_"]).where("block <= block_")
    near = stored(near.select("block", "block_", "interval_", F.expr(f"block div {interval}").alias("part")))
    # Blocks of one interval are held (turn 0), then the earlier interval's stream past them: each is sent once for a pair of intervals.
    body = table_.select("block", "node", "n", "p", "v")
    sent = lambda column, turn: near.select(F.col(column).alias("block"), "interval_", "part").distinct().join(body, "block").select("interval_", "part", F.lit(turn).alias("turn"), "block", "node", "n", "p", "v")
    streams = sent("block_", 0).unionByName(sent("block", 1)).repartition(parts, "interval_", "part").sortWithinPartitions("interval_", "part", "turn", "block")

    def pair_links(now: tuple, host: tuple) -> Iterator[pa.RecordBatch]:
        (bx, x, px, nx, cx), (by, y, py, ny, cy) = now, host
        same = bx == by
        links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        label = np.arange(len(x) + len(y))
        if same:
            label[len(x) :] = label[: len(x)]
        forest = []
        for a, c, hit in grid_join(x, px, y, py, slack, cosine, same):
            if same and a == c:
                np.fill_diagonal(hit, False)
            links_x[a : a + hit.shape[0]] += hit @ cy[c : c + hit.shape[1]]
            if not same or a != c:
                links_y[c : c + hit.shape[1]] += cx[a : a + hit.shape[0]] @ hit
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                at = c + np.flatnonzero(hit[r])
                other = label[len(x) + at]
                new = other != label[a + r]
                if new.any():
                    for z in np.unique(other[new]).tolist():
                        forest.append((int(nx[a + r]), int(ny[at[other == z][0]])))
                        label[label == z] = label[a + r]
        if same:
            links_x += links_y
            links_y[:] = 0
        some_x, some_y = np.flatnonzero(links_x), np.flatnonzero(links_y)
        k = len(some_x) + len(some_y)
        if k:
            nodes_ = [*nx[some_x].tolist(), *ny[some_y].tolist(), *[e[0] for e in forest]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes_, pa.int64()), pa.array([*links_x[some_x].tolist(), *links_y[some_y].tolist(), *[0] * len(forest)], pa.int64()), pa.array([*[None] * k, *[e[1] for e in forest]], pa.int64())], ["node", "links", "other"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hosts = None, []
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c: b.column(b.schema.get_field_index(c))[i]  # noqa: B023, E731
                v = get("v").values
                p = get("p").values
                now = (get("block").as_py(), _matrix(v, len(v[0])), np.array(p.flatten()).reshape(len(v), -1), get("node").values.to_numpy(), get("n").values.to_numpy())
                if key != (key := (get("interval_").as_py(), get("part").as_py())):
                    hosts = []
                if get("turn").as_py() == 0:
                    hosts.append((now, now[2].min(0), now[2].max(0)))
                    continue
                lo, hi = now[2].min(0), now[2].max(0)
                for host, low, high in hosts:
                    if now[0] <= host[0] and _apart(lo, hi, low, high) <= slack:
                        yield from pair_links(now, host)

    found = stored(streams.mapInArrow(linked, "node bigint, links bigint, other bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = nodes.join(counts, "node", "left").join(roots, "node", "left").select("key", "n", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    of = stored(of)
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(ids, "root").select("key", (F.col("links") + F.col("n") - 1).alias("links"), "component_id")
    out = rows.join(of, "key", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs with equal labels, then everything reachable.
OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS r FROM v
         WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.r * b.r) >= {COSINE}),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT vec_id, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id))::BIGINT AS c FROM v)
"""
