import pytest
from pyspark.sql import functions as F

from quiverlake.functions.metrics import centroids, metric, squared_l2
from quiverlake.operators import index as ix
from quiverlake.operators import topk
from quiverlake.sources.config import boolean, read_config, unsigned
from quiverlake.sources.snapshot import load, save
from quiverlake.sources.vector_file import read_vectors, synthetic_vectors, write_vectors
from quiverlake.streaming import mutations

FLOATS = [
    (1, [0.2, 25.6, -12.2, 1.112, 36.0, 7.5, -3.3, 8.8]),
    (2, [9.1, -4.6, 5.5, 2.2, 3.3, -1.1, 6.6, 7.7]),
    (3, [8.8, 9.9, -10.1, 11.2, 12.3, -13.4, 14.5, 15.6]),
]


def ramp(spark, n=32):
    return spark.createDataFrame([(r, [4 * r + i for i in (1, 2, 3, 4)]) for r in range(n)], "id bigint, vec array<int>")


def test_float_distances_and_centroid(spark):
    v = spark.createDataFrame(FLOATS, "id bigint, vec array<float>")
    pairs = v.alias("a").join(v.alias("b"), F.col("a.id") < F.col("b.id")).select("a.id", F.col("b.id").alias("b"), squared_l2(F.col("a.vec"), F.col("b.vec")).alias("d"))
    assert {(r[0], r[1]): r[2] for r in pairs.collect()} == {(1, 2): 2548.1937629297554, (1, 3): 1788.2077410752365, (2, 3): 891.8099987649927}
    mean = centroids(v, [], integer=False).first()["vec"]
    assert mean == pytest.approx([6.0333333, 10.3, -5.6, 4.8373332, 17.199999, -2.3333333, 5.9333329, 10.7], abs=1e-5)


def test_single_cluster_and_tree_search(spark):
    one = ix.exact_knn(ramp(spark, 8), spark.createDataFrame([(0, [12, 14, 15, 16])], "qid bigint, q array<int>"), 3)
    assert [(r.vec_id, r.distance) for r in one.orderBy("rank").collect()] == [(3, 1), (2, 57), (4, 73)]
    index = ix.build(ramp(spark), ix.Attributes(dimension=4, leaf_max=8, leaf_min=2, internal_max=4, internal_min=1), 6)
    q = spark.createDataFrame([(0, [5, 15, 6, 17])], "qid bigint, q array<int>")
    assert [(r.vec_id, r.distance) for r in ix.ann_search(index, q, 6, 10, 10).orderBy("rank").collect()] == [(2, 91), (3, 147), (1, 163), (4, 331), (0, 363), (5, 643)]


def test_edges(spark):
    a = ix.Attributes(dimension=4, leaf_max=8, leaf_min=2, internal_max=4, internal_min=1)
    q = spark.createDataFrame([(0, [5, 15, 6, 17])], "qid bigint, q array<int>")
    empty = ix.build(ramp(spark, 0), a, 1)
    assert ix.ann_search(empty, q, 3, 2, 2).count() == 0 and ix.size(empty).first()["n"] == 0
    assert ix.exact_knn(ramp(spark, 3), q, 10).count() == 3
    for bad in (lambda: ix.ann_search(empty, q, 0, 1, 1), lambda: ix.ann_search(empty, q, 1, 0, 1), lambda: ix.Attributes(dimension=4, leaf_max=2, leaf_min=2), lambda: metric("cosine"), lambda: topk.ordered(q, "sideways")):
        with pytest.raises(ValueError):
            bad()
    index = ix.build(ramp(spark), a, 6)
    everything = ramp(spark).select(F.col("id").alias("vec_id"))
    assert ix.size(ix.delete(index, everything)).first()["n"] == 0
    assert ix.not_found(index, spark.createDataFrame([(5,), (99,), (99,)], "vec_id bigint")).collect() == [(99,)]
    half = everything.where("vec_id < 16")
    back = ix.append(ix.compact(ix.delete(index, half)), ramp(spark).where("id < 16"), 10)
    assert ix.size(back).first()["n"] == 32
    assert back.members.where("level = 1 AND state = 1").groupBy("child_id").count().where("count > 1").count() == 0


def test_files_config_snapshot(spark, tmp_path):
    for kind, width in (("u8", 3), ("f32", 10), ("u8", 128)):
        v = spark.range(50).select("id", F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.col("id") * i % 251).cast("int" if kind == "u8" else "float")).alias("vec"))
        write_vectors(v, f"file://{tmp_path}/{kind}{width}.bin", kind)
        back = read_vectors(spark, f"file://{tmp_path}/{kind}{width}.bin", kind, split=256)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, v.collect()))
        with pytest.raises(ValueError):
            read_vectors(spark, f"file://{tmp_path}/{kind}{width}.bin", kind, dimension=width + 1)
    assert read_config("a : 1\n# x\n\nb: [1, 2 ]") == {"a": "1", "b": ["1", "2"]}
    assert unsigned("7", 1, 9) == 7 and boolean("true")
    with pytest.raises(ValueError):
        unsigned("10", 1, 9)
    index = ix.build(ramp(spark), ix.Attributes(dimension=4), 6)
    save(index, f"{tmp_path}/s")
    assert ix.size(load(spark, f"{tmp_path}/s")).first()["n"] == 32
    s = synthetic_vectors(spark, 2000, 4, mean=5, stddev=2, alpha=0)
    assert abs(s.select(F.avg(F.col("vec")[0])).first()[0] - 5) < 0.3


def test_mutation_stream(spark, tmp_path):
    index = ix.build(ramp(spark), ix.Attributes(dimension=4), 6)
    save(index, f"{tmp_path}/0")
    rows = [(1, "delete", 3, None), (2, "insert", 100, [1, 2, 3, 4]), (3, "insert", 101, [9, 9, 9, 9]), (4, "delete", 101, None)]
    spark.createDataFrame(rows, "seq bigint, op string, vec_id bigint, vec array<int>").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("seq bigint, op string, vec_id bigint, vec array<int>").parquet(f"{tmp_path}/in")
    mutations.start(stream, str(tmp_path), f"{tmp_path}/cp").awaitTermination()
    after = load(spark, f"{tmp_path}/1").members.where("level = 1 AND state = 1")
    assert sorted(r[0] for r in after.select("child_id").collect()) == sorted({*range(32), 100} - {3})


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
