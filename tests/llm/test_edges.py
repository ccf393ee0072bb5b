"""Every registered query, and each stage of the pipeline, over tables that are empty or full of odd rows."""

import os

import pytest

import corpus_pipeline
from quiverlake.llm import registry

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
EXTRA = ["id", "key", "row", "n", "band", "label", "core", "kept", "size", "start", "index", "blocks", "found", "src", "page", "w", "t"]
LONG = " ".join(f"word{i * i % 9973} 7" for i in range(60_000)) + " " + "x" * 300_000


def rows():
    syllables = ["an", "ber", "co", "del", "em", "fir", "gol", "hun", "ist", "jor", "kel"]
    words = [a + b for a in syllables for b in syllables]
    base = " ".join(w + "." * (i % 9 == 8) for i, w in enumerate(words)) + "\n" + " ".join(reversed(words)) + "."
    odd = [(None, None), (None, "text of a row without an id"), (1, None), (2, ""), (3, " \n\t "), (4, base), (4, base), (5, base), (6, base.replace("cofir", "cofur", 1)), (7, "é\x00\U0001f600 " * 40), (8, LONG), (9, "a.b@c.org 10.0.0.1"), (9, "other text of the same id")]
    return [(i, t, "en", None if k % 3 == 0 else f"s{k % 2}", None if t is None else len(t)) for k, (i, t) in enumerate(odd)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def data(request, spark, tmp_path_factory):
    d, few = str(tmp_path_factory.mktemp(request.param)), (lambda x: x) if request.param == "odd" else (lambda x: [])
    more = lambda df: df.selectExpr("*", *[f"cast(length(cast({df.columns[0]} as string)) as bigint) AS `{c}`" for c in EXTRA if c not in df.columns])
    more(spark.createDataFrame(few(rows()), DOCUMENTS)).write.parquet(f"{d}/documents.parquet")
    more(spark.createDataFrame(few([(4, 1, 1), (5, None, None), (None, 0, 1), (9, 0, 0), (9, 0, 0)]), "doc_id bigint, quality int, toxic int")).write.parquet(f"{d}/labels.parquet")
    vectors = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, None, 1), (None, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, [float("inf"), 1.0], 1), (6, [1.0, None], 1), (7, [1.0, 0.0], None), (8, [], 1), (9, [1.0, 0.0, 0.0], 1)]
    more(spark.createDataFrame(few(vectors), "vec_id bigint, embedding array<float>, label int")).write.parquet(f"{d}/embeddings.parquet")
    pages = [(None, None, None), (1, "http://h/a", "<article><p>one</p></article>"), (1, "http://h/a", "<article><p>one</p></article>"), (2, "http://h/b", ""), (3, None, "<p>" + LONG), (4, "http://h/c", "<<<>>> </ <! & &#0; &amp;lt;")]
    more(spark.createDataFrame(few(pages), "page_id bigint, url string, html string")).write.parquet(f"{d}/pages.parquet")
    return request.param, d


def key(x):
    return (x is None, x or 0)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    kind, d = data
    if "bpe" in name:
        pytest.importorskip("public_tokenizers")
    got = registry.queries()[name](spark, d).collect()
    table, column = ("embeddings", "vec_id") if name.startswith("op1_") else ("pages", "page_id") if name.startswith("op4_") else ("documents", "doc_id")
    want = [r[0] for r in spark.read.parquet(f"{d}/{table}.parquet").select(column).collect()]
    assert sorted((r[column] for r in got), key=key) == sorted(want, key=key)
    if kind == "empty":
        assert got == []
        return
    if name.startswith("op1_"):
        by = {r.vec_id: r for r in got}
        assert (by[1].n_links, by[2].n_links, by[2].component_id, by[None].component_id) == (3, 3, 1, 1)
        assert all((by[i].n_links, by[i].component_id) == (0, i) for i in (3, 4, 5, 6, 7, 8, 9))
    if name.startswith("op10_"):
        assert {r.class_id for r in got if r.doc_id in (4, 5)} == {4} and [r.class_id for r in got if r.doc_id in (1, 2)] == [1, 2]
    if name.startswith("op4_"):
        assert [r.text for r in got if r.page_id in (None, 1, 2)].count("one") == 2


def test_stages(spark, data):
    """Each stage on the one before; all but the last give the columns of documents."""
    pytest.importorskip("public_tokenizers")
    kind, d = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        path = f"{d}/{name.replace(' ', '-')}.parquet"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        counts[name] = docs.count()
    if kind == "empty":
        assert set(counts.values()) == {0}
    else:
        assert counts["quality rules"] >= counts["near-dedup"] == counts["pii"] > 0 and counts["mixing"] == counts["byte-level bpe"]
        assert sorted(r.n_tokens for r in docs.collect())[0] > 0


def test_pipeline(spark):
    """The whole run: a row for each row of the mix, and every text decoded to itself."""
    pytest.importorskip("public_tokenizers")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    stages = {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path_rows = stage(spark, docs, d)
        docs = spark.createDataFrame(path_rows.collect(), path_rows.schema)
        stages[name] = docs
    got = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()))
    import hashlib

    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r[0], r[3]) for r in got) == want
    quality = {r.doc_id for r in registry.queries()["op2_quality_rules"](spark, d).where("kept").collect()}
    assert {r.doc_id for r in stages["quality rules"].select("doc_id").collect()} == quality
    assert stages["near-dedup"].select("doc_id").distinct().count() == stages["near-dedup"].count()
    assert not any("@" in r.text and "[EMAIL]" not in r.text and __import__("re").search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", r.text) for r in stages["pii"].collect())
