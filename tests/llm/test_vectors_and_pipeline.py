import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import ann, embed_dedup, queries
from netloom.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((150, 16))
    near = base[:5].repeat(6, axis=0) + 0.02 * r.standard_normal((30, 16))
    x = np.concatenate([base, near, base[:8].repeat(3, axis=0)]).astype(np.float32).tolist()
    rows = [(i, v, 0, 0) for i, v in enumerate(x)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0, 2.0]]
    rows += [(500 + i, v, 1, 0) for i, v in enumerate(bad)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key int").repartition(4)


def arrays(vectors):
    rows = [r for r in vectors.orderBy("vec_id").collect() if r.vec_id < 500]
    x = np.array([r.embedding for r in rows], np.float64)
    return np.array([r.vec_id for r in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_embed_dedup(spark, vectors):
    ids, x = arrays(vectors)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    comp = np.arange(len(ids))
    for _ in range(len(ids)):
        comp = np.array([min([comp[i], *comp[close[i]]]) for i in range(len(ids))])
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(vectors).collect()}
    for i in ids:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (close[i].sum(), comp[i], comp[i] == i)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(500, 507))
    assert embed_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_embed_blocks_agree(spark, vectors, monkeypatch):
    want = sorted(map(tuple, embed_dedup.near_duplicates(vectors).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 5)
    assert sorted(map(tuple, embed_dedup.near_duplicates(vectors).collect())) == want


def test_ann_recall_and_rules(spark, vectors):
    ids, x = arrays(vectors)
    queries_ = np.flatnonzero(ids % 5 == 0)
    truth = ann.brute_force(x, ids, queries_)
    rows = ann.search(vectors, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(ids[queries_].tolist())
    recall = np.mean([len({r.vec_id for r in got[ids[q]]} & set(t)) / 5 for q, t in zip(queries_, truth)])
    assert recall >= 0.9
    for q, found in got.items():
        assert [r.rank for r in found] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert np.allclose([r.score for r in found], [x[q] @ x[r.vec_id] for r in found])
    assert ann.search(vectors.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = ann.search(vectors.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2


def test_ann_copies_tie_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(50)], "vec_id long, embedding array<float>, label int")
    got = [r.vec_id for r in ann.search(df, F.col("vec_id") == 2).orderBy("rank").collect()]
    assert got == [0, 1, 3, 4, 5]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 3), (3, 5), (7, 7), (None, 4)] + [(200, i) for i in range(201, 260)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r.id: r.component_id for r in components(df).collect()}
    want = {i: 100 for i in range(100, 161)} | {3: 3, 5: 3} | {i: 200 for i in range(200, 260)}
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as P
    from netloom.llm.common import documents, materialize

    docs = documents(spark, sf)
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in P.STAGES] == ["quality_filter", "template_lines", "near_copies", "secrets_redacted", "packed"]
    seen = []
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, sf))
        seen.append((name, docs))
        if name != "packed":
            assert docs.columns == P.COLUMNS
            rows = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in rows.values())
            if name == "quality_filter":
                wrong = sum((i in rows) != bool(q) for i, q in labels.items())
                assert wrong <= 0.1 * len(labels) and all(rows[i].text == before[i] for i in rows)
    kept = {r.doc_id for r in seen[3][1].collect()}
    assert kept == {r.doc_id for r in seen[4][1].select("doc_id").distinct().collect()}
    assert P.ORACLE_SQL is None


def test_pipeline_edge_rows(spark, tmp_path):
    import corpus_pipeline as P

    rows = [(1, None, "en", None, 0, 7), (2, "", "en", "s", 0, 7), (2, "", "en", "s", 0, 7), (None, "some words to keep here today", None, "s", 1, 7), (4, "word " * 5000, "en", "s", 1, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int")
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (df, df.limit(0)):
        docs = frame
        for _, stage in P.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            docs.count()


def test_registered_queries():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}


def test_equal_vectors_are_one_class(spark):
    rows = spark.range(20_000).selectExpr("id AS vec_id", "CASE WHEN id % 100 = 7 THEN array(1.0D, 0.05D, 0.0D) WHEN id = 50 THEN array(0.0D, 0.0D, -1.0D) ELSE array(2.0D, 0.0D, 0.0D) END AS embedding")
    got = {(r.n_links, r.component_id, r["count"]) for r in embed_dedup.near_duplicates(rows).groupBy("n_links", "component_id").count().collect()}
    assert got == {(19_998, 0, 19_999), (0, 50, 1)}
    members, found = embed_dedup.links(rows)
    assert members.select("rep").distinct().count() == 3 and found.count() < 20


def test_queries_go_to_near_leaves_only(spark):
    random = np.random.default_rng(8)
    centres = random.standard_normal((16, 32)) * 5
    x = np.repeat(centres, 100, axis=0) + random.standard_normal((1600, 32)) * 0.05
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    forest = ann.Forest(ann.V.unit(x))
    found, indexed, asked = ann.candidates(df, df.where("vec_id % 50 = 0"), forest, 5, ann.SEARCH)
    seen = asked.join(indexed, "leaf").select("query_id", "vec_id").distinct().count()
    assert seen < 0.2 * 32 * 1600 and indexed.count() <= 1600 * ann.TREES
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    truth = ann.brute_force(x, np.arange(1600), np.arange(0, 1600, 50))
    assert sum(len(got[50 * i] & set(t)) for i, t in enumerate(truth)) >= 0.95 * 160


def test_lengths_are_searched_apart_and_ids_repeat(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.2]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (5, [1e300, 1e299])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(df, F.col("vec_id").isin(1, 3)).collect()}
    assert got in ({(1, 1): 2, (1, 2): 5, (3, 1): 4}, {(1, 1): 5, (1, 2): 2, (3, 1): 4})
