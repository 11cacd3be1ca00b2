import math
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelake.functions import vector as V
from notelake.operators import embed, generators, hnsw_file, knn, metrics
from notelake.operators.hnsw import HNSW, HNSWConfig


@pytest.fixture()
def three(spark):
    return spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.8, 0.6, 0.0]), ("c", [0.0, 1.0, 0.0])], "id string, vec array<float>")


def ask(spark, *vecs):
    return spark.createDataFrame([(f"q{i}", list(map(float, v))) for i, v in enumerate(vecs)], "query_id string, qvec array<float>")


@pytest.mark.parametrize("strategy", ["exact", "expression", "ivf", "lsh", "hnsw"])
def test_top_two(spark, three, strategy):
    rows = knn.knn(three, ask(spark, [1, 0, 0]), 2, 3, strategy).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "b"] and abs(rows[1]["score"] - 0.8) < 1e-6


@pytest.mark.parametrize("strategy", ["exact", "expression"])
def test_limits_empty_and_ties(spark, three, strategy):
    assert knn.knn(three, ask(spark, [1, 0, 0]), 100, 3, strategy).count() == 3
    assert knn.knn(three, ask(spark, [1, 0, 0]), 0, 3, strategy).count() == 0
    assert knn.knn(three, ask(spark, [1, 0, 0]), -1, 3, strategy).count() == 0
    assert knn.knn(three.limit(0), ask(spark, [1, 0, 0]), 2, 3, strategy).count() == 0
    same = spark.createDataFrame([("z", [1.0, 0.0]), ("m", [1.0, 0.0]), ("a", [1.0, 0.0])], "id string, vec array<float>")
    assert [r["id"] for r in knn.knn(same, ask(spark, [1, 0]), 2, 2, strategy).orderBy("rank").collect()] == ["a", "m"]


def test_wrong_dimension_fails(spark, three):
    with pytest.raises(Exception, match="dimension"):
        knn.knn(three, ask(spark, [1, 0]), 2, 3).collect()


def directions(n, d, seed):
    """Vectors around a few centres, as far apart as a centre is long; like G2, with a third as many centres as dimensions."""
    rng = np.random.default_rng(seed)
    x = np.random.default_rng(99).normal(size=(d // 3, d))[rng.integers(0, d // 3, n)] + 0.7 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("share", [0.0, 0.01])
@pytest.mark.parametrize("strategy", ["ivf", "lsh"])
def test_recall_of_buckets_and_cells(spark, strategy, share):
    x, q = directions(3000, 32, 5), directions(20, 32, 6)
    x[np.random.default_rng(7).random(len(x)) < share] *= 10
    v = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], "id string, vec array<float>")
    truth = knn.knn(v, ask(spark, *q), 10, 32)
    found = knn.knn(v, ask(spark, *q), 10, 32, strategy)
    assert metrics.index_recall(truth, found).agg(F.avg("recall")).first()[0] >= 0.9


@pytest.mark.parametrize("strategy", ["ivf", "lsh"])
def test_what_no_bucket_holds_is_scored(spark, strategy):
    v = spark.createDataFrame([(str(i), [-1.0, 0.001 * i, *[0.0] * 6]) for i in range(200)], "id string, vec array<float>")
    rows = knn.knn(v, ask(spark, [1, 0] + [0] * 6, [0, 1] + [0] * 6), 250, 8, strategy).collect()
    assert len(rows) == 400 and len({(r["query_id"], r["id"]) for r in rows}) == 400


def test_more_queries_than_a_block(spark, three):
    rows = knn.knn_lsh(three, ask(spark, [1, 0, 0], [0, 1, 0], [0, 0, 1]), 1, 3, block=2).collect()
    assert {(r["query_id"], r["id"]) for r in rows} == {("q0", "a"), ("q1", "c"), ("q2", "a")}


def test_best_of_breaks_ties_by_column():
    s = np.array([[1.0, 3.0, 3.0, np.nan, 2.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    r, j = knn.best_of(s, 2)
    assert r.tolist() == [0, 0, 1, 1] and j.tolist() == [1, 2, 0, 1]
    assert [x.tolist() for x in knn.best_of(s, 9)] == [[0] * 5 + [1] * 5, [1, 2, 4, 0, 3, 0, 1, 2, 3, 4]]


@pytest.mark.parametrize("strategy", [knn.knn_matrix, knn.knn_ivf, knn.knn_lsh, knn.knn_hnsw])
def test_any_number_of_queries_in_blocks(spark, strategy):
    x = vectors(400, 16)
    v = spark.createDataFrame([(f"v{i:03d}", r.tolist()) for i, r in enumerate(x)], "id string, vec array<float>")
    got = strategy(v, ask(spark, *x[:30]), 1, 16, block=7).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(f"q{i}", f"v{i:03d}") for i in range(30)}


def test_a_kept_index_is_searched_and_read(spark):
    x = vectors(300, 12)
    v = spark.createDataFrame([(f"id {i}", r.tolist()) for i, r in enumerate(x)] + [("id 0", x[0].tolist())], "id string, vec array<float>")
    index = hnsw_file.build(v, 120, HNSWConfig(m=4))
    assert index.count() == 3
    nodes = hnsw_file.nodes_of(index)
    assert hnsw_file.stats(nodes).first()["live_count"] == 300 and nodes.agg(F.max("level")).first()[0] >= 1
    one = index.where("shard = 0").first()
    again = hnsw_file.load(bytes(one["data"]), HNSWConfig(m=4))
    q = again.x[:20]
    assert (again.search(q, 1)[0][:, 0] == np.arange(20)).all()
    assert hnsw_file.name_of(str(uuid.UUID(int=7))) == str(uuid.UUID(int=7)) and uuid.UUID(hnsw_file.name_of("id 3"))


def test_large_layers_are_built_by_search():
    """Beyond `paired` nodes a layer's candidates come from searching the graph of those before."""
    x = vectors(1500, 16)
    ids, _ = HNSW(x, HNSWConfig(m=8, paired=200)).search(x, 5)
    truth = np.argsort(-(x @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, truth, strict=True)]) >= 0.9


def test_upsert_and_remove(spark, three):
    v = three.withColumn("version", F.lit(0))
    new = spark.createDataFrame([("a", [0.0, 0.0, 1.0], 1)], "id string, vec array<float>, version int")
    up = knn.upsert(v, new)
    assert up.count() == 3
    assert knn.knn(up.select("id", "vec"), ask(spark, [0, 0, 1]), 1, 3).first()["id"] == "a"
    left = knn.remove(up, spark.createDataFrame([("a",), ("unknown",)], "id string"))
    assert sorted(r["id"] for r in left.collect()) == ["b", "c"]
    assert knn.remove_all(up).count() == 0
    one = knn.upsert(v.where("id = 'a'"), new)  # one vector, replaced: found, where a tombstoned graph would find none
    assert knn.knn(one.select("id", "vec"), ask(spark, [0, 0, 1]), 1, 3).first()["score"] == 1.0
    assert not knn.must_compact(100, 100 // 2) and knn.must_compact(199, 101) and not knn.must_compact(0, 64)


def test_vector_expressions(spark, three):
    r = three.where("id = 'b'").select(
        V.norm(F.col("vec")).alias("n"), V.cosine(F.col("vec"), F.array(*[F.lit(0.0)] * 3)).alias("zero"),
        V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.l2_normalize(F.array(F.lit(0.0))).alias("z"),
    ).first()
    assert abs(r["n"] - 1) < 1e-6 and r["zero"] is None and r["u"] == [0.6, 0.8] and r["z"] == [0.0]
    b = spark.createDataFrame([([1.5, -2.0, 0.0, 3.25],), (None,)], "v array<float>").select("v", V.to_bytes("v").alias("b")).select("v", "b", V.from_bytes("b").alias("w")).collect()
    assert b[0]["v"] == b[0]["w"] and len(b[0]["b"]) == 16 and b[1]["w"] is None
    bad = spark.createDataFrame([([1.0, None],), ([float("nan"), 0.0],), ([float("inf"), 0.0],), ([1.0],), (None,), ([0.0, 1.0],)], "v array<float>")
    assert [r[0] for r in bad.select(V.is_valid(F.col("v"), 2)).collect()] == [False] * 5 + [True]


def test_mock_embedding():
    a, b = embed.mock_vector("passage: x", 8), embed.mock_vector("passage: y", 8)
    assert np.array_equal(a, embed.mock_vector("passage: x", 8)) and not np.array_equal(a, b)
    assert abs(np.linalg.norm(a) - 1) < 1e-4 and (a >= 0).all()
    texts = ["", "x", "字" * 40, "x", "some words"]
    assert np.array_equal(embed.mock_vectors(texts, 8), np.stack([embed.mock_vector(t, 8) for t in texts]))
    # Empty text: the seed is the FNV basis itself.
    state = (0xCBF29CE484222325 * 6364136223846793005 + 1442695040888963407) % 2 ** 64
    raw = [state >> 33]
    state = (state * 6364136223846793005 + 1442695040888963407) % 2 ** 64
    raw.append(state >> 33)
    assert np.allclose(embed.mock_vector("", 2), np.array(raw) / math.hypot(*raw), atol=1e-6)


def test_pending_embeddings_are_filled_once(spark):
    c = spark.createDataFrame([("a", 1, 0, "x", None), ("b", 1, 1, "y", [1.0] * 8)], "chunk_id string, note_id long, chunk_index int, content string, embedding array<float>")
    fixed = spark.createDataFrame([("passage: x", [0.0] * 7 + [1.0])], "text string, vec array<float>")
    full, done = embed.embed_pending(c, embed.mock_embedder(8), fixed)
    assert done.count() == 1 and done.first()["embedding"][7] == 1.0 and full.count() == 2
    assert embed.embed_pending(full, embed.mock_embedder(8))[1].count() == 0


def test_pooling_and_tokens(spark):
    r = spark.range(1).select(
        embed.mean_pool(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))).alias("p"),
        embed.truncate_tokens(F.sequence(F.lit(1), F.lit(600))).alias("t"), embed.truncate_tokens(F.sequence(F.lit(1), F.lit(5))).alias("s"),
    ).first()
    assert np.allclose(r["p"], [0.6, 0.8]) and len(r["t"]) == 512 and r["t"][-1] == 600 and r["t"][510] == 511 and r["s"] == [1, 2, 3, 4, 5]


def vectors(n, d, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n,d,ef,least", [(200, 16, 256, 1.0), (1000, 64, 64, 0.95), (1, 4, 8, 1.0), (2, 4, 8, 1.0)])
def test_hnsw_recall(n, d, ef, least):
    x = vectors(n, d)
    q = vectors(50, d, 1)
    k = min(10, n)
    ids, sims = HNSW(x, HNSWConfig(m=16, ef_construction=200, ef_search=ef)).search(q, k)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :k]
    assert np.mean([len(set(a) & set(b)) / k for a, b in zip(ids, truth, strict=True)]) >= least
    assert (np.diff(sims, axis=1) <= 1e-6).all()


def test_hnsw_copies_and_empty():
    x = np.repeat(vectors(3, 8), 100, axis=0)
    ids, _ = HNSW(x, HNSWConfig(m=8)).search(x[:5], 10)
    assert (ids >= 0).all() and all(len(set(r)) == 10 for r in ids)
    assert HNSW(np.zeros((0, 8), np.float32)).search(x[:2], 3)[0].tolist() == [[-1] * 3] * 2


def test_hnsw_file_round_trip_and_corruption(spark, tmp_path):
    x = vectors(150, 12)
    index = HNSW(x, HNSWConfig(m=6))
    ids = [str(uuid.UUID(int=i + 1)) for i in range(len(x))]
    data = hnsw_file.encode(index, ids, 6)
    hnsw_file.write(str(tmp_path / "i.hnsw"), data)
    nodes = hnsw_file.read(spark, str(tmp_path))
    rows = nodes.orderBy("node").collect()
    assert [r["id"] for r in rows] == ids and np.allclose([r["vec"] for r in rows], x, atol=1e-6)
    s = hnsw_file.stats(nodes).first()
    assert s["live_count"] == 150 and s["approximate_bytes"] == 4 * 150 * 12 + 16 * 150 + 4 * s["total_links"]
    for bad in (b"", data[:40], data[:-3], b"\0" * 4 + data[4:], data + b"x", data[:-4] + b"\xff\xff\xff\x7f", data[:24] + b"\xff\xff\xff\xff" + data[28:]):
        with pytest.raises((hnsw_file.CorruptFile, Exception)):
            hnsw_file.decode(bad)
    assert hnsw_file.decode(hnsw_file.encode(HNSW(np.zeros((0, 3), np.float32)), [], 6)) == []


def test_generators(spark):
    for make in (generators.uniform_vectors, generators.clustered_vectors):
        a = np.array([r["vec"] for r in make(spark, 60, 16).orderBy("id").collect()])
        b = np.array([r["vec"] for r in make(spark, 60, 16).orderBy("id").collect()])
        assert np.array_equal(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-5)


def test_best_groups_equals_all_scores(spark):
    x, q = vectors(300, 8), vectors(4, 8, 2)
    v = spark.createDataFrame([(str(i), int(i % 40), r.tolist()) for i, r in enumerate(x)], "id string, group long, vec array<float>")
    got = {(r["query_id"], r["rank"]): r["group"] for r in knn.best_groups(v, ask(spark, *q), 5, 8).collect()}
    s = q.astype(float) @ x.astype(float).T
    for i in range(4):
        best = np.array([s[i][np.arange(300) % 40 == g].max() for g in range(40)])
        assert [got[(f"q{i}", k + 1)] for k in range(5)] == np.argsort(-best, kind="stable")[:5].tolist()


def test_metrics(spark):
    queries = spark.createDataFrame([("q-en-1",), ("q-ja-1",), ("q-ja-2",), ("q-ja-3",)], "query_id string")
    rel = spark.createDataFrame([("q-en-1", "a", 2), ("q-en-1", "b", 1), ("q-ja-1", "a", 0), ("q-ja-3", "z", 1)], "query_id string, note_id string, grade int")
    ranked = spark.createDataFrame([(q, n, r) for q in ("q-en-1", "q-ja-1", "q-ja-2", "q-ja-3") for r, n in enumerate(["b", "a", "c"], 1)], "query_id string, note_id string, rank int")
    rec = {r["query_id"]: r["recall"] for r in metrics.recall_at(queries, rel, ranked, 10).collect()}
    assert rec == {"q-en-1": 1.0, "q-ja-1": 1.0, "q-ja-2": 1.0, "q-ja-3": 0.0}
    ndcg = {r["query_id"]: r["ndcg"] for r in metrics.ndcg_at(queries, rel, ranked, 10).collect()}
    want = (1 / math.log2(2) + 3 / math.log2(3)) / (3 / math.log2(2) + 1 / math.log2(3))
    assert abs(ndcg["q-en-1"] - want) < 1e-9 and ndcg["q-ja-1"] == 1.0 and ndcg["q-ja-2"] == 1.0 and ndcg["q-ja-3"] == 0.0
    assert metrics.failures(queries, rel, ranked).first()["top3"] == "b,a,c"
    s = {r["lang"]: (r["n_queries"], r["recall"]) for r in metrics.summary(queries, rel, ranked).collect()}
    assert s["EN"] == (1, 1.0) and s["ALL"] == (4, 0.75)
    truth = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, id string")
    found = spark.createDataFrame([("q", "b"), ("q", "c"), ("other", "x")], "query_id string, id string")
    assert {r["query_id"]: r["recall"] for r in metrics.index_recall(truth, found).collect()} == {"q": 0.5, "other": 1.0}
    assert {r["query_id"]: r["recall"] for r in metrics.index_recall(truth, found, 0.0).collect()}["other"] == 0.0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-10, 10, width=32), min_size=4, max_size=4), min_size=1, max_size=40))
def test_hnsw_never_returns_a_node_twice(rows):
    x = np.array(rows, np.float32)
    ids, _ = HNSW(x, HNSWConfig(m=4, ef_construction=16, ef_search=16)).search(x, 5)
    for r in ids:
        r = [i for i in r if i >= 0]
        assert len(r) == len(set(r)) and len(r) >= 1
