import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.operators import features as X
from spoorline.operators import neighbours as N
from spoorline.operators import propagate as P
from spoorline.operators import scoring as S

ID2 = [[1.0, 0.0], [0.0, 1.0]]


@pytest.fixture
def small(spark):
    nodes = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0]), ("c", [0.0, 0.0])], "entity_key string, vec array<double>")
    edges = spark.createDataFrame([(0, "a", "b"), (1, "a", "b"), (2, "c", "b")], "event_id long, src_key string, dst_key string")
    return nodes, edges


def vecs(df, name="vec"):
    return {r.entity_key: list(r[name]) for r in df.collect()}


def test_mean_counts_parallel_edges_and_isolated_nodes(small):
    got = vecs(P.sage_mean(*small, ID2, ID2))
    assert got["a"] == [1.0, 2.0]
    assert got["b"] == pytest.approx([3 + 2 / 3, 4 + 4 / 3])


def test_sum_layer(small):
    assert vecs(P.gin_sum(*small, [(ID2, [0.0, 0.0])], eps=1.0))["b"] == [8.0, 12.0]


def test_attention_weights_sum_to_one(small):
    nodes, edges = small
    ones = nodes.withColumn("vec", F.array(F.lit(1.0), F.lit(1.0)))
    got = vecs(P.gat_attention(ones, edges, [{"w": ID2, "a_src": [1.0, 0.0], "a_dst": [0.0, 1.0]}]))
    assert all(v == pytest.approx([1.0, 1.0]) for v in got.values()) and set(got) == {"a", "b", "c"}


def test_cosine_of_zero_vector(small):
    nodes, edges = small
    got = {r.event_id: (r.score, r.prediction) for r in S.cosine_edge_anomaly(edges, nodes).collect()}
    assert got[2] == (1.0, 1)


def test_random_features_depend_on_key_only(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("entity_key"))
    a, b = (vecs(X.random_features(df.repartition(n), "entity_key", 4)) for n in (1, 7))
    assert a == b
    flat = np.array(list(a.values())).ravel()
    assert abs(flat.mean()) < 0.1 and abs(flat.std() - 1) < 0.1


def test_softmax_and_argmax(spark):
    row = spark.createDataFrame([([1.0, 1000.0, 3.0],)], "v array<double>").select(V.softmax(F.col("v")).alias("s"), V.argmax(F.col("v")).alias("i")).first()
    assert sum(row.s) == pytest.approx(1) and row.i == 1


def test_onehot_unknown_is_zero(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "t string")
    got = [r.onehot for r in X.onehot(df, "t", ["b", "a"]).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_time_delta_over_slices(events):
    rows = events([("a", "b", t) for t in (0, 10, 4000, 4000, 200000)] + [("c", "b", 5)])
    got = [r.time_delta for r in X.time_delta(rows).where("src_key = 'a'").orderBy("event_id").collect()]
    assert got == [None, 10.0, 3990.0, 0.0, 86400.0]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("block", [7, 4096])
def test_knn_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 5)).round(3)
    x[:40] = x[0]  # a third of all rows is one point
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>")
    got = {r.vec_id: r.score for r in N.knn_anomaly(df, df.where("vec_id < 90"), 6).collect()}
    d = np.sort(1 - unit(x) @ unit(x[:90]).T, axis=1)[:, :6].mean(1)
    assert [got[i] for i in range(120)] == pytest.approx(d.tolist(), abs=1e-9)


def test_contrast_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 5)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 12, 3))
    rows = [(i, w, x[w, i].tolist()) for w in (0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "entity_key long, window_id long, vec array<double>")
    got = {r.entity_key: r.loss for r in N.temporal_contrast(df, 0.5).collect()}
    s = unit(x[1]) @ unit(x[0]).T / 0.5
    want = np.log(np.exp(s).sum(1)) - np.diag(s)
    assert [got[i] for i in range(12)] == pytest.approx(want.tolist())


def test_pluggable_model_streams_batches(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 0.5)
    out = S.score_with_model(df, lambda b: b[["id"]].assign(score=b["x"] + 1), ["id", "x"], "id long, score double")
    assert out.agg(F.sum("score")).first()[0] == 100 + 0.5 * 4950


def test_a_model_sees_whole_windows_in_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(i, i % 3 if i % 5 else None, f"n{i % 11}", f"n{(i * 7) % 13}") for i in range(200)]
    edges = spark.createDataFrame(rows, "event_id long, window_id int, src_key string, dst_key string")

    def count_nodes(key, batches):
        nodes, held, sizes = set(), [], []
        for batch in batches:
            sizes.append(batch.num_rows)
            nodes.update(batch.column("src_key").to_pylist(), batch.column("dst_key").to_pylist())
            held.append(batch.column("event_id"))
        for ids in held:
            yield pa.RecordBatch.from_arrays([ids, pa.array([float(len(nodes))] * len(ids)), pa.array([max(sizes)] * len(ids), pa.int64())], ["event_id", "score", "size"])

    try:
        got = S.score_with_model(edges, count_nodes, ["event_id", "src_key", "dst_key"], "event_id long, score double, size long", ["window_id"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for _, w, s, d in rows:
        want.setdefault(w, set()).update((s, d))
    assert {r.event_id: r.score for r in got} == {i: float(len(want[w])) for i, w, _, _ in rows}
    assert max(r["size"] for r in got) <= 7


def test_words_of_equal_contexts_lie_closer(spark):
    animals = [f"the {a} {v} on the mat today" for a in ("cat", "dog") for v in ("sat", "slept", "ate")]
    traffic = [f"a {c} {v} down some road quickly" for c in ("car", "bus") for v in ("drove", "raced", "rolled")]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(animals + traffic)] + [(100, None), (101, ""), (102, "lonely"), (103, "Dog"), (104, "cat!")], "id int, text string")
    vec = {r.word: np.array(r.vec) for r in X.word_vectors(texts, "text", 64).collect()}
    assert vec["cat"] @ vec["dog"] > 0.95 and vec["car"] @ vec["bus"] > 0.95
    assert abs(vec["cat"] @ vec["car"]) < 0.6 and all(abs(v @ v - 1) < 1e-9 for v in vec.values())
    out = {r.id: np.array(r.vec) for r in X.text_embeddings(texts, "text", "id", 64).collect()}
    assert len(out) == texts.count() and all(not out[i].any() for i in (100, 101, 102))
    assert np.allclose(out[103], vec["dog"]) and np.allclose(out[104], vec["cat"])
    assert out[0] @ out[3] > out[0] @ out[7]
    assert X.text_embeddings(texts.limit(0), "text", "id", 4).count() == 0


def test_word_vectors_write_no_table_of_pairs(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    texts = spark.createDataFrame([(i, " ".join(words[(i * 7 + j * (i + 1)) % 40] for j in range(30))) for i in range(40)] + [(40, None), (41, "w1")], "id int, text string")
    sizes = []
    monkeypatch.setattr(X, "cut", lambda df, keep=X.cut: (table := keep(df), sizes.append(table.count()))[0])
    all_sent = {r.id: np.array(r.vec) for r in X.text_embeddings(texts, "text", "id", 20).collect()}
    assert max(sizes) <= len(words)
    # the same rows whether all, some or no words are sent to the tasks
    for sent in (20 * 15, 0):
        got = {r.id: np.array(r.vec) for r in X.text_embeddings(texts, "text", "id", 20, sent=sent).collect()}
        assert got.keys() == all_sent.keys() and all(np.allclose(got[i], all_sent[i]) for i in got)
