import pytest
from pyspark.sql import functions as F

from spoorline.operators import graph as G
from spoorline.operators import ranking
from spoorline.operators import windows as W


def test_gap_windows(events):
    got = W.tumbling_windows(events([("a", "b", 0), ("a", "b", 10000), ("a", "b", 10001)]), 3600).orderBy("ts_s").collect()
    assert [r.window_id for r in got] == [0, 2, 2]
    assert W.tumbling_windows(events([("a", "b", 0), ("a", "b", 10000)]), 0).select("window_id").distinct().count() == 1


def test_last_instant_and_single_instant(events):
    two = events([("a", "b", 0), ("a", "b", 3600)])
    assert W.sliding_windows(two, 3600, overlap=0.0).select("event_id").distinct().count() == 2
    assert W.sliding_windows(two, 3600, overlap=0.0, compat=True).select("event_id").distinct().count() == 1
    one = events([("a", "b", 5), ("a", "b", 5)])
    assert W.sliding_windows(one, 3600).select("window_id").distinct().count() == 1
    assert W.sliding_windows(one, 3600, compat=True).count() == 0


def test_every_event_is_in_size_over_stride_windows(events):
    rows = events([("a", "b", i * 13.7) for i in range(300)])
    counts = W.sliding_windows(rows, 100, stride=30).groupBy("event_id").count().collect()
    assert len(counts) == 300 and max(r["count"] for r in counts) <= 4
    wrong = W.sliding_windows(rows, 100, stride=30).where("ts_s < window_start or ts_s >= window_end")
    assert wrong.count() == 0


def test_self_loop_only_entity_is_a_node(events):
    rows = events([("a", "a", 0), ("b", "c", 1)])
    assert {r.entity_key for r in G.build_nodes(rows).collect()} == {"a", "b", "c"}
    assert G.remove_self_loops(rows).count() == 1


def test_parallel_edges(events):
    rows = events([("a", "b", 0, "t", 9), ("a", "b", 1, "t", 1)])
    assert [r.score for r in G.simple_digraph(rows).collect()] == [1.0]
    assert [r.score for r in G.simple_digraph(rows, "max_score").collect()] == [9.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_node_ids_do_not_depend_on_partitioning(events, parts):
    rows = events([(f"p:{i * 7 % 50}", f"f:{i % 13}", i // 3) for i in range(400)])
    rows = W.tumbling_windows(rows, 20).repartition(parts)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts_s, r.event_id)):
        ids = got.setdefault(r.window_id, {})
        for key in (r.src_key, r.dst_key):
            ids.setdefault(key, len(ids))
    nodes = G.build_nodes(rows, ["window_id"]).collect()
    assert {(r.window_id, r.entity_key): r.node_id for r in nodes} == {(w, k): i for w, ids in got.items() for k, i in ids.items()}


def test_group_rank_spreads_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("g"), (-F.col("id")).alias("v"))
    got = ranking.group_rank(df, ["g"], ["v"]).where("g = 0").collect()
    assert sorted(r["rank"] for r in got) == list(range(2500))
    assert all(r["rank"] == 2499 + r["v"] for r in got)


def test_running_sums(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    got = {r["id"]: r["s"] for r in ranking.running_sums(df, ["id"], {"s": "x"}).collect()}
    assert all(got[i] == i * (i + 1) for i in range(1000))


def test_batches_are_disjoint_unions(events):
    rows = W.tumbling_windows(events([(f"a{i % 4}", f"b{i % 3}", i) for i in range(60)]), 10)
    per = ["window_id"]
    nodes = G.build_nodes(rows, per)
    edges = G.build_edges(rows, nodes, G.edge_type_dict(rows, per), per)
    shifted, moved = W.batch_graphs(nodes, edges, 2)
    per_batch = shifted.groupBy("batch").agg(F.count("node_id").alias("n"), F.countDistinct("node_id").alias("d"), F.max("node_id").alias("m")).collect()
    assert len(per_batch) == 3 and all(r.n == r.d == r.m + 1 for r in per_batch)
    known = shifted.select("batch", "window_id", F.col("node_id").alias("src"))
    assert moved.join(known, ["batch", "window_id", "src"]).count() == 60


def test_transformations(events):
    rows = events([("a", "b", 0), ("a", "b", 1)]).selectExpr("event_id as edge_id", "src_key as src", "dst_key as dst", "event_type", "ts_s")
    assert G.transform_graph(rows, "undirected").count() == 4
    assert [r.edge_id for r in G.transform_graph(rows, "deduplicate").collect()] == [0]
    assert G.transform_graph(rows).count() == 2
    with pytest.raises(ValueError):
        G.transform_graph(rows, "other")
