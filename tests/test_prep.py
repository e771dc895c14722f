import numpy as np
from pyspark.sql import functions as F

from spoorline.operators import prep as P
from spoorline.operators import graph as G


def test_interval_labels_against_brute_force(spark, events):
    rng = np.random.default_rng(4)
    ts = rng.uniform(0, 50000, 300).round(1)
    spans = [(0.0, 10.0), (3599.0, 7300.0), (20000.0, 20000.0), (7200.0, 7201.0)]
    intervals = spark.createDataFrame(spans, "start_s double, end_s double")
    got = P.label_attack_windows(events([("a", "b", t) for t in ts]), intervals).collect()
    assert len(got) == 300
    assert all(r.label == int(any(a <= r.ts_s <= b for a, b in spans)) for r in got)


def test_resolve_by_fields(spark):
    rows = [("e1", "x", None), ("e2", "x", "k"), ("e3", None, "k"), ("e4", "y", None)]
    df = spark.createDataFrame(rows, "entity_key string, name string, host string")
    got = {r.entity_key: r.canonical for r in P.resolve_by_fields(df, ["name", "host"]).collect()}
    assert got == {"e1": "e1", "e2": "e1", "e3": "e1", "e4": "e4"}


def test_splits(spark, events):
    graphs = spark.range(10).withColumnRenamed("id", "graph_id")
    counts = {r["split"]: r["count"] for r in P.random_split(graphs).groupBy("split").count().collect()}
    assert counts == {"train": 8, "val": 2}
    assert P.random_split(graphs.limit(4)).where("split = 'val'").count() == 0
    split = P.temporal_split(events([("a", "b", i) for i in range(100)])).groupBy("split").agg(F.count("*").alias("n"), F.min("ts_s").alias("lo")).collect()
    assert {r["split"]: (r.n, r.lo) for r in split} == {"train": (70, 0.0), "val": (15, 70.0), "test": (15, 85.0)}


def test_balance(spark):
    df = spark.range(100).select(F.col("id").alias("event_id"), (F.col("id") < 7).cast("int").alias("label"))
    under = {r.label: r["count"] for r in P.balance(df).groupBy("label").count().collect()}
    over = {r.label: (r.n, r.d) for r in P.balance(df, "over").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("d")).collect()}
    assert under == {0: 7, 1: 7} and over == {0: (93, 93), 1: (93, 7)}


def test_negative_samples_are_non_edges(events):
    rows = events([(f"a{i % 5}", f"b{i % 7}", i) for i in range(30)])
    nodes = G.endpoints(rows).select("entity_key").distinct()
    got = P.negative_samples(rows, nodes, 1).collect()
    real = {(f"a{i % 5}", f"b{i % 7}") for i in range(30)}
    assert got and all((r.src_key, r.dst_key) not in real and r.src_key != r.dst_key for r in got)


def test_sampling_does_not_depend_on_partitioning(events):
    rows = events([("a", "b", i) for i in range(200)])
    draw = lambda df: {r.event_id for r in P.sample(df, share=0.3, method="random").collect()}
    assert draw(rows.repartition(1)) == draw(rows.repartition(5))
    assert P.sample(rows, 10, method="random").count() == 10


def test_validation_counts(spark, events):
    rows = events([("a", "b", 1), ("a", None, -1), ("c", "c", 2)])
    got = {r.rule: r.violations for r in P.validate(rows, spark.createDataFrame([("a",), ("b",)], "entity_key string")).collect()}
    assert got == {"null_key": 1, "null_type": 0, "null_time": 0, "negative_time": 1, "self_loop": 1, "dangling_end": 1, "repeated_id": 0, "time_order": 1}


def test_missing_modes_and_labels(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "event_id long, label int")
    assert P.handle_missing(df).count() == 1 and P.handle_missing(df, "ignore").count() == 2
    assert P.handle_missing(df, "fill", fill={"label": 1}).where("label = 1").count() == 1
    assert P.detect_mode(df).first().mode == "unsupervised"
