"""Cases that once went wrong: broken lines, map columns, dense sources, nested folder names, left-over stage tables."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.operators import graph as G
from spoorline.operators import prep as P
from spoorline.operators import records as R
from spoorline.plans.catalogue import QUERIES
from spoorline.session import cut, scratch_path, shared_root, stage
from spoorline.sources import readers
from spoorline.streaming import streams as S


@pytest.mark.parametrize("raw, good", [
    ('{"a":1}', True), (' {"a":{"b":[1]}} ', True), ('"x": 1}', False), ("42 z", False), ("42", False), ('{"a":1}{"a":2}', False),
    ('{"a":1},"b":2', False), ("{}],[{}", False), ("{bad", False), ("[1]", False), ("", False)])
def test_only_whole_objects_are_records(spark, raw, good):
    table = spark.createDataFrame([("f", 0, raw)], "file string, pos long, raw string")
    assert (R.parse(table).count() == 1) == good


def test_files_are_read_by_content(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a":1}\n{"a":2},\n{"x":\n')
    (tmp_path / "array.json").write_text('[\n  {\n "a": 3\n },\n {"a": 4}\n]\n')
    (tmp_path / "object.json").write_text('{\n "a": 5\n}\n')
    (tmp_path / "data.bin").write_text('{"a":6}\n')
    (tmp_path / "broken.json").write_text('{"a":7}{"a":8}')
    paths = [str(tmp_path / n) for n in ("lines.json", "array.json", "object.json", "data.bin", "broken.json", "none.json")]
    records, counts = readers.read_many(spark, paths)
    assert sorted(r[0] for r in records.select(R.get("v", "a", kind="int")).collect()) == [1, 2, 3, 4, 5, 6]
    assert counts == {"read": 4, "missing": 1, "failed": 1}


def test_depth_is_counted_from_the_folder(spark, tmp_path):
    root = tmp_path / "logs"
    for path in ("a.json", "archive-logs/b.json", "x/logs/c.json"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("{}")
    names = lambda deep: sorted(os.path.basename(r["path"]) for r in readers.discover_files(spark, str(root), "json", deep).collect())
    assert names(False) == ["a.json"] and names(True) == ["a.json", "b.json"]


def test_duplicates_go_with_a_map_column_at_hand(spark):
    events = spark.createDataFrame([(2, "a", "b", "t", 1.0, {"k": "2"}), (1, "a", "b", "t", 1.0, {"k": "1"}), (3, "a", "b", "t", 2.0, {"k": "3"})],
                                   "event_id long, src_key string, dst_key string, event_type string, ts_s double, attributes map<string,string>")
    row = P.remove_duplicates(events, ["src_key", "dst_key", "event_type"]).first()
    assert (row["event_id"], row["attributes"]) == (1, {"k": "1"})
    edges = events.withColumnsRenamed({"event_id": "edge_id", "src_key": "src", "dst_key": "dst"})
    assert G.dedupe_edges(edges).first()["attributes"] == {"k": "1"}
    kept = G.simple_digraph(events.withColumn("score", F.lit(0.0)), keep=("event_type", "ts_s", "score", "attributes")).first()
    assert (kept["event_id"], kept["attributes"]) == (3, {"k": "3"})


def test_negative_samples_are_complete_for_dense_and_full_sources(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "entity_key string")
    dense = [(i, "n0", f"n{i + 1}") for i in range(17)]
    full = [(100 + i, "n1", f"n{i}") for i in range(20) if i != 1]
    sparse = [(200, "n2", "n3"), (201, "n2", "n4")]
    edges = spark.createDataFrame(dense + full + sparse, "event_id long, src_key string, dst_key string")
    got = P.negative_samples(edges, nodes, 2).collect()
    real = {(s, d) for _, s, d in dense + full + sparse}
    per = {}
    for r in got:
        assert (r["src_key"], r["dst_key"]) not in real and r["src_key"] != r["dst_key"]
        per.setdefault(r["event_id"], set()).add(r["dst_key"])
    assert len(got) == sum(map(len, per.values())) == 2 * 17 + 2 * 2
    assert all(len(per[i]) == 2 for i, *_ in dense + sparse) and not any(i in per for i, *_ in full)


def test_merged_intervals_are_disjoint_and_cover_the_same(spark):
    rng = random.Random(1)
    rows = [(float(a), float(a + rng.randrange(0, 6))) for a in (rng.randrange(100) for _ in range(30))] + [(50.0, 40.0)]
    got = sorted((r["start_s"], r["end_s"]) for r in P.merge_intervals(spark.createDataFrame(rows, "start_s double, end_s double")).collect())
    assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
    inside = lambda spans, t: any(a <= t <= b for a, b in spans)
    assert all(inside(rows, t / 2) == inside(got, t / 2) for t in range(-2, 230))


def test_time_disorder_counts_events_before_an_earlier_id(spark):
    times = [5.0, 3.0, 6.0, 6.0, 1.0, 9.0]
    events = spark.createDataFrame(list(enumerate(times)), "event_id long, ts_s double").repartition(3)
    assert P.time_disorder(events).first()["violations"] == 2


def test_stage_tables_go_with_their_scope(spark):
    with stage(spark) as outer:
        with stage(spark) as inner:
            lost, kept = cut(spark.range(3)), inner.keep(spark.range(5))
            lone = inner.paths[0]
        assert kept.count() == 5 and not os.path.exists(lone.removeprefix("file:"))
        held = outer.paths[0]
    assert lost is not None and not os.path.exists(held.removeprefix("file:"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("name", ["trace", "pagerank_feature", "logs_to_graphs"])
def test_queries_leave_no_stage_tables(spark, name):
    folder = f"{shared_root(spark)}/spoorline".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert set(os.listdir(folder)) <= before if os.path.exists(folder) else True


def test_row_values_of_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    got = row.select(V.softmax(F.col("v")).alias("s"), V.unit(F.col("v")).alias("u"), V.standardise(F.col("v")).alias("z")).first()
    e = [math.exp(x) for x in (1, 2, 3, 4)]
    assert got["s"] == pytest.approx([x / sum(e) for x in e]) and got["u"] == pytest.approx([x / math.sqrt(30) for x in (1, 2, 3, 4)])
    assert got["z"] == pytest.approx([(x - 2.5) / math.sqrt(1.25 + 1e-5) for x in (1, 2, 3, 4)])


def test_streams_close_their_windows_and_order_their_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"n":1}\n{"n":2}\n{bad\n{"n":3}\n')
    records = S.stream_events(spark, str(tmp_path / "in")).select("file", "pos")
    S.run_available(records, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 3
    rows = [(float(t), "t", "s", 1.0) for t in (0, 10, 4000, 9000)]
    spark.createDataFrame(rows, "ts_s double, event_type string, src_key string, score double").write.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "events"))
    out = S.stream_window_counts(S.with_end(live, str(tmp_path / "end")))
    S.run_available(out, str(tmp_path / "counts"), str(tmp_path / "c2"))
    S.end_of_data(live, str(tmp_path / "end"))
    S.run_available(out, str(tmp_path / "counts"), str(tmp_path / "c2"))
    assert sorted((r["window_start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "counts")).collect()) == [(0, 2), (3600, 1), (7200, 1)]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = setCheckpointDir = lambda self, *path: None

    class Session:
        sparkContext = Context()
        conf = {"spark.sql.warehouse.dir": "file:/data/warehouse"}

    with pytest.raises(RuntimeError):
        shared_root(Session)
    Session.conf = {"spark.sql.warehouse.dir": "hdfs://host/warehouse"}
    assert shared_root(Session) == "hdfs://host/warehouse/_stages"
