import json

import pytest
from pyspark.sql import functions as F

from spoorline.functions.times import to_epoch
from spoorline.operators import cdm, ecs, records as R
from spoorline.operators.normalize import build_graphs, normalize
from spoorline.operators.registry import entity_registry
from spoorline.session import configure, stage
from spoorline.sources import readers, sinks

P = "com.bbn.tc.schema.avro.cdm18."


def table(spark, rows):
    return spark.createDataFrame([(f, p, json.dumps(r) if isinstance(r, dict) else r) for f, p, r in rows], "file string, pos long, raw string")


def wrap(kind, **record):
    return {"CDMVersion": "18", "datum": {P + kind: record}}


def uuid(u):
    return {P + "UUID": u}


def test_timestamp_forms(spark):
    forms = ["1523366400000000000", "1523366400000", "1523366400", "2018-04-10T13:20:00Z", "x", None]
    got = spark.createDataFrame([(f,) for f in forms], "t string").select(to_epoch(F.col("t")).alias("s"), to_epoch(F.col("t"), compat=True).alias("c")).collect()
    assert [r.s for r in got] == [1523366400.0] * 4 + [None, None]
    assert [r.c for r in got][4:] == [0.0, 0.0]


def test_dirty_ndjson_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n\n {"a": 1},\n{bad\n,\n]\n')
    rows = readers.read_ndjson(spark, str(tmp_path)).collect()
    assert [json.loads(r.raw) for r in rows] == [{"a": 1}]


def test_positions_ascend_across_blocks(spark, tmp_path):
    (tmp_path / "big.json").write_text("".join('{"n": %d}\n' % i for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = readers.read_ndjson(spark, str(tmp_path)).select("pos", R.get("v", "n", kind="int").alias("n")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.n for r in rows] == list(range(2000))
    assert len({r.pos for r in rows}) == 2000


def test_json_array_and_single_object(spark, tmp_path):
    (tmp_path / "list.json").write_text('[\n {"a": 1}, {"a": {"b": "]"}}\n]')
    (tmp_path / "one.json").write_text('{\n "a": 5\n}')
    rows = readers.read_json_array(spark, str(tmp_path)).select(F.regexp_extract("file", r"(\w+)\.json", 1).alias("f"), "pos", "raw").collect()
    assert sorted((r.f, r.pos, r.raw) for r in rows) == [("list", 0, '{"a":1}'), ("list", 1, '{"a":{"b":"]"}}'), ("one", 0, '{"a":5}')]


def test_avro_without_module_says_so(spark, tmp_path):
    with pytest.raises(RuntimeError, match="spark-avro"):
        readers.read_avro(spark, str(tmp_path))


def test_read_many_counts_missing(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n')
    (tmp_path / "b.bin").write_text("x")
    records, counts = readers.read_many(spark, [str(tmp_path / "a.json"), str(tmp_path / "no.json"), str(tmp_path / "b.bin")])
    assert counts == {"read": 1, "missing": 1, "failed": 1} and records.count() == 1


def test_discovery_patterns(spark, tmp_path):
    for name in ("a.json", "a.json.1", "b.bin", "b.bin.2", "c.ndjson", "d.txt"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.json").write_text("x")

    def names(**kw):
        return [r.path.rsplit("/", 1)[-1] for r in readers.discover_files(spark, str(tmp_path), **kw).collect()]

    assert names() == ["a.json", "a.json.1"]
    assert names(fmt="bin") == ["b.bin", "b.bin.2"]
    assert names(fmt="all", sub_level=True) == ["a.json", "a.json.1", "b.bin", "b.bin.2", "c.ndjson", "e.json"]
    assert readers.limit_files(readers.discover_files(spark, str(tmp_path)), 1).count() == 1


def test_labels_list_and_object(spark, tmp_path):
    graphs = spark.range(4).withColumnRenamed("id", "graph_id")
    (tmp_path / "l.json").write_text("[0, 1]")
    (tmp_path / "o.json").write_text('{"3": 1}')

    def labels(path):
        return [r.label for r in readers.load_labels(spark, path, graphs).orderBy("graph_id").collect()]

    assert labels(str(tmp_path / "l.json")) == [0, 1, 0, 0]
    assert labels(str(tmp_path / "o.json")) == [0, 0, 0, 1]
    assert labels(str(tmp_path / "none.json")) == labels(None) == [0, 0, 0, 0]


def test_format_per_file(spark):
    rows = table(spark, [
        ("a", 0, {"@timestamp": "2024-01-01T00:00:00Z", "event": {}}), ("a", 1, {"x": 1}),
        ("b", 0, wrap("Subject", uuid="u")), ("c", 0, {"datum": {"uuid": 1}}), ("d", 0, {"datum": {"uuid": 1}, "source": "s"}),
    ])
    got = {r.file: r.format for r in R.detect_format(R.parse(rows)).collect()}
    assert got == {"a": "ecs", "b": "cdm", "c": "custom", "d": "cdm"}


def cdm_rows():
    return [
        ("f", 0, wrap("Event", uuid="e1", type="EVENT_READ", timestampNanos=1523366400000000000, subject=uuid("s1"), predicateObject=uuid("o1"), threadId=7)),
        ("f", 1, wrap("Subject", uuid="s1", type="SUBJECT_PROCESS", cid=42)),
        ("f", 2, wrap("FileObject", uuid="o1", baseObject={"properties": {}})),
        ("f", 3, wrap("FileObject", uuid="o2", baseObject={"properties": {"path": ""}})),
        ("f", 4, wrap("Event", uuid="e2", type="EVENT_NOVEL", timestampNanos=1523366400000000000, subject="s1", predicateObject=uuid("o2"), predicateObject2=uuid("o1"))),
        ("f", 5, wrap("Event", uuid="e3", type="EVENT_READ", timestampNanos=0, subject=uuid("s1"), predicateObject=uuid("gone"))),
        ("f", 6, wrap("RegistryKeyObject", uuid="r1", key="HK")),
        ("f", 7, wrap("Subject", type="SUBJECT_PROCESS", cid=1)),
    ]


def test_cdm_entities_and_resolution(spark):
    records = R.parse(table(spark, cdm_rows()))
    entities = {r.uuid: r for r in cdm.entities(records).collect()}
    assert set(entities) == {"s1", "o1", "o2", "r1"}
    assert entities["s1"].entity_key == "process:pid_42_s1" and entities["s1"].attributes["pid"] == "42"
    assert entities["o1"].entity_key == "file:o1" and entities["o2"].entity_key == "file:o2"
    assert entities["r1"].entity_type == "registry" and entities["r1"].attributes["key"] == "HK"
    events = cdm.events(records)
    got = {r.event_id: r for r in cdm.resolve_entities(events, cdm.entities(records)).collect()}
    assert {k: v.status for k, v in got.items()} == {"e1": "parsed", "e2": "parsed", "e3": "missing_entities"}
    assert got["e1"].ts_s == 1523366400.0 and got["e2"].event_type == "other"
    strict = {r.event_id: r.status for r in cdm.resolve_entities(events, cdm.entities(records), strict_order=True).collect()}
    assert strict == {"e1": "missing_entities", "e2": "parsed", "e3": "missing_entities"}
    expanded = cdm.second_object(events, expand=True).groupBy("event_id").count().collect()
    assert {r["event_id"]: r["count"] for r in expanded} == {"e1": 1, "e2": 2, "e3": 1}


def test_ecs_categories_and_targets(spark):
    base = {"@timestamp": "2024-01-01T00:00:00Z", "process": {"entity_id": "", "executable": "/bin/a", "pid": 3, "parent": {"pid": 1}}}
    rows = table(spark, [
        ("a", 0, {**base, "event": {"category": "file", "action": "x"}, "file": {"name": "n"}}),
        ("a", 1, {**base, "event": {"category": ["process", "web"]}}),
        ("a", 2, {**base, "event": {"category": []}}),
        ("a", 3, {**base, "event": {"category": "network"}, "destination": {"ip": "1.2.3.4"}}),
        ("a", 4, "{bad"),
    ])
    got = {r.pos: r for r in ecs.events(rows).collect()}
    assert [got[i].category for i in (0, 1, 2, 3)] == ["file", "process", "unknown", "network"]
    assert [got[i].status for i in range(5)] == ["parsed", "parsed", "missing_target", "parsed", "bad_json"]
    assert got[0].src_key == "process:/bin/a:3" and got[0].dst_key == "file:n"
    assert got[1].dst_key == "process:unknown:1" and got[3].dst_key == "network:1.2.3.4"
    assert got[0].event_id == "1704067200.0_/bin/a:3_x"


def test_custom_endpoints(spark):
    rows = R.parse(table(spark, [
        ("a", 0, {"timestamp": 5, "source": "s", "target": {"name": "n", "type": "file"}, "type": "w"}),
        ("a", 1, {"timestamp": "5.25", "target": {"id": "i"}}),
    ]))
    got = {r.pos: r for r in R.custom_events(rows).collect()}
    assert (got[0].src_key, got[0].dst_key, got[0].event_id) == ("entity:s", "file:n", "5.0_s_w")
    assert (got[1].src_key, got[1].dst_key, got[1].event_type, got[1].ts_s) == ("entity:unknown", "entity:i", "unknown", 5.25)


def test_registry_latest_attribute_wins(spark):
    rows = [("k:1", "k", {"a": "1", "b": "x"}, "f", 0), ("k:1", "k", {"a": "2"}, "f", 9), ("k:1", "k", {"a": "3"}, "f", 5), ("k:2", "k", {}, "f", 1)]
    df = spark.createDataFrame(rows, "entity_key string, entity_type string, attributes map<string,string>, file string, pos long")
    got = {r.entity_key: r for r in entity_registry(df).collect()}
    assert got["k:1"].attributes == {"a": "2", "b": "x"} and got["k:1"].occurrences == 3 and got["k:2"].attributes == {}


def test_mixed_files_to_graphs(spark):
    rows = table(spark, cdm_rows() + [("g", 0, {"timestamp": 1523366400, "source": "a", "target": "a", "type": "w"})])
    events, entities = normalize(R.parse(rows))
    assert events.groupBy("status").count().count() == 2
    assert entities.where("entity_key = 'entity:a'").count() == 2
    nodes, edges = build_graphs(events, 3600)
    assert {r.entity_key for r in nodes.collect()} == {"process:pid_42_s1", "file:o1", "file:o2", "entity:a"}
    assert edges.count() == 2


def test_report_orders_counts(spark):
    rows = spark.createDataFrame([("parsed", "a")] * 3 + [("missing_target", "b")], "status string, event_type string")
    got = [(r.metric, r.value, r.n) for r in R.parse_report(rows).collect()]
    assert got == [("event", "a", 3), ("status", "parsed", 3), ("status", "missing_target", 1)]


def test_materialize_reuses_and_overwrites(spark):
    one, two = spark.range(3), spark.range(5)
    assert sinks.materialize(one, "stage-test").count() == 3
    assert sinks.materialize(two, "stage-test").count() == 3
    assert sinks.materialize(two, "stage-test", overwrite=True).count() == 5


def test_repeated_keys_and_numbers_that_are_not_finite(spark, tmp_path):
    configure(spark)
    lines = ['{"a":1,"a":2}', '{"a":NaN,"b":[Infinity, -Infinity],"c":"NaN, \\"-Infinity\\" x"}', '{"a":NaNs}', '{"NaN": 3}', '{"a":"\\\\", "b":NaN}']
    (tmp_path / "x.json").write_text("\n".join(lines))
    got = [json.loads(r.j) for r in readers.read_ndjson(spark, str(tmp_path)).select("pos", F.to_json("v").alias("j")).orderBy("pos").collect()]
    want = [{"a": 2}, {"b": [None, None], "c": 'NaN, "-Infinity" x', "a": None}, {"NaN": 3}, {"a": "\\", "b": None}]
    # a null may be left out of the written form
    assert [{k: v for k, v in r.items() if v is not None} for r in got] == [{k: v for k, v in r.items() if v is not None} for r in want]


def test_read_many_keeps_files_with_a_broken_first_line(spark, tmp_path):
    configure(spark)
    good = [json.dumps({"n": i}) for i in range(100)]
    (tmp_path / "cut.json").write_text("\n".join(['st of": 1}', *good]))
    (tmp_path / "pretty.json").write_text(json.dumps([{"n": 1, "list": [{"x": 1}, {"x": 2}]}], indent=1))
    (tmp_path / "none.json").write_text("no record\n")
    with stage(spark):
        records, counts = readers.read_many(spark, [str(tmp_path / f"{n}.json") for n in ("cut", "pretty", "none")])
        assert counts == {"read": 2, "missing": 0, "failed": 1}
        assert records.count() == 101


def test_mixed_records_are_made_and_parsed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def row(n):
        made.add(1)
        ecs_like = {"@timestamp": 5 + n, "event": {"action": "a", "category": "file"}, "file": {"path": "/x"}}
        return "ec"[n % 2], n, json.dumps({"timestamp": 5 + n, "source": "a", "target": "b"} if n % 2 else ecs_like)

    rows = spark.createDataFrame(spark.sparkContext.parallelize(range(40), 2).map(row), "file string, pos long, raw string")
    events, entities = normalize(R.parse(rows))
    assert sorted(map(tuple, events.groupBy("file").count().collect())) == [("c", 20), ("e", 20)]
    assert entities.count() == 80 and made.value == 40
