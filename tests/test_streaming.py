import json
import time

import pandas as pd
from pyspark.sql import functions as F

from spoorline.streaming import resolve
from spoorline.streaming import streams as S

SCHEMA = "event_id long, src_key string, dst_key string, event_type string, ts_s double, score double"
P = "com.bbn.tc.schema.avro.cdm18."


def feed(spark, folder, batches, maximum=1):
    """One file per batch, named so that they are read in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", maximum).option("recursiveFileLookup", "true").json(str(folder))


def row(i, ts, key="a"):
    return (i, key, "b", "t", float(ts), 1.0)


def test_late_events_are_dropped(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[row(0, 100), row(1, 9000)], [row(4, 9100)], [row(2, 200)], [row(3, 20000)]])
    out = S.stream_window_counts(stream, "1 hour", delay="10 minutes")
    S.run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.window_start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 1, 7200: 2}


def test_dedupe_and_sessions(spark, tmp_path):
    rows = [row(0, 0), row(1, 10), row(2, 4000), row(3, 50000, "z")]
    stream = feed(spark, tmp_path / "in", [rows])
    S.run_available(S.stream_dedupe(stream, ["src_key"], "10 days"), str(tmp_path / "d"), str(tmp_path / "ck1"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 2
    S.run_available(S.stream_sessions(stream), str(tmp_path / "s"), str(tmp_path / "ck2"))
    got = {(r.src_key, r.session_start // 10**6): (r.session_end // 10**6, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got == {("a", 0): (1810, 2), ("a", 4000): (5800, 1)}


def test_dedupe_windows_forget_closed_windows(spark, tmp_path):
    first = [row(0, 0), row(1, 10), row(2, 3700), row(3, 20, "z")]
    stream = feed(spark, tmp_path / "in", [first])
    out, folder, check = S.stream_dedupe_windows(stream, ["src_key"]), str(tmp_path / "d"), str(tmp_path / "ck")

    def run():
        query = (
            out.select("event_id", "src_key", "ts_s").writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", check).trigger(availableNow=True).start(folder)
        )
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        return state["numRowsTotal"]

    run()
    seen = lambda: sorted((r.src_key, r.ts_s // 3600) for r in spark.read.parquet(folder).collect())
    # keys of open windows are known after a restart, closed windows leave the state, and their late events are dropped
    feed(spark, tmp_path / "in", [[row(4, 3800), row(5, 50000)]])
    assert run() == 1
    feed(spark, tmp_path / "in", [[row(6, 30), row(7, 50010)]])
    assert run() == 1
    assert seen() == sorted([("a", 0), ("z", 0), ("a", 1), ("a", 13)])


def test_alerts(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[(0, "a", "b", "t", 0.0, 5.0), (1, "a", "b", "t", 0.0, 0.5), (2, "a", "b", "u", 0.0, 9.0)]])
    baseline = spark.createDataFrame([("t", 1.0)], "event_type string, threshold double")
    S.run_available(S.stream_alerts(stream, baseline).select("event_id", "excess"), str(tmp_path / "o"), str(tmp_path / "ck"))
    assert [(r.event_id, r.excess) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [(0, 4.0)]


class Audit:
    """Audit files that are put into a folder one after the other, and the stream over them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        (folder / "in").mkdir()

    def put(self, name, *records):
        (self.folder / "in" / name).write_text("\n".join(json.dumps({"datum": {P + k: r}}) for k, r in records))

    def run(self, **more):
        resolve.stream_resolve(S.stream_events(self.spark, str(self.folder / "in")), str(self.folder / "t"), str(self.folder / "ck"), parts=2, **more)
        rows = resolve.resolved(self.spark, str(self.folder / "t")).collect()
        assert len({r.event_id for r in rows}) == len(rows)
        return {r.event_id: (r.src_key, r.dst_key) for r in rows}

    def rejected(self):
        return sorted((r.event_id, r.missing_uuid) for r in resolve.rejected(self.spark, str(self.folder / "t")).collect())


class Held(dict):
    """Map state in memory."""

    getValue, updateValue = dict.get, dict.__setitem__

    def removeKey(self, key):
        del self[key]


class Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: now


def test_one_call_resolves_many_uuids():
    states, timers = {}, []

    class Handle:
        def getMapState(self, name, *_):
            return states.setdefault(name, Held())

        def registerTimer(self, at):
            timers.append(at)

    def call(now, *rows):
        frame = pd.DataFrame(rows, columns=["kind", "uuid", "file", "pos", "name", "event", "part"])
        return [tuple(r[1:]) for out in one.handleInputRows((7,), iter([frame]), Clock(now)) for r in out.itertuples()]

    one = resolve.Waiting(10)
    one.init(Handle())
    assert call(100, ("event", "a", "f", 1, None, "e1", 0), ("event", "b", "f", 2, None, "e2", 0), ("event", "a", "f", 3, None, "e3", 1)) == []
    assert call(105, ("event", "b", "f", 4, None, "e4", 0)) == [] and timers == [110, 115]
    got = call(106, ("event", "a", "f", 6, None, "e5", 0), ("entity", "a", "f", 5, "A", None, 0), ("entity", "c", "f", 7, "C", None, 1), ("entity", "a", "f", 4, "old", None, 0))
    assert [r for r in got if r[0] == "entity"] == [("entity", "a", "f", 5, "A", None), ("entity", "a", "f", 4, "old", None)]
    assert [r for r in got if r[0] != "entity"] == [("known", "a", "f", 1, "A", "e1"), ("known", "a", "f", 6, "A", "e5")]
    gone = [tuple(r[1:]) for at in timers for out in one.handleExpiredTimer((7,), None, Clock(at)) for r in out.itertuples()]
    assert gone == [("rejected", "b", "f", 2, None, "e2"), ("rejected", "a", "f", 3, None, "e3"), ("rejected", "b", "f", 4, None, "e4")]
    assert not states["chunks"] and not states["due"] and sorted(states["seen"]) == [("a", 0), ("c", 1)]


def ref(uuid):
    return {P + "UUID": uuid}


def event(name, src, dst):
    return "Event", {"uuid": name, "type": "EVENT_READ", "timestampNanos": 1, "subject": src and ref(src), "predicateObject": dst and ref(dst)}


def subject(uuid, cid):
    return "Subject", {"uuid": uuid, "cid": cid}


def file(uuid, path):
    return "FileObject", {"uuid": uuid, "baseObject": {"properties": {"path": path}}}


def test_open_events_resolve_after_a_restart(spark, tmp_path):
    audit = Audit(spark, tmp_path)
    audit.put("1.json", subject("s", 1), event("e", "s", "f"), event("g", "t", "f"))
    assert audit.run() == {}
    audit.put("2.json", file("f", "/x"), event("h", "s", "f"))
    assert audit.run() == {"e": ("process:pid_1_s", "file:/x"), "h": ("process:pid_1_s", "file:/x")}
    # an earlier batch is not read again, and what it named stays; the newest record names later events
    audit.put("3.json", file("f", "/y"), subject("t", 2), event("i", "t", "f"))
    assert audit.run() == {"e": ("process:pid_1_s", "file:/x"), "h": ("process:pid_1_s", "file:/x"), "g": ("process:pid_2_t", "file:/y"), "i": ("process:pid_2_t", "file:/y")}
    assert audit.rejected() == []


def test_events_that_wait_too_long_are_rejected(spark, tmp_path):
    audit = Audit(spark, tmp_path)
    audit.put("1.json", subject("s", 1), event("a", "none", "f"), event("b", "s", "g"), event("c", "s", None))
    assert audit.run(wait=0) == {}
    time.sleep(0.1)
    audit.put("2.json", subject("other", 1))
    audit.run(wait=0)
    audit.put("3.json", file("g", "/late"))
    audit.run(wait=0)
    assert audit.rejected() == [("a", "none"), ("b", "g"), ("c", None)]
    audit.put("4.json", event("d", "s", "g"))
    assert audit.run(wait=0) == {"d": ("process:pid_1_s", "file:/late")}


def test_a_file_of_many_blocks_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"n": i, "pad": "é" * (i % 50)}) + ("," if i % 3 else "") for i in range(5000)]
    (tmp_path / "in" / "big.json").write_text("[\n" + "\n".join(lines) + "\n\n{broken\n]\n")
    (tmp_path / "in" / "small.json").write_text('{"n": -1}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        tasks = F.spark_partition_id().alias("task")
        out = S.stream_events(spark, str(tmp_path / "in")).select("file", "pos", F.try_variant_get("v", "$.n", "long").alias("n"), tasks)
        S.run_available(out, str(tmp_path / "o"), str(tmp_path / "ck"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.read.parquet(str(tmp_path / "o")).orderBy("file", "pos").collect()
    big = [r for r in rows if "big" in r.file]
    assert [r.n for r in big] == list(range(5000)) and len({r.pos for r in big}) == 5000
    assert len({r.task for r in big}) > 10 and len(rows) == 5001
