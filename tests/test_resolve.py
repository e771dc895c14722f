import json
import pickle
import random

import pandas as pd
import pyarrow as pa

from spoorline.operators import cdm
from spoorline.operators.records import parse
from spoorline.streaming import resolve


class Counted(dict):
    """Map state in memory that counts calls."""

    calls = 0

    def getValue(self, key):
        Counted.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Counted.calls += 1
        self[key] = value

    def removeKey(self, key):
        Counted.calls += 1
        del self[key]


class Slot:
    """One key of state and its timers."""

    def __init__(self, wait=10, kind=resolve.Waiting):
        self.states, self.timers, self.own = {}, set(), kind(wait)
        self.own.init(self)

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Counted())

    def registerTimer(self, at):
        self.timers.add(at)

    def call(self, now, rows):
        self.now = now
        frame = pd.DataFrame(rows, columns=resolve.TAKEN)
        out = [tuple(r[1:]) for o in self.own.handleInputRows((7,), iter([frame]), self) for r in o.itertuples()]
        for at in sorted(t for t in self.timers if t <= now):
            self.now = at
            out += [tuple(r[1:]) for o in self.own.handleExpiredTimer((7,), self, self) for r in o.itertuples()]
            self.timers.remove(at)
        return out

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def event(uuid, pos, part=0):
    return "event", uuid, "f", pos, None, f"e{pos}", part


def entity(uuid, pos, name, part=0):
    return "entity", uuid, "f", pos, name, None, part


def test_calls_of_state_do_not_grow_with_uuids():
    slot, uuids = Slot(), [f"u{i:05}" for i in range(3000)]
    Counted.calls = 0
    assert slot.call(1, [event(u, i) for i, u in enumerate(uuids)]) == []
    assert Counted.calls < 100
    got = slot.call(2, [entity(u, 5000 + i, f"n{i}") for i, u in enumerate(uuids)])
    assert sorted(r for r in got if r[0] == "known") == sorted(("known", u, "f", i, f"n{i}", f"e{i}") for i, u in enumerate(uuids))
    assert Counted.calls < 300 and not slot.states["chunks"]


def test_any_order_of_events_names_and_deadlines():
    draw = random.Random(5)
    for wait in (3, 40):
        slot = Slot(wait)
        names, waiting, pos = {}, {}, 0
        for now in range(1, 150):
            rows, want, first = [], [], {}
            before = dict(names)
            for _ in range(draw.randrange(30)):
                pos += 1
                at = str(draw.randrange(400)), draw.randrange(2)
                if draw.random() < 0.25:
                    place = draw.randrange(pos + 1)
                    rows.append(entity(at[0], place, f"n{pos}", at[1]))
                    want += [("entity", at[0], "f", place, f"n{pos}", None)] if at[1] == 0 else []
                    names[at] = max(names.get(at, ()), ("f", place, f"n{pos}"))
                else:
                    rows.append(event(at[0], pos, at[1]))
                    first.setdefault(at, []).append((now + wait, pos))
            for at in {*first, *names} - {*before}:
                waiting[at] = waiting.get(at, []) + first.pop(at, [])
                if at in names:
                    want += [("known", at[0], "f", p, names[at][2], f"e{p}") for _, p in waiting.pop(at)]
            for at, own in first.items():
                want += [("known", at[0], "f", p, names[at][2], f"e{p}") for _, p in own]
            for at, own in waiting.items():
                want += [("rejected", at[0], "f", p, None, f"e{p}") for until, p in own if until <= now]
                waiting[at] = [x for x in own if x[0] > now]
            draw.shuffle(rows)
            assert sorted(map(str, slot.call(now, rows))) == sorted(map(str, want)), now
        live = sum(map(len, waiting.values()))
        assert sum(len(resolve._unpack(v[0])) for v in slot.states["chunks"].values()) == live
        assert len(slot.states["lists"]) < 3 * resolve.FANOUT


def test_rows_are_the_same_packed():
    rows = [(i % 7, *event(f"u{i % 50}", i, i % 3)) for i in range(5000)] + [(3, *entity("u1", 9999, "n", 2))]
    batches = [pa.RecordBatch.from_pydict(dict(zip(["slot", *resolve.TAKEN], map(list, zip(*rows[i : i + 999]))))) for i in range(0, 5001, 999)]
    schema = pa.schema([("slot", pa.int32()), *((c, pa.int32() if c == "part" else pa.int64() if c == "pos" else pa.string()) for c in resolve.TAKEN)])
    out = [r for b in resolve._packed(iter([b.cast(schema) for b in batches])) for r in b.to_pylist()]
    got = [(r["slot"], *x) for r in out for x in zip(*pickle.loads(r["rows"]))]
    assert sorted(map(str, got)) == sorted(map(str, rows)) and len(out) <= 14


def test_events_and_entities_in_one_pass(spark):
    p = "com.bbn.tc.schema.avro.cdm18."
    raw = [
        {p + "Event": {"uuid": "e", "type": "EVENT_READ", "timestampNanos": 5, "subject": {p + "UUID": "s"}, "predicateObject": "f"}}, {p + "Event": {"type": "x"}},
        {p + "Subject": {"uuid": "s", "cid": 1}}, {p + "FileObject": {"uuid": "f", "baseObject": {"properties": {"path": "/x"}}}},
        {p + "NetFlowObject": {"uuid": "n", "srcAddress": "1"}}, {p + "Subject": {"uuid": "", "cid": 1}}, {p + "Subject": {"cid": 1}}, {p + "Host": {"uuid": "h"}},
        {p + "Principal": {"uuid": "p"}}, {"type": "EVENT_READ", "uuid": "bare"}, {"uuid": "b", "pid": 7},
    ]
    records = parse(spark.createDataFrame([("f", i, json.dumps({"datum": r})) for i, r in enumerate(raw)], "file string, pos long, raw string"))
    both = cdm.events_and_entities(records)
    columns = ["uuid", "entity_key", "file", "pos"]
    assert sorted(map(str, both.where("event is not null").select("event.*").collect())) == sorted(map(str, cdm.events(records).collect()))
    assert sorted(map(str, both.where("event is null").select(columns).collect())) == sorted(map(str, cdm.entities(records).select(columns).collect()))
    assert both.count() == 8
