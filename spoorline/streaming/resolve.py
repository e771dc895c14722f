"""Resolution of streamed audit events by keyed state: a uuid's entity and the events that wait for it.

Two queries follow each other, one per side of an event. Each keeps, in slots of many uuids and per uuid, the name of its entity and the events
that came before it; entities pass through the first query to the second. An event that waits longer than allowed is
rejected. No batch reads what earlier batches wrote, and hot uuids are dealt out over several keys.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from spoorline.operators import cdm
from spoorline.session import configure
from spoorline.sources.readers import make_folder

PARTS = 8
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"
BOUND = "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB"
CHANGES_ONLY = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS = 512  # keys of state; a change needs a new checkpoint
COLUMNS = ["kind", "uuid", "file", "pos", "name", "event"]
OUT = "kind string, uuid string, file string, pos long, name string, event string"
TAKEN = [*COLUMNS, "part"]
HELD_ROWS, HELD_BYTES = 25_000, 16 << 20  # rows of a task that are sorted into slots at once
PACKED_ROWS = 1000  # rows of a slot that travel as one
PAGE = 128  # names in one value of state, at most
CHUNK = 128  # open events in one value of state, at most
FANOUT = 8  # lists of open uuids of a size, before they become one of the next size
CODEC = "zstd"


def _pack(value) -> bytes:
    raw = pickle.dumps(value, 5)
    return len(raw).to_bytes(4, "big") + pa.compress(raw, codec=CODEC, asbytes=True)


def _unpack(held: bytes):
    return pickle.loads(pa.decompress(held[4:], int.from_bytes(held[:4], "big"), codec=CODEC, asbytes=True))


def _prints(ats) -> np.ndarray:
    """Short prints of ``(uuid, part)``, the same in every process."""
    return np.fromiter((zlib.crc32(f"{part}:{uuid}".encode()) for uuid, part in ats), np.uint32)


class Names:
    """The newest records of a slot's uuids, in pages that follow the order of uuids within a part.

    A page is kept under its first uuid and split when it is full. The first uuids of all pages are one value of state.
    """

    def __init__(self, seen, firsts):
        self.seen, self.stored = seen, firsts
        held = firsts.getValue((0,))
        self.firsts: dict[int, list[str]] = pickle.loads(held[0]) if held else {}
        self.pages: dict[tuple, dict] = {}

    def _page(self, uuid: str, part: int) -> dict | None:
        firsts = self.firsts.get(part)
        if not firsts:
            return None
        key = firsts[max(bisect_right(firsts, uuid) - 1, 0)], part
        if key not in self.pages:
            self.pages[key] = _unpack(self.seen.getValue(key)[0])
        return self.pages[key]

    def get(self, uuid: str, part: int) -> tuple | None:
        page = self._page(uuid, part)
        return page and page.get(uuid)

    def put(self, records: dict[tuple, tuple]) -> None:
        """Stores records by ``(uuid, part)``; every page that changes is written once."""
        changed, begun = set(), False
        for (uuid, part), record in sorted(records.items()):
            page = self._page(uuid, part)
            if page is None:
                begun = True
                self.firsts[part] = [uuid]
                page = self.pages[uuid, part] = {}
            page[uuid] = record
            firsts = self.firsts[part]
            changed.add((firsts[max(bisect_right(firsts, uuid) - 1, 0)], part))
        for first, part in changed:
            page = sorted(self.pages[first, part].items())
            if len(page) <= PAGE:
                self.seen.updateValue((first, part), (_pack(dict(page)),))
                continue
            begun = True
            if page[0][0] < first:  # the lowest page may hold uuids before its key
                self.seen.removeKey((first, part))
            self.firsts[part].remove(first)
            for at in range(0, len(page), PAGE // 2):
                insort(self.firsts[part], page[at][0])
                self.seen.updateValue((page[at][0], part), (_pack(dict(page[at : at + PAGE // 2])),))
        if begun:
            self.stored.updateValue((0,), (pickle.dumps(self.firsts, 5),))


class Waiting(StatefulProcessor):
    """Key ``slot``; state of the slot: names of its ``(uuid, part)`` in pages, and open events in chunks.

    A call costs far more than a row, for the processor as for its state, so a key stands for many uuids and a value of state for many
    names or events. The open events of a batch are cut into chunks in the order of their uuids; lists say whose events a
    chunk holds, and deadlines which chunks they end. The events of a uuid leave their chunks as soon as it is named.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # pages by their first uuid, and the first uuids of all pages
        self.seen = handle.getMapState("seen", "uuid string, part int", "page binary")
        self.firsts = handle.getMapState("firsts", "at int", "firsts binary")
        self.chunks = handle.getMapState("chunks", "n long", "rows binary")
        # lists of the uuids in chunks; the next number of a chunk and of a list, and the lists with their sizes and last deadlines
        self.lists = handle.getMapState("lists", "n long", "prints binary")
        self.heads = handle.getMapState("heads", "at int", "heads binary")
        self.due = handle.getMapState("due", "deadline long", "chunks array<long>")

    @staticmethod
    def _lists_of(frame: pd.DataFrame) -> Iterator[list[list]]:
        """The columns ``TAKEN`` of a frame as lists."""
        yield [frame[c].tolist() for c in TAKEN]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, last, events = [], {}, {}
        for frame in rows:
            for columns in self._lists_of(frame):
                for kind, uuid, file, pos, name, event, part in zip(*columns):
                    if kind != "entity":
                        events.setdefault((uuid, part), []).append((file, pos, event))
                        continue
                    if part == 0:
                        sent.append((uuid, file, pos, name, None))
                    record = (file, pos, name)
                    if record > last.get((uuid, part), ()):
                        last[uuid, part] = record
        if sent:
            yield self._frame("entity", sent)
        names = Names(self.seen, self.firsts)
        held = {at: names.get(*at) for at in {**last, **events}}
        newer = {at: record for at, record in last.items() if not held[at] or record > held[at]}
        names.put(newer)
        waited = self._waited({at for at in newer if not held[at]})
        known, late = [], {}
        for at, before in held.items():
            record = newer.get(at, before)
            if record:
                known.extend((at[0], file, pos, record[2], event) for file, pos, event in [*waited.get(at, ()), *events.get(at, ())])
            else:
                late[at] = events[at]
        if known:
            yield self._frame("known", known)
        if late:
            self._wait(late, timerValues.getCurrentProcessingTimeInMs())

    def _heads(self) -> tuple[int, int, list[tuple[int, int, int]]]:
        held = self.heads.getValue((0,))
        return pickle.loads(held[0]) if held else (0, 0, [])

    def _waited(self, named: set[tuple]) -> dict[tuple, list[tuple]]:
        """The open events of uuids, which are open no more."""
        out: dict[tuple, list[tuple]] = {}
        wanted = _prints(named)
        for n in sorted(self._chunks_of(wanted)) if len(wanted) else ():
            held = self.chunks.getValue((n,))
            if held is None:
                continue  # ended since
            rows = _unpack(held[0])
            rest = []
            for row in rows:
                at = row[1], row[0]
                out.setdefault(at, []).append(row[2:]) if at in named else rest.append(row)
            if not rest:
                self.chunks.removeKey((n,))
            elif len(rest) < len(rows):
                self.chunks.updateValue((n,), (_pack(rest),))
        return out

    def _chunks_of(self, wanted: np.ndarray) -> set[int]:
        found = set()
        for number, *_ in self._heads()[2]:
            chunks = _unpack(self.lists.getValue((number,))[0])
            prints = [np.frombuffer(b, np.uint32) for _, b in chunks.values()]
            of = np.repeat(np.fromiter(chunks, np.int64), [len(p) for p in prints])
            found.update(of[np.isin(np.concatenate(prints), wanted)].tolist())
        return found

    def _wait(self, late: dict[tuple, list[tuple]], now: int) -> None:
        deadline = now + self.wait_ms
        n, number, lists = self._heads()
        rows = [(part, uuid, *event) for (uuid, part), own in sorted(late.items(), key=lambda x: x[0][::-1]) for event in own]
        own = {}
        for at in range(0, len(rows), CHUNK):
            chunk = rows[at : at + CHUNK]
            self.chunks.updateValue((n,), (_pack(chunk),))
            own[n] = deadline, _prints((uuid, part) for part, uuid in dict.fromkeys(r[:2] for r in chunk)).tobytes()
            n += 1
        ends = self.due.getValue((deadline,))
        self.due.updateValue((deadline,), ([*(ends[0] if ends else ()), *own],))
        self.handle.registerTimer(deadline)
        lists, number = self._listed(own, lists, number, now)
        self.heads.updateValue((0,), (pickle.dumps((n, number, lists), 5),))

    def _listed(self, own: dict, lists: list[tuple[int, int, int]], number: int, now: int) -> tuple[list, int]:
        """Adds the list of a batch's chunks. As many lists of a size as ``FANOUT`` become one; lists of ended chunks go."""
        for gone, _, until in lists:
            if until < now:
                self.lists.removeKey((gone,))
        lists = [x for x in lists if x[2] >= now]
        size = 0
        while len(same := [x for x in lists if x[1] == size]) >= FANOUT - 1:
            for old, *_ in same:
                own |= {n: held for n, held in _unpack(self.lists.getValue((old,))[0]).items() if held[0] >= now}
                self.lists.removeKey((old,))
            lists = [x for x in lists if x[1] != size]
            size += 1
        self.lists.updateValue((number,), (_pack(own),))
        return [*lists, (number, size, max(until for until, _ in own.values()))], number + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        deadline = (expiredTimerInfo.getExpiryTimeInMs(),)
        ends = self.due.getValue(deadline)
        if ends is None:
            return
        gone = []
        for n in ends[0]:
            held = self.chunks.getValue((n,))
            if held is None:
                continue  # resolved since
            gone.extend((uuid, file, pos, None, event) for _, uuid, file, pos, event in _unpack(held[0]))
            self.chunks.removeKey((n,))
        self.due.removeKey(deadline)
        if gone:
            yield self._frame("rejected", gone)

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(kind: str, rows: list[tuple]) -> pd.DataFrame:
        uuid, file, pos, name, event = map(list, zip(*rows))
        columns = [kind] * len(rows), uuid, file, np.array(pos, np.int64), name, event
        return pd.DataFrame(dict(zip(COLUMNS, columns)))


class WaitingPacked(Waiting):
    """``Waiting`` over the rows of ``_packed``."""

    @staticmethod
    def _lists_of(frame: pd.DataFrame) -> Iterator[list[list]]:
        return map(pickle.loads, frame["rows"])


def _lists(column: pa.ChunkedArray) -> list:
    """The values; equal texts are one object, which is packed once."""
    if not pa.types.is_string(column.type):
        return column.to_pylist()
    coded = column.combine_chunks().dictionary_encode()
    texts = [*coded.dictionary.to_pylist(), None]
    return [texts[-1 if i is None else i] for i in coded.indices.to_pylist()]


def _in_slots(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    slots = table.column("slot").to_numpy()
    order = np.argsort(slots, kind="stable")
    columns = [_lists(table.column(c).take(pa.array(order))) if c != "event" else table.column(c).take(pa.array(order)).to_pylist() for c in TAKEN]
    slots, at, keys, rows = slots[order].tolist(), 0, [], []
    for slot, own in groupby(slots):
        end = at + sum(1 for _ in own)
        for start in range(at, end, PACKED_ROWS):
            keys.append(slot)
            rows.append(pickle.dumps([c[start : min(start + PACKED_ROWS, end)] for c in columns], 5))
        at = end
    for i in range(0, len(keys), 100):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100], pa.int32()), pa.array(rows[i : i + 100], pa.binary())], ["slot", "rows"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one slot as one, as far as a task can hold them; only the layout changes."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= HELD_ROWS or size >= HELD_BYTES:
            yield from _in_slots(held)
            held, rows, size = [], 0, 0
    if rows:
        yield from _in_slots(held)


def _await_names(rows: DataFrame, wait_ms: int, parts: int) -> DataFrame:
    """Rows ``(kind, uuid, file, pos, name, event)`` keyed by uuid; entities go to every part, events to one."""
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    one = F.array(F.pmod(F.xxhash64("file", "pos"), F.lit(parts)).cast("int"))
    # an empty uuid names nothing, so it can stand for none
    rows = rows.withColumn("uuid", F.coalesce("uuid", F.lit("")))
    dealt = rows.withColumn("part", F.explode(F.when(F.col("kind") == "entity", every).otherwise(one)))
    slots = dealt.withColumn("slot", F.pmod(F.xxhash64("uuid", "part"), F.lit(SLOTS)).cast("int"))
    packed = slots.select("slot", *TAKEN).mapInArrow(_packed, "slot int, rows binary")
    return packed.groupBy("slot").transformWithStateInPandas(WaitingPacked(wait_ms), OUT, "Append", "ProcessingTime")


def _start(df: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Starts a query into a table. Timers need the state store that keeps several columns of state per key; a run to
    the end of the data must not go on with empty batches for them, so its timers fire with the next data.

    Every batch commits every partition of state, also an idle one: it writes the changes only, and there are no more
    partitions than keep the cores busy. What the partitions of an executor hold in memory is bounded together.
    """
    conf, cores = df.sparkSession.conf, df.sparkSession.sparkContext.defaultParallelism
    own = {
        PROVIDER: ROCKS, EMPTY_BATCHES: str(not available_now).lower(), CHANGES_ONLY: "true", BOUNDED: "true", BOUND: "300",
        BATCH_BYTES: str(8 << 20),
        PARTITIONS: str(min(int(conf.get(PARTITIONS)), max(4 * cores, 32), SLOTS // 2)),
    }
    before = {key: conf.get(key, None) for key in own}
    for key, value in own.items():
        conf.set(key, value)
    try:
        writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start(path)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def stream_resolve(records: DataFrame, table: str, checkpoint: str, wait: float = 86_400, parts: int = PARTS, available_now: bool = True) -> list[StreamingQuery]:
    """Resolves streamed audit records into ``table``; see ``resolved`` and ``rejected`` for the result.

    An event is named by the newest record of each of its uuids, in the order of files and positions, that has come by
    the time the event or the uuid's first record has, whichever is later. An event that waits ``wait`` seconds for one
    side is rejected, also where a uuid is null; a record that comes later does not bring it back. The state of named uuids is kept.
    With ``available_now`` both queries run to the end of the data, one after the other; else they run on side by side.
    """
    spark = records.sparkSession
    configure(spark)
    wait_ms = max(int(wait * 1000), 1)
    both = cdm.events_and_entities(records)
    is_event = F.col("event").isNotNull()
    rows = both.select(
        F.when(is_event, "event").otherwise("entity").alias("kind"), F.when(is_event, F.col("event.src_uuid")).otherwise(F.col("uuid")).alias("uuid"),
        "file", "pos", F.col("entity_key").alias("name"), F.to_json("event").alias("event"),
    )
    first = _start(_await_names(rows, wait_ms, parts), f"{table}/first", f"{checkpoint}/first", available_now)
    if available_now:
        first.awaitTermination()
    make_folder(spark, f"{table}/first")
    after = spark.readStream.schema(OUT).parquet(f"{table}/first")
    dst = F.get_json_object("event", "$.dst_uuid")
    # the first side's name travels behind the event's text, which is one line, until the second is known
    is_event = F.col("kind") == "known"
    rows = after.where("kind in ('known', 'entity')").select(
        F.when(is_event, "event").otherwise("entity").alias("kind"), F.when(is_event, dst).otherwise(F.col("uuid")).alias("uuid"),
        "file", "pos", F.when(~is_event, F.col("name")).alias("name"), F.when(is_event, F.concat("event", F.lit("\n"), "name")).alias("event"),
    )
    second = _start(_await_names(rows, wait_ms, parts), f"{table}/second", f"{checkpoint}/second", available_now)
    if available_now:
        second.awaitTermination()
    return [first, second]


def event_schema(spark: SparkSession) -> StructType:
    """The columns of audit events."""
    return cdm.events(spark.sql("select '' as file, 0L as pos, '' as raw, parse_json('{}') as v where false")).schema


def _both(column: str) -> tuple[Column, Column]:
    """An event's text, and the name behind it."""
    ends = F.split(column, "\n", 2)
    return ends[0], ends[1]


def resolved(spark: SparkSession, table: str) -> DataFrame:
    """Events with ``src_key`` and ``dst_key``."""
    rows = spark.read.schema(OUT).parquet(f"{table}/second").where("kind = 'known'")
    event, src = _both("event")
    named = rows.select(F.from_json(event, event_schema(spark)).alias("row"), src.alias("src_key"), F.col("name").alias("dst_key"))
    return named.select("row.*", "src_key", "dst_key")


def rejected(spark: SparkSession, table: str) -> DataFrame:
    """Events that waited too long, with the uuid that was not there."""
    first, second = (spark.read.schema(OUT).parquet(f"{table}/{side}").where("kind = 'rejected'") for side in ("first", "second"))
    late = first.select("uuid", "event").unionByName(second.select("uuid", _both("event")[0].alias("event")))
    return late.select(F.from_json("event", event_schema(spark)).alias("row"), F.nullif("uuid", F.lit("")).alias("missing_uuid")).select("row.*", "missing_uuid")
