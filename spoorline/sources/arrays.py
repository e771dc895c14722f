"""One JSON array or object per file, read by many tasks.

Spark's text reader cuts files into blocks and blocks at every comma. Whether a comma separates two elements depends on
the depth and on whether it lies in a string, which a block does not know. So a first pass notes, for both cases of the
block's first byte, how the block changes depth and string state, and how many commas it has at each relative depth;
composing these from block to block gives every block its start. The second pass cuts the elements; only those that
cross a block border are put together in an exchange. Every element is then parsed on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators.records import once, strictly
from spoorline.session import configure, cut

SPACE = b" \t\r\n"
EFFECT = "file string, block long, first string, flip boolean, plain long, quoted long, plain_depths map<int,long>, quoted_depths map<int,long>"
PIECE = "file string, pos long, block long, text string, whole boolean, last boolean, bytes long, size long"
PACKED = (".gz", ".bz2", ".zst", ".lz4", ".deflate", ".snappy")


@dataclass
class Start:
    """State before a block: depth, in a string or not, number of the element, kind of document; whether the block ends the file."""

    depth: int = 0
    quoted: bool = False
    element: int = 0
    first: str = ""
    last: bool = True


class Scan:
    """Depth and string state after each fragment of some text, for either state before it."""

    def __init__(self, text: bytes, ends: np.ndarray):
        data = np.frombuffer(text, np.uint8)
        quotes = data == 34
        slashes = data == 92
        if slashes.any():
            at = np.arange(len(data))
            other = np.maximum.accumulate(np.where(slashes, -1, at))
            run = np.zeros(len(data), np.int64)
            run[1:] = at[:-1] - other[:-1]
            quotes &= run % 2 == 0
        odd = np.cumsum(quotes) % 2 == 1
        step = ((data == 91) | (data == 123)).astype(np.int64) - ((data == 93) | (data == 125))
        self.odd = np.r_[False, odd][ends]
        self.plain, self.quoted = (np.r_[0, np.cumsum(step * side)][ends] for side in (~odd, odd))


def _runs(batches) -> Iterator[tuple[tuple[str, int, int], bytes, np.ndarray]]:
    """Fragments of one block in one batch: (file, block, file size), text with its commas, where each fragment ends."""
    for batch in batches:
        values, i = batch.column("value").to_pylist(), 0
        for key, rows in groupby(zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")))):
            own = values[i : i + sum(1 for _ in rows)]
            i += len(own)
            yield key, b",".join(own), np.cumsum([len(v) + 1 for v in own]) - 1


def _first(text: bytes) -> str:
    return text.lstrip(SPACE)[:1].decode("latin-1")


def _effects(batches):
    def row():
        odd, plain, quoted, a, b, first = state
        return pa.RecordBatch.from_pylist(
            [{"file": key[0], "block": key[1], "first": first, "flip": odd, "plain": plain, "quoted": quoted, "plain_depths": list(a.items()), "quoted_depths": list(b.items())}],
            pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("flip", pa.bool_()), ("plain", pa.int64()), ("quoted", pa.int64()),
                       ("plain_depths", pa.map_(pa.int32(), pa.int64())), ("quoted_depths", pa.map_(pa.int32(), pa.int64()))]))

    key, state = None, None
    for at, text, ends in _runs(batches):
        if at != key:
            if key:
                yield row()
            key, state = at, (False, 0, 0, Counter(), Counter(), "")
        odd, plain, quoted, a, b, first = state
        scan = Scan(text, ends)
        sides = (scan.plain, scan.quoted) if not odd else (scan.quoted, scan.plain)
        outside = scan.odd == odd  # as many quotes as the block's first byte had: even from there
        a.update((plain + sides[0])[outside].tolist())
        b.update((quoted + sides[1])[~outside].tolist())
        state = (odd ^ bool(scan.odd[-1]), plain + int(sides[0][-1]), quoted + int(sides[1][-1]), a, b, first or _first(text))
    if key:
        yield row()


def starts_of(effects: list) -> dict[tuple[str, int], Start]:
    """The start of every block, from the effects of all blocks of some files."""
    out = {}
    for file, rows in groupby(sorted(effects, key=lambda r: (r["file"], r["block"])), key=lambda r: r["file"]):
        rows = list(rows)
        first = next((r["first"] for r in rows if r["first"]), "")
        now = Start(first=first, last=False)
        for r in rows:
            out[file, r["block"]] = now
            side = "quoted" if now.quoted else "plain"
            commas = r[f"{side}_depths"].get(1 - now.depth, 0) if first == "[" else 0
            now = Start(now.depth + r[side], now.quoted ^ r["flip"], now.element + commas, first, False)
        out[file, rows[-1]["block"]].last = True
    return out


def _pieces(shared):
    def run(batches):
        key, start = None, None
        held: list[bytes] = []
        opened = False  # whether the element at hand began before the block
        rows: list[tuple] = []

        def piece(whole: bool, last: bool) -> None:
            text = b",".join(held)
            rows.append((key[0], start.element, key[1], text.decode(errors="replace"), whole, last, len(text) + 1, key[2]))
            held.clear()

        def out():
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split(" ")[0] for f in PIECE.split(", ")])
            rows.clear()
            return batch

        for at, text, ends in _runs(batches):
            if at != key:
                if held:
                    piece(start.last and not opened, start.last)
                key = at
                known = shared.value.get(at[:2])
                start = Start(**vars(known)) if known else Start()
                opened = at[1] > 0
            start.first = start.first or _first(text)
            scan = Scan(text, ends)
            depth = start.depth + (scan.quoted if start.quoted else scan.plain)
            quoted = scan.odd ^ start.quoted
            begin = 0
            for c in np.flatnonzero((depth == 1) & ~quoted) if start.first == "[" else ():
                held.append(text[begin : ends[c]])
                piece(not opened, False)
                opened = False
                start.element += 1
                begin = int(ends[c]) + 1
            if begin <= len(text):
                held.append(text[begin:])
            start.depth, start.quoted = int(depth[-1]), bool(quoted[-1])
            if len(rows) >= 5000:
                yield out()
        if held:
            piece(start.last and not opened, start.last)
        if rows:
            yield out()

    return run


# as bytes, the time to open a file; with Spark's 4 MB a task gets one or two small files and is mostly its own start
OPEN_COST = 1 << 16


@contextmanager
def _same_blocks(spark: SparkSession, read: DataFrame) -> Iterator[int]:
    """Holds the block size for both passes: Spark's own choice follows from the files that a scan happens to read.

    The files were listed for ``read``, whose plan knows their size; small files are packed into few tasks.
    """
    conf, names = spark.conf, ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    most, least = (spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(n)) for n in names)
    total = int(str(read._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    size = min(most, max(least, total // spark.sparkContext.defaultParallelism))
    own = {names[0]: str(size), names[1]: str(min(least, OPEN_COST)), "spark.sql.files.minPartitionNum": "1"}
    before = {key: conf.get(key, None) for key in own}
    for key, value in own.items():
        conf.set(key, value)
    try:
        yield size
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def elements(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file, pos, raw, v)``: elements of files that hold one JSON array or one object and nothing else.

    A file with any element that is no JSON value, that is not closed or that goes on behind its end, gives no rows;
    elements that are no objects have a position but no row. Blank files and empty arrays have none. Of files of
    several blocks one entry per block reaches the driver. An element must fit into a task's memory, the file need not.
    """
    configure(spark)
    read = spark.read.text(paths, lineSep=",")
    lines = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    with _same_blocks(spark, read) as size:
        # files of one block begin at depth 0 and need no first pass
        effects = lines.where(F.col("size") > size).mapInArrow(_effects, EFFECT).collect()
        shared = spark.sparkContext.broadcast(starts_of([r.asDict() for r in effects]))
        pieces = cut(lines.mapInArrow(_pieces(shared), PIECE))
    joined = pieces.where("not whole").groupBy("file", "pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), ",").alias("text"), F.max("last").alias("last"))
    texts = pieces.where("whole").select("file", "pos", "text", "last").unionByName(joined)

    found = cut(_parsed(texts))
    # the text reader does not show a comma at the very end: then fragments and commas are all bytes of the file
    packed = F.col("file").rlike("(" + "|".join(re.escape(e) for e in PACKED) + ")$")
    ends = pieces.groupBy("file").agg(F.max("last").alias("ended"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    bad = found.where("not ok").select("file").union(ends.where(~F.col("ended") | (~packed & (F.col("bytes") == F.col("size")))).select("file")).distinct()
    kept = found.where(F.col("raw").startswith("{")).join(bad, "file", "left_anti")
    return kept.select("file", "pos", "raw", F.try_parse_json("raw").alias("v"))


def _parsed(texts: DataFrame) -> DataFrame:
    """``(file, pos, raw, ok)``: elements without the array's own brackets, and whether they are whole JSON values."""
    trimmed = lambda c: F.trim(c, F.lit(SPACE.decode()))
    rows = texts.withColumn("text", trimmed(F.col("text")))
    rows = rows.withColumn("array", (F.col("pos") > 0) | F.col("text").startswith("["))
    rows = rows.withColumn("closed", ~F.col("array") | ~F.col("last") | F.col("text").endswith("]"))
    opened = F.when(F.col("array") & (F.col("pos") == 0), F.expr("substring(text, 2)")).otherwise(F.col("text"))
    rows = rows.withColumn("body", opened)
    rows = rows.withColumn("body", trimmed(F.when(F.col("array") & F.col("last") & F.col("closed"), F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body"))))
    empty = F.col("array") & F.col("last") & F.col("closed") & (F.col("pos") == 0) & (F.col("body") == "")
    wrapped, whole = strictly(F.col("body"))
    held = once(rows.where(~empty), __w=wrapped)
    ok = F.coalesce(F.col("closed") & whole(F.col("__w")) & (F.col("array") | F.col("body").startswith("{")), F.lit(False))
    return held.select("file", "pos", F.to_json(F.try_variant_get("__w", "$[0]", "variant")).alias("raw"), ok.alias("ok"))
