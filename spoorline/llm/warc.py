"""WARC archives of captures, with a two-level index for reading them back by address.

Archives are gzip members, one per record. The index holds the captures sorted by their reversed-host key in compressed
blocks; every index file ends with its block directory (the first key of each block), and the first key of each file is
known to the driver. A look-up searches these three levels by bisection and then reads the record's byte range.

Tasks write files of their own under new names and return what they wrote; only returned files count, so a task that is
lost or run twice leaves an unread file at most. The root must be a folder that all executors reach by an Arrow file
system (file, hdfs, s3, gs).
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.session import cut

ARCHIVE_BYTES = 256 << 20  # an archive file is closed when it exceeds this
BLOCK_ENTRIES = 512
FILE_BLOCKS = 8192  # of an index file, which bounds its directory
KEY_BYTES = 256  # of a file's first key, as the driver holds it
READ_BYTES, GAP_BYTES = 4 << 20, 64 << 10  # neighbouring ranges are read at once
CHUNK_BYTES = 64 << 20  # of an archive, read by one task
OUT_BYTES = 8 << 20
LEAST_REVISIT = 100
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "key string, archive string, offset long, length long"


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a folder and the folder's path in it."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _new_file(system: fs.FileSystem, folder: str, ending: str):
    system.create_dir(folder, recursive=True)
    path = f"{folder}/{uuid.uuid4().hex}{ending}"
    return path, system.open_output_stream(path, compression=None, buffer_size=1 << 20)


def _pack(data: bytes) -> bytes:
    return zlib.compress(data, 6, wbits=31)


# keys


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL: scheme, user, fragment and standard port go, host labels are turned
    round and lower-cased; white space and control characters become ``%20``. A text that is no URL is its own key."""
    plain = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    head = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
    place = F.lower(F.regexp_extract(plain, head + r"([^/?#]*)", 1))
    host, port = F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1), F.regexp_extract(place, r"(:[0-9]+)$", 1)
    rest = F.regexp_extract(plain, head + r"[^/?#]*([^#]*)", 1)
    turned = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    kept_port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    return F.when(plain.rlike(head), F.concat(turned, kept_port, F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(plain)


def id_text(capture_id: Column) -> Column:
    return F.url_encode(F.coalesce(capture_id.cast("string"), F.lit("")))


def capture_key(url: Column, capture_id: Column) -> Column:
    return F.concat(url_key(url), F.lit("\0"), id_text(capture_id))


# writing


def record(kind: str, name: str, url: str, date: str, digest: str, body: bytes, refers_to: str | None = None, refers_url: str | None = None) -> bytes:
    """One record, uncompressed; ``body`` is the payload of a response and is left out of a revisit."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:capture:{refers_to}>", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Profile: {PROFILE}"]
    block = HTTP % len(body) + (body if kind == "response" else b"")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _write(root: str, archive_bytes: int):
    def run(batches):
        system, base = file_system(root)
        out, path, offset, date = None, "", 0, "1970-01-01T00:00:00Z"
        try:
            for batch in batches:
                entries = []
                for row in range(batch.num_rows):
                    key, name, url, date, digest, ref, ref_url, payload = (c[row].as_py() for c in batch.columns)
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        path, out = _new_file(system, f"{base}/archive", ".warc.gz")
                        note = b"software: spoorline\r\nformat: WARC File Format 1.1\r\n"
                        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(note)}\r\n\r\n"
                        info = _pack(head.encode() + note + b"\r\n\r\n")
                        out.write(info)
                        offset = len(info)
                    kind = "response" if ref is None else "revisit"
                    member = _pack(record(kind, name, _header_url(url), date, digest, payload, ref, _header_url(ref_url)))
                    out.write(member)
                    entries.append((key, path.rsplit("/", 1)[1], offset, len(member)))
                    offset += len(member)
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*entries)], ["key", "archive", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def write(pages: DataFrame, root: str, id_column: str, url_column: str, payload_column: str, date: Column | None = None, least: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row into archives below ``root``; returns the captures ``(key, archive, offset, length)``.

    Of records with equal payloads of at least ``least`` bytes those with the smallest id are responses, the others
    revisit it; smaller payloads are all responses. A null payload is empty. Null ids come after all others; rows of a
    null id alone are responses, and so are repeated rows of the smallest id. ``date`` is a WARC date (default: the
    epoch's). Other columns are not looked at. Payloads cross one exchange at most, by their digest, in which Spark
    splits a payload that many rows share.
    """
    base = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"),
        F.coalesce(date if date is not None else F.lit(None), F.lit("1970-01-01T00:00:00Z")).alias("date")).withColumn("digest", F.sha2("payload", 256))
    big = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url")).alias("first"))
    joined = base.join(big.where("copies > 1").select("digest", "first"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("first.none") & ~F.col("id").eqNullSafe(F.col("first.id"))
    records = joined.select(
        capture_key(F.col("url"), F.col("id")).alias("key"), id_text(F.col("id")).alias("name"), "url", "date", "digest",
        F.when(again, id_text(F.col("first.id"))).alias("ref"), F.when(again, F.coalesce("first.url", F.lit(""))).alias("ref_url"), "payload")
    return cut(records.mapInArrow(_write(root, archive_bytes), ENTRY))


# index


@dataclass
class Index:
    """The sorted index files: ``first`` key, path, place of the block directory. One entry per file."""

    root: str
    first: list[bytes] = field(default_factory=list)
    files: list[tuple[str, int, int]] = field(default_factory=list)


def _write_index(root: str, block_entries: int, file_blocks: int):
    def run(batches):
        system, base = file_system(root)
        out, path, at, directory, block, files = None, "", 0, [], [], []

        def end_block():
            nonlocal at
            data = _pack("\n".join("\t".join(map(str, e)) for e in block).encode())
            out.write(data)
            directory.append(f"{block[0][0]}\t{at}\t{len(data)}")
            at += len(data)
            block.clear()

        def end_file():
            nonlocal out
            if block:
                end_block()
            data = _pack("\n".join(directory).encode())
            out.write(data)
            out.close()
            files.append((directory[0].split("\t")[0].encode()[:KEY_BYTES], path.rsplit("/", 1)[1], at, len(data)))
            out = None
            directory.clear()

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, out = _new_file(system, f"{base}/index", ".cdx")
                    at = 0
                block.append(entry)
                if len(block) == block_entries:
                    end_block()
                    if len(directory) == file_blocks:
                        end_file()
        if out is not None:
            end_file()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files)], ["first", "path", "at", "length"])

    return run


def build_index(captures: DataFrame, root: str, block_entries: int = BLOCK_ENTRIES, file_blocks: int = FILE_BLOCKS) -> Index:
    """Sorts the captures by key, in parallel, into index files below ``root``; one row per file reaches the driver."""
    order = ["key", "archive", "offset"]
    laid = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    files = laid.mapInArrow(_write_index(root, block_entries, file_blocks), "first binary, path string, at long, length long").collect()
    files = sorted((bytes(r["first"]), r["path"], r["at"], r["length"]) for r in files)
    return Index(root, [f[0] for f in files], [f[1:] for f in files])


# reading


def _route(shared):
    """The index files that a query's keys may lie in."""

    def run(batches):
        first = shared.value.first
        for batch in batches:
            low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
            part, source = [], []
            for i, (lo, hi) in enumerate(zip(low, high)):
                # cut keys say less: all files that may hold the range are searched
                start = max(bisect_left(first, lo.encode()[:KEY_BYTES]) - 1, 0)
                stop = bisect_right(first, hi.encode()[:KEY_BYTES])
                part.extend(range(start, stop))
                source.extend([i] * max(stop - start, 0))
            rows = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *rows.columns], ["part", *rows.schema.names])

    return run


class _IndexFile:
    """One index file: its directory, and the block read last."""

    def __init__(self, system: fs.FileSystem, path: str, at: int, length: int):
        self.file = system.open_input_file(path)
        lines = [line.split("\t") for line in self._read(at, length)]
        self.first = [line[0].encode() for line in lines]
        self.places = [(int(line[1]), int(line[2])) for line in lines]
        self.last: tuple[int, list[bytes], list[list[str]]] = (-1, [], [])

    def _read(self, at: int, length: int) -> list[str]:
        return zlib.decompress(self.file.read_at(length, at), wbits=31).decode().split("\n")

    def _block(self, b: int) -> tuple[list[bytes], list[list[str]]]:
        if self.last[0] != b:
            entries = [line.split("\t") for line in self._read(*self.places[b])]
            self.last = (b, [e[0].encode() for e in entries], entries)
        return self.last[1], self.last[2]

    def between(self, low: bytes, high: bytes) -> Iterator[list[str]]:
        """Entries with ``low <= key < high``: bisection in the directory, then in the blocks."""
        b = max(bisect_left(self.first, low) - 1, 0)
        while b < len(self.first) and self.first[b] < high:
            keys, entries = self._block(b)
            yield from entries[bisect_left(keys, low) : bisect_left(keys, high)]
            b += 1


def _search(shared):
    def run(batches):
        index: Index = shared.value
        system, base = file_system(index.root)
        number, file = -1, None
        for batch in batches:
            source, found = [], []
            parts, low, high = (batch.column(c).to_pylist() for c in ("part", "low", "high"))
            for i, (part, lo, hi) in enumerate(zip(parts, low, high)):
                if part != number:
                    path, at, length = index.files[part]
                    number, file = part, _IndexFile(system, f"{base}/index/{path}", at, length)
                for key, archive, offset, size in file.between(lo.encode(), hi.encode()):
                    source.append(i)
                    found.append((key, archive, int(offset), int(size)))
                    if len(found) >= 100_000:
                        yield _hits(batch, source, found)
                        source, found = [], []
            yield _hits(batch, source, found)

    return run


def _hits(batch, source, found):
    rows = batch.column("row").take(pa.array(source, pa.int64()))
    columns = list(zip(*found)) if found else [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([rows, *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["row", "key", "archive", "offset", "length"])


def lookup(spark: SparkSession, index: Index, queries: DataFrame, keep: list[str], url_column: str = "url", id_column: str | None = None, prefix: bool = False) -> DataFrame:
    """``(row, key, archive, offset, length)`` of all captures of each query's URL; ``row`` is a struct of ``keep``.

    With ``id_column`` only the capture of that id; with ``prefix`` all captures whose key begins with that of
    ``url_column``, read as a ready key (``com,example,`` for a domain and all below). A query is split by the index
    files it touches, so one that matches a large part of the archive is spread. A null URL is an empty one. Repeated
    queries are answered each.
    """
    if prefix:
        low = F.coalesce(F.col(url_column), F.lit(""))
        high = F.concat(low, F.lit("\U0010ffff"))
    elif id_column:
        low = capture_key(F.col(url_column), F.col(id_column))
        high = F.concat(low, F.lit("\0"))
    else:
        low = F.concat(url_key(F.col(url_column)), F.lit("\0"))
        high = F.concat(url_key(F.col(url_column)), F.lit("\1"))
    asked = queries.select(F.struct(*keep).alias("row"), low.alias("low"), high.alias("high"))
    kind = asked.schema["row"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(index)  # one entry of at most KEY_BYTES and a name per index file
    routed = asked.mapInArrow(_route(shared), f"part int, row {kind}, low string, high string")
    laid = routed.repartitionByRange("part", "low").sortWithinPartitions("part", "low")
    return laid.mapInArrow(_search(shared), f"row {kind}, {ENTRY}")


def parse(data: bytes) -> dict:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    name = lambda h: headers[h].removeprefix("<urn:capture:").removesuffix(">") if h in headers else None
    return {
        "kind": headers["WARC-Type"], "name": name("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "date": headers.get("WARC-Date"),
        "digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha256:"), "refers_to": name("WARC-Refers-To"),
        "payload": block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None,
    }


def _ranges(places: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Groups of neighbouring places, in order, that are read at once."""
    group, start, end = [], 0, 0
    for i, (offset, length) in enumerate(places):
        if group and (offset > end + GAP_BYTES or offset + length > start + READ_BYTES):
            yield group
            group = []
        if not group:
            start, end = offset, offset
        group.append(i)
        end = max(end, offset + length)
    if group:
        yield group


FIELDS = ["kind", "name", "url", "date", "digest", "refers_to", "payload"]


def _fetch(root: str):
    def run(batches):
        system, base = file_system(root)
        for batch in batches:
            archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            for archive, own in groupby(range(batch.num_rows), key=archives.__getitem__):
                own = list(own)
                with system.open_input_file(f"{base}/archive/{archive}") as file:
                    source, records, held = [], [], 0
                    for group in _ranges([(offsets[i], lengths[i]) for i in own]):
                        rows = [own[g] for g in group]
                        start = offsets[rows[0]]
                        data = memoryview(file.read_at(max(offsets[i] + lengths[i] for i in rows) - start, start))
                        for i in rows:
                            found = parse(zlib.decompress(data[offsets[i] - start : offsets[i] - start + lengths[i]], wbits=31))
                            source.append(i)
                            records.append(found)
                            held += len(found["payload"] or b"")
                            if held >= OUT_BYTES:
                                yield _fetched(batch, source, records)
                                source, records, held = [], [], 0
                    if records:
                        yield _fetched(batch, source, records)

    return run


def _fetched(batch, source, records):
    row = batch.column("row").take(pa.array(source, pa.int64()))
    columns = [pa.array([r[f] for r in records], pa.binary() if f == "payload" else pa.string()) for f in FIELDS]
    return pa.RecordBatch.from_arrays([row, *columns], ["row", *FIELDS])


def fetch(hits: DataFrame, root: str) -> DataFrame:
    """``(row, kind, name, url, date, digest, refers_to, payload)`` of the captures found: their byte ranges, by archive
    and offset, neighbours read together. A revisit has no payload of its own."""
    kind = hits.schema["row"].dataType.simpleString()
    placed = hits.select("row", "archive", "offset", "length")
    laid = placed.repartition("archive", F.expr(f"offset div {CHUNK_BYTES}")).sortWithinPartitions("archive", "offset")
    return laid.mapInArrow(_fetch(root), f"row {kind}, " + ", ".join(f"{f} {'binary' if f == 'payload' else 'string'}" for f in FIELDS))


def resolve(captures: DataFrame, *columns: str) -> DataFrame:
    """Gives revisits the named columns of their response, found by its name and digest among ``captures``.

    ``captures`` is read twice, so it should be stored. A revisit whose response is not there keeps its nulls.
    """
    answers = captures.where("kind = 'response'").groupBy("name", "digest").agg(*[F.first(c).alias(f"__{c}") for c in columns])
    answers = answers.withColumnsRenamed({"name": "refers_to"})
    own = captures.where("kind <> 'revisit'")
    again = captures.where("kind = 'revisit'").join(answers, ["refers_to", "digest"], "left")
    again = again.withColumns({c: F.col(f"__{c}") for c in columns}).select(*captures.columns)
    return own.unionByName(again)
