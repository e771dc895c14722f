"""Term divergence between the sources of a language, over the terms that enough of its documents hold.

The kept terms are found by prefix refinement. A level counts, per language, the distinct documents that hold a term
with each byte prefix of the level's length; prefixes below the threshold are dropped with all their terms, the others
are extended to twice the length, until only complete terms remain. Between levels the live prefixes travel as a filter
of fixed size that never loses one, so what it lets through too much only costs work; a term is kept by its own exact
count.

Documents are read once, into chunks of distinct terms with their documents; levels read those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.textops import LOWER, flat, pieces
from spoorline.session import cut

SCALE = 1_000_000_000
CHUNK_BYTES = 2_000_000  # of text
FIRST_LEVEL = 4  # bytes
FILTER_BITS = 25  # of the filter between levels: 4 MB in each task
SHIFTS = (0, 64 - FILTER_BITS)  # two places of a hash

TERM = np.zeros(256, dtype=bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True

FLUSH_ROWS = 500_000  # of counts that a task holds before it hands them on

# arrays of a chunk, as little-endian integers: bytes per term, pairs (term, document) per term, of each pair the document
# and the occurrences, of each document its (lang, source) group, of each group its language
CHUNK = "langs array<string>, sources array<string>, letters binary, lengths binary, held binary, doc binary, n binary, doc_group binary, group_lang binary"
COUNTS = "lang string, source string, prefix binary, docs long, n long"


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the terms of some texts."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = TERM[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    starts[heads], ends[tails] = TERM[data[heads]], TERM[data[tails]]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _blob(values: np.ndarray, kind: str = "<u4") -> bytes:
    return values.astype(kind).tobytes()


def _kind(most: int) -> str:
    return "<u2" if most < 1 << 16 else "<u4"


def _chunk(data: np.ndarray, offsets: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.RecordBatch:
    """The distinct terms of some documents, and per (term, document) the number of occurrences."""
    start, end = spans(data, offsets)
    places = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=places[1:])
    letters = LOWER[data][TERM[data]]  # terms side by side
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    n_docs = len(offsets) - 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    keys, counts = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_docs + doc, return_counts=True)
    lang, source = langs.dictionary_encode(), sources.dictionary_encode()
    pair, group = np.unique(lang.indices.to_numpy().astype(np.int64) * n_docs + source.indices.to_numpy(), return_inverse=True)
    letters, ends = flat(words.dictionary)
    held = np.bincount(keys // n_docs, minlength=len(words.dictionary))
    row = [
        lang.dictionary.to_pylist(), source.dictionary.take(pa.array(pair % n_docs)).to_pylist(), letters.tobytes(), _blob(np.diff(ends)), _blob(held),
        _blob(keys % n_docs, _kind(n_docs)), _blob(counts, _kind(int(counts.max(initial=0)))), _blob(group), _blob(pair // n_docs)]
    kinds = [pa.list_(pa.string())] * 2 + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [f.split(" ")[0] for f in CHUNK.split(", ")])


class Chunk:
    """A stored chunk, read back."""

    def __init__(self, row: dict):
        numbers = lambda name, kind="<u4": np.frombuffer(row[name], kind).astype(np.int64)
        self.langs, self.sources = row["langs"], row["sources"]
        self.length, held, self.doc_group, self.group_lang = (numbers(c) for c in ("lengths", "held", "doc_group", "group_lang"))
        self.doc = numbers("doc", _kind(len(self.doc_group)))
        self.n = numbers("n", "<u2" if len(row["n"]) == 2 * len(self.doc) else "<u4")
        self.term = np.repeat(np.arange(len(held)), held)
        ends = np.zeros(len(held) + 1, np.int32)
        np.cumsum(self.length, out=ends[1:])
        self.terms = pa.BinaryArray.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends), pa.py_buffer(row["letters"])])
        self.doc_lang = self.group_lang[self.doc_group]

    def prefixes(self, level: int, used: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct prefixes of the used terms and each term's number among them."""
        heads = pc.binary_slice(self.terms.take(pa.array(used)), 0, level).dictionary_encode()
        number = np.zeros(len(self.terms), np.int64)
        number[used] = heads.indices.to_numpy(zero_copy_only=False)
        return heads.dictionary, number


def _chunks(chunk_bytes: int):
    def run(batches):
        held, size = [], 0

        def close():
            table = pa.Table.from_batches(held).combine_chunks()
            data, offsets = flat(table.column("text"))
            held.clear()
            return _chunk(data, offsets, *(table.column(c).combine_chunks() for c in ("lang", "source")))

        for batch in batches:
            _, offsets = flat(batch.column("text"))
            for i, j in pieces(offsets, chunk_bytes):
                if held and size + offsets[j] - offsets[i] > chunk_bytes:
                    yield close()
                    size = 0
                held.append(batch.slice(i, j - i))
                size += offsets[j] - offsets[i]
        if held:
            yield close()

    return run


class Filter:
    """The live prefixes of a level as a bitmap; it may let others through."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        live = np.ones(len(hashes), dtype=bool)
        for shift in SHIFTS:
            at = (hashes >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
            live &= ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
        return live


def _hashes(langs: list[str], codes: np.ndarray, prefixes: list[bytes]) -> np.ndarray:
    """As Spark's ``xxhash64(lang, prefix)``."""
    seeds = [xxhash.xxh64_intdigest(lang.encode(), 42) for lang in langs]
    return np.fromiter((xxhash.xxh64_intdigest(p, seeds[c]) for c, p in zip(codes.tolist(), prefixes)), np.uint64, len(prefixes))


def live_filter(prefixes: DataFrame) -> Filter:
    """The filter of ``(lang, prefix)`` rows. At most its own words reach the driver, however many rows there are."""
    key = F.xxhash64("lang", "prefix")
    places = F.explode(F.array(*[F.shiftrightunsigned(key, shift).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) for shift in SHIFTS]))
    at = prefixes.select(places.alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words)


def _seen(keys: np.ndarray, size: int) -> np.ndarray:
    marks = np.zeros(size, dtype=bool)
    marks[keys] = True
    return np.flatnonzero(marks)


def _counts(chunk: Chunk, level: int, live) -> Iterator[tuple]:
    """``(lang, source, prefix, docs, n)`` columns of one chunk: complete terms by source, longer ones without."""
    term, doc, n, langs = chunk.term, chunk.doc, chunk.n, len(chunk.langs)
    if live is not None:
        done = level // 2
        on = chunk.length[term] >= done
        term, doc, n = term[on], doc[on], n[on]
        heads, number = chunk.prefixes(done, _seen(term, len(chunk.terms)))
        key = number[term] * langs + chunk.doc_lang[doc]
        asked = _seen(key, len(heads) * langs)
        passed = np.zeros(len(heads) * langs, dtype=bool)
        passed[asked] = live(_hashes(chunk.langs, asked % langs, heads.take(pa.array(asked // langs)).to_pylist()))
        on = passed[key]
        term, doc, n = term[on], doc[on], n[on]
    ready = chunk.length[term] < level
    groups = len(chunk.group_lang)
    key = term[ready] * groups + chunk.doc_group[doc[ready]]
    keys, back = np.unique(key, return_inverse=True)
    group = keys % groups
    yield chunk.group_lang[group], group, chunk.terms.take(pa.array(keys // groups)), np.bincount(back, minlength=len(keys)), np.bincount(back, weights=n[ready], minlength=len(keys))
    term, doc = term[~ready], doc[~ready]
    heads, number = chunk.prefixes(level, _seen(term, len(chunk.terms)))
    both = np.unique(number[term] * len(chunk.doc_lang) + doc)
    keys, docs = np.unique(both // len(chunk.doc_lang) * langs + chunk.doc_lang[both % len(chunk.doc_lang)], return_counts=True)
    yield keys % langs, None, heads.take(pa.array(keys // langs)), docs, np.zeros(len(keys))


def _level(level: int, shared):
    """Counts of a task's chunks at one level, added up as long as they are few."""

    def run(batches):
        names: dict[str | None, int] = {None: 0}
        held, size = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "source", "prefix"]).aggregate([("docs", "sum"), ("n", "sum")])

        def out(table: pa.Table):
            known = pa.array(list(names), pa.string())
            for part in table.combine_chunks().to_batches(100_000):
                columns = [known.take(part.column("lang")), known.take(part.column("source")), part.column("prefix"), part.column("docs_sum"), part.column("n_sum")]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "prefix", "docs", "n"])

        code = lambda values: np.array([names.setdefault(v, len(names)) for v in values], np.int32)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk({name: batch.column(name)[row].as_py() for name in batch.schema.names})
                langs, sources = code(chunk.langs), code(chunk.sources)
                for lang, source, prefix, docs, n in _counts(chunk, level, shared and shared.value):
                    source = np.zeros(len(lang), np.int32) if source is None else sources[source]
                    held.append(pa.table([langs[lang], source, prefix, docs.astype(np.int64), n.astype(np.int64)], ["lang", "source", "prefix", "docs", "n"]))
                    size += len(lang)
                if size >= 2 * FLUSH_ROWS:
                    table = added()
                    if len(table) >= FLUSH_ROWS:
                        yield from out(table)
                        held, size = [], 0
                    else:
                        held, size = [table.rename_columns({"docs_sum": "docs", "n_sum": "n"})], len(table)
        if size:
            yield from out(added())

    return run


def _cleaned(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """``(lang, source, term, n, whole, first)``: occurrences, in a source and in the language, of the terms that at
    least ``least_docs`` documents of the language hold; ``first`` marks one source per term."""
    sc = docs.sparkSession.sparkContext
    chunks = cut(_cleaned(docs).mapInArrow(_chunks(CHUNK_BYTES), CHUNK))
    level, shared, complete = FIRST_LEVEL, None, None
    while True:
        counted = cut(
            chunks.mapInArrow(_level(level, shared), COUNTS).groupBy("lang", "source", "prefix")
            .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")))
        own = counted.where("source is not null").select("lang", "source", F.col("prefix").cast("string").alias("term"), "docs", "n")
        complete = own if complete is None else complete.unionByName(own)
        live = counted.where(F.col("source").isNull() & (F.col("docs") >= least_docs))
        if live.isEmpty():
            break
        shared, level = sc.broadcast(live_filter(live)), 2 * level
    term = Window.partitionBy("lang", "term")
    added = complete.withColumns({
        "held": F.sum("docs").over(term), "whole": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return added.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "whole", "first")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """Smoothed share of a term in parts of SCALE, exact; null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * wide(n + 1)
    return F.when(terms > 0, F.lit(1) + _div(scaled, wide(total + terms)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _total(value: Column) -> Column:
    """Exact sum of longs, by halves, which stay in machine words."""
    high, low = F.sum(F.shiftright(value, 32)), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    return (high.cast("decimal(27,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(27,0)")).cast("decimal(38,0)").alias("value")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source of a language is from the others, and by which terms.

    Terms are runs of ASCII letters, lower-cased, and of characters beyond ASCII. With p the smoothed share of a kept
    term in a source, a ``pair`` row adds up (p - q)^2 / q over all kept terms, q the share in the other source
    ``item``; a ``term`` row has it for one term more common in the source than in the whole language, the ``top``
    largest per source. Shares are integers, every quotient is rounded down, sums are exact.

    Null text, lang and source are empty; every row is a document of its own, repeated or not. Sources without terms
    take part in pairs. Ties rank by the item's bytes. A language without kept terms has pairs of value 0. An empty
    table gives no rows, and other columns are not looked at. Very long texts and terms are counted whole. Terms
    missing in a source all have one share: pairs list the terms that both sources have, the others enter by the
    histogram of shares.
    """
    counts = cut(kept_counts(docs, least_docs))
    groups = _cleaned(docs).select("lang", "source").distinct()
    langs = counts.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("total"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    sizes = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.monotonically_increasing_id().alias("g"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own", "terms", "total")])
    sizes = cut(sizes.withColumn("p0", _share(F.lit(0), F.col("own"), F.col("terms"))))
    shares = cut(counts.join(sizes, ["lang", "source"]).select(
        "lang", "source", "g", "term", "p0", _share(F.col("n"), F.col("own"), F.col("terms")).alias("p"), _share(F.col("whole"), F.col("total"), F.col("terms")).alias("q")))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    apart = F.col("g") != F.col("h")
    other = lambda df, *names: df.select(F.col("g").alias("h"), *names)
    both = shares.select("lang", "term", "g", "p", "p0").join(other(shares, "lang", "term", p.alias("q"), p0.alias("q0")), ["lang", "term"]).where(apart)
    both = both.groupBy("g", "h").agg(_total(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)))
    bars = shares.groupBy("lang", "g", "p0", "p").agg(F.count(F.lit(1)).alias("m"))
    many = F.col("m").cast("decimal(20,0)")
    mine = bars.join(other(sizes, "lang", p0.alias("q0")), "lang").where(apart).groupBy("g", "h").agg(F.sum((many * (_gap(p, q0) - _gap(p0, q0))).cast("decimal(38,0)")).alias("value"))
    theirs = other(bars, "lang", "m", p.alias("q"), p0.alias("q0")).join(sizes.select("lang", "g", "p0"), "lang").where(apart).groupBy("g", "h").agg(
        F.sum((many * (_gap(p0, q) - _gap(p0, q0))).cast("decimal(38,0)")).alias("value"))
    neither = sizes.join(other(sizes, "lang", p0.alias("q0")), "lang").where(apart).select(
        "g", "h", F.coalesce((F.col("terms").cast("decimal(20,0)") * _gap(p0, q0)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("value"))
    pairs = neither.unionByName(both).unionByName(mine).unionByName(theirs).groupBy("g", "h").agg(F.sum("value").cast("long").alias("value"))
    pairs = pairs.join(sizes.select("g", "lang", "source"), "g").join(sizes.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
