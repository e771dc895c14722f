"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item of n words is fingerprinted at every offset by windows of the largest ladder size L <= 0.8 n, documents by
windows of the same sizes at a step that no item can slip through: some sampled window of an occurrence lies at an
indexed offset. Fingerprints have four blocks of 16 bits; if two fingerprints differ in at most seven bits, some block
differs in at most one, and every block value within one bit of an indexed one is indexed, so no pair within the radius
is missed. Each hit implies where the item would lie in the document; there the 5-word shingles of item and document
decide exactly. A shingle of n different texts of the whole benchmark weighs 1/n there, and shingles that only the
document has weigh as much as the item's missing ones on average. The plain similarity counts as well if the document
holds a shingle that no other text of the benchmark has, or the item has none of its own: so near copies of items that
share a template are found, and the other items of the template are not.

The benchmark is the stated query set: it is split by hash into parts of a bounded number of words, and every part is
held against all documents in a scan without shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.tables import carried
from spoorline.llm.textops import LOWER, Words, flat, pieces, texts_of
from spoorline.session import cut

RADIUS, SHINGLE, SIMILARITY = 7, 5, 0.8
PART_WORDS = 200_000
SHIFTS = (0, -1, 1, -2, 2)
SHARED_WORDS = 0.5  # of an item's words; similar shingles need more
FALSE_START = 0.5  # similarity at the implied place from which its neighbours are tried too

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class BareWords(Words):
    """Words without punctuation at their ends and without case, two-byte Latin letters included; bare marks drop out."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        small = LOWER[data]
        if len(data):
            lead = np.r_[False, data[:-1] == 0xC3]
            small[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
        super().__init__(small, offsets)

    def _trim(self, data: np.ndarray, offsets: np.ndarray) -> None:
        # most words begin and end with a letter or digit and stay as they are
        ragged = np.flatnonzero(~(ALNUM[data[self.start]] & ALNUM[data[self.end - 1]]))
        solid = np.flatnonzero(ALNUM[data])
        low, high = np.searchsorted(solid, self.start[ragged]), np.searchsorted(solid, self.end[ragged])
        some = low < high
        self.start[ragged[some]], self.end[ragged[some]] = solid[low[some]], solid[high[some] - 1] + 1
        bare = ragged[~some]
        self.start, self.end = np.delete(self.start, bare), np.delete(self.end, bare)
        self.first = self.first - np.searchsorted(bare, self.first)


def ladder(n: int) -> int:
    """The largest window size for an item of n words: 1, 2, .. 8, then by quarters, at most 0.8 n."""
    size = best = 1
    while size <= max(1, int(0.8 * n)):
        best = size
        size = size + 1 if size < 8 else size + size // 4
    return best


def step(size: int) -> int:
    """Distance of sampled document windows; an item of at least 1.25 ``size`` words has two of them inside."""
    return max(1, size // 8)


def prints(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit SimHash of the windows of ``size`` words at the positions ``at``; ``sums``: running bit counts."""
    ones = (sums.take(at + size, axis=0) - sums.take(at, axis=0)).view(np.uint8 if sums.shape[1] == 8 else np.uint16)
    return np.packbits(ones > size // 2, axis=1).view(np.uint64).ravel()


def bit_sums(hashes: np.ndarray, most: int) -> np.ndarray:
    """Running counts of every hash bit, several to a 64-bit number.

    Counts run over into their neighbours, but the difference of two sums is exact: no window of up to ``most`` words fills
    the 8 or 16 bits of a count.
    """
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    packed = (bits if most < 256 else bits.astype(np.uint16)).view(np.uint64)
    out = np.zeros((len(hashes) + 1, packed.shape[1]), np.uint64)
    np.cumsum(packed, axis=0, out=out[1:])
    return out


@dataclass
class BlockIndex:
    """Fingerprints of one window size by block value, every value within one bit of it included."""

    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    heads: list[np.ndarray] = field(default_factory=list)
    members: list[np.ndarray] = field(default_factory=list)
    taken: list[np.ndarray] = field(default_factory=list)  # which block values have members

    def __post_init__(self):
        flips = np.r_[0, 1 << np.arange(16)]
        for b in range(4):
            value = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            values, owner = (value[:, None] ^ flips).ravel(), np.repeat(np.arange(len(value)), len(flips))
            order = np.argsort(values, kind="stable")
            self.heads.append(np.searchsorted(values[order], np.arange(65537)).astype(np.int32))
            self.members.append(owner[order].astype(np.int32))
            self.taken.append(np.diff(self.heads[b]) > 0)

    def near(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row of ``found``, row of the index) within the radius, each once or more."""
        rows, hits = [], []
        for b in range(4):
            value = ((found >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            some = np.flatnonzero(self.taken[b][value])
            value = value[some].astype(np.int64)
            low = self.heads[b][value]
            count = self.heads[b][value + 1] - low
            for part in np.array_split(np.arange(len(some)), max(1, int(count.sum()) // 4_000_000 + 1)):
                n = count[part]
                row = np.repeat(some[part], n)
                index = self.members[b][np.repeat(low[part], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
                close = np.bitwise_count(found[row] ^ self.prints[index]) <= RADIUS
                rows.append(row[close])
                hits.append(index[close])
        return np.concatenate(rows), np.concatenate(hits)


def shingle_counts(hashes: np.ndarray) -> dict[int, int]:
    """Multiset of 5-word shingles; a shorter text is one shingle."""
    k = min(SHINGLE, len(hashes))
    if not k:
        return {}
    sums = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        sums = (sums + hashes[i : len(hashes) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        sums ^= sums >> np.uint64(29)
    keys, counts = np.unique(sums, return_counts=True)
    return dict(zip(keys.tolist(), counts.tolist()))


def similarity(item: dict[int, int], other: dict[int, int], weight: dict[int, float]) -> float:
    """Jaccard similarity of two shingle multisets: the weighted one, or the plain one if it is higher and counts.

    An item's shingles without a weight have 1; foreign ones without a weight have the mean of the item's missing ones.
    """
    inner = missing = foreign = 0.0
    shared = n_missing = n_foreign = unknown = own = 0
    for key in item.keys() | other.keys():
        a, b, w = item.get(key, 0), other.get(key, 0), weight.get(key)
        both = min(a, b)
        shared += both
        n_foreign += b - both
        if a:
            own = max(own, 0 if w else 2 if b else 1)
            inner += both * (w or 1.0)
            n_missing += a - both
            missing += (a - both) * (w or 1.0)
        if w or a:
            foreign += (b - both) * (w or 1.0)
        else:
            unknown += b
    usual = missing / n_missing if n_missing else inner / shared if shared else 1.0
    outer = inner + missing + foreign + unknown * usual
    weighted = inner / outer if outer else 0.0
    # own: 0 the item has no shingle of its own, 1 none of them is met, 2 some are
    plain = shared / (shared + n_missing + n_foreign) if own != 1 and shared else 0.0
    return max(weighted, plain)


class Index:
    """Everything a task needs to find the items of one part of the benchmark.

    ``spread``: in how many different texts of the whole benchmark a shingle is, for those in more than one.
    """

    def __init__(self, items: list[tuple[int, str]], spread: dict[int, int]):
        texts = pa.array([t for _, t in items], pa.string())
        words = BareWords(*flat(texts))
        self.ids = [i for i, _ in items]
        self.words = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.shingles = [shingle_counts(h) for h in self.words]
        self.distinct = [set(h.tolist()) for h in self.words]
        self.weight = {key: 1 / n for key, n in spread.items()}
        groups: dict[int, list] = {}
        for i, h in enumerate(self.words):
            if len(h):
                size = ladder(len(h))
                offsets = np.arange(len(h) - size + 1)
                groups.setdefault(size, []).append((prints(bit_sums(h, size), offsets, size), np.full(len(offsets), i), offsets))
        self.sizes = {size: BlockIndex(*(np.concatenate(c) for c in zip(*parts))) for size, parts in sorted(groups.items())}

    def matches(self, words: Words) -> list[dict[int, tuple[float, int, int]]]:
        """Per text its items as ``{item: (similarity, first word, number of words)}`` at their best places."""
        out: list[dict] = [{} for _ in range(len(words.first) - 1)]
        if not len(words.hash):
            return out
        sums = bit_sums(words.hash, max(self.sizes, default=1))
        counts = words.counts()
        for size, index in self.sizes.items():
            gap = step(size)
            n = np.maximum((counts - size) // gap + 1, 0)
            text = np.repeat(np.arange(len(counts)), n)
            at = words.first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * gap
            for low in range(0, len(at), 200_000):
                own = at[low : low + 200_000]
                row, hit = index.near(prints(sums, own, size))
                places = {(int(text[low + r]), int(index.item[h]), int(own[r] - index.offset[h])) for r, h in zip(row, hit)}
                for t, item, start in places:
                    self._verify(words, t, item, start, out[t])
        return out

    def _verify(self, words: Words, t: int, item: int, start: int, into: dict) -> None:
        first, last, n = int(words.first[t]), int(words.first[t + 1]), len(self.words[item])
        around = words.hash[max(first, start + min(SHIFTS)) : min(last, start + n + max(SHIFTS))]
        if len(self.distinct[item].intersection(around.tolist())) < SHARED_WORDS * len(self.distinct[item]):
            return
        for i, shift in enumerate(SHIFTS):
            a, b = max(first, start + shift), min(last, start + shift + n)
            score = similarity(self.shingles[item], shingle_counts(words.hash[a:b]), self.weight)
            if score >= SIMILARITY and score > into.get(item, (0.0,))[0]:
                into[item] = (score, a - first, b - a)
            if not i and (score < FALSE_START or score == 1.0):
                return


def _scan(shared):
    def run(batches):
        index: Index = shared.value
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in batches:
            data, offsets = flat(texts_of(batch))
            found = []
            for i, j in pieces(offsets):
                for own in index.matches(BareWords(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    found.append([{"item_id": index.ids[item], "similarity": s, "first_word": a, "n_words": n} for item, (s, a, n) in sorted(own.items())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], ["row", "found"])

    return run


def _item_shingles(batches):
    """Per text its distinct shingles and a digest of its words."""
    for batch in batches:
        words = BareWords(*flat(batch.column("text")))
        own = [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        keys = [np.array(list(shingle_counts(h)), np.uint64).view(np.int64) for h in own]
        digests = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in own]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["part", "digest", "keys"])


def benchmark_parts(items: DataFrame) -> Iterator[Index]:
    """Indexes of the benchmark's parts, each of about ``PART_WORDS`` words; blank and null items are left out.

    Shingles are counted over the texts of all parts.
    """
    known = items.where("item_id is not null and text is not null").select("item_id", "text")
    size = known.agg(F.sum(F.size(F.split("text", "\\s+"))).alias("n")).first()["n"] or 0
    parts = int(size // PART_WORDS) + 1
    dealt = known.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    held = dealt.select("part", "text").mapInArrow(_item_shingles, "part long, digest binary, keys array<long>")
    held = held.select("part", "digest", F.explode("keys").alias("key"))
    spread = held.groupBy("key").agg(F.count_distinct("digest").alias("n")).where("n > 1")
    if parts > 1:
        held, spread = cut(held.select("part", "key").distinct()), cut(spread)
    for p in range(parts):
        rows = dealt.where(F.col("part") == p).orderBy("item_id", "text").collect()
        own = spread if parts == 1 else spread.join(held.where(F.col("part") == p), "key", "left_semi")
        found = own.select("key", "n").toArrow()
        counts = dict(zip(found["key"].to_numpy().view(np.uint64).tolist(), found["n"].to_pylist()))
        yield Index([(r["item_id"], r["text"]) for r in rows], counts)


def find_items(docs: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """``(*keep, found)`` for every row of ``docs`` and part of the benchmark; mostly one part, so one row per row.

    ``found`` lists ``struct<item_id, similarity, first_word, n_words>`` of the items that lie in the text with a
    similarity of 0.8 or more (see ``similarity``), at their best places. Equal items are found side by side. A null or
    empty text holds none, an empty benchmark finds none. Words are compared without case and outer punctuation. Only
    ``text`` is read.
    """
    rows = carried(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, found array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"
    context = docs.sparkSession.sparkContext
    found = [rows.mapInArrow(_scan(context.broadcast(part)), schema).select("row.*", "found") for part in benchmark_parts(items)]
    return reduce(DataFrame.unionByName, found)


def drop_holders(docs: DataFrame, items: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``) that hold no item; each part of the benchmark sees what the last one left."""
    context = docs.sparkSession.sparkContext
    left = docs.select(*keep)
    kind = left.schema.simpleString()
    for part in benchmark_parts(items):
        rows = carried(left, keep)
        found = rows.mapInArrow(_scan(context.broadcast(part)), f"row {kind}, found array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>")
        left = found.where(F.size("found") == 0).select("row.*")
    return left
