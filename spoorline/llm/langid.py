"""Language identification with a bit-sliced Bloom filter over letter n-grams.

Every position of the filter holds one bit per language. An n-gram's positions are combined by AND, which names all
languages that contain it at once. A text's bits are counted per language, the hits that chance alone would give are
taken off (the filter's fill is known per language), and the highest count decides. The filter has a fixed size
whatever the corpus; what grows with the corpus are the n-gram counts it is made from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.tables import carried
from spoorline.llm.textops import LOWER, flat, pieces, texts_of
from spoorline.session import cut

POSITION_BITS = 20
MULTIPLIERS = (0x2545F491, 0x6A09E667, 0x3C6EF373)
# a language holds an n-gram if it is this frequent there, compared with the language where it is most frequent
KEEP_RATIO, KEEP_COUNT = 0.25, 3
MERGE_KEYS = 2_000_000

# letters stay, lower-cased; bytes of other scripts stay; the rest of ASCII separates
LETTERS = LOWER.copy()
LETTERS[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-byte grams with letters in the middle, and where each text's begin (one more entry than texts).

    Texts are set apart by two separators, so a gram never spans two of them.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(data) + 2 * n + 2, 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(2 * np.arange(1, n + 1), size)] = LETTERS[data]
    wide = padded.astype(np.uint32)
    keys = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    at = np.flatnonzero((padded[1:-2] != 32) & (padded[2:-1] != 32))
    return keys[at], np.searchsorted(at, offsets + 2 * np.arange(n + 1))


def _tally(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _count(batches):
    """Per task and language the n-gram counts."""
    held: dict[str, list] = {}
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for i, j in pieces(offsets):
            keys, first = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.diff(first)
            names = sorted(set(langs[i:j]))
            code = {name: c for c, name in enumerate(names)}
            owner = np.repeat(np.array([code[x] for x in langs[i:j]], np.uint64), size)
            both = np.sort((owner << np.uint64(32)) | keys)
            head = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            counts, lang = np.diff(np.r_[head, len(both)]), (both[head] >> np.uint64(32)).astype(np.int64)
            for c, name in enumerate(names):
                a, b = np.searchsorted(lang, [c, c + 1])
                parts = held.setdefault(name, [])
                parts.append(((both[head[a:b]] & np.uint64(0xFFFFFFFF)), counts[a:b]))
                if sum(len(p[0]) for p in parts) > MERGE_KEYS:
                    held[name] = [_tally(parts)]
    for name, parts in held.items():
        keys, counts = _tally(parts)
        for i in range(0, len(keys), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys[part]), pa.string()), pa.array(keys[part].astype(np.int64)), pa.array(counts[part].astype(np.int64))], ["lang", "gram", "n"])


@dataclass
class Filter:
    """``slices``: per 64 languages one word per position; ``false``: chance hit rate per language, most frequent first."""

    langs: list[str]
    slices: np.ndarray
    false: np.ndarray


def learn(docs: DataFrame) -> Filter:
    """The filter from all rows with text and lang. One row per filter position at most reaches the driver."""
    spark = docs.sparkSession
    counted = cut(
        docs.where("text is not null and lang is not null").select("text", F.col("lang").cast("string"))
        .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()  # one row per language
    langs = [r["lang"] for r in totals]
    if not langs:
        return Filter([], np.zeros((1, 1 << POSITION_BITS), np.uint64), np.zeros(0))
    # rows given as a list would go through Python workers of a kind of their own, which stay in memory beside the others
    sizes = spark.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "code": pa.array(range(len(langs)), pa.int32()), "total": pa.array([r["total"] for r in totals], pa.int64())}))
    rates = counted.join(F.broadcast(sizes), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = rates.join(best, "gram").where((F.col("n") >= KEEP_COUNT) & (F.col("rate") >= KEEP_RATIO * F.col("best")))
    spots = F.explode(F.array(*[
        F.shiftright((F.col("gram") * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - POSITION_BITS) for m in MULTIPLIERS
    ])).alias("at")
    bit = F.expr("shiftleft(1L, code % 64)").alias("bit")
    rows = kept.select(F.expr("code div 64").cast("int").alias("slice"), bit, spots).groupBy("slice", "at").agg(F.bit_or("bit").alias("bits")).toArrow()
    slices = np.zeros(((len(langs) + 63) // 64, 1 << POSITION_BITS), np.uint64)
    slices[rows["slice"].to_numpy(), rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    fill = np.array([((slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(langs))])
    return Filter(langs, slices, fill ** len(MULTIPLIERS))


def _smallest(f: Filter) -> np.ndarray:
    """The slices with the narrowest words that hold the languages, for the processor's cache."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(f.langs) <= 8 * np.dtype(k).itemsize or k is np.uint64)
    return f.slices.astype(kind)


def _predict(shared):
    def run(batches):
        f: Filter = shared.value
        slices = _smallest(f)
        for batch in batches:
            text = texts_of(batch)
            data, offsets = flat(text)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            counts, sizes = [], []
            for i, j in pieces(offsets):
                keys, first = grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spots = [(keys * np.uint32(m)) >> np.uint32(32 - POSITION_BITS) for m in MULTIPLIERS]
                hits = np.zeros((j - i, len(f.langs)))
                for s, words in enumerate(slices):
                    bits = words[spots[0]] & words[spots[1]] & words[spots[2]]
                    for c in range(64 * s, min(64 * s + 64, len(f.langs))):
                        total = np.zeros(len(bits) + 1, np.int64)
                        np.cumsum((bits >> bits.dtype.type(c % 64)) & bits.dtype.type(1), out=total[1:])
                        hits[:, c] = total[first[1:]] - total[first[:-1]]
                counts.append(hits)
                sizes.append(np.diff(first))
            hits = np.concatenate(counts) if counts else np.zeros((0, len(f.langs)))
            size = np.concatenate(sizes) if sizes else np.zeros(0)
            if f.langs:
                real = np.maximum((hits - size[:, None] * f.false) / np.maximum(1 - f.false, 1e-9), 0)
                best = real.argmax(axis=1)
                total, top = real.sum(axis=1), real[np.arange(len(best)), best]
                known = letters
                score = np.where(known & (total > 0), top / np.maximum(total, 1e-12), 0.0)
                share = np.where(known & (size > 0), top / np.maximum(size, 1), 0.0)
                lang = np.where(known, np.array(f.langs, dtype=object)[best], "und")
            else:
                score, share, lang = np.zeros(len(text)), np.zeros(len(text)), np.full(len(text), "und", dtype=object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(np.minimum(share, 1.0), pa.float64())],
                ["row", "lang_pred", "score", "share"])

    return run


def identify(docs: DataFrame, model: Filter, keep: list[str]) -> DataFrame:
    """``(row, lang_pred, score, share)`` per row; ``row`` is a struct of the columns ``keep`` as they were.

    ``score`` is the best language's part of all corrected hits, ``share`` that of the n-grams it holds. A null text or
    one without letters is ``und`` with score 0; so is every text if nothing was learned. Ties go to the language with
    more training text. Only ``text`` is looked at, so clashing names and repeated rows do not matter.
    """
    rows = carried(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"row {kind}, lang_pred string, score double, share double")
