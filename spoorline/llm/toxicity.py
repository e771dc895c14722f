"""Toxicity by a support vector machine with a gap-weighted subsequence kernel over words.

The kernel counts triples of letters that two words share in order, each gap costing a factor; what is not a letter is
skipped and runs of single letters are read as one word, so ``i.d.i.o.t``, ``i d i o t`` and ``idxiot`` stay close to
``idiot``. The machine is trained with Nystroem landmarks. As the kernel is a product of explicit features (letter
triples), the landmarks fold into one weight per triple afterwards, and a text is scored by array lookups alone.

Labels belong to whole texts, so the words that carry the label are found first: words and word beginnings that are far
commoner in toxic than in clean texts cover each toxic text up to three times, greedily, and the words that have them
are the positive examples. The highest clean words under each model are added as negatives before the next fit. A
logistic model of a text's highest margin, its number of high words and its length gives the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.ngram_join import active_bits, in_bits
from spoorline.llm.textops import Spans, flat, pieces
from spoorline.session import cut

# bounds of the sample and of the training set that the machine is fitted to; words are counted over all labelled texts
MAX_TOXIC, MAX_CLEAN = 4000, 8000
MAX_POSITIVE, MAX_NEGATIVE, HARD_NEGATIVE, LANDMARKS = 4000, 20_000, 2000, 512
ROUNDS = 3
FLUSH = 200_000  # keys that a task holds
# a key must be this many times commoner in toxic texts, and add texts that lack their three words
COMMONER, TIMES, MIN_TEXTS = 20, 3, 3
HIGH = 0.5  # margin of a high word

# gap factor, and the steps between the letters of a triple
GAP = 0.6
STEPS = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a + b <= 4]
PIECE, STRIDE, EDGE = 16, 8, 31
NOTHING = -3.0  # margin of a text without a scorable word

CODE = np.zeros(256, np.uint8)
CODE[97:123] = CODE[65:91] = np.arange(1, 27)
# two-byte letters: the lead byte is skipped, the other tells four groups apart, capital and small alike
CODE[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 3)

_n = np.arange(PIECE + 1)
NORM = np.sqrt(np.maximum(sum(np.maximum(_n - a - b, 0) * GAP ** (2 * (a + b - 2)) for a, b in STEPS), 1e-9))


def word_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all pieces, piece ends in them, and the number of pieces before each text.

    A piece is a word's letters between two edge marks; a longer one is cut into overlapping pieces, so no letter of a
    text is left out.
    """
    spans = Spans(data, offsets)
    codes = CODE[data]
    at = np.flatnonzero(codes)
    word = np.searchsorted(spans.start, at, side="right") - 1
    count = np.bincount(word, minlength=len(spans.start)) if len(spans.start) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), spans.counts())
    full = np.flatnonzero(count)
    count, text = count[full], text[full]
    fresh = np.ones(len(full), bool)
    fresh[1:] = ~((count[1:] == 1) & (count[:-1] == 1) & (text[1:] == text[:-1]))
    heads = np.flatnonzero(fresh)
    size = np.add.reduceat(count, heads) + 2 if len(heads) else np.zeros(0, np.int64)
    text = text[heads]
    begin = np.cumsum(size) - size
    symbols = np.full(int(size.sum()), EDGE, np.uint8)
    symbols[np.arange(len(at)) + np.repeat(2 * np.arange(len(size)) + 1, size - 2)] = codes[at]
    parts = np.maximum(-(-(size - PIECE) // STRIDE), 0) + 1
    owner = np.repeat(np.arange(len(size)), parts)
    skip = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRIDE
    length = np.minimum(size[owner] - skip, PIECE)
    ends = np.cumsum(length)
    index = np.arange(int(length.sum())) + np.repeat(begin[owner] + skip - (ends - length), length)
    return symbols[index], ends, np.searchsorted(text[owner], np.arange(len(offsets)))


def triples(symbols: np.ndarray, ends: np.ndarray):
    """Per pair of steps: positions of first letters, triple codes and the gap factor."""
    limit = np.repeat(ends, np.diff(ends, prepend=0))
    wide = symbols.astype(np.int32)
    for a, b in STEPS:
        n = len(wide) - a - b
        if n <= 0:
            continue
        ok = np.arange(n) + (a + b) < limit[:n]
        yield ok, (wide[:n] << 10) | (wide[a : n + a] << 5) | wide[a + b :], GAP ** (a + b - 2)


def margins(weights: np.ndarray, bias: float, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Decision value of every piece."""
    if not len(ends):
        return np.zeros(0)
    total = np.zeros(len(symbols), np.float32)
    for ok, code, factor in triples(symbols, ends):
        total[: len(code)] += np.where(ok, weights[code] * np.float32(factor), np.float32(0))
    length = np.diff(ends, prepend=0)
    return np.add.reduceat(total, ends - length) / NORM[length] + bias


def features(words: list[bytes], columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised triple features of words given as symbol bytes, over ``columns`` or all triples that occur."""
    symbols, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    found = [(owner[: len(code)][ok], code[ok], factor) for ok, code, factor in triples(symbols, ends)]
    if columns is None:
        columns = np.unique(np.concatenate([c for _, c, _ in found]))
    place = np.full(1 << 15, -1, np.int64)
    place[columns] = np.arange(len(columns))
    out = np.zeros((len(words), len(columns)), np.float32)
    for row, code, factor in found:
        at = place[code]
        np.add.at(out, (row[at >= 0], at[at >= 0]), factor)
    return out / NORM[[len(w) for w in words]][:, None].astype(np.float32), columns


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps on the violators."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-3]

    def loss(v):
        return 0.5 * (ridge * v * v).sum() + 0.5 * (weight * np.maximum(1 - y * (x @ v), 0) ** 2).sum()

    for _ in range(rounds):
        bad = y * (x @ w) < 1
        xa, ya, wa = x[bad], y[bad], weight[bad]
        gradient = ridge * w - xa.T @ (wa * (ya - xa @ w))
        step = np.linalg.solve((xa * wa[:, None]).T @ xa + np.diag(ridge), gradient)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_kernel(positive: list[bytes], negative: list[bytes], landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """One weight per letter triple and a bias, from words given as symbol bytes."""
    half = landmarks // 2
    marks = positive[:: max(1, len(positive) // half)][:half] + negative[:: max(1, len(negative) // half)][:half]
    own, columns = features(marks)
    values, vectors = np.linalg.eigh((own @ own.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    words = positive + negative
    mapped = np.vstack([(features(words[i : i + 1000], columns)[0] @ own.T) @ root for i in range(0, len(words), 1000)])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.where(y > 0, len(words) / (2 * len(positive)), len(words) / (2 * len(negative)))
    w, bias = squared_hinge(mapped, y, weight)
    weights = np.zeros(1 << 15, np.float32)
    weights[columns] = own.T @ (root @ w)
    return weights, bias


@dataclass
class Model:
    """Triple weights and bias of a word's margin, and the logistic weights of a text's evidence."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray


def keys_of(word: str) -> set[str]:
    """The word with its edges, and its beginnings of three to seven letters, marked as such."""
    return {word} | {"p" + word[:k] for k in range(4, 9) if len(word) > k}


def _text_keys(column):
    """Per text the keys of its words of three letters or more."""
    data, offsets = flat(column)
    known: dict[bytes, set[str]] = {}
    for i, j in pieces(offsets):
        symbols, ends, first = word_pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        raw = (symbols + np.uint8(64)).tobytes()
        begin = np.r_[0, ends].tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            keys: set[str] = set()
            for word in {raw[begin[k] : begin[k + 1]] for k in range(a, b) if begin[k + 1] - begin[k] > 4}:
                if word not in known:
                    known[word] = keys_of(word.decode("ascii"))
                keys |= known[word]
            yield keys


def _key_counts(batches):
    """Per key the numbers of toxic and of clean texts that have it, summed over the texts of a task."""
    held = Counter(), Counter()

    def out():
        parts = [(list(c), list(c.values())) for c in held]
        for c in held:
            c.clear()
        zeros = [[0] * len(k) for k, _ in parts]
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts[0][0] + parts[1][0], pa.string()), pa.array(zeros[0] + parts[1][1], pa.int64()), pa.array(parts[0][1] + zeros[1], pa.int64())], ["key", "t", "c"])

    for batch in batches:
        for toxic, keys in zip(batch.column("toxic").to_pylist(), _text_keys(batch.column("text"))):
            held[toxic].update(keys)
            if len(held[0]) + len(held[1]) > FLUSH:
                yield from out()
    yield from out()


def _doc_keys(shared):
    """Per text its keys that are among the marked ones."""

    def run(batches):
        marked = shared.value
        for batch in batches:
            found = [sorted(keys & marked) for keys in _text_keys(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.list_(pa.string()))], ["doc", "keys"])

    return run


def _symbols(word: str) -> bytes:
    return (np.frombuffer(word.encode("ascii"), np.uint8) - np.uint8(64)).tobytes()


def _word_margins(shared):
    def run(batches):
        m: Model = shared.value
        for batch in batches:
            words = [_symbols(w) for w in batch.column("word").to_pylist()]
            found = margins(m.weights, m.bias, np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(found.astype(float), pa.float64())], ["word", "margin"])

    return run


def evidence(column, m: Model) -> np.ndarray:
    """Per text: highest margin, logarithms of the numbers of high words and of words, and 1."""
    data, offsets = flat(column)
    out = [np.zeros((0, 4))]
    for i, j in pieces(offsets):
        symbols, ends, first = word_pieces(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found = margins(m.weights, m.bias, symbols, ends)
        best = np.full(j - i, NOTHING)
        some = first[:-1] < first[1:]
        if some.any():
            best[some] = np.maximum.reduceat(found, first[:-1][some])
        high = np.r_[0, np.cumsum(found > HIGH)]
        out.append(np.c_[np.maximum(best, NOTHING), np.log1p(high[first[1:]] - high[first[:-1]]), np.log1p(np.diff(first)), np.ones(j - i)])
    return np.concatenate(out)


def _evidence(shared):
    def run(batches):
        for batch in batches:
            found = evidence(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(found[:, i]) for i in range(4)]], ["toxic", "a", "b", "c", "d"])

    return run


def _score(shared):
    def run(batches):
        m: Model = shared.value
        for batch in batches:
            found = evidence(batch.column("__text"), m)
            score = 1 / (1 + np.exp(-np.clip(found @ m.logistic, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found[:, 0]), pa.array(score)], ["row", "margin", "score"])

    return run


def stem(key: str) -> str:
    return key.strip("p").rstrip("_")


def cover(pairs: dict[str, set], least: float, times: int = TIMES, lack: dict | None = None) -> list[str]:
    """Keys that cover the texts greedily, each at least ``least`` texts that lack their ``times`` (or ``lack``) keys.

    Of keys of which one begins the other, the first counts.
    """
    lack = {text: times for texts in pairs.values() for text in texts} if lack is None else lack
    gain = {key: len(texts) for key, texts in pairs.items()}
    out, bare = [], []
    while gain:
        key = max(gain, key=lambda k: (gain[k], k))
        real = sum(lack[text] > 0 for text in pairs[key])
        if real < gain[key] and real >= least:  # counts only fall, so a stale best is refreshed and compared again
            gain[key] = real
            continue
        del gain[key]
        if real < least:
            continue
        own = stem(key)
        if any(own.startswith(other) or other.startswith(own) for other in bare):
            continue
        out.append(key)
        bare.append(own)
        for text in pairs[key]:
            lack[text] -= 1
    return out


def cover_all(held: DataFrame) -> list[str]:
    """``cover`` of any number of texts ``(doc, keys)``, at ``MIN_TEXTS``: bounded samples of the texts that still lack keys, in rounds.

    A round in which no key of the sample suffices takes the key that most of all lacking texts have; the last round has
    no key with enough of them.
    """
    seeds: list[str] = []
    while True:
        chosen = F.array(*[F.lit(k) for k in seeds]).cast("array<string>")
        left = held.withColumn("lack", TIMES - F.size(F.array_intersect("keys", chosen))).where("lack > 0")
        bare = F.array(*[F.lit(stem(k)) for k in seeds]).cast("array<string>")
        own = lambda k: F.rtrim(F.ltrim(k, F.lit("p")), F.lit("_"))
        free = left.withColumn("keys", F.filter("keys", lambda k: ~F.exists(bare, lambda s: F.startswith(own(k), s) | F.startswith(s, own(k))))).where(F.size("keys") > 0)
        best = free.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), F.desc("key")).first()
        if best is None:
            return seeds
        sample = free.orderBy(F.xxhash64("doc"), "doc").limit(MAX_TOXIC).collect()
        pairs: dict[str, set] = {}
        for r in sample:
            for key in r["keys"]:
                pairs.setdefault(key, set()).add(r["doc"])
        seeds += cover(pairs, MIN_TEXTS, lack={r["doc"]: r["lack"] for r in sample}) or [best["key"]]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps; a small ridge keeps separable samples finite, not on the last weight."""
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.02), 1e-4]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _in_filter(bits):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bits(batch.column("__key").to_numpy(), bits.value))).select(["doc_id", "text"])

    return run


def with_labels(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, text, toxic)`` of the rows with a label.

    A bitmap of the labelled ids, of a bounded size, goes over the texts first, so that texts without a label do not
    travel, but for few whose ids share a bit; the join is exact. It deals the texts out evenly at every size.
    """
    keys = known.select(F.xxhash64("doc_id").alias("__key"))
    bits = docs.sparkSession.sparkContext.broadcast(active_bits(keys))
    kind = docs.schema["doc_id"].dataType.simpleString()
    near = docs.where("text is not null").select("doc_id", "text", F.xxhash64(F.col("doc_id").cast(known.schema["doc_id"].dataType)).alias("__key"))
    return near.mapInArrow(_in_filter(bits), f"doc_id {kind}, text string").join(known.hint("merge"), "doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from labelled texts: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic), both already cut to training rows.

    Words and keys are counted over all labelled texts. A key that is far commoner in toxic ones counts at every size if
    it has ``MIN_TEXTS`` of them and more than chance gives to one of all keys; such keys reach the driver. The machine is fitted to at most ``MAX_POSITIVE`` words
    that have the keys, its logistic model to at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean texts, chosen by hash
    of the id; four numbers per sampled text reach the driver.
    """
    spark = docs.sparkSession
    known = cut(labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    # an id that occurs twice counts as two texts
    labelled = cut(with_labels(docs, known).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "toxic", "text"))
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    unlearned = Model(np.zeros(1 << 15, np.float32), 0.0, np.array([0, 0, 0, np.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else -2.0]))
    if not n1 or not n0:
        return unlearned
    commoner = F.col("c") * COMMONER * n1 <= F.col("t") * n0
    counted = cut(labelled.select("toxic", "text").mapInArrow(_key_counts, "key string, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    # a bound of the chance that as many of a key's texts are toxic as are, against the number of keys that are tried
    t, c, all_, share = F.col("t"), F.col("c"), F.col("t") + F.col("c"), n1 / (n1 + n0)
    bound = t * F.log(t / all_ / share) + F.when(c > 0, c * F.log(c / all_ / (1 - share))).otherwise(0.0)
    tried = counted.where(all_ >= MIN_TEXTS).count()
    marked = {r["key"] for r in counted.where((t >= MIN_TEXTS) & commoner & (bound >= np.log(max(tried, 1)))).select("key").collect()}
    held = labelled.where("toxic = 1").select("doc", "text").mapInArrow(_doc_keys(spark.sparkContext.broadcast(marked)), "doc long, keys array<string>")
    seeds = cover_all(cut(held.where(F.size("keys") > 0)))
    if not seeds:
        return unlearned
    counts = counted.where(~F.startswith("key", F.lit("p"))).withColumnRenamed("key", "word")
    starts = F.array(F.col("word"), *[F.when(F.length("word") > k, F.concat(F.lit("p"), F.substring("word", 1, k))) for k in range(4, 9)])
    holding = counts.where((F.col("t") > 0) & commoner & F.arrays_overlap(starts, F.array(*[F.lit(k) for k in seeds])))
    positive = [r["word"] for r in holding.orderBy(F.desc("t"), "word").limit(MAX_POSITIVE).collect()]
    if not positive:
        return unlearned
    clean = counts.where("t = 0")
    negative = [r["word"] for r in clean.orderBy(F.xxhash64("word"), "word").limit(MAX_NEGATIVE).collect()]
    if not negative:
        return unlearned
    for turn in range(ROUNDS):
        weights, bias = fit_kernel([_symbols(w) for w in sorted(positive)], [_symbols(w) for w in sorted(set(negative))])
        model = Model(weights, bias, unlearned.logistic)
        if turn + 1 < ROUNDS:
            scored = clean.select("word").mapInArrow(_word_margins(spark.sparkContext.broadcast(model)), "word string, margin double")
            negative += [r["word"] for r in scored.where("margin > -0.9").orderBy(F.desc("margin"), "word").limit(HARD_NEGATIVE).collect()]
    chosen = None
    for value, limit in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select("doc_id")
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = labelled.join(F.broadcast(chosen), "doc_id", "left_semi")
    found = texts.select("toxic", "text").mapInArrow(_evidence(spark.sparkContext.broadcast(model)), "toxic int, a double, b double, c double, d double").toArrow()
    x = np.column_stack([found[c].to_numpy() for c in "abcd"])
    return Model(weights, bias, logistic(x, found["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``(row, margin, score)`` per row; ``row`` is a struct of the columns ``keep`` as they were.

    The score lies in 0..1; a null or empty text, or one without words, has no high word and the lowest margin. Equal texts get equal scores. Only ``text`` is looked at, so clashing names and repeated rows do not matter.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("__text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"row {kind}, margin double, score double")
