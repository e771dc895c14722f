"""Language-model scores from a probabilistic suffix tree over the bytes of the tokens.

A text is read as its words, lower-cased, one space apart and closed by an end mark, so the tree predicts exactly the
tokens that the word counts of the base score see. A context of up to ``DEPTH`` bytes becomes a state if its next-byte
distribution diverges from that of its longest shorter suffix by more than its extra parameters cost; suffixes of
states are states. Each state's distribution is smoothed with its parent's (Witten-Bell), down to the uniform one, and
a byte is predicted by the longest state that ends the text read so far. The probability of a word is that of its bytes
and the mark behind it, mixed with the smoothed word count, which remembers whole words better than any short context;
the end token has its smoothed count.

All counts cover all training rows, and no state is left out. What is held in a task is bounded: the ``MAX_STATES``
states of the largest gain, the counts of the ``MAX_WORDS`` most frequent words, and a Bloom filter of the other states.
All other words meet their counts in a join; a byte whose context the filter knows meets the other states in one, too.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.textops import Words, flat, pieces
from spoorline.session import cut

DEPTH = 5
MAX_STATES, MAX_WORDS = 1 << 17, 1 << 18
WORD_SHARE = 0.3  # weight of the word counts in the mixture
# nats that a state must gain per parameter (a distinct next byte)
PENALTY = 3.0
END = 10  # a line end never lies inside a word
END_WORD = 0x0E4D_0E4D
STATE = np.uint64(1 << 60)
FILTER_BITS = 24  # of the Bloom filter; a context has two places
MERGE_KEYS = 4_000_000

U = np.uint64
MARKS = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def stream(words: Words, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all predicted bytes with their contexts, ``depth + 1`` bytes each, and per text their first and last + 1.

    Every text starts from ``depth`` end marks and owes nothing to its neighbours.
    """
    n, size = len(offsets) - 1, words.end - words.start
    count = words.counts()
    letters = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=letters[1:])
    length = depth + letters[words.first[1:]] - letters[words.first[:-1]] + np.maximum(count, 1)
    last = np.cumsum(length)
    begin = last - length
    text = np.repeat(np.arange(n), count)
    out = np.full(int(length.sum()), 32, np.uint8)
    word_at = begin[text] + depth + (letters[:-1] - letters[words.first[:-1]][text]) + np.arange(len(size)) - words.first[:-1][text]
    total = int(letters[-1])
    within = np.arange(total) - np.repeat(letters[:-1], size)
    out[np.repeat(word_at, size) + within] = words.low[np.repeat(words.start, size) + within]
    for i in range(depth):
        out[begin + i] = END
    out[last - 1] = END
    wide = out.astype(np.uint64)
    keys = np.zeros(max(len(wide) - depth, 0), np.uint64)
    for i in range(depth + 1):
        keys = (keys << U(8)) | wide[i : len(wide) - depth + i]
    return keys, begin, last - depth


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.r_[head, len(keys)])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and for every key its place among them."""
    order = np.argsort(keys)
    keys = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(head) - 1
    return keys[head], place


class _Counter:
    """Counts of 64-bit keys, merged whenever the parts outgrow a bound."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)
        if self.held > MERGE_KEYS and len(self.parts) > 1:
            self.parts = [self.total()]
            self.held = min(len(self.parts[0][0]), MERGE_KEYS)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _own(keys: np.ndarray, begin: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of the keys that belong to a text; those between two texts span both."""
    edge = np.zeros(len(keys) + 1, np.int8)
    edge[begin] += 1
    edge[last] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def _count(depth: int):
    """Per task: word counts (kind 0) and counts of ``depth + 1`` bytes (kind 1)."""

    def run(batches):
        words_, grams = _Counter(), _Counter()
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in pieces(offsets):
                own = offsets[i : j + 1] - offsets[i]
                words = Words(data[offsets[i] : offsets[j]], own)
                words_.add(*_runs(words.hash))
                words_.add(np.array([END_WORD], np.uint64), np.array([j - i]))
                keys, begin, last = stream(words, own, depth)
                grams.add(*_runs(keys[_own(keys, begin, last)]))
        for kind, counter in enumerate((words_, grams)):
            keys, counts = counter.total()
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[part]), kind, np.int8)), pa.array(keys[part].view(np.int64)), pa.array(counts[part].astype(np.int64))], ["kind", "key", "n"])

    return run


class Table:
    """64-bit keys to numbers by open addressing, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, U(2**64 - 1)), np.zeros(1 << bits, values.dtype)
        todo = np.arange(len(keys))
        at = self._home(keys)
        while len(todo):
            free = self.keys[at] == U(2**64 - 1)
            self.keys[at[free]] = keys[todo[free]]  # of rivals for a place one wins
            won = free & (self.keys[at] == keys[todo])
            self.values[at[won]] = values[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        at = self._home(keys)
        got = self.keys[at]
        found = got == keys
        values = np.where(found, self.values[at], self.values.dtype.type(0))
        todo = np.flatnonzero(~found & (got != U(2**64 - 1)))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.keys[at]
            hit = got == keys[todo]
            found[todo[hit]], values[todo[hit]] = True, self.values[at[hit]]
            on = ~hit & (got != U(2**64 - 1))
            todo, at = todo[on], at[on]
        return found, values


@dataclass
class Model:
    """Word counts of the most frequent words, training totals, and the tree as log10 tables by tagged key."""

    words: np.ndarray
    word_counts: np.ndarray
    train_tokens: int
    vocabulary: int
    entries: np.ndarray
    entry_logs: np.ndarray
    states: np.ndarray
    state_logs: np.ndarray
    depth: int
    far: np.ndarray | None = None  # Bloom filter of the states that are not sent to tasks


@dataclass
class Joined:
    """What is met in joins: the counts of all words, and the states that are not sent to tasks, if there are any."""

    words: DataFrame
    far: DataFrame | None


def _tag(level: np.ndarray) -> np.ndarray:
    return U(1) << (level.astype(np.uint64) * U(8))


def smooth(level: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of a tree given as (context length, context bytes + next byte, count); the root and all suffixes included.

    Returns entry keys with log10 P(next | state), and state keys with the log10 weight of the parent for unseen bytes.
    """
    entries, entry_logs, states, state_logs = [], [], [], []
    previous_keys, previous = None, None
    for d in range(int(level.max()) + 1 if len(level) else 0):
        own = np.flatnonzero(level == d)
        own = own[np.argsort(key[own])]
        keys, counts = key[own], n[own].astype(float)
        context, first = np.unique(keys >> U(8), return_index=True)
        size = np.diff(np.r_[first, len(keys)])
        total = np.add.reduceat(counts, first)
        lower = np.full(len(keys), 1 / 256) if d == 0 else previous[np.searchsorted(previous_keys, keys & U((1 << (8 * d)) - 1))]
        total_each, kinds = np.repeat(total, size), np.repeat(size, size)
        p = (counts + kinds * lower) / (total_each + kinds)
        entries.append(keys | _tag(np.full(len(keys), d + 1)))
        entry_logs.append(np.log10(p))
        states.append(context | _tag(np.full(len(context), d)) | STATE)
        state_logs.append(np.log10(size / (total + size)))
        previous_keys, previous = keys, p
    none = np.zeros(0)
    return (np.concatenate(entries) if entries else none.astype(np.uint64), np.concatenate(entry_logs) if entries else none,
            np.concatenate(states) if entries else none.astype(np.uint64), np.concatenate(state_logs) if entries else none)


def tree(grams: DataFrame, depth: int = DEPTH, max_states: int = MAX_STATES, penalty: float = PENALTY) -> DataFrame:
    """``(level, key, n, sent)`` from counts ``(key, n)`` of ``depth + 1`` bytes: all entries of all states.

    ``sent`` marks the entries of the ``max_states`` states of the largest gain and of their suffixes.
    """
    levels = F.explode(F.array(*[
        F.struct(F.lit(d).alias("level"), F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1)).alias("key")) for d in range(depth + 1)
    ]))
    counted = cut(grams.select(levels.alias("e"), "n").groupBy("e.level", "e.key").agg(F.sum("n").alias("n")))
    context = F.shiftright("key", 8).alias("context")
    sums = counted.groupBy("level", context).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    with_context = counted.select("level", "key", "n", context).join(sums, ["level", "context"])
    # P(next | context) against P(next | context without its first byte): the entry one level down, masked
    down = with_context.select((F.col("level") + 1).alias("level"), F.col("key").alias("low"), (F.col("n") / F.col("total")).alias("q"))
    mask = F.expr("shiftleft(1L, 8 * level) - 1")
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))) - penalty * F.count(F.lit(1))
    better = (
        with_context.where("level > 0").withColumn("low", F.col("key").bitwiseAND(mask)).join(down, ["level", "low"])
        .groupBy("level", "context").agg(gain.alias("gain")).where("gain > 0")
    )
    better = cut(better)
    # suffixes of a state: the last 0..level bytes of its context
    suffixes = F.explode(F.expr("transform(sequence(0, level), d -> struct(d as level, context & (shiftleft(1L, 8 * d) - 1) as context))"))
    closed = lambda some: some.select(suffixes.alias("s")).select("s.level", "s.context").distinct()
    root = grams.sparkSession.createDataFrame([(0, 0)], "level int, context long")
    states = F.broadcast(closed(better.orderBy(F.desc("gain"), "level", "context").limit(max_states)).unionByName(root).distinct())
    each = counted.withColumn("context", F.shiftright("key", 8))
    out = each.join(states, ["level", "context"], "left_semi").withColumn("sent", F.lit(True))
    if better.count() > max_states:
        far = closed(better).join(states, ["level", "context"], "left_anti")
        out = out.unionByName(each.join(far, ["level", "context"], "left_semi").withColumn("sent", F.lit(False)))
    return out.select("level", "key", "n", "sent")


def far_states(kept: DataFrame, depth: int) -> DataFrame:
    """``(tag, log)`` of all entries and states that are not sent, tagged and smoothed as in ``smooth``."""
    parts, previous = [], None
    for d in range(depth + 1):
        own = kept.where(F.col("level") == d).select("key", "n", "sent", F.shiftright("key", 8).alias("context"))
        own = own.join(own.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "context")
        if previous is None:
            own = own.withColumn("lower", F.lit(1 / 256))
        else:
            own = own.withColumn("low", F.col("key").bitwiseAND(F.lit((1 << (8 * d)) - 1))).join(previous.select(F.col("key").alias("low"), F.col("p").alias("lower")), "low")
        previous = cut(own.select("key", "context", "sent", "total", "kinds", ((F.col("n") + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds"))).alias("p")))
        far = previous.where("not sent")
        parts.append(far.select(F.col("key").bitwiseOR(F.lit(1 << (8 * d + 8))).alias("tag"), F.log10("p").alias("log")))
        weight = F.log10(F.col("kinds") / (F.col("total") + F.col("kinds")))
        parts.append(far.select(F.col("context").bitwiseOR(F.lit(1 << (8 * d) | int(STATE))).alias("tag"), weight.alias("log")).distinct())
    return cut(reduce(DataFrame.unionByName, parts))


def _place(tags: np.ndarray, mark: np.uint64) -> np.ndarray:
    """A bit of tagged contexts in the filter; each has one for every number in ``MARKS``."""
    return (tags * mark) >> U(64 - FILTER_BITS)


def _filter_bits(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_place(batch.column("tag").to_numpy().view(np.uint64), mark) for mark in MARKS]).astype(np.int32))], ["bit"])


def far_filter(far: DataFrame) -> np.ndarray:
    """Bloom filter of the states in ``far``, a bit per place."""
    bits = far.where(F.col("tag") >= F.lit(int(STATE))).select("tag").mapInArrow(_filter_bits, "bit int").distinct().toArrow()["bit"].to_numpy()
    out = np.zeros(1 << FILTER_BITS, bool)
    out[bits] = True
    return np.packbits(out, bitorder="little")


def far_bytes(keys: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Mask of the keys of which some context may be a state that is not sent."""
    out = np.zeros(len(keys), bool)
    for d in range(1, depth + 1):
        tags = (keys >> U(8)) & U((1 << (8 * d)) - 1) | U(1 << (8 * d)) | STATE
        some = np.arange(len(keys))
        for mark in MARKS:  # few pass the first place and are asked for the second
            at = _place(tags[some], mark)
            some = some[(known[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)]
        out[some] = True
    return out


def far_logs(keys: DataFrame, far: DataFrame, depth: int) -> DataFrame:
    """``(byte, whole, log)`` of the distinct ``byte`` in ``keys`` that meet a state of ``far``.

    ``log`` stands for the sent tree's log10 probability if ``whole``, else it is added to that.
    """
    tags = []
    for d in range(1, depth + 1):
        for state in (False, True):
            bare = F.shiftright("byte", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1)) if state else F.col("byte").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1))
            mark = 1 << (8 * d) | int(STATE) if state else 1 << (8 * d + 8)
            tags.append(F.struct(bare.bitwiseOR(F.lit(mark)).alias("tag"), F.lit(d).alias("level"), F.lit(state).alias("state")))
    each = keys.select("byte").distinct().select("byte", F.explode(F.array(*tags)).alias("t")).select("byte", "t.*")
    entry, state = F.struct("level", "log"), F.when(F.col("state"), F.struct("level", "log"))
    met = each.join(far, "tag").groupBy("byte").agg(F.max(F.when(~F.col("state"), entry)).alias("top"), F.collect_list(state).alias("states"))
    above = F.expr("aggregate(filter(states, s -> top is null or s.level > top.level), 0D, (a, s) -> a + s.log)")
    return met.select("byte", F.col("top").isNotNull().alias("whole"), (above + F.coalesce("top.log", F.lit(0.0))).alias("log"))


def learn(texts: DataFrame, depth: int = DEPTH) -> tuple[Model, Joined]:
    """The model from all rows of ``texts`` (a null text is empty), and the tables of what it does not hold."""
    counted = cut(
        texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count(depth), "kind byte, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))
    )
    words, grams = counted.where("kind = 0").select("key", "n"), counted.where("kind = 1").select("key", "n")
    size = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # the smallest count that leaves at most MAX_WORDS words, from the number of words per count
    per_count = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(MAX_WORDS).toArrow()
    fits = np.flatnonzero(np.cumsum(per_count["words"].to_numpy()) <= MAX_WORDS)
    least = int(per_count["n"].to_numpy()[fits[-1]]) if len(fits) else 1 << 62
    top = words.where((F.col("n") >= least) | (F.col("key") == END_WORD)).toArrow()
    kept = cut(tree(grams, depth, MAX_STATES))
    sent = kept.where("sent").toArrow()
    tables = smooth(sent["level"].to_numpy(), sent["key"].to_numpy().view(np.uint64), sent["n"].to_numpy())
    far = None if kept.where("not sent").isEmpty() else far_states(kept, depth)
    model = Model(top["key"].to_numpy().view(np.uint64), top["n"].to_numpy(), size["n"], size["v"], *tables, depth, None if far is None else far_filter(far))
    return model, Joined(words, far)


def tree_logs(entries: Table, states: Table, keys: np.ndarray, depth: int) -> np.ndarray:
    """log10 P of each key's last byte after its context."""
    out = np.zeros(len(keys))
    todo = np.arange(len(keys))
    for d in range(depth, -1, -1):
        part = keys[todo] & U((1 << (8 * d + 8)) - 1)
        hit, logs = entries.get(part | U(1 << (8 * d + 8)))
        out[todo] += logs
        todo, part = todo[~hit], part[~hit]
        if not len(todo):
            return out
        out[todo] += states.get((part >> U(8)) | U(1 << (8 * d)) | STATE)[1]
    out[todo] -= np.log10(256)
    return out


_tables: dict[str, tuple] = {}


def _score(shared, job: str):
    def run(batches):
        m: Model = shared.value
        if job not in _tables:
            _tables.clear()
            _tables[job] = Table(m.words, m.word_counts.astype(np.float64)), Table(m.entries, m.entry_logs), Table(m.states, m.state_logs)
        known, entries, states = _tables[job]
        bottom = m.train_tokens + 0.5 * (m.vocabulary + 1)
        end_count = known.get(np.array([END_WORD], np.uint64))[1][0]
        for batch in batches:
            data, offsets = flat(batch.column("__text"))
            tokens, base, seen, scores, rare, rare_logs, far = [], [], [], [], [], [], []
            for i, j in pieces(offsets):
                own = offsets[i : j + 1] - offsets[i]
                words = Words(data[offsets[i] : offsets[j]], own)
                a, b = words.first[:-1], words.first[1:]
                hit, counts = known.get(words.hash)
                by_tree, far_word, *far_byte = word_logs(*stream(words, own, m.depth), b - a, entries, states, m.depth, m.far)
                hit[far_word] = False  # such a word meets its count and its bytes' other states in joins
                by_count = np.where(hit, (counts + 0.5) / bottom, 1.0)
                logs = np.where(hit, np.log10(by_count), 0.0)
                mixed = np.where(hit, np.log10(WORD_SHARE * by_count + (1 - WORD_SHARE) * 10**by_tree), 0.0)
                hits = np.r_[0, np.cumsum(hit)]
                end = np.log10((end_count + 0.5) / bottom)
                tokens.append(b - a + 1)
                base.append(_sums(logs, a, b) + end)
                scores.append(_sums(mixed, a, b) + end)
                seen.append(hits[b] - hits[a] + int(end_count > 0))
                miss = np.flatnonzero(~hit)
                edges = np.searchsorted(miss, words.first)
                rare.append((words.hash[miss], np.diff(edges)))
                rare_logs.append(by_tree[miss])
                text = np.searchsorted(words.first, far_word, side="right") - 1
                far.append((np.searchsorted(miss, far_word) - edges[text], *far_byte, np.bincount(text, minlength=j - i)))
            sizes = np.concatenate([n for _, n in rare])
            at = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            place, byte, log, sizes = (np.concatenate(x) for x in zip(*far))
            far_at = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(base)), pa.array(np.concatenate(seen)), pa.array(np.concatenate(scores)),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate([h for h, _ in rare]).view(np.int64))),
                 pa.ListArray.from_arrays(at, pa.array(np.concatenate(rare_logs).astype(np.float32))),
                 pa.ListArray.from_arrays(far_at, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(far_at, pa.array(byte.view(np.int64))),
                 pa.ListArray.from_arrays(far_at, pa.array(log.astype(np.float32)))],
                ["row", "n_tokens", "base", "seen", "score", "rare", "rare_logs", "far", "far_bytes", "far_logs"])

    return run


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of ranges, each added up on its own, so that long batches lose no digits."""
    return np.array([values[x:y].sum() for x, y in zip(first.tolist(), last.tolist())])


def word_logs(
    keys: np.ndarray, begin: np.ndarray, last: np.ndarray, counts: np.ndarray, entries: Table, states: Table, depth: int, far: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sent tree's log10 probability of every word with the mark behind it; ``counts`` are the words of each text.

    Also the bytes that may meet a state in the filter ``far``: the word, the key and the log10 probability of each.
    """
    own = _own(keys, begin, last)
    keys = keys[own]
    byte = keys & U(255)
    ends = np.flatnonzero((byte == U(32)) | (byte == U(END)))
    # of a million bytes about a quarter meet a context for the first time
    once, place = distinct(keys)
    logs = tree_logs(entries, states, once, depth)[place]
    sums = np.add.reduceat(logs, np.r_[0, ends[:-1] + 1]) if len(ends) else np.zeros(0)
    # a text without words is its end mark alone
    lone = np.cumsum(np.maximum(counts, 1))[counts == 0] - 1
    at = np.flatnonzero(far_bytes(once, far, depth)[place]) if far is not None else np.zeros(0, np.int64)
    word = np.searchsorted(ends, at)
    real = ~np.isin(word, lone)
    at, word = at[real], word[real]
    return np.delete(sums, lone), word - np.searchsorted(lone, word), keys[at], logs[at]


def score(docs: DataFrame, model: Model, joined: Joined, keep: list[Column]) -> DataFrame:
    """``(*keep, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    ``score`` is the model's log10 probability of the text's tokens, ``base_score`` that of smoothed word counts alone; a null
    text is empty and consists of the end token. Without training rows both treat all symbols alike. Repeated rows are
    scored one by one; columns not in ``keep`` are ignored.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("__text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = cut(
        rows.mapInArrow(_score(shared, uuid.uuid4().hex), f"row {kind}, n_tokens long, base double, seen long, score double, rare array<long>, rare_logs array<float>, far array<int>, far_bytes array<long>, far_logs array<float>")
        .withColumn("uid", F.monotonically_increasing_id())
    )
    bottom = model.train_tokens + 0.5 * (model.vocabulary + 1)
    rare = first.select("uid", F.posexplode(F.arrays_zip("rare", "rare_logs")).alias("at", "r")).select("uid", "at", F.col("r.rare").alias("key"), F.col("r.rare_logs").cast("double").alias("log"))
    if joined.far is not None:
        met = first.select("uid", F.explode(F.arrays_zip("far", "far_bytes", "far_logs")).alias("r")).select("uid", F.col("r.far").alias("at"), F.col("r.far_bytes").alias("byte"), F.col("r.far_logs").alias("was"))
        change = met.join(far_logs(met, joined.far, model.depth), "byte").groupBy("uid", "at").agg(F.sum(F.col("log") - F.when(F.col("whole"), F.col("was")).otherwise(0)).alias("change"))
        rare = rare.join(change, ["uid", "at"], "left").withColumn("log", F.col("log") + F.coalesce("change", F.lit(0.0)))
    c, by_count = F.coalesce("n", F.lit(0)), (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(float(bottom))
    mixed = F.log10(WORD_SHARE * by_count + (1 - WORD_SHARE) * F.pow(F.lit(10.0), F.col("log")))
    sums = rare.join(joined.words, "key", "left").groupBy("uid").agg(
        F.sum(F.log10(by_count)).alias("rest"), F.sum(mixed).alias("rest_score"), F.sum(F.when(c > 0, 1).otherwise(0)).alias("more"))
    return first.drop("rare", "rare_logs", "far", "far_bytes", "far_logs").join(sums, "uid", "left").select(
        "row.*", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rest_score", F.lit(0.0))).alias("score"))
