"""Secret scan: three fixed formats, and what probabilistic automata learned from them.

The values that the fixed formats find are labelled credentials. Per kind their prefix tree over character classes is
folded into a probabilistic automaton: a state is merged into an earlier one if all their transition and end
frequencies agree within Hoeffding's bound. Every other long token that mixes letters and digits is a candidate; it is
added if some automaton gives it a likelihood per character well above that of ordinary candidates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.tables import carried
from spoorline.llm.textops import flat, texts_of
from spoorline.session import cut

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

# bounds of the labelled sample per kind, and of the sample of ordinary candidates
MAX_LABELLED, MAX_ORDINARY, MAX_LENGTH = 500, 5000, 64
# Hoeffding confidence; log10 odds per character above which a candidate is taken; least labelled values
ALPHA, ODDS, LEAST = 0.05, 0.15, 20
PRIOR = 200

HEX_BYTE, DIGIT_BYTE = np.zeros(256, bool), np.zeros(256, bool)
HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
DIGIT_BYTE[48:58] = True
END = "$"


def base_spans(text: str, long_hex: bool = True) -> list[tuple[int, int, int, str]]:
    """``(start, kind index, end, value)`` of the fixed formats, by start, then kind; offsets in code points.

    Matches of a kind are leftmost and do not overlap; one that is too short is dropped but has used up its text.
    """
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if long_hex:
        # a maximal run either has 32 characters or fails as a whole
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def classes(token: str) -> str:
    """The token by character class: digits, hexadecimal and other small letters, capitals; the rest as it is."""
    return "".join("9" if c.isdigit() else "f" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in token)


@dataclass
class Automaton:
    """States 0..n-1, 0 first: ``steps[state][symbol] = (next state, log10 probability)``; END has no next state."""

    steps: list[dict[str, tuple[int, float]]]
    floor: float

    def log10(self, word: str) -> float:
        state, total = 0, 0.0
        for symbol in [*word, END]:
            step = self.steps[state].get(symbol) if state >= 0 else None
            if step is None:
                return total + self.floor * (len(word) + 1)
            state, total = step[0], total + step[1]
        return total


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > (n1**-0.5 + n2**-0.5) * math.sqrt(0.5 * math.log(2 / alpha))


def infer(words: list[str], alpha: float = ALPHA, floor: float = -3.0) -> Automaton:
    """Folds the prefix tree of the words; the order of merging is by count, then by first arrival."""
    children: list[dict[str, int]] = [{}]
    visits, ends = [0], [0]
    for word in words:
        node = 0
        visits[0] += 1
        for symbol in word:
            if symbol not in children[node]:
                children[node][symbol] = len(children)
                children.append({})
                visits.append(0)
                ends.append(0)
            node = children[node][symbol]
            visits[node] += 1
        ends[node] += 1

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if _differ(ends[x], visits[x], ends[y], visits[y], alpha):
                return False
            for symbol in children[x].keys() | children[y].keys():
                p, q = children[x].get(symbol), children[y].get(symbol)
                if _differ(flow.get((x, symbol), 0), visits[x], flow.get((y, symbol), 0), visits[y], alpha):
                    return False
                if p is not None and q is not None and p != q:
                    todo.append((p, q))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            visits[x] += visits[y]
            ends[x] += ends[y]
            for symbol, child in children[y].items():
                flow[x, symbol] = flow.get((x, symbol), 0) + flow[y, symbol]
                if symbol in children[x]:
                    todo.append((children[x][symbol], child))
                else:
                    children[x][symbol] = child

    flow = {(node, symbol): visits[child] for node, own in enumerate(children) for symbol, child in own.items()}
    red = [0]
    while True:
        settled = set(red)
        blue = [(flow[node, symbol], -child, node, symbol) for node in red for symbol, child in children[node].items() if child not in settled]
        if not blue:
            break
        _, child, node, symbol = max(blue)
        child = -child
        for other in red:
            if compatible(other, child):
                children[node][symbol] = other
                fold(other, child)
                break
        else:
            red.append(child)
    place = {node: i for i, node in enumerate(red)}
    steps = []
    for node in red:
        own = {s: (place[c], flow[node, s]) for s, c in children[node].items()}
        total = sum(n for _, n in own.values()) + ends[node]
        own = {s: (c, math.log10(n / total)) for s, (c, n) in own.items() if n}
        if ends[node]:
            own[END] = (-1, math.log10(ends[node] / total))
        steps.append(own)
    return Automaton(steps, floor)


@dataclass
class Model:
    """An automaton per learned kind, and log10 class frequencies of ordinary candidates."""

    automata: dict[str, Automaton]
    ordinary: dict[str, float]

    def odds(self, token: str) -> tuple[float, str]:
        """Best log10 odds per character against ordinary candidates, and the kind that gives it."""
        word = classes(token)
        plain = sum(self.ordinary.get(s, self.ordinary[""]) for s in [*word, END])
        return max(((a.log10(word) - plain) / (len(word) + 1), kind) for kind, a in self.automata.items())


def fit(labelled: dict[str, list[str]], ordinary: list[str]) -> Model:
    automata = {kind: infer([classes(v)[:MAX_LENGTH] for v in sorted(values)]) for kind, values in sorted(labelled.items()) if len(values) >= LEAST}
    # every class counts a little beforehand, so that a handful of candidates is not its own background
    counts = Counter({s: PRIOR for s in [*"9fgA", END]})
    counts.update(s for token in ordinary for s in [*classes(token)[:MAX_LENGTH], END])
    total = sum(counts.values()) + 1
    return Model(automata, {s: math.log10(n / total) for s, n in counts.items()} | {"": math.log10(1 / total)})


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def find(column) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Base spans, and candidates ``(start, end, token)``, of every text of a batch."""
    data, offsets = flat(column)
    n = len(offsets) - 1
    # a run of 31 or more covers an aligned block of 16
    blocks = len(data) // 16
    full = np.flatnonzero(HEX_BYTE[data[: blocks * 16]].reshape(-1, 16).all(axis=1)) * 16
    has_hex, has_digit = np.zeros(n, bool), np.zeros(n, bool)
    has_hex[np.searchsorted(offsets, full, side="right") - 1] = True
    has_digit[np.searchsorted(offsets, np.flatnonzero(DIGIT_BYTE[data]), side="right") - 1] = True
    base, others = [], []
    for i, text in enumerate(column.to_pylist()):
        spans = base_spans(text, bool(has_hex[i]))
        base.append(spans)
        tokens = []
        if has_digit[i]:
            for m in CANDIDATE.finditer(text):
                word = m[0]
                if sum(map(str.isdigit, word)) >= 2 and sum(map(str.isalpha, word)) >= 2 and not any(a < m.end() and m.start() < b for a, _, b, _ in spans):
                    tokens.append((m.start(), m.end(), word))
        others.append(tokens)
    return base, others


def _values(batches):
    """Values of all base spans, by kind, and candidates, kind -1; no longer than the training looks at."""
    for batch in batches:
        base, others = find(batch.column("__text"))
        rows = sorted({(k, v[:MAX_LENGTH]) for spans in base for _, k, _, v in spans} | {(-1, v[:MAX_LENGTH]) for tokens in others for _, _, v in tokens})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])


def learn(docs: DataFrame) -> Model:
    """Automata from the distinct values that the fixed formats find; bounded samples, chosen by hash, are collected."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("__text"))
    values = cut(texts.mapInArrow(_values, "kind int, value string").distinct())

    def sample(kind: int, limit: int) -> list[str]:
        return [r["value"] for r in values.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(limit).collect()]

    return fit({name: sample(i, MAX_LABELLED) for i, name in enumerate(KINDS)}, sample(-1, MAX_ORDINARY))


def _judge(shared):
    def run(batches):
        m: Model = shared.value
        for batch in batches:
            base, others = find(texts_of(batch))
            fixed = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b, _ in spans] for spans in base]
            added = []
            for tokens in others:
                found = [(m.odds(word), a, b) for a, b, word in tokens] if m.automata else []
                added.append([{"start": a, "kind": "like_" + kind, "end": b} for (odds, kind), a, b in found if odds >= ODDS])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(fixed, SPAN), pa.array(added, SPAN)], ["row", "base", "added"])

    return run


def scan(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``(*keep, base, added)`` per row: arrays of ``struct<start, kind, end>`` in code points, end exclusive.

    ``base`` holds the fixed formats by start, then kind; ``added`` the candidates that the automata take, kinds
    ``like_<kind>``. A null or empty text has none. Repeated rows are scanned one by one, other columns are ignored.
    """
    rows = carried(docs, keep)
    kind = rows.schema["row"].dataType.simpleString()
    span = "array<struct<start:bigint,kind:string,end:bigint>>"
    return rows.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(model)), f"row {kind}, base {span}, added {span}").select("row.*", "base", "added")


def merged(base, added):
    """All spans of a row by start; of equal starts the fixed formats first, as listed."""
    ranked = lambda spans, first: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (F.lit(first) + F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.regexp_replace(s["kind"], "^like_", ""))).alias("rank"),
        s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat(ranked(base, 0), ranked(added, 10)))


def text_of(spans):
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text, spans, mark: str = "[secret]"):
    """The text with every span replaced by ``mark``; overlapping spans are replaced once. ``spans`` as of ``merged``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.greatest(s["start"] - acc["at"], F.lit(0))
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, gap.cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
