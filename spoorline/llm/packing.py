"""Packing of tokenised documents into windows by non-negative least squares.

A document's whole windows stand alone; its rest falls into a bin of nearly equal lengths. All combinations of up to
three bins that fill a window are enumerated, their repeat counts are solved against the histogram of the rests (least
squares with counts >= 0), rounded down and dealt out. What rounding leaves over is laid end to end and cut at the
window; the last cut is made at powers of two, which need no padding. A task packs its own documents in shards of a
bounded number of tokens, so there is no shuffle, no rank and nothing to collect.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.textops import flat, pieces, released

SHARD_TOKENS = 8_000_000
BATCH_PIECES = 5000
CACHED_WORDS = 250_000

# printable ASCII without the apostrophe, and the letters of Latin-1: composed already, lower-cased alike everywhere
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_workers: dict[str, "WordIds"] = {}


def _byte_names() -> dict[int, str]:
    """Byte -> the visible character that stands for it in a byte-level vocabulary."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of white-space separated words, remembered per word.

    The vocabulary's rules never join text across white space and its special tokens hold none, so a text's ids are its
    words' ids. Plain words skip the tokenizer's normaliser, whose cost exceeds that of the merges, and go to its merge
    model part by part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.names = self.tokenizer.model, _byte_names()
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.ids = array("q", [0]), array("I")

    def encode(self, word: str) -> list[int]:
        # special tokens are found in the text as it is, also inside a word
        if "<|" in word or not PLAIN.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out = []
        for part in PARTS.findall(word.lower()):
            if not part.isascii():
                part = part.encode().decode("latin-1").translate(self.names)
            out += [t.id for t in self.model.tokenize(part)]
        return out

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each closed by ``end_id``, and the number of each."""
        if len(self.known) > CACHED_WORDS:
            self.clear()
        lists = pc.ascii_split_whitespace(texts)
        words = pc.list_flatten(lists).dictionary_encode()
        known, rows = self.known, []
        for word in words.dictionary.to_pylist():
            row = known.get(word)
            if row is None:
                row = known[word] = len(known)
                self.ids.extend(self.encode(word) if word else [])
                self.start.append(len(self.ids))
            rows.append(row)
        rows = np.array(rows, np.int64)[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        starts = np.frombuffer(self.start, np.int64)
        store = np.frombuffer(self.ids, np.uint32) if len(self.ids) else np.zeros(0, np.uint32)
        size = starts[rows + 1] - starts[rows]
        before = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        found = store[np.arange(before[-1]) + np.repeat(starts[rows] - before[:-1], size)]
        edges = lists.offsets.to_numpy().astype(np.int64)
        counts = np.diff(before[edges - edges[0]])
        del starts, store  # views keep the arrays from growing
        out = np.full(len(found) + len(counts), end_id, np.uint32)
        spot = np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)
        out[spot] = found
        return out, counts + 1


def combinations(bins: int) -> list[tuple[int, ...]]:
    """All multisets of at most three bins 1..bins whose sum is ``bins``."""
    out: list[tuple[int, ...]] = [(bins,)]
    out += [(i, bins - i) for i in range(1, bins // 2 + 1)]
    out += [(i, j, bins - i - j) for i in range(1, bins // 3 + 1) for j in range(i, (bins - i) // 2 + 1)]
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """argmin |a x - b| over x >= 0 by the active-set method; at most rank(a) entries are above 0."""
    x, chosen = np.zeros(a.shape[1]), []
    tolerance = 1e-8 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a[:, chosen] @ x[chosen])
        slope[chosen] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        chosen.append(j)
        while chosen:
            part = a[:, chosen]
            gram = part.T @ part
            gram[np.diag_indices_from(gram)] += 1e-10
            best = np.linalg.solve(gram, part.T @ b)
            if best.min() > 0:
                x[chosen] = best
                break
            now = x[chosen]
            falls = best <= 0
            step = float((now[falls] / np.maximum(now[falls] - best[falls], 1e-300)).min())
            x[chosen] = np.maximum(now + step * (best - now), 0)
            gone = [c for c, low in zip(chosen, falls) if low and x[c] <= 1e-12]
            if not gone:
                gone = [min((c for c, low in zip(chosen, falls) if low), key=lambda c: x[c])]
            x[gone] = 0
            chosen = [c for c in chosen if c not in gone]
    return x


def plan(lengths: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Pieces of documents of the given lengths (all > 0): doc, start, length, sequence, offset; sequences from 0.

    Every token lies in one piece; no sequence is longer than ``window``.
    """
    width = max(1, window // 256)
    bins = window // width
    doc = np.arange(len(lengths))
    whole, rest = lengths // window, lengths % window
    owner = np.repeat(doc, whole)
    parts = [(owner, (np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)) * window, np.full(len(owner), window), np.arange(len(owner)), np.zeros(len(owner), np.int64))]
    used = len(owner)
    # a window that is no multiple of the bin width keeps its last bin for itself
    own = np.minimum(-(-rest // width), bins)
    order = np.argsort(own, kind="stable")
    order = order[own[order] > 0]
    heads = np.searchsorted(own[order], np.arange(bins + 2))
    left, taken = np.diff(heads), heads[:-1].copy()
    if bins > 1 and len(order) > bins:
        combos = combinations(bins)
        a = np.zeros((bins, len(combos)))
        for c, members in enumerate(combos):
            for m in members:
                a[m - 1, c] += 1
        repeats = np.floor(nnls(a, left[1 : bins + 1].astype(float)) + 1e-6).astype(np.int64)
        for c in np.flatnonzero(repeats):
            members = combos[c]
            n = min([int(repeats[c])] + [int(left[m]) // members.count(m) for m in members])
            if n <= 0:
                continue
            offset = np.zeros(n, np.int64)
            for m in members:
                docs = order[taken[m] : taken[m] + n]
                taken[m] += n
                left[m] -= n
                parts.append((docs, whole[docs] * window, rest[docs], used + np.arange(n), offset.copy()))
                offset += rest[docs]
            used += n
    over = np.concatenate([order[taken[m] : heads[m + 1]] for m in range(1, bins + 1)] or [np.zeros(0, np.int64)])
    over = over[np.argsort(-rest[over], kind="stable")]
    if len(over):
        end = np.cumsum(rest[over])
        begin, total = end - rest[over], int(end[-1])
        cuts, at = list(range(0, total - total % window + 1, window)), total - total % window
        for bit in range(window.bit_length(), -1, -1):
            if (total - at) >> bit & 1:
                at += 1 << bit
                cuts.append(at)
        cuts = np.array(cuts)
        low, high = np.searchsorted(cuts, begin, side="right") - 1, np.searchsorted(cuts, end, side="left") - 1
        n = high - low + 1
        row = np.repeat(np.arange(len(over)), n)
        sequence = np.repeat(low, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = np.maximum(begin[row], cuts[sequence])
        last = np.minimum(end[row], cuts[sequence + 1])
        docs = over[row]
        parts.append((docs, whole[docs] * window + first - begin[row], last - first, used + sequence, first - cuts[sequence]))
    doc, start, length, sequence, offset = (np.concatenate(c).astype(np.int64) for c in zip(*parts))
    order = np.lexsort((start, doc))
    return {"doc": doc[order], "start": start[order], "length": length[order], "sequence": sequence[order], "offset": offset[order]}


def _narrow(ids: np.ndarray) -> np.ndarray:
    """The same ids in half the bytes if they fit."""
    return ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids


def _shard(parts: list[tuple[pa.Array, np.ndarray, np.ndarray]], window: int, base: int):
    """Record batches of the pieces of a shard's parts ``(ids of documents, tokens, tokens per document)``; returns the number of its sequences.

    A part leaves ``parts`` as its batches are made, so that only these are held as wide as they travel.
    """
    pieces_ = plan(np.concatenate([counts for _, _, counts in parts]), window)
    sequences, first = int(pieces_["sequence"].max()) + 1, 0
    parts.reverse()
    while parts:
        names, tokens, counts = parts.pop()
        low, high = np.searchsorted(pieces_["doc"], [first, first + len(counts)])
        used = 0
        for i in range(low, high, BATCH_PIECES):
            own = {name: column[i : min(i + BATCH_PIECES, high)] for name, column in pieces_.items()}
            ends = np.zeros(len(own["length"]) + 1, np.int64)
            np.cumsum(own["length"] * 4, out=ends[1:])
            # pieces in document order lie end to end in the part's tokens
            stream = tokens[used : used + ends[-1] // 4].astype(np.uint32)
            used += len(stream)
            binary = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(stream)]).cast(pa.binary())
            doc = own["doc"] - first
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(doc)), pa.array(own["start"]), pa.array(own["length"]), binary, pa.array(counts[doc]),
                 pa.array(own["sequence"] + base), pa.array(own["offset"])],
                ["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )
        first += len(counts)
    return sequences


def _pack(path: str, window: int, end_id: int, shard_tokens: int):
    def run(batches):
        if path not in _workers:
            _workers[path] = WordIds(path)
        encode, base = _workers[path], TaskContext.get().partitionId() << 40
        parts, held = [], 0
        for batch in batches:
            text = batch.column("__text")
            _, offsets = flat(text)
            for i, j in pieces(offsets):
                found, n = encode(text.slice(i, j - i), end_id)
                # a slice would hold the whole batch with its texts
                names = batch.column("__id").take(pa.array(np.arange(i, j)))
                parts.append((names, _narrow(found), n))
                held += len(found)
                if held >= shard_tokens:
                    base += yield from _shard(parts, window, base)
                    held = 0
        if parts:
            yield from _shard(parts, window, base)

    return released(run)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces ``(id_column, start, length, ids, doc_tokens, sequence_id, offset)`` of all documents.

    ``ids`` are the piece's token ids as little-endian 32-bit integers; a document's ids are those of its text and
    ``end_id``, so a null or empty text has one. Every id lies in exactly one piece, a sequence's pieces fill it
    gaplessly from offset 0 up to ``window`` at most. Repeated rows and null ids are packed like any other row; other
    columns are ignored. An empty table gives no pieces. ``tokenizer_path`` must exist on every executor.
    """
    source = docs.select(F.col(id_column).alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    kind = source.schema["__id"].dataType.simpleString()
    packed = source.mapInArrow(
        _pack(tokenizer_path, window, end_id, shard_tokens),
        f"__id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return packed.withColumnRenamed("__id", id_column)
