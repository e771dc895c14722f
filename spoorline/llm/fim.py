"""Fill-in-the-middle transformation: a text is cut at two unit borders and its parts are rearranged between marks.

A text is divided into blocks of a fixed number of bytes. Two Fenwick trees over the blocks hold the units that end in
them and their code points, so a cut is a descent by powers of two to the block that holds the wanted unit's end, and a
search in that block alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.llm.textops import flat, pieces, texts_of

BLOCK = 4096
MARKS = ("<P>", "<S>", "<M>")
OUT_BYTES = 8_000_000  # of texts per batch handed back


class BlockTree:
    """Units and code points of a UTF-8 text, summed over blocks in Fenwick trees; a unit runs up to ``end``, inclusive."""

    def __init__(self, data: np.ndarray, end: int = 10, block: int = BLOCK):
        self.data, self.end, self.block = data, end, block
        self.blocks = -(-len(data) // block)
        ends, heads = data == end, (data & 0xC0) != 0x80
        sums = np.zeros((2, self.blocks + 1), np.int64)
        if self.blocks:
            edges = np.arange(0, len(data), block)
            np.cumsum([np.add.reduceat(x, edges, dtype=np.int64) for x in (ends, heads)], axis=1, out=sums[:, 1:])
        nodes = np.arange(self.blocks + 1)
        # a node sums the blocks from the one after its parent up to its own
        self.tree = sums - sums[:, nodes & (nodes - 1)]
        self.tree[:, 0] = 0
        self.chars = int(sums[1, -1])
        self.units = int(sums[0, -1]) + int(len(data) > 0 and data[-1] != end)

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the first ``units`` units."""
        if units <= 0:
            return 0, 0
        at, left, chars = 0, units, 0
        step = 1 << self.blocks.bit_length() >> 1
        while step:
            if at + step <= self.blocks and self.tree[0, at + step] < left:
                at += step
                left -= int(self.tree[0, at])
                chars += int(self.tree[1, at])
            step >>= 1
        if at == self.blocks:  # the last unit has no end of its own
            return len(self.data), self.chars
        start = at * self.block
        piece = self.data[start : start + self.block]
        length = int(np.flatnonzero(piece == self.end)[left - 1]) + 1
        return start + length, chars + int(np.count_nonzero((piece[:length] & 0xC0) != 0x80))


def _check_marks(marks: Sequence[str]) -> None:
    """Marks must not overlap, or a text's end could make one up together with the mark behind it."""
    for a in marks:
        for b in marks:
            if any(b.startswith(a[i:]) for i in range(1, len(a))) or (a != b and a in b):
                raise ValueError(f"marks overlap: {a} {b}")
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different marks are needed")


def draws(id_column: Column, seed: int | str) -> Column:
    """Four unsigned 32-bit numbers of a row: the first groups of the sha256 of ``seed:id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])


def _transform(marks: tuple[str, str, str], rate: int, spm_rate: int, end: int, block: int):
    p, s, m = (mark.encode() for mark in marks)

    def run(batches):
        for batch in batches:
            texts, numbers = texts_of(batch), batch.column("__draws").to_pylist()
            data, offsets = flat(texts)
            for i, j in pieces(offsets, OUT_BYTES):
                out, form, units, prefix, middle, spots = [], [], [], [], [], []
                for r in range(i, j):
                    own = data[offsets[r] : offsets[r + 1]]
                    text = own.tobytes()
                    tree = BlockTree(own, end, block)
                    units.append(tree.units)
                    h1, h2, h3, h4 = numbers[r]
                    if not text or p in text or s in text or m in text or h3 % 100 >= rate:
                        out.append(text), form.append("plain"), prefix.append(None), middle.append(None), spots.append(None)
                        continue
                    first, second = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
                    (a, before), (b, upto) = tree.cut(first), tree.cut(second)
                    if h4 % 100 < spm_rate:
                        form.append("spm"), out.append(b"".join((s, text[b:], p, text[:a], m, text[a:b])))
                    else:
                        form.append("psm"), out.append(b"".join((p, text[:a], s, text[b:], m, text[a:b])))
                    prefix.append(before), middle.append(upto - before), spots.append([first, second])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(i, j - i), pa.array(units, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(spots, pa.list_(pa.int64())), pa.array(out, pa.binary()).view(pa.string())],
                    ["row", "n", "form", "prefix_chars", "middle_chars", "cuts", "output"])

    return run


def rearrange(docs: DataFrame, keep: list[str], id_column: str = "doc_id", seed: int | str = 0, rate: int = 100, spm_rate: int = 50,
              marks: tuple[str, str, str] = MARKS, unit_end: str = "\n", block: int = BLOCK) -> DataFrame:
    """``(row, n, form, prefix_chars, middle_chars, cuts, output)`` per row; ``row`` is a struct of the columns ``keep``.

    ``n`` units end with the ASCII character ``unit_end``, the last one maybe without; ``cuts`` are the units before the
    two cuts. ``rate`` per cent of the texts are rearranged, ``spm_rate`` per cent of those with the suffix first; all
    draws follow from ``seed`` and the id. Forms: ``psm`` is P prefix S suffix M middle, ``spm`` S suffix P prefix M
    middle; a null or empty text and one that holds a mark stay ``plain``, without cuts. Equal draws give an empty
    middle. Rows of one id and text give equal results, a null id draws like an empty one, a long text is cut like a
    short one, an empty table gives no rows. Other columns are not looked at, so their names may clash.
    """
    _check_marks(marks)
    if len(unit_end.encode()) != 1:
        raise ValueError("a unit ends with one ASCII character")
    beside = [] if "text" in keep else [F.coalesce("text", F.lit("")).alias("__text")]
    rows = docs.select(F.struct(*keep).alias("row"), draws(F.col(id_column), seed).alias("__draws"), *beside)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        _transform(tuple(marks), rate, spm_rate, ord(unit_end), block),
        f"row {kind}, n long, form string, prefix_chars long, middle_chars long, cuts array<long>, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``rearrange`` was given; a rearranged text holds each mark once."""
    parts = F.split(output, "|".join(re.escape(mark) for mark in marks), -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
