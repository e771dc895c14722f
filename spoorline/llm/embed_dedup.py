"""Embedding near-duplicates by sorted projection passes.

Per pass every vector gets a word of random hyperplane bits; within a label the vectors are sorted by that word and
each is compared, in double precision, with its neighbours in the order. The window is 256 vectors at least and stays
open backwards while links are still found at its far end, so a dense stretch is compared as a whole. The links of all
passes are united. The number of passes follows from the number of vectors per label, so that a pair just at the
threshold meets in some pass with the wanted probability at every size.

Vectors that fall into one cell of a fine grid (their cosine is above 0.9999 by the cell's diameter) are one point with
a multiplicity: a group of copies costs as much as a vector. Where the members of two cells may fall on both sides of
the threshold they are compared one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.llm.textops import mix64
from spoorline.operators.graphalgo import connected_components
from spoorline.session import cut

WINDOW, BITS = 256, 62
GRID = 1024.0
MISS = 0.02  # accepted probability that a pair at the threshold never meets

U = np.uint64


def _rows(column) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for a null, zero or non-finite vector or one with a null entry."""
    out = []
    for value in column.to_pylist():
        if not value or any(x is None for x in value):
            out.append(None)
            continue
        v = np.array(value, dtype=np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        v /= top  # keeps the squares of very large and very small entries in range
        out.append(v / math.sqrt(float(v @ v)))
    return out


def _units(batches):
    for batch in batches:
        units = _rows(batch.column("__vector"))
        his, los = [], []
        for u in units:
            if u is None:
                his.append(None), los.append(None)
                continue
            cell = np.floor(u * GRID).astype(np.int64).view(np.uint64) + mix64(np.arange(1, len(u) + 1, dtype=np.uint64))
            his.append(int(mix64(cell).sum(dtype=np.uint64).view(np.int64)))
            los.append(int(mix64(cell ^ U(0x5BE0CD19137E2179)).sum(dtype=np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("__label"), pa.array(his, pa.int64()), pa.array(los, pa.int64()),
             pa.array([None if u is None else u.tolist() for u in units], pa.list_(pa.float64()))],
            ["__id", "__label", "hi", "lo", "unit"])


def _words(passes: int):
    """The sort word of every pass."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            out = []
            for unit in batch.column("unit").to_pylist():
                if len(unit) not in planes:
                    planes[len(unit)] = np.random.default_rng(len(unit)).standard_normal((passes * BITS, len(unit)))
                bits = (planes[len(unit)] @ np.array(unit) > 0).reshape(passes, BITS)
                out.append((bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("__label"), batch.column("unit"), pa.array(out, pa.list_(pa.int64()))], ["cell", "__label", "unit", "words"])

    return run


def _neighbours(threshold: float):
    """Pairs of sorted rows within the open window whose cosine reaches the threshold."""

    def run(batches):
        ids, labels, units = [], [], []

        def compare(new_ids, new_labels, new_units):
            nonlocal ids, labels, units
            both_ids, both_labels, both = ids + new_ids, labels + new_labels, units + new_units
            width = max(len(u) for u in both)
            flat = np.zeros((len(both), width))
            for row, u in zip(flat, both):
                row[: len(u)] = u
            size = np.array([len(u) for u in both])
            label = np.array(both_labels)
            old = len(ids)
            cosine = flat[old:] @ flat.T
            ok = (cosine >= threshold) & (label[old:, None] == label) & (size[old:, None] == size)
            ok &= np.arange(len(both)) < old + np.arange(len(new_ids))[:, None]
            a, b = np.nonzero(ok)
            names = np.array(both_ids, dtype=np.int64)
            found = pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(names[old + a], names[b])), pa.array(np.maximum(names[old + a], names[b])), pa.array(cosine[a, b])], ["a", "b", "cosine"])
            # the window stays open while its far end is still linked
            keep = 0 if len(a) and b.min() < min(old, WINDOW) else max(0, len(both) - WINDOW)
            ids, labels, units = both_ids[keep:], both_labels[keep:], both[keep:]
            return found

        for batch in batches:
            for i in range(0, len(batch), WINDOW):
                part = batch.slice(i, WINDOW)
                yield compare(part.column("cell").to_pylist(), part.column("__label").to_pylist(), [np.array(u) for u in part.column("unit").to_pylist()])

    return run


def _member_cosines(batches):
    for batch in batches:
        cosine = [float(np.dot(x, y)) if len(x) == len(y) else -1.0 for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "ua", "ub")], pa.array(cosine, pa.float64())], ["a", "b", "ua", "ub", "cosine"])


def passes_for(rows: int, threshold: float) -> int:
    """Passes after which a pair at the threshold has met with probability 1 - MISS, for ``rows`` cells of one label."""
    same = 1 - math.acos(threshold) / math.pi
    meet = 0.8 * same ** max(0.0, math.log2(max(rows, 1) / WINDOW))
    return max(4, math.ceil(math.log(MISS) / math.log(1 - meet)))


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row of ``vectors``.

    Rows link if their labels are equal and not null and their cosine reaches the threshold; null and zero vectors,
    those with null or non-finite entries, and vectors of different lengths link with nothing. ``n_links`` counts other
    rows, repeated rows included; ``component_id`` is the smallest id reachable by links. A null id names nothing, and
    its row is not kept. Windows end at the borders of range partitions; other passes have other borders.
    """
    source = vectors.select(F.col(id_column).cast("long").alias("__id"), F.col(label_column).cast("string").alias("__label"), F.col(vector_column).alias("__vector"))
    rows = cut(
        source.mapInArrow(_units, "__id long, __label string, hi long, lo long, unit array<double>").withColumn("uid", F.monotonically_increasing_id())
    )
    usable = rows.where("unit is not null and __label is not null")
    cells = cut(usable.groupBy("__label", "hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("cell")))
    most = cells.groupBy("__label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c")).first()["c"] or 0
    passes = passes_for(most, threshold)
    points = cut(
        usable.select(F.col("uid").alias("cell"), "__label", "unit").join(cells.select("cell"), "cell", "left_semi")
        .mapInArrow(_words(passes), "cell long, __label string, unit array<double>, words array<long>")
    )
    diameter = 2 * math.sqrt(64) / GRID  # of a cell in 64 dimensions; wider vectors get more below
    wide = points.agg(F.max(F.size("unit")).alias("d")).first()["d"] or 1
    margin = max(diameter, 2 * math.sqrt(wide) / GRID)
    found = None
    for p in range(passes):
        order = [F.col("__label"), F.col("word"), F.col("cell")]
        sorted_ = points.select("cell", "__label", "unit", F.col("words")[p].alias("word")).repartitionByRange(*order).sortWithinPartitions(*order)
        pairs = sorted_.mapInArrow(_neighbours(threshold - margin), "a long, b long, cosine double")
        found = pairs if found is None else found.unionByName(pairs)
    size = cells.select("cell", "n")
    pairs = cut(
        found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
        .join(size.withColumnsRenamed({"cell": "a", "n": "na"}), "a").join(size.withColumnsRenamed({"cell": "b", "n": "nb"}), "b")
    )
    alone = (F.col("na") == 1) & (F.col("nb") == 1)
    sure = pairs.where(F.when(alone, F.col("cosine") >= threshold).otherwise(F.col("cosine") >= threshold + margin))
    unsure = pairs.where(~alone & (F.col("cosine") < threshold + margin)).select("a", "b")
    members = usable.join(cells, ["__label", "hi", "lo"]).select("cell", "uid", "unit")
    close = cut(
        unsure.join(members.select(F.col("cell").alias("a"), F.col("uid").alias("ua"), F.col("unit").alias("x")), "a")
        .join(members.select(F.col("cell").alias("b"), F.col("uid").alias("ub"), F.col("unit").alias("y")), "b")
        .mapInArrow(_member_cosines, "a long, b long, ua long, ub long, cosine double").where(F.col("cosine") >= threshold).drop("cosine")
    )
    ends = lambda df, left, right, n: df.select(F.explode(F.array(
        F.struct(F.col(left).alias("k"), F.col(n[1]).alias("m")), F.struct(F.col(right).alias("k"), F.col(n[0]).alias("m")))).alias("e")).select("e.k", "e.m")
    by_cell = ends(sure, "a", "b", ("na", "nb")).groupBy("k").agg(F.sum("m").alias("far"))
    one = close.withColumn("one", F.lit(1).cast("long"))
    by_row = ends(one, "ua", "ub", ("one", "one")).groupBy("k").agg(F.sum("m").alias("near"))
    edges = cut(sure.select("a", "b").unionByName(close.select("a", "b").distinct()))
    components = connected_components(edges, src="a", dst="b").select(F.col("node").alias("cell"), "component")
    known = cut(
        cells.join(components, "cell", "left").join(by_cell.withColumnRenamed("k", "cell"), "cell", "left")
        .select("__label", "hi", "lo", F.coalesce("component", "cell").alias("root"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    )
    placed = cut(usable.select("__id", "uid", "__label", "hi", "lo").join(known, ["__label", "hi", "lo"]).select("__id", "uid", "root", "links"))
    least = placed.groupBy("root").agg(F.min("__id").alias("least"))
    linked = (
        placed.join(by_row.withColumnRenamed("k", "uid"), "uid", "left").join(least, "root")
        .select("__id", (F.col("links") + F.coalesce("near", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    )
    lone = rows.where("unit is null or __label is null").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    return linked.unionByName(lone).select(F.col("__id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"))
