"""Best simple paths between key nodes without listing all of them.

Beginnings of paths grow by one edge per round. Of those that start at one key node and meet at one node after equally
many edges, only those are kept that some end can still complete to one of the best paths. An end rules out beginnings
that share a node with it, so the best few alone are not enough: a beginning stays if some choice of at most as many
nodes as are still to come leaves fewer than ``per_pair`` better beginnings untouched. By a classic theorem on
intersecting sets the kept ones are few, whatever the number of paths.

The score of a whole path is ``(MAX_PART * largest + MEAN_PART * mean edge score) / log2(edges + 2)``. Its largest edge
lies in the beginning or in the end, so for a given length it is the larger of two sums of a part of the beginning and
a part of the end; one order of beginnings per case and length decides what is better.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.operators.graphalgo import best_per_pair
from spoorline.session import cut

MAX_PART, MEAN_PART = 0.7, 0.3
SAME = 1e-12  # relative difference up to which sums of scores count as equal
GROUP_ROWS = 512  # beginnings of one group looked at together
HELD_ROWS = 100_000  # beginnings that a task holds before its first pass hands them on


def path_score(scores: Column) -> Column:
    mean = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / F.size(scores)
    return (MAX_PART * F.array_max(scores) + MEAN_PART * mean) / F.log2(F.size(scores) + 2)


def _needed(better: list[frozenset], own: frozenset, to_come: int, per_pair: int) -> bool:
    """Whether some end of at most ``to_come`` nodes outside ``own`` leaves fewer than ``per_pair`` of the better ones."""
    if len(better) < per_pair:
        return True
    if not to_come:
        return False
    # such an end meets one of any per_pair sets
    for node in frozenset().union(*better[:per_pair]) - own:
        if _needed([s for s in better if node not in s], own, to_come - 1, per_pair):
            return True
    return False


def _orders(length: int, cutoff: int, places: int | None) -> Iterator[tuple[float, float, float]]:
    """Weights of (largest, sum) and the difference that surely survives rounding, per case and whole length."""
    margin = 0.0 if places is None else 10.0**-places
    for whole in range(length, cutoff + 1):
        yield MAX_PART, MEAN_PART / whole, margin * math.log2(whole + 2)
    yield 0.0, MEAN_PART / cutoff, margin * math.log2(cutoff + 2)


def needed_beginnings(rows: list[tuple[list[str], list[float]]], cutoff: int, per_pair: int, places: int | None = None) -> list[int]:
    """The places of the beginnings ``(path, scores)`` to keep, all of one first node, last node and length."""
    length = len(rows[0][1])
    inner = [frozenset(path[1:-1]) for path, _ in rows]
    marks = [(max(scores), math.fsum(scores)) for _, scores in rows]
    kept: set[int] = set()
    for by_max, by_sum, margin in _orders(length, cutoff, places):
        weight = [by_max * m + by_sum * s for m, s in marks]
        family: list[int] = []
        for i in sorted(range(len(rows)), key=lambda i: (-weight[i], rows[i][0])):
            tie = SAME * max(1.0, abs(weight[i]))
            better = [
                inner[j] for j in family
                if weight[j] - weight[i] > max(margin, tie) or (abs(weight[j] - weight[i]) <= tie and rows[j][0] < rows[i][0])]
            if _needed(better, inner[i], cutoff - length, per_pair):
                family.append(i)
        kept.update(family)
    return sorted(kept)


def _prune(cutoff: int, per_pair: int, places: int | None, sorted_groups: bool):
    def run(batches):
        groups: dict[tuple, list] = {}
        held = 0

        def less(rows):
            return [rows[i] for i in needed_beginnings(rows, cutoff, per_pair, places)]

        def out():
            # rows of a group that is still open stay in it
            columns = [(rank, at, path, scores) for (rank, at), rows in groups.items() for path, scores in less(rows)]
            groups.clear()
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*columns), kinds)], ["first_rank", "at", "path", "scores"])

        last = None
        for batch in batches:
            for rank, at, path, scores in zip(*(c.to_pylist() for c in batch.columns)):
                key = (rank, at)
                if key != last and held >= HELD_ROWS:
                    yield out()
                    held = 0
                last = key
                rows = groups.setdefault(key, [])
                rows.append((path, scores))
                held += 1
                if len(rows) >= GROUP_ROWS:
                    groups[key] = less(rows)
                    held += len(groups[key]) - len(rows)
                if not sorted_groups and held >= HELD_ROWS:
                    yield out()
                    held = 0
        if groups:
            yield out()

    return run


def best_beginnings(grown: DataFrame, cutoff: int, per_pair: int, places: int | None = None) -> DataFrame:
    """Of the beginnings ``(first_rank, at, path, scores)``, all of one length, those that best paths may need.

    Tasks drop what they can before the exchange, so a hub sends few rows per task; afterwards a group is read in
    bounded pieces.
    """
    kind = "first_rank long, at string, path array<string>, scores array<double>"
    rows = grown.select(F.col("first_rank").cast("long").alias("first_rank"), "at", "path", "scores")
    some = rows.mapInArrow(_prune(cutoff, per_pair, places, False), kind)
    laid = some.repartition("first_rank", "at").sortWithinPartitions("first_rank", "at")
    return laid.mapInArrow(_prune(cutoff, per_pair, places, True), kind)


def near_keys(pairs: DataFrame, keys: DataFrame, cutoff: int) -> DataFrame:
    """``(node, hops)``: edges from a node to its nearest key node, at most ``cutoff - 1``."""
    near = keys.select(F.col("entity_key").alias("node"), F.lit(0).alias("hops"))
    for hop in range(1, cutoff):
        ring = pairs.join(near.withColumnRenamed("node", "dst_key"), "dst_key").select(F.col("src_key").alias("node")).distinct()
        near = cut(near.unionByName(ring.join(near, "node", "left_anti").withColumn("hops", F.lit(hop))))
    return near


def best_paths(edges: DataFrame, key_nodes: DataFrame, cutoff: int = 6, per_pair: int = 3, places: int | None = None) -> DataFrame:
    """The ``per_pair`` best simple paths of each pair of key nodes, exactly: ``(first, last, path, scores, score)``.

    ``key_nodes`` is ``(entity_key, rank)``; a path runs from a key node to one ranked after it over at most ``cutoff``
    edges and may pass others. Paths compare by score (rounded to ``places``), then by their nodes. Parallel edges are
    paths of their own; self loops and edges without a finite score take no part.
    """
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    pairs = cut(edges.withColumn("score", F.col("score").cast("double")).where((F.col("src_key") != F.col("dst_key")) & finite).select("src_key", "dst_key", "score"))
    keys = cut(key_nodes.select("entity_key", F.col("rank").alias("key_rank")))
    near = near_keys(pairs.select("src_key", "dst_key").distinct(), keys, cutoff)
    reach = cut(pairs.join(near.withColumnRenamed("node", "dst_key"), "dst_key").select(F.col("src_key").alias("at"), F.col("dst_key").alias("to"), "score", "hops"))
    found = keys.select(
        F.col("entity_key").alias("at"), F.col("key_rank").cast("long").alias("first_rank"), F.array("entity_key").alias("path"), F.array().cast("array<double>").alias("scores"))
    whole = None
    for length in range(1, cutoff + 1):
        grown = found.join(reach.where(F.col("hops") <= cutoff - length), "at").where(~F.array_contains("path", F.col("to"))).select(
            "first_rank", F.col("to").alias("at"), F.array_append("path", F.col("to")).alias("path"), F.array_append("scores", F.col("score")).alias("scores"))
        found = cut(best_beginnings(grown, cutoff, per_pair, places))
        ended = found.join(keys.withColumnRenamed("entity_key", "at"), "at").where(F.col("key_rank") > F.col("first_rank"))
        whole = ended if whole is None else whole.unionByName(ended)
    paths = whole.select(F.col("path")[0].alias("first"), F.col("at").alias("last"), "path", "scores", path_score(F.col("scores")).alias("score"))
    return best_per_pair(paths, per_pair, places)
