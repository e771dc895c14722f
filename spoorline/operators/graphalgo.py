"""Iterative graph measures: components, PageRank, betweenness, simple paths.

Each round is a join and a combinable aggregation; rounds end in a reliable checkpoint, so plans stay short and
a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.ranking import global_rank
from spoorline.session import bucketed, cut, stage


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src_key", dst: str = "dst_key") -> DataFrame:
    """Weakly connected components: ``(node, component)``, a component named by its smallest node.

    Alternates large-star and small-star steps, which converge in few rounds on long chains too; a hub only takes
    part in minima, which combine before the shuffle.
    """
    links = cut(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    )
    ends = edges.select(F.explode(F.array(src, dst)).alias("node"))
    everyone = ends if nodes is None else ends.unionByName(nodes.select(F.col("entity_key").alias("node")))
    fingerprint = None
    while True:
        # large star: every larger neighbour moves to the smallest node around
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: a node and its smaller neighbours meet at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == fingerprint:
            break
        fingerprint = state
    return everyone.distinct().join(links.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


PLAN_ROUNDS = 5
# so few edges are one task's work in every round; buckets would only be more tasks
SMALL_EDGES = 1_000_000


def _unsent(df: DataFrame, large: bool) -> DataFrame:
    """Keeps a join's sides from the driver: stored keys are small by their files' size and many times that as a broadcast."""
    return df.hint("merge") if large else df


def _received(edges: DataFrame, hot: DataFrame | None, ranks: DataFrame, large: bool = False) -> DataFrame:
    """What every edge brings to its ``dst_key``; hot sources' edges lie anywhere and meet their few ranks by broadcast."""
    give = F.col("y") * F.col("share") + F.col("floor")
    sent = edges.join(_unsent(ranks, large), "src_key").select(F.col("dst_key").alias("src_key"), give.alias("y"))
    if hot is None:
        return sent
    few = ranks.join(F.broadcast(hot.select("src_key").distinct()), "src_key", "left_semi")
    return sent.unionByName(hot.join(F.broadcast(few), "src_key").select(F.col("dst_key").alias("src_key"), give.alias("y")))


def pagerank(
    edges: DataFrame, nodes: DataFrame, damping: float = 0.85, tol: float = 1e-6, max_rounds: int = 100, check_every: int = 5,
    hot_share: float = 0.001, hot_rows: int = 1_000_000,
) -> DataFrame:
    """PageRank over distinct ``(src_key, dst_key)`` pairs; sums to 1 with the mass of dangling nodes spread evenly.

    Spreading dangling mass evenly is a uniform term, so the iteration runs without it and the result is scaled
    to 1 at the end: same fixed point, no global sum inside the rounds.

    More than ``SMALL_EDGES`` edges are stored once in sorted buckets of their source and are not exchanged again: a round's sums leave their
    exchange with the layout of the buckets, so the next round joins in place, and its one exchange carries partial sums
    per target. Sources with more than ``hot_rows`` edges and ``hot_share`` of all edges, fewer than 1 / ``hot_share``,
    are kept apart, spread evenly; only their ranks are broadcast, and neither the other ranks nor the edges reach the driver. Edges whose ends are not in ``nodes`` count for their source's share only.
    """
    spark = edges.sparkSession
    with stage(spark) as scope:
        pairs = cut(edges.select("src_key", "dst_key").distinct())
        degree = pairs.groupBy("src_key").agg(F.count(F.lit(1)).alias("n"))
        total = pairs.count()
        large = total > SMALL_EDGES
        split = degree.select("src_key", (F.lit(float(damping)) / F.col("n")).alias("share"), ((F.col("n") > hot_share * total) & (F.col("n") > hot_rows)).alias("hot"))
        split = cut(split)
        everyone = cut(nodes.select(F.col("entity_key").alias("src_key")).distinct())
        # a rank outside the nodes is never read nor returned
        known = pairs.join(_unsent(everyone.withColumnRenamed("src_key", "dst_key"), large), "dst_key", "left_semi")
        # every node has a row to itself that brings no rank but the floor
        floor = F.lit(1.0 - damping).alias("floor")
        alone = everyone.select("src_key", F.col("src_key").alias("dst_key"), F.lit(0.0).alias("share"), floor)
        shared = lambda sources: known.join(sources, "src_key").select("src_key", "dst_key", "share", F.lit(0.0).alias("floor"))
        hot = None
        few = split.where("hot").drop("hot")
        if not few.isEmpty():
            hot = cut(shared(F.broadcast(few)))
        rows = shared(_unsent(split.where("not hot").drop("hot"), large)).unionByName(alone)
        stored = bucketed(rows, "src_key") if large else cut(rows.coalesce(1))
        ranks, done, rounds = everyone.withColumn("y", F.lit(1.0 - damping)), False, 0
        while not done and rounds < max_rounds:
            before, written = ranks, rounds
            for _ in range(min(check_every, max_rounds - rounds)):
                ranks = _received(stored, hot, ranks, large).groupBy("src_key").agg(F.sum("y").alias("y"))
                rounds += 1
                # a plan of few rounds; with hot sources a round reads the ranks twice
                if hot is not None or rounds % PLAN_ROUNDS == 0:
                    ranks, written = cut(ranks), rounds
            if written != rounds:
                ranks, written = cut(ranks), rounds
            change = ranks.join(_unsent(before.withColumnRenamed("y", "old"), large), "src_key").agg(
                (F.sum(F.abs(F.col("y") - F.col("old"))) / F.sum("y")).alias("c")
            ).first()["c"]
            done = change is None or change < tol
        ranks = scope.keep(ranks)
    total = ranks.agg(F.sum("y")).scalar()
    return ranks.select(F.col("src_key").alias("entity_key"), (F.col("y") / total).alias("pagerank"))


def betweenness(edges: DataFrame, nodes: DataFrame, sources_at_once: int = 10_000) -> DataFrame:
    """Normalised betweenness on the undirected simple graph, by level-wise path counting; exact.

    ``sources_at_once`` sources are followed at a time: the state is at most nodes times that number of rows, and a block
    of sources takes two rounds per level of its widest search; its tables go when it ends. A neighbour of a level lies in
    that level, the one before or the next, so a search looks back two levels, however deep it is.
    """
    spark = edges.sparkSession
    with stage(spark) as scope:
        pair = F.array(F.struct(F.col("src_key").alias("v"), F.col("dst_key").alias("w")), F.struct(F.col("dst_key").alias("v"), F.col("src_key").alias("w")))
        links = cut(
            edges.where(F.col("src_key") != F.col("dst_key")).select(F.explode(pair).alias("e")).select("e.v", "e.w").distinct()
        )
        everyone = cut(nodes.select("entity_key").distinct())
        n = everyone.count()
        blocks = [everyone] if n <= sources_at_once else _blocks(everyone, n, sources_at_once)
        sums = []
        for sources in blocks:
            with stage(spark) as block:
                found = _dependencies(links, sources)
                if found is not None:
                    sums.append(block.keep(found))
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        if not sums:
            return scope.keep(everyone.withColumn("betweenness", F.lit(0.0)))
        total = reduce(DataFrame.unionByName, sums).groupBy(F.col("v").alias("entity_key")).agg((F.sum("delta") * scale).alias("betweenness"))
        return scope.keep(everyone.join(total, "entity_key", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0))))


def _blocks(everyone: DataFrame, n: int, size: int) -> list[DataFrame]:
    numbered = cut(global_rank(everyone, ["entity_key"], "number"))
    return [numbered.where((F.col("number") >= i) & (F.col("number") < i + size)).select("entity_key") for i in range(0, n, size)]


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame | None:
    """``(v, delta)``: the dependencies of all ``sources`` on ``v``, summed; None if no source has a neighbour."""
    level = cut(sources.select(F.col("entity_key").alias("s"), F.col("entity_key").alias("v"), F.lit(1.0).alias("sigma")))
    levels = [level]
    while True:
        back = reduce(DataFrame.unionByName, [x.select("s", "v") for x in levels[-2:]])
        level = cut(
            levels[-1].join(links, "v").groupBy("s", "w").agg(F.sum("sigma").alias("sigma"))
            .withColumnRenamed("w", "v").join(back, ["s", "v"], "left_anti")
        )
        if level.isEmpty():
            break
        levels.append(level)
    total = None
    delta = levels[-1].withColumn("delta", F.lit(0.0))
    for i in range(len(levels) - 1, 0, -1):
        delta = cut(delta)
        part = delta.groupBy("v").agg(F.sum("delta").alias("delta"))
        total = part if total is None else total.unionByName(part)
        if i == 1:
            break  # what flows on to the sources themselves does not count
        share = delta.select("s", F.col("v").alias("w"), ((1.0 + F.col("delta")) / F.col("sigma")).alias("share"))
        received = (
            share.join(links, "w").join(levels[i - 1], ["s", "v"])
            .groupBy("s", "v").agg(F.sum(F.col("share") * F.col("sigma")).alias("delta"))
        )
        delta = levels[i - 1].join(received, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
    return None if total is None else total.groupBy("v").agg(F.sum("delta").alias("delta"))


def simple_paths(edges: DataFrame, key_nodes: DataFrame, cutoff: int = 6) -> DataFrame:
    """All simple directed paths of at most ``cutoff`` edges from a key node to one ranked after it.

    ``key_nodes`` is ``(entity_key, rank)``. A path is grown only while some key node is still in reach within the
    edges left, which loses nothing and keeps dead ends out. Rows: ``(first, last, path, scores)``.
    """
    pairs = cut(edges.where(F.col("src_key") != F.col("dst_key")).select("src_key", "dst_key", "score"))
    keys = cut(key_nodes.select("entity_key", F.col("rank").alias("key_rank")))
    # hops from each node to its nearest key node, at most cutoff - 1
    near = keys.select(F.col("entity_key").alias("node"), F.lit(0).alias("hops"))
    for hop in range(1, cutoff):
        ring = pairs.join(near.withColumnRenamed("node", "dst_key"), "dst_key").select(F.col("src_key").alias("node")).distinct()
        near = cut(near.unionByName(ring.join(near, "node", "left_anti").withColumn("hops", F.lit(hop))))
    reach = pairs.join(near.withColumnRenamed("node", "dst_key"), "dst_key").select(
        F.col("src_key").alias("at"), F.col("dst_key").alias("to"), "score", "hops"
    )
    reach = cut(reach)
    paths = keys.select(
        F.col("entity_key").alias("at"), F.col("key_rank").alias("first_rank"), F.array("entity_key").alias("path"),
        F.array().cast("array<double>").alias("scores"),
    )
    out = None
    for length in range(1, cutoff + 1):
        paths = cut(
            paths.join(reach.where(F.col("hops") <= cutoff - length), "at").where(~F.array_contains("path", F.col("to")))
            .select(F.col("to").alias("at"), "first_rank", F.array_append("path", F.col("to")).alias("path"),
                    F.array_append("scores", F.col("score")).alias("scores"))
        )
        ended = paths.join(keys.withColumnRenamed("entity_key", "at"), "at").where(F.col("key_rank") > F.col("first_rank"))
        out = ended if out is None else out.unionByName(ended)
    return out.select(F.col("path")[0].alias("first"), F.col("at").alias("last"), "path", "scores")


def best_per_pair(paths: DataFrame, n: int = 3, places: int | None = None) -> DataFrame:
    """The n best paths of each (first, last) pair by score (rounded to ``places``), then path."""
    value = F.col("score") if places is None else F.round("score", places)
    order = Window.partitionBy("first", "last").orderBy(value.desc(), F.asc("path"))
    return paths.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
