"""Attack graphs: seeds, bounded provenance expansion, clusters, importance, ranked paths.

A digraph is ``(src_key, dst_key, event_id, event_type, ts_s, score)`` with one row per ordered pair. Ties in
score are broken by the higher event id everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators import graphalgo
from spoorline.operators.features import degrees
from spoorline.operators.graph import entity_type
from spoorline.operators.paths import best_paths, path_score
from spoorline.operators.ranking import first_per_group, global_rank
from spoorline.session import cut

ORDER = ("score", "event_id")


def _best_first():
    return [F.desc(c) for c in ORDER]


def anomalous_edges(digraph: DataFrame, threshold: Column) -> DataFrame:
    """Edges with a score at or above the threshold, descending."""
    return digraph.where(F.col("score") >= threshold).orderBy(*_best_first())


def seed_subgraph(anomalous: DataFrame, top_k: int = 100) -> DataFrame:
    return anomalous.orderBy(*_best_first()).limit(top_k)


def edge_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src_key", "dst_key")).alias("entity_key")).distinct()


def seed_nodes(anomalous: DataFrame, n: int = 50) -> DataFrame:
    """Endpoints of the n best edges."""
    return edge_nodes(anomalous.orderBy(*_best_first()).limit(n))


def _expand(digraph, members, seeds, floor, depth, fan, near, far, tag):
    """Level-synchronous walk from ``near`` to ``far`` ends; returns the added edges and all members."""
    frontier = visited = seeds
    added = None
    for level in range(depth):
        fringe = frontier.withColumnRenamed("entity_key", near)
        best = first_per_group(digraph.join(fringe, near, "left_semi"), [near], _best_first(), fan)
        inside = members.select(F.col("entity_key").alias(far), F.lit(True).alias("__in"))
        step = cut(
            best.join(inside, far, "left").where((F.col("score") > floor) | F.col("__in"))
            .drop("__in").withColumn("provenance", F.lit(tag)).withColumn("level", F.lit(level + 1))
        )
        added = step if added is None else added.unionByName(step)
        reached = step.select(F.col(far).alias("entity_key")).distinct()
        members = cut(members.unionByName(reached).distinct())
        frontier = cut(reached.join(visited, "entity_key", "left_anti"))
        visited = visited.unionByName(frontier)
    return added, members


def expand_backward(digraph, members, seeds, threshold: float, depth: int = 2, fan: int = 10) -> tuple[DataFrame, DataFrame]:
    """Predecessor edges of the seeds, level by level: the ``fan`` best per node, kept if they score above 0.3 of the
    threshold or come from a member. Returns ``(edges, members)``."""
    return _expand(digraph, members, seeds, 0.3 * threshold, depth, fan, "dst_key", "src_key", "backward")


def expand_forward(digraph, members, seeds, threshold: float, depth: int = 2, fan: int = 10) -> tuple[DataFrame, DataFrame]:
    """As ``expand_backward`` on successors."""
    return _expand(digraph, members, seeds, 0.3 * threshold, depth, fan, "src_key", "dst_key", "forward")


@dataclass
class AttackGraph:
    edges: DataFrame
    nodes: DataFrame
    seeds: DataFrame
    backward: DataFrame
    forward: DataFrame
    threshold: float


def reconstruct(
    digraph: DataFrame, threshold: float, top_k: int = 100, n_seeds: int = 50, depth: int = 2, fan: int = 10
) -> AttackGraph:
    """The top-k anomalies and their bounded provenance context; frozen, as every later step reads it again."""
    digraph = cut(digraph)
    top = cut(seed_subgraph(anomalous_edges(digraph, F.lit(threshold)), top_k))
    seeds = cut(seed_nodes(top, n_seeds))
    members = cut(edge_nodes(top))
    backward, members = expand_backward(digraph, members, seeds, threshold, depth, fan)
    forward, members = expand_forward(digraph, members, seeds, threshold, depth, fan)
    every = (
        top.withColumns({"provenance": F.lit("seed"), "level": F.lit(0)})
        .unionByName(backward).unionByName(forward)
    )
    # an edge found again takes the later tag: seed, then backward, then forward
    rank = F.when(F.col("provenance") == "forward", 2).when(F.col("provenance") == "backward", 1).otherwise(0)
    edges = cut(
        every.groupBy("src_key", "dst_key", "event_id", "event_type", "ts_s", "score")
        .agg(F.max_by("provenance", rank).alias("provenance"))
    )
    nodes = cut(members.withColumn("entity_type", entity_type(F.col("entity_key"))))
    return AttackGraph(edges, nodes, seeds, backward, forward, threshold)


def cluster_entity(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("cluster", F.coalesce("entity_type", F.lit("unknown")))


def cluster_time(nodes: DataFrame, edges: DataFrame, bins: int = 10) -> DataFrame:
    """Bin of the mean time of a node's outgoing edges; the latest instant falls in bin ``bins``."""
    timed = edges.where("ts_s > 0")
    span = timed.agg(F.struct(F.min("ts_s").alias("lo"), ((F.max("ts_s") - F.min("ts_s")) / bins).alias("w"))).scalar()
    mean = timed.groupBy(F.col("src_key").alias("entity_key")).agg(F.avg("ts_s").alias("__t"))
    number = F.when(span["w"] > 0, F.floor((F.col("__t") - span["lo"]) / span["w"])).otherwise(0)
    return nodes.join(mean, "entity_key", "left").withColumn(
        "cluster", F.when(F.col("__t").isNull(), "time_unknown").otherwise(F.concat(F.lit("time_"), number.cast("string")))
    ).drop("__t")


def cluster_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components, numbered by their smallest node."""
    parts = graphalgo.connected_components(edges, nodes).withColumnRenamed("node", "entity_key")
    numbered = global_rank(parts.select("component").distinct(), ["component"], "__n")
    return nodes.join(parts.join(numbered, "component"), "entity_key").withColumn(
        "cluster", F.concat(F.lit("path_"), F.col("__n").cast("string"))
    ).drop("__n", "component")


def graph_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    counted = degrees(edges).withColumnRenamed("node", "entity_key")
    return nodes.join(counted, "entity_key", "left").fillna(0, ["in_degree", "out_degree", "degree"])


def importance(nodes: DataFrame, edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Half betweenness, half PageRank."""
    between = graphalgo.betweenness(edges, nodes)
    rank = graphalgo.pagerank(edges, nodes, tol=tol)
    return nodes.join(between, "entity_key").join(rank, "entity_key").withColumn(
        "importance", 0.5 * F.col("betweenness") + 0.5 * F.col("pagerank")
    )


def key_nodes(scored: DataFrame, n: int = 15, places: int | None = None) -> DataFrame:
    """The n most important nodes with rank 1..n (``places`` rounds before comparing; ties by name)."""
    value = F.col("importance") if places is None else F.round("importance", places)
    order = [F.desc("__i"), F.asc("entity_key")]
    best = scored.withColumn("__i", value).orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("__i")


def attack_paths(edges: DataFrame, keys: DataFrame, cutoff: int = 6, per_pair: int = 3, min_score: float = 0.0, places: int | None = None) -> DataFrame:
    """Best simple paths between ordered key nodes with their score (``places`` rounds before comparing)."""
    best = best_paths(edges, keys, cutoff, per_pair, places)
    return best.where(F.col("score") >= min_score).withColumn("length", F.size("path"))


def top_paths(paths: DataFrame, k: int = 10, places: int | None = None) -> DataFrame:
    value = F.col("score") if places is None else F.round("score", places)
    order = [F.desc("__s"), F.asc("path")]
    best = paths.withColumn("__s", value).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("__s")


def path_details(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge information along each path, in path order (a path has at most cutoff + 1 nodes)."""
    steps = paths.select(
        "path", F.posexplode("path").alias("pos", "entity_key")
    ).withColumn("dst_key", F.try_element_at("path", F.col("pos") + 2))
    info = nodes.select("entity_key", "entity_type", *[c for c in ("importance",) if c in nodes.columns])
    node_list = (
        steps.join(info, "entity_key", "left").groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "entity_key", *info.columns[1:]))).alias("nodes"))
    )
    edge_list = (
        steps.join(edges.select(F.col("src_key").alias("entity_key"), "dst_key", "event_type", "score", "ts_s"), ["entity_key", "dst_key"])
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("entity_key").alias("src_key"), "dst_key", "event_type", "score", "ts_s"))).alias("edges"))
    )
    return paths.join(node_list, "path").join(edge_list, "path")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, weak components and density."""
    parts = graphalgo.connected_components(edges, nodes)
    counts = parts.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    n = F.col("nodes")
    return counts.withColumn("edges", edges.agg(F.count(F.lit(1))).scalar()).withColumn(
        "density", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0)
    )


def edge_band(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


def display_name(name: Column, limit: int = 40) -> Column:
    """Names cut to 50, and to 37 + ``...`` where longer than ``limit``."""
    cut50 = F.substring(name, 1, 50)
    return F.when(F.length(cut50) > limit, F.concat(F.substring(cut50, 1, limit - 3), F.lit("..."))).otherwise(cut50)


def composition(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge type counts and the time span of an attack graph (type vocabularies are small)."""
    by_node = nodes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity_type", "n")))).alias("m")
    )
    by_edge = edges.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m")
    )
    return edges.agg(F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts")).withColumns(
        {"node_types": by_node.scalar(), "edge_types": by_edge.scalar()}
    )


def trace(digraph: DataFrame, starts: DataFrame, max_hops: int = 5, min_score: float = 0.5) -> DataFrame:
    """Greedy walk back from each detected edge: the best-scored edge into its source, and so on.

    Stops below ``min_score``, at a node without predecessor, or where the walk would meet itself. The best
    predecessor is one row per node, so a step is a key look-up however many edges enter a hub.
    """
    best = cut(
        digraph.where((F.col("score") >= min_score) & (F.col("src_key") != F.col("dst_key")))
        .groupBy(F.col("dst_key").alias("at"))
        .agg(F.max(F.struct("score", "event_id", "src_key")).alias("p"))
    )
    walk = cut(starts.select(
        F.col("event_id").alias("anomaly"), F.lit(0).alias("hop"), "event_id", "src_key", "dst_key", "score",
        F.array("src_key", "dst_key").alias("path"),
    ))
    out = walk
    for hop in range(1, max_hops + 1):
        walk = cut(
            walk.withColumnRenamed("src_key", "at").join(best, "at").where(~F.array_contains("path", F.col("p.src_key")))
            .select("anomaly", F.lit(hop).alias("hop"), "p.event_id", "p.src_key", F.col("at").alias("dst_key"), "p.score",
                    F.array_append("path", F.col("p.src_key")).alias("path"))
        )
        out = out.unionByName(walk)
    return out.drop("path")
