"""Provenance graphs: node and edge tables, type statistics, set and multiplicity operations.

Events are rows ``(event_id, event_type, src_key, dst_key, ts_s, …)``; an entity key is ``type:id``.
``per`` names the columns that separate graphs (usually ``["window_id"]``; empty means one graph).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.ranking import first_per_group, global_rank, group_rank


def entity_type(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def endpoints(events: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Both ends of every event, one scan: ``(*per, entity_key, side, ts_s, event_id)``."""
    ends = F.array(
        F.struct(F.col("src_key").alias("entity_key"), F.lit(0).alias("side")),
        F.struct(F.col("dst_key").alias("entity_key"), F.lit(1).alias("side")),
    )
    return events.select(*per, "ts_s", "event_id", F.explode(ends).alias("e")).select(
        *per, "e.entity_key", "e.side", "ts_s", "event_id"
    )


def build_nodes(events: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """One row per entity and graph; ``node_id`` is dense in order of first appearance.

    Self-loop events count here: an entity seen only in self-loops is still a node.
    """
    first = F.min(F.struct("ts_s", "event_id", "side")).alias("__first")
    seen = endpoints(drop_dangling(events), per).groupBy(*per, "entity_key").agg(first)
    ranked = group_rank(seen, per, ["__first"], "node_id") if per else global_rank(seen, ["__first"], "node_id")
    return ranked.select(
        *per, "node_id", "entity_key", entity_type(F.col("entity_key")).alias("entity_type"),
        F.col("__first.ts_s").alias("first_ts"),
    )


def edge_type_dict(edges: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Dense id per event type in order of first appearance."""
    first = edges.groupBy(*per, "event_type").agg(F.min(F.struct("ts_s", "event_id")).alias("__first"))
    # a graph's types are a short vocabulary, one row each
    number = (F.row_number().over(Window.partitionBy(*per).orderBy("__first")) - 1).cast("long")
    return first.withColumn("edge_type_id", number).select(*per, "event_type", "edge_type_id")


def sort_by_time(events: DataFrame) -> DataFrame:
    return events.orderBy("ts_s", "event_id")


def drop_dangling(events: DataFrame) -> DataFrame:
    """Only events with both endpoints."""
    return events.where(F.col("src_key").isNotNull() & F.col("dst_key").isNotNull())


def remove_self_loops(events: DataFrame) -> DataFrame:
    return events.where(F.col("src_key") != F.col("dst_key"))


def build_edges(
    events: DataFrame, nodes: DataFrame, types: DataFrame, per: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Edges over node ids: ``(*per, edge_id, src, dst, edge_type_id, event_type, ts_s, *keep)``."""
    ids = nodes.select(*per, "entity_key", "node_id")
    src = ids.withColumnsRenamed({"entity_key": "src_key", "node_id": "src"})
    dst = ids.withColumnsRenamed({"entity_key": "dst_key", "node_id": "dst"})
    return (
        events.join(src, [*per, "src_key"])
        .join(dst, [*per, "dst_key"])
        .join(types, [*per, "event_type"])
        .select(*per, F.col("event_id").alias("edge_id"), "src", "dst", "edge_type_id", "event_type", "ts_s", *keep)
    )


def type_stats(df: DataFrame, column: str, top: int | None = 20) -> DataFrame:
    """Count and percent per type, descending; types beyond ``top`` are summed in one ``(other)`` row."""
    counts = df.groupBy(F.col(column).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    order = [F.desc("n"), F.asc("type")]
    if top is not None:
        best = counts.orderBy(*order).limit(top)
        rest = counts.join(best.select("type"), "type", "left_anti").agg(F.sum("n").alias("n"))
        counts = best.unionByName(rest.where("n is not null").select(F.lit("(other)").alias("type"), "n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / total).orderBy(*order)


def time_range(events: DataFrame) -> DataFrame:
    span = F.col("max_ts") - F.col("min_ts")
    return events.agg(F.min("ts_s").alias("min_ts"), F.max("ts_s").alias("max_ts")).select(
        "min_ts", "max_ts", (span / 3600).alias("hours"), (span / 86400).alias("days")
    )


def node_attributes(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Merged attribute map of every node (bounded per node, whatever its number of occurrences)."""
    return nodes.join(entities.select("entity_key", "attributes"), "entity_key", "left").withColumn(
        "attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    )


def node_lookup(nodes: DataFrame, entities: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Node id to entity id, type and attributes."""
    return node_attributes(nodes, entities).select(
        *per, "node_id", F.expr("substring(entity_key, instr(entity_key, ':') + 1)").alias("entity_id"),
        "entity_type", "attributes",
    )


def to_undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every edge and its reverse."""
    both = F.array(
        F.struct(F.col(src).alias("a"), F.col(dst).alias("b")),
        F.struct(F.col(dst).alias("a"), F.col(src).alias("b")),
    )
    return (
        edges.withColumn("__e", F.explode(both))
        .withColumns({src: F.col("__e.a"), dst: F.col("__e.b")})
        .drop("__e")
    )


def dedupe_edges(edges: DataFrame, per: Sequence[str] = (), order: Sequence[str] = ("ts_s", "edge_id")) -> DataFrame:
    """First edge in ``order`` of each ``(src, dst, event_type)``; combined before the shuffle."""
    keys = [*per, "src", "dst", "event_type"]
    rest = [c for c in edges.columns if c not in keys]
    first = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f"))
    return first.select(*[c if c in keys else F.col(f"__f.{c}").alias(c) for c in edges.columns])


def transform_graph(edges: DataFrame, kind: str = "none", per: Sequence[str] = ()) -> DataFrame:
    """Edges after the named transformation: ``none``, ``undirected`` or ``deduplicate``."""
    if kind == "undirected":
        return to_undirected(edges)
    if kind in ("deduplicate", "dedupe"):
        return dedupe_edges(edges, per)
    if kind != "none":
        raise ValueError(f"unknown transformation {kind!r}")
    return edges


def attach_scores(edges: DataFrame, scores: DataFrame, on: str = "edge_id") -> DataFrame:
    """Scores joined by edge id; edges without a score are left out."""
    return edges.join(scores, on)


def simple_digraph(events: DataFrame, dedupe: str = "last", keep: Sequence[str] = ("event_type", "ts_s", "score")) -> DataFrame:
    """One edge per ordered pair: the last event wins, or with ``max_score`` the best scored one."""
    order = {"last": ["event_id"], "max_score": ["score", "event_id"]}[dedupe]
    fields = list(dict.fromkeys(["event_id", *keep]))
    best = F.max_by(F.struct(*fields), F.struct(*order)).alias("__b")
    return events.groupBy("src_key", "dst_key").agg(best).select(
        "src_key", "dst_key", *[F.col(f"__b.{c}").alias(c) for c in fields]
    )


def digraph_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints of a digraph with their type, ``unknown`` where the node table lacks them."""
    ends = edges.select(F.explode(F.array("src_key", "dst_key")).alias("entity_key")).distinct()
    return ends.join(nodes.select("entity_key", "entity_type"), "entity_key", "left").withColumn(
        "entity_type", F.coalesce("entity_type", F.lit("unknown"))
    )


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One self edge per node on top of the ``(src, dst)`` edges."""
    loops = nodes.select(F.col("entity_key").alias("src_key"), F.col("entity_key").alias("dst_key"))
    return edges.select("src_key", "dst_key").unionByName(loops)


def cap_nodes(nodes: DataFrame, edges: DataFrame, max_nodes: int, per: Sequence[str] = ("window_id",)):
    """The ``max_nodes`` nodes of highest degree per graph and the edges among them."""
    degree = (
        edges.select(*per, F.explode(F.array("src", "dst")).alias("node_id"))
        .groupBy(*per, "node_id").agg(F.count(F.lit(1)).alias("degree"))
    )
    known = nodes.join(degree, [*per, "node_id"], "left").fillna(0, ["degree"])
    kept = first_per_group(known, per, [F.desc("degree"), F.asc("node_id")], max_nodes)
    ids = kept.select(*per, "node_id")
    inner = edges.join(ids.withColumnRenamed("node_id", "src"), [*per, "src"], "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), [*per, "dst"], "left_semi"
    )
    return kept, inner
