"""Time windows anchored at the first event, window sizes, snapshots and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.ranking import global_rank
from spoorline.session import cut


def tumbling_windows(events: DataFrame, window_seconds: float = 3600) -> DataFrame:
    """``window_id`` and ``window_start`` of windows anchored at the first event; ``<= 0``: one window."""
    first = events.agg(F.min("ts_s")).scalar()
    if window_seconds <= 0:
        return events.withColumns({"window_id": F.lit(0).cast("long"), "window_start": first})
    index = F.floor((F.col("ts_s") - first) / float(window_seconds)).cast("long")
    return events.withColumn("window_id", index).withColumn(
        "window_start", first + F.col("window_id") * float(window_seconds)
    )


def sliding_windows(
    events: DataFrame, size: float, stride: float | None = None, overlap: float | None = None, compat: bool = False
) -> DataFrame:
    """One row per event and half-open window ``[start, start + size)`` that holds it.

    Windows start every ``stride`` (or ``size * (1 - overlap)``) seconds from the first event on. ``compat``
    drops windows that start at or after the last event.
    """
    if stride is None:
        stride = size * (1.0 - (overlap or 0.0))
    if stride <= 0:
        raise ValueError("stride must be positive")
    bounds = events.agg(F.struct(F.min("ts_s").alias("lo"), F.max("ts_s").alias("hi"))).scalar()
    since = F.col("ts_s") - bounds["lo"]
    last = F.floor(since / float(stride)).cast("long")
    first = F.greatest(F.floor((since - float(size)) / float(stride)).cast("long") + 1, F.lit(0).cast("long"))
    start = bounds["lo"] + F.col("window_id") * float(stride)
    out = (
        events.where(F.col("ts_s").isNotNull())
        .withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last))))
        .withColumns({"window_start": start, "window_end": start + float(size)})
    )
    return out.where(F.col("window_start") < bounds["hi"]) if compat else out


def window_table(windowed: DataFrame) -> DataFrame:
    """One row per window that has events: id, start and number of events."""
    return windowed.groupBy("window_id", "window_start").agg(F.count(F.lit(1)).alias("num_edges"))


def window_sizes(windowed: DataFrame) -> DataFrame:
    """Window count and min / max / integer mean of events per window."""
    sizes = windowed.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("windows"), F.min("n").alias("min_events"), F.max("n").alias("max_events"),
        F.floor(F.avg("n")).cast("long").alias("avg_events"),
    )


def totals(windowed: DataFrame, loop_free: DataFrame) -> DataFrame:
    """Sums over all windows: graphs, events, nodes and edges, in total and per type (``type`` NULL = total)."""
    nodes = (
        windowed.select("window_id", F.explode(F.array("src_key", "dst_key")).alias("entity_key")).distinct()
        .select(F.substring_index("entity_key", ":", 1).alias("type"))
    )
    graphs = windowed.select("window_id").distinct().agg(F.count(F.lit(1)).alias("n"))

    def per_type(df: DataFrame, kind: str) -> DataFrame:
        return df.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")

    return (
        graphs.select(F.lit("graphs").alias("kind"), F.lit(None).cast("string").alias("type"), "n")
        .unionByName(per_type(windowed.select(F.col("event_type").alias("type")), "events"))
        .unionByName(per_type(nodes, "nodes"))
        .unionByName(per_type(loop_free.select(F.col("event_type").alias("type")), "edges"))
    )


def filter_small_windows(windowed: DataFrame, min_events: int) -> DataFrame:
    big = windowed.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events)
    return windowed.join(cut(big.select("window_id")), "window_id", "left_semi")


def limit_windows(windowed: DataFrame, n: int) -> DataFrame:
    """Events of the first ``n`` windows."""
    first = cut(windowed.select("window_id").distinct().orderBy("window_id").limit(n))
    return windowed.join(first, "window_id", "left_semi")


def snapshots(events: DataFrame, n: int) -> DataFrame:
    """``n`` consecutive snapshots of equal size by time (earlier ones take the remainder)."""
    rows = events.agg(F.count(F.lit(1))).scalar()
    small, extra = F.floor(rows / n), rows % n
    cut_at = extra * (small + 1)
    tile = F.when(F.col("__r") < cut_at, F.floor(F.col("__r") / (small + 1))).otherwise(
        extra + F.floor((F.col("__r") - cut_at) / F.greatest(small, F.lit(1)))
    )
    return global_rank(events, ["ts_s", "event_id"], "__r").withColumn("snapshot", tile.cast("long")).drop("__r")


def temporal_batches(events: DataFrame, size: int) -> DataFrame:
    """Consecutive batches of ``size`` events in time order."""
    ranked = global_rank(events, ["ts_s", "event_id"], "__r")
    return ranked.withColumn("batch", F.floor(F.col("__r") / size).cast("long")).drop("__r")


def batch_graphs(nodes: DataFrame, edges: DataFrame, batch_size: int) -> tuple[DataFrame, DataFrame]:
    """Groups of ``batch_size`` windows with edges as one disjoint union; node ids shift by a running offset."""
    sizes = (
        nodes.groupBy("window_id").agg(F.count(F.lit(1)).alias("num_nodes"))
        .join(edges.select("window_id").distinct(), "window_id", "left_semi")
    )
    ranked = global_rank(sizes, ["window_id"], "__r").withColumn("batch", F.floor(F.col("__r") / batch_size).cast("long"))
    earlier = Window.partitionBy("batch").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(ranked.select(
        "window_id", "batch", F.coalesce(F.sum("num_nodes").over(earlier), F.lit(0)).alias("offset")
    ))
    shifted_nodes = nodes.join(offsets, "window_id").withColumn("node_id", F.col("node_id") + F.col("offset"))
    shifted_edges = (
        edges.join(offsets, "window_id")
        .withColumns({"src": F.col("src") + F.col("offset"), "dst": F.col("dst") + F.col("offset")})
    )
    return shifted_nodes, shifted_edges


def pool_snapshots(snapped: DataFrame, value: str, how: str = "mean") -> DataFrame:
    """One number per snapshot: mean, max or sum of ``value``."""
    fn = {"mean": F.avg, "max": F.max, "sum": F.sum}[how]
    return snapped.groupBy("snapshot").agg(fn(value).alias(value))


def load_order(events: DataFrame, columns: Sequence[str] = ("ts_s", "event_id")) -> DataFrame:
    """Events with their global position in time."""
    return global_rank(events, list(columns), "position")
