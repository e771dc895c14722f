"""Preparation: duplicates, missing values, filters, samples, splits, labels, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions.draws import draw
from spoorline.operators import graph as G
from spoorline.operators.features import degrees
from spoorline.operators.graphalgo import connected_components
from spoorline.operators.ranking import global_rank, group_rank, running_sums
from spoorline.session import cut

def remove_duplicates(events: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts_s", "event_id")) -> DataFrame:
    """The first event in ``order`` of each key."""
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__f"))
    return first.select(*[c if c in keys else F.col(f"__f.{c}").alias(c) for c in events.columns])


def handle_missing(df: DataFrame, policy: str = "skip", columns: Sequence[str] | None = None, fill: dict | None = None) -> DataFrame:
    """``skip`` drops rows with a NULL, ``fill`` replaces NULLs by the given values, ``ignore`` keeps all."""
    if policy == "skip":
        return df.dropna(subset=list(columns) if columns else None)
    if policy == "fill":
        return df.fillna(fill or {})
    if policy == "ignore":
        return df
    raise ValueError(f"unknown policy {policy!r}")


def min_degree(edges: DataFrame, n: int) -> DataFrame:
    """Edges whose two ends both have at least ``n`` edges."""
    kept = degrees(edges).where(F.col("degree") >= n).select("node")
    return edges.join(kept.withColumnRenamed("node", "src_key"), "src_key", "left_semi").join(
        kept.withColumnRenamed("node", "dst_key"), "dst_key", "left_semi"
    )


def resolve_by_fields(entities: DataFrame, fields: Sequence[str], key: str = "entity_key") -> DataFrame:
    """Canonical key per entity: entities equal on any listed field are one.

    Each entity links to the smallest key with its value (a star, not all pairs); components do the rest.
    """
    links = None
    for field in fields:
        held = entities.select(F.col(key).alias("src_key"), F.col(field).alias("__v")).where(F.col("__v").isNotNull())
        first = held.groupBy("__v").agg(F.min("src_key").alias("dst_key"))
        star = held.join(first, "__v").select("src_key", "dst_key").where(F.col("src_key") != F.col("dst_key"))
        links = star if links is None else links.unionByName(star)
    return connected_components(links, entities.select(F.col(key).alias("entity_key"))).select(
        F.col("node").alias(key), F.col("component").alias("canonical")
    )


def filter_actions(events: DataFrame, include: Sequence[str] | DataFrame | None = None, exclude: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Allow and deny lists of event types, as Python lists or (long ones) as tables of ``event_type``."""
    if include is not None:
        events = events.join(include, "event_type", "left_semi") if isinstance(include, DataFrame) else events.where(F.col("event_type").isin(list(include)))
    if exclude is not None:
        events = events.join(exclude, "event_type", "left_anti") if isinstance(exclude, DataFrame) else events.where(~F.col("event_type").isin(list(exclude)))
    return events


def sample(events: DataFrame, n: int | None = None, share: float | None = None, method: str = "first", seed: int = 42) -> DataFrame:
    """The first ``n`` events by time, ``n`` random ones, or a random ``share``; random means by hash of the id."""
    if method == "first":
        return events.orderBy("ts_s", "event_id").limit(n)
    if share is not None:
        return events.where(draw(seed, "event_id") < share)
    return events.orderBy(draw(seed, "event_id"), "event_id").limit(n)


def random_split(graphs: DataFrame, ratio: float = 0.2, seed: int = 42, key: str = "graph_id") -> DataFrame:
    """``split`` = train / val over graphs: ``ratio`` to val, each side at least one; under 5 graphs all train."""
    n = graphs.agg(F.count(F.lit(1))).scalar()
    train = F.least(F.greatest(F.floor(n * (1.0 - ratio)), F.lit(1)), n - 1)
    ranked = global_rank(graphs.withColumn("__h", draw(seed, key)), ["__h", key], "__r")
    return ranked.withColumn(
        "split", F.when((n < 5) | (F.col("__r") < train), "train").otherwise("val")
    ).drop("__h", "__r")


def temporal_split(events: DataFrame, ratios: Sequence[float] | None = (0.7, 0.15, 0.15), days: Sequence[int] | None = None) -> DataFrame:
    """``split`` = train / val / test by time: shares of the events, or so many days each (NULL after them)."""
    names = ["train", "val", "test"]
    if days:
        first = events.agg(F.min("ts_s")).scalar()
        day, edge, split = F.floor((F.col("ts_s") - first) / 86400), 0, None
        for name, length in zip(names, days):
            edge += length
            split = F.when(day < edge, name) if split is None else split.when(day < edge, name)
        return events.withColumn("split", split)
    n = events.agg(F.count(F.lit(1))).scalar()
    ranked = global_rank(events, ["ts_s", "event_id"], "__r")
    a, b = F.floor(n * ratios[0]), F.floor(n * (ratios[0] + ratios[1]))
    return ranked.withColumn(
        "split", F.when(F.col("__r") < a, "train").when(F.col("__r") < b, "val").otherwise("test")
    ).drop("__r")


def stratified_split(events: DataFrame, ratios: Sequence[float] = (0.7, 0.15, 0.15), label: str = "label") -> DataFrame:
    """As ``temporal_split`` by shares, but inside every label, so that each part has every label's share."""
    sizes = cut(events.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    ranked = group_rank(events, [label], ["ts_s", "event_id"], "__r").join(sizes, label)
    a, b = F.floor(F.col("__n") * ratios[0]), F.floor(F.col("__n") * (ratios[0] + ratios[1]))
    return ranked.withColumn("split", F.when(F.col("__r") < a, "train").when(F.col("__r") < b, "val").otherwise("test")).drop("__r", "__n")


def balance(df: DataFrame, method: str = "under", seed: int = 42, label: str = "label", key: str = "event_id") -> DataFrame:
    """Equal class sizes: down to the smallest class, or up to the largest by repeating rows."""
    ranked = group_rank(df.withColumn("__h", draw(seed, key)), [label], ["__h", key], "__r")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if method == "under":
        return ranked.where(F.col("__r") < sizes.agg(F.min("__n")).scalar()).drop("__h", "__r")
    goal = sizes.agg(F.max("__n")).scalar()
    sized = ranked.join(sizes, label).withColumn("__goal", goal)
    copies = F.floor(F.col("__goal") / F.col("__n")) + F.when(F.col("__r") < F.col("__goal") % F.col("__n"), 1).otherwise(0)
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("__h", "__r", "__n", "__goal")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint intervals ``(start_s, end_s)`` with the same union; touching ones become one, reversed ones leave.

    Both ends are events of a sweep whose running sum of starts less ends is 0 between two merged intervals.
    """
    ends = F.array(
        F.struct(F.col("start_s").alias("at"), F.lit(0).alias("kind"), F.lit(1).alias("step")),
        F.struct(F.col("end_s").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("step")),
    )
    points = intervals.where(F.col("start_s") <= F.col("end_s")).select(F.inline(ends)).groupBy("at", "kind").agg(F.sum("step").alias("step"))
    swept = running_sums(points, ["at", "kind"], {"open": "step"})
    # a merged interval starts where the sum leaves 0 and ends where it returns
    edges = cut(swept.where(((F.col("kind") == 0) & (F.col("open") == F.col("step"))) | ((F.col("kind") == 1) & (F.col("open") == 0))))
    starts = global_rank(edges.where("kind = 0").select(F.col("at").alias("start_s")), ["start_s"], "n")
    stops = global_rank(edges.where("kind = 1").select(F.col("at").alias("end_s")), ["end_s"], "n")
    return starts.join(stops, "n").select("start_s", "end_s")


def label_attack_windows(events: DataFrame, intervals: DataFrame, slot_seconds: float = 3600.0) -> DataFrame:
    """``label`` 1 for events inside any closed interval ``(start_s, end_s)``, else 0.

    Overlapping intervals are merged first, then spread over fixed time slots, so the range test runs as an equi-join
    on the slot; the events themselves are neither copied nor sorted. A slot's list holds disjoint intervals only.
    """
    intervals = merge_intervals(intervals)
    first, last = F.floor(F.col("start_s") / slot_seconds), F.floor(F.col("end_s") / slot_seconds)
    slots = intervals.select("start_s", "end_s", F.explode(F.sequence(first, last)).alias("__slot"))
    # per slot, the parts of intervals inside it, merged into one short list
    inside = slots.groupBy("__slot").agg(F.array_sort(F.collect_set(F.struct("start_s", "end_s"))).alias("__i"))
    hit = F.exists("__i", lambda i: (F.col("ts_s") >= i["start_s"]) & (F.col("ts_s") <= i["end_s"]))
    return (
        events.withColumn("__slot", F.floor(F.col("ts_s") / slot_seconds)).join(inside, "__slot", "left")
        .withColumn("label", F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)).drop("__slot", "__i")
    )


def dataset_stats(events: DataFrame) -> DataFrame:
    """Events, nodes, edges per type and the time range as one long report."""
    edge_types = events.groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    keys = G.endpoints(events).select("entity_key").distinct()
    node_types = keys.groupBy(G.entity_type(F.col("entity_key")).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    span = G.time_range(events)
    ranges = span.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in span.columns])))
    parts = [("edge_type", edge_types), ("node_type", node_types), ("time", ranges)]
    out = None
    for section, df in parts:
        df = df.select(F.lit(section).alias("section"), "name", "value")
        out = df if out is None else out.unionByName(df)
    return out


def time_disorder(events: DataFrame) -> DataFrame:
    """Number of events whose time lies before that of an event with a smaller id.

    Ids are laid out in ranges; the running maximum of a range starts from the maxima of the ranges before it.
    """
    timed = events.where("ts_s is not null").select("event_id", "ts_s")
    laid = cut(timed.repartitionByRange("event_id").sortWithinPartitions("event_id").withColumn("__p", F.spark_partition_id()))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    tops = laid.groupBy("__p").agg(F.max("ts_s").alias("__top")).select("__p", F.max("__top").over(earlier).alias("__before"))
    inside = Window.partitionBy("__p").orderBy("event_id").rangeBetween(Window.unboundedPreceding, -1)
    seen = laid.join(F.broadcast(tops), "__p").withColumn("__m", F.greatest("__before", F.max("ts_s").over(inside)))
    return seen.agg(F.count_if(F.col("ts_s") < F.col("__m")).alias("violations"))


def validate(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Violations per rule: missing keys, types or times, negative times, dangling ends, repeated ids, time order.

    The order rule counts events that are earlier than one with a smaller id.
    """
    counted = events.agg(
        F.count_if(F.col("src_key").isNull() | F.col("dst_key").isNull()).alias("null_key"),
        F.count_if(F.col("event_type").isNull()).alias("null_type"),
        F.count_if(F.col("ts_s").isNull()).alias("null_time"), F.count_if(F.col("ts_s") < 0).alias("negative_time"),
        F.count_if(F.col("src_key") == F.col("dst_key")).alias("self_loop"),
    )
    rules = counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in counted.columns
    ])))
    known = nodes.select("entity_key")
    dangling = G.endpoints(events).where(F.col("entity_key").isNotNull()).join(known, "entity_key", "left_anti").agg(
        F.count_distinct("event_id").alias("violations")
    )
    repeated = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations"))
    return (
        rules.unionByName(dangling.select(F.lit("dangling_end").alias("rule"), "violations"))
        .unionByName(repeated.select(F.lit("repeated_id").alias("rule"), "violations"))
        .unionByName(time_disorder(events).select(F.lit("time_order").alias("rule"), "violations"))
    )


def negative_samples(edges: DataFrame, nodes: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
    """``n`` different random non-edges per edge: same source, a node that the source never touches, not itself.

    Where a source has fewer than ``n`` such nodes all of them are returned. A source's free nodes are numbered without
    being listed: an edge draws ``n`` of these numbers, one from each of ``n`` equal parts, and number k belongs to the
    node whose code is k plus the taken codes that have at most k free ones below them. These are counted for all draws
    at once by a running sum over draws and taken codes in one order, which spreads a source of any size.
    """
    codes = global_rank(nodes.select(F.col("entity_key").alias("dst_key")).distinct(), ["dst_key"], "code")
    total = codes.count()
    # what a source must not draw: its targets and itself
    taken = (
        edges.select("src_key", "dst_key").unionByName(edges.select("src_key", F.col("src_key").alias("dst_key"))).distinct()
        .join(codes, "dst_key").select("src_key", "code")
    )
    placed = group_rank(taken, ["src_key"], ["code"], "i").select("src_key", (F.col("code") - F.col("i")).alias("at"), "code")
    held = cut(placed.groupBy("src_key").agg((F.lit(total) - F.count(F.lit(1))).alias("free")))
    free = F.col("free")
    parts = F.least(F.lit(n).cast("long"), free)
    slots = edges.join(held.where("free > 0"), "src_key").select(
        "event_id", "src_key", "free", parts.alias("parts"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("slot"))
    low, high = F.expr("slot * free div parts"), F.expr("(slot + 1) * free div parts")
    drawn = slots.select("event_id", "src_key", "slot", (low + F.pmod(F.xxhash64("event_id", "slot", F.lit(seed)), high - low)).alias("at"))
    marks = placed.select("src_key", "at", F.lit(0).alias("kind"), "code", F.lit(1).cast("long").alias("one")).unionByName(
        drawn.select("src_key", "at", F.lit(1).alias("kind"), F.col("slot").alias("code"), F.lit(0).cast("long").alias("one"), "event_id"), allowMissingColumns=True)
    counted = running_sums(marks, ["src_key", "at", "kind", "code", "event_id"], {"below": "one"})
    before = cut(counted.groupBy("src_key").agg((F.max("below") - F.sum("one")).alias("before")))
    picked = counted.where("kind = 1").join(before, "src_key").select("event_id", "src_key", (F.col("at") + F.col("below") - F.col("before")).alias("code"))
    return picked.join(codes, "code").select("event_id", "src_key", "dst_key")


def label_subset(df: DataFrame, ratio: float, seed: int = 42, key: str = "event_id") -> DataFrame:
    """Labels kept for a share of the rows, NULL elsewhere."""
    return df.withColumn("label", F.when(draw(seed, key) < ratio, F.col("label")))


def detect_mode(df: DataFrame) -> DataFrame:
    """``supervised`` if any label differs from 0."""
    return df.agg(F.when(F.coalesce(F.bool_or(F.col("label") != 0), F.lit(False)), "supervised").otherwise("unsupervised").alias("mode"))
