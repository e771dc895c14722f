"""Reports over scored events: ensembles, time profiles, model ranking, entity and pattern views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.graph import entity_type
from spoorline.operators.metrics import separation_ratio, top_k
from spoorline.operators.ranking import exact_percentiles, percentile_of
from spoorline.session import cut


def ensemble(scores: DataFrame, require_all: bool = False) -> DataFrame:
    """Min-max per model (range + 1e-10), then the mean over models per event."""
    # one row per model, stored so that it is broadcast by its size
    span = cut(scores.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    scaled = scores.join(span, "model").withColumn(
        "scaled", (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-10)
    )
    out = scaled.groupBy("event_id").agg(F.avg("scaled").alias("score"), F.count(F.lit(1)).alias("models"))
    if require_all:
        out = out.where(F.col("models") == span.agg(F.count(F.lit(1))).scalar())
    return out


def temporal_profile(events: DataFrame, hours: float = 1.0, p: float = 0.99) -> DataFrame:
    """Epoch-aligned buckets by mean score: count, mean, max, deviation and number above the global percentile."""
    width = int(hours * 3600)
    limit = percentile_of(events, "score", p)
    return (
        events.where(F.col("ts_s") > 0)
        .groupBy((F.floor(F.col("ts_s") / width) * width).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"),
            F.stddev_pop("score").alias("std_score"), F.count_if(F.col("score") > limit).alias("above"),
        )
        .orderBy(F.desc("avg_score"), "bucket")
    )


def anomaly_details(scores: DataFrame, events: DataFrame, entities: DataFrame, k: int = 100) -> DataFrame:
    """The k best scores with their event, both entities and their attributes; a score without event shows an error."""
    best = top_k(scores, k).withColumnRenamed("score", "anomaly_score")
    event = events.select("event_id", "event_type", "src_key", "dst_key", "ts_s")
    # k rows by construction, so they may be sent to every task; events and entities are scanned, never moved
    best = cut(best)
    hits = cut(event.join(F.broadcast(best.select("event_id")), "event_id"))
    found = best.join(hits, "event_id", "left")
    wanted = hits.select(F.explode(F.array("src_key", "dst_key")).alias("entity_key")).distinct()
    known = entities.select("entity_key", "attributes").join(F.broadcast(wanted), "entity_key")
    src = known.withColumnsRenamed({"entity_key": "src_key", "attributes": "src_attributes"})
    dst = known.withColumnsRenamed({"entity_key": "dst_key", "attributes": "dst_attributes"})
    return (
        found.join(src, "src_key", "left").join(dst, "dst_key", "left")
        .withColumns({
            "src_type": entity_type(F.col("src_key")), "dst_type": entity_type(F.col("dst_key")),
            "error": F.when(F.col("event_type").isNull(), "event not found"),
        })
        .orderBy("rank")
    )


def rank_models(scores: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """Models by separation ratio with critical (>= p99.9) and high (>= p99) counts; expected but absent ones fail."""
    cuts = cut(
        exact_percentiles(scores, "score", [0.99, 0.999], ["model"]).groupBy("model")
        .agg(F.max(F.when(F.col("p") < 0.995, F.col("value"))).alias("p99"), F.max(F.when(F.col("p") > 0.995, F.col("value"))).alias("p999"))
    )
    counts = scores.join(cuts, "model").groupBy("model").agg(
        F.count_if(F.col("score") >= F.col("p999")).alias("critical"), F.count_if(F.col("score") >= F.col("p99")).alias("high")
    )
    done = separation_ratio(scores, ["model"]).join(counts, "model").withColumn("status", F.lit("ok"))
    if expected:
        names = scores.sparkSession.createDataFrame([(m,) for m in expected], "model string")
        done = names.join(done, "model", "full").withColumn("status", F.coalesce("status", F.lit("failed")))
    # one row per model
    order = Window.orderBy(F.desc_nulls_last("separation"), F.asc("model"))
    return done.withColumn("rank", F.row_number().over(order))


def flagged(scores: DataFrame, p: float = 0.95) -> DataFrame:
    """Rows at or above their own model's percentile."""
    cuts = cut(exact_percentiles(scores, "score", [p], ["model"]).select("model", F.col("value").alias("cut")))
    return scores.join(cuts, "model").where(F.col("score") >= F.col("cut")).drop("cut")


def consensus(scores: DataFrame, min_models: int = 2, p: float = 0.95) -> DataFrame:
    """Events flagged by at least ``min_models`` models."""
    votes = flagged(scores, p).groupBy("event_id").agg(
        F.count_distinct("model").alias("votes"), F.sort_array(F.collect_set("model")).alias("models")
    )
    return votes.where(F.col("votes") >= min_models)


def anomalous_events(events: DataFrame, p: float = 0.95) -> DataFrame:
    return events.withColumn("anomalous", F.col("score") >= percentile_of(events, "score", p))


def suspicious_entities(events: DataFrame, p: float = 0.95) -> DataFrame:
    """Entities by number of anomalous events touching them."""
    hits = anomalous_events(events, p).where("anomalous")
    ends = F.array_distinct(F.array("src_key", "dst_key"))
    return (
        hits.select(F.explode(ends).alias("entity_key"), "score").groupBy("entity_key")
        .agg(F.count(F.lit(1)).alias("anomalies"), F.max("score").alias("max_score"))
        .withColumn("entity_type", entity_type(F.col("entity_key")))
        .orderBy(F.desc("anomalies"), F.desc("max_score"), "entity_key")
    )


def pattern_profile(events: DataFrame, p: float = 0.95) -> DataFrame:
    """Anomalous and all counts by event type, by target type, by both, and overall, with the lift."""
    marked = anomalous_events(events, p).withColumn("target_type", entity_type(F.col("dst_key")))
    counts = marked.cube("event_type", "target_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("anomalous").alias("anomalies"),
        F.grouping_id().cast("int").alias("level"),
    )
    base = marked.agg(F.count_if("anomalous") / F.count(F.lit(1))).scalar()
    return counts.withColumn("lift", F.when(base > 0, F.col("anomalies") / F.col("n") / base).otherwise(0.0))


def hourly_daily(events: DataFrame, p: float = 0.95) -> DataFrame:
    """Anomalies per day and hour with day totals and the overall total (NULL marks a total)."""
    hits = anomalous_events(events, p).where("anomalous")
    day = F.floor(F.col("ts_s") / 86400).cast("long")
    hour = F.floor(F.pmod(F.col("ts_s"), F.lit(86400.0)) / 3600).cast("int")
    return hits.select(day.alias("day"), hour.alias("hour")).rollup("day", "hour").agg(F.count(F.lit(1)).alias("n"))


def history_means(history: DataFrame) -> DataFrame:
    """Mean of each metric per epoch from rows ``(epoch, metric, value)``."""
    return history.groupBy("epoch", "metric").agg(F.avg("value").alias("value"))


def best_epoch(history: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Epoch with the best mean per metric; of equals the first."""
    sign = 1 if higher_is_better else -1
    best = F.max(F.struct((F.col("value") * sign).alias("v"), (-F.col("epoch")).alias("e"))).alias("b")
    return history_means(history).groupBy("metric").agg(best).select(
        "metric", (-F.col("b.e")).alias("epoch"), (F.col("b.v") * sign).alias("value")
    )
