"""The given tables seen as provenance events, scores and node vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.functions.times import ntz_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prov_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "file:")
        .when(F.col("event_type") == "purchase", "network:")
        .otherwise("process:")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        (ntz_micros("ts") / 1e6).alias("ts_s"),
        F.concat(F.lit("process:"), "user_id").alias("src_key"),
        F.concat(kind, k).alias("dst_key"),
        "event_type",
        F.col("value").alias("score"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 60), 1).otherwise(0).alias("label"),
        k.cast("int").alias("k"),
        "user_id",
    )


def prov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors' scores in long form: ``(model, event_id, score, label)``."""
    models = F.array(
        F.struct(F.lit("m1").alias("model"), F.col("score").alias("score")),
        F.struct(F.lit("m2").alias("model"), F.abs(F.col("k") - 50).cast("double").alias("score")),
        F.struct(F.lit("m3").alias("model"), (F.col("score") * (1 + F.col("user_id") % 3)).alias("score")),
    )
    return (
        prov_events(spark, sf_dir)
        .select("event_id", "label", "ts_s", "score", "k", "user_id", F.explode(models).alias("m"))
        .select("m.model", "event_id", "m.score", "label", "ts_s")
    )


SCORES_SQL = """sc as (
  select 'm1' as model, event_id, score, label, ts_s from pe union all
  select 'm2', event_id, cast(abs(k-50) as double), label, ts_s from pe union all
  select 'm3', event_id, score*(1+user_id%3), label, ts_s from pe)"""


def prov_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors ``(entity_key, vec_id, vec ARRAY<DOUBLE>, label)`` of all entries, as processes."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("process:"), "vec_id").alias("entity_key"), "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity_key, vec)`` for processes, files (entries reversed) and networks, so that every event has both ends."""
    vec = F.col("embedding").cast("array<double>")
    forms = F.array(*[
        F.struct(F.concat(F.lit(kind), F.col("vec_id")).alias("entity_key"), form.alias("vec"))
        for kind, form in (("process:", vec), ("file:", F.reverse(vec)), ("network:", vec))
    ])
    return table(spark, sf_dir, "embeddings").select(F.inline(forms))


VECTORS_SQL = """vv as materialized (select 'process:'||vec_id as entity_key, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings),
  nn as materialized (select kind||vec_id as entity_key, case kind when 'file:' then list_reverse(vec) else vec end as vec from vv, (values ('process:'),('file:'),('network:')) k(kind))"""
