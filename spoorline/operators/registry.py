"""Entity registry: one row per entity key, attributes merged with later records winning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_registry(entities: DataFrame) -> DataFrame:
    """Merge records ``(entity_key, entity_type, attributes, file, pos)`` per key and attribute.

    The latest value per attribute is kept by a combinable maximum, so a hub entity never gathers its
    occurrences in one place; the final map holds one entry per attribute name.
    """
    kinds = entities.groupBy("entity_key").agg(
        F.min_by("entity_type", F.struct("file", "pos")).alias("entity_type"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    latest = (
        entities.select("entity_key", "file", "pos", F.explode("attributes").alias("k", "v"))
        .groupBy("entity_key", "k").agg(F.max(F.struct("file", "pos", "v")).alias("last"))
    )
    maps = latest.groupBy("entity_key").agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.col("last.v").alias("v")))).alias("attributes")
    )
    return kinds.join(maps, "entity_key", "left").select(
        "entity_key", "entity_type", "occurrences",
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
    )
