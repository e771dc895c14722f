"""Small helpers shared by the operators: tables by name, internal columns, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``row``, a struct of the kept columns, and the text beside it unless it is one of them."""
    beside = [] if "text" in keep else [F.coalesce("text", F.lit("")).alias("__text")]
    return docs.select(F.struct(*keep).alias("row"), *beside)


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
