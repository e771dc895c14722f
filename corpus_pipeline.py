"""A corpus pipeline of five stages over ``documents``, each calling one operator of the llm folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import decontaminate, langid, packing, secret_scan
from spoorline.llm.prefix_join import jaccard_groups
from spoorline.llm.queries import tokenizer_path
from spoorline.llm.tables import crc_part, table
from spoorline.session import configure, cut, frozen, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# a text is rejected if no learned language holds this share of its n-grams
LEAST_SHARE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those unlike every learned language; a null lang is filled in."""
    configure(spark)
    with stage(spark):
        model = langid.learn(docs.where(crc_part(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model, COLUMNS).where((F.col("lang_pred") != "und") & (F.col("share") >= LEAST_SHARE))
    return found.select("row.*", "lang_pred").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of every group linked by a 5-word Jaccard similarity of 0.8 or more.

    Rows of one id and text count as one; a group without any id keeps the row of the smallest text hash.
    """
    configure(spark)
    with stage(spark) as scope:
        # only members of groups leave; they are named by id and text
        grouped = jaccard_groups(docs, 5, 80, 100).where("group is not null")
        members = cut(grouped.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies")))
        best = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
        stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_key") == F.col("text_key"))
        marked = members.join(best, "group").select("doc_id", "text_key", "copies", stays.alias("stays"))
        marked = scope.keep(marked.where("not stays or copies > 1"))
    gone, again = marked.where("not stays"), marked.where("stays and copies > 1")
    rows = docs.select(*COLUMNS).withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda other: rows["doc_id"].eqNullSafe(other["doc_id"]) & (rows["__key"] == other["text_key"])
    once = rows.join(gone, same(gone), "left_anti")
    single = once.join(again, once["doc_id"].eqNullSafe(again["doc_id"]) & (once["__key"] == again["text_key"]), "left_anti")
    repeated = rows.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "__key"])
    return single.unionByName(repeated).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    configure(spark)
    return decontaminate.drop_holders(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; documents stay."""
    configure(spark)
    with stage(spark):
        model = secret_scan.learn(docs)
    found = secret_scan.scan(docs, model, COLUMNS)
    spans = secret_scan.merged(F.col("base"), F.col("added"))
    clean = F.when(F.size("spans") > 0, secret_scan.redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("spans", spans).withColumn("text", clean).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids as little-endian 32-bit integers and the crc32 of these."""
    configure(spark)
    return packing.pack(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("without_secrets", without_secrets),
    ("packed", packed),
]

# token ids and learned models have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder for the next and goes at the end."""
    configure(spark)
    *steps, last = [fn for _, fn in STAGES]
    with stage(spark):
        kept = reduce(lambda docs, fn: cut(fn(spark, docs, sf_dir)), steps, table(spark, sf_dir, "documents"))
        return frozen(last(spark, kept, sf_dir))
