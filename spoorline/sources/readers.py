"""Record files and stored tables as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import pyspark
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.operators.features import random_features
from spoorline.operators.records import parse
from spoorline.sources import arrays

_ROW = (1 << 33) - 1

# Path parts that tell the kind of data set.
DARPA_MARKS = ["darpa", "ta1-", "cadets", "theia", "trace", "clearscope"]
SOC_MARKS = ["soc", "elastic", "endpoint"]

PATTERNS = {
    "json": "{*.json,*.json.*}",
    "ndjson": "{*.json,*.json.*}",
    "bin": "{*.bin,*.bin.*}",
    "avro": "{*.bin,*.bin.*}",
    "all": "{*.json,*.json.*,*.bin,*.bin.*,*.ndjson,*.avro}",
}


def clean_lines(lines: DataFrame) -> DataFrame:
    """Record text per line: blanks and array punctuation dropped, trailing comma stripped, bad JSON skipped."""
    body = F.trim(F.col("value"))
    kept = lines.withColumn("value", body).where(~F.col("value").isin("", "[", "]", ","))
    return parse(kept.select("file", "pos", F.regexp_replace("value", r",$", "").alias("raw")))


def read_ndjson(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Line-delimited JSON, split freely over tasks.

    ``pos`` is block start + row in the task: a task reads at most one block length of bytes and a line takes
    at least one, so positions are unique and ascending within a file.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))).alias("pos"),
        "value",
    )
    return clean_lines(lines)


def read_json_array(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Files that each hold one JSON array or one object; large ones are read by many tasks (``arrays.elements``)."""
    return arrays.elements(spark, paths)


def avro_on_class_path() -> bool:
    """Whether Spark's own jar folder holds the external Avro module."""
    return any((Path(pyspark.__file__).parent / "jars").glob("spark-avro*"))


def read_avro(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Avro containers as records; needs the external ``spark-avro`` module."""
    try:
        rows = spark.read.format("avro").load(paths)
    except AnalysisException as e:
        raise RuntimeError("reading Avro needs the spark-avro package on the session's class path") from e
    datum = F.struct(F.struct("*").alias("datum")) if "datum" not in rows.columns else F.struct("*")
    return parse(rows.select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))).alias("pos"),
        F.to_json(datum).alias("raw"),
    ))


def route_by_extension(path: Column) -> Column:
    """``avro`` for binary containers by name, else ``json``."""
    name = F.lower(F.substring_index(path, "/", -1))
    return F.when(name.rlike(r"\.(bin|avro|dat)$") | name.contains(".bin"), "avro").otherwise("json")


def detect_dataset_type(path: Column) -> Column:
    lower = F.lower(path)
    return F.when(lower.rlike("|".join(DARPA_MARKS)), "darpa").when(lower.rlike("|".join(SOC_MARKS)), "custom_soc").otherwise("custom")


def discover_files(spark: SparkSession, folder: str, fmt: str = "json", sub_level: bool = False) -> DataFrame:
    """Matching files ``(path, length)`` sorted by path; ``sub_level`` also looks one folder deeper."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", PATTERNS[fmt])
        .option("recursiveFileLookup", "true").load(folder).select("path", "length")
    )
    below = F.expr("substring(path, length(root) + 2)")
    depth = F.size(F.split(below, "/")) - 1
    return (
        listing.withColumn("root", F.lit(qualified(spark, folder))).where(depth <= (1 if sub_level else 0)).drop("root").orderBy("path")
    )


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file listings name it, with scheme and without a closing slash."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held)


def make_folder(spark: SparkSession, path: str) -> None:
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(held)


def limit_files(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` files by path."""
    return files.orderBy("path").limit(n)


def json_kinds(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """``lines``, ``whole`` or ``none`` per file.

    A file is read by lines if the first line that may be a record is one. Otherwise it may be one document; else it is
    read by lines if any line is a record, as logs that were cut while being written begin in the middle of one.
    """
    return _kinds(spark, paths)[0]


def _kinds(spark: SparkSession, paths: Sequence[str]) -> tuple[dict[str, str], DataFrame | None]:
    """``json_kinds``, and the records of the ``whole`` files, which are known by having been read."""
    whole = None
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))).alias("pos"),
    )
    marked = lines.where(~F.col("value").isin("", "[", "]", ",")).groupBy("file").agg(F.min_by("value", "pos").alias("raw"))
    first = parse(marked.withColumn("raw", F.regexp_replace("raw", r",$", ""))).select("file", F.lit(True).alias("leads"))
    # one row per file, as the paths were given
    kinds = {r["file"]: "lines" if r["leads"] else "none" for r in lines.select("file").distinct().join(first, "file", "left").collect()}
    rest = [f for f, kind in kinds.items() if kind == "none"]
    if rest:
        whole = read_json_array(spark, rest)
        kinds.update({r["file"]: "whole" for r in whole.select("file").distinct().collect()})
    rest = [f for f, kind in kinds.items() if kind == "none"]
    if rest:
        kinds.update({r["file"]: "lines" for r in read_ndjson(spark, rest).select("file").distinct().collect()})
    return kinds, whole


def read_many(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame | None, dict[str, int]]:
    """Records of all readable paths, and how many paths were read, missing or failed.

    Containers are read as Avro where the module is at hand; they are tried as JSON if that fails, and JSON files are
    read by lines or as one document by their content, all files of a kind at once. A path without any record failed.
    """
    counts, out, texts = {"read": 0, "missing": 0, "failed": 0}, None, []
    for path in paths:
        if not exists(spark, path):
            counts["missing"] += 1
            continue
        name = path.rstrip("/").rsplit("/", 1)[-1].lower()
        binary = name.endswith((".bin", ".avro", ".dat")) or ".bin" in name
        if binary and avro_on_class_path():
            try:
                records = read_avro(spark, path)
                if not records.isEmpty():
                    counts["read"] += 1
                    out = records if out is None else out.unionByName(records)
                    continue
            except (AnalysisException, PySparkException):
                pass
        texts.append(path)
    kinds, whole = _kinds(spark, texts) if texts else ({}, None)
    for path in texts:
        root = qualified(spark, path)
        held = {kind for file, kind in kinds.items() if file == root or file.startswith(root + "/")}
        counts["read" if held - {"none"} else "failed"] += 1
    files = [file for file, kind in kinds.items() if kind == "lines"]
    found = [read_ndjson(spark, files)] if files else []
    if "whole" in kinds.values():
        found.append(whole)
    for records in found:
        out = records if out is None else out.unionByName(records)
    return out, counts


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Parquet or CSV table, or ``jdbc`` with its options."""
    if fmt == "csv":
        return spark.read.options(header="true", **options).csv(path)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(**options).load()
    return spark.read.options(**options).format(fmt).load(path)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored node and edge tables; an empty graph is an error."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if edges.isEmpty():
        raise ValueError(f"no edges in {path}")
    return nodes, edges


def load_scores(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Scores of all models, or of one (a partition directory)."""
    scores = spark.read.parquet(path)
    return scores if model is None else scores.where(F.col("model") == model)


def load_labels(spark: SparkSession, path: str | None, graphs: DataFrame) -> DataFrame:
    """Label per ``graph_id`` from a JSON list or object of graph id → label; 0 where none is given."""
    ids = graphs.select("graph_id")
    if path is None:
        return ids.withColumn("label", F.lit(0))
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return ids.withColumn("label", F.lit(0))
    body = F.trim(F.col("value"))
    listed = text.where(body.startswith("[")).select(F.posexplode(F.from_json(body, "array<int>")).alias("graph_id", "label"))
    named = text.where(~body.startswith("[")).select(F.explode(F.from_json(body, "map<string,int>")).alias("graph_id", "label"))
    labels = listed.select(F.col("graph_id").cast("long").alias("graph_id"), "label").unionByName(
        named.select(F.col("graph_id").try_cast("long").alias("graph_id"), "label")
    )
    return ids.join(labels, "graph_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def load_embeddings(spark: SparkSession, path: str | None, nodes: DataFrame, dim: int, seed: int = 42) -> DataFrame:
    """External vectors per entity; a seeded random vector where there is none."""
    drawn = random_features(nodes, "entity_key", dim, seed, "__random")
    if path is None:
        return drawn.withColumnRenamed("__random", "vec")
    held = spark.read.parquet(path).select("entity_key", "vec")
    return drawn.join(held, "entity_key", "left").withColumn("vec", F.coalesce("vec", "__random")).drop("__random")
