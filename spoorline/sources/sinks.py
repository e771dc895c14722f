"""Stored graphs, reports and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.session import shared_root


def save_graphs(nodes: DataFrame, edges: DataFrame, path: str, totals: DataFrame | None = None) -> None:
    """Node and edge tables by window, plus the totals as JSON.

    Ranges over (window, id) give every task few windows, and spread a large window over several tasks.
    """
    nodes.repartitionByRange("window_id", "node_id").write.mode("overwrite").partitionBy("window_id").parquet(f"{path}/nodes")
    edges.repartitionByRange("window_id", "edge_id").write.mode("overwrite").partitionBy("window_id").parquet(f"{path}/edges")
    if totals is not None:
        totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def save_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("model").parquet(path)


def save_top_anomalies(top: DataFrame, path: str) -> None:
    """Ranked anomalies (already limited to k) in rank order."""
    top.orderBy("rank").coalesce(1).write.mode("overwrite").json(path)


def save_temporal(profile: DataFrame, path: str, limit: int = 50) -> None:
    """The ``limit`` windows with the highest mean score."""
    best = profile.orderBy(F.desc("avg_score"), "bucket").limit(limit)
    best.coalesce(1).write.mode("overwrite").json(path)


def save_evaluation(results: DataFrame, path: str) -> None:
    """One table for all models: rows of one model replace only that model's."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").json(path)


def attack_summary(stats: DataFrame, paths: DataFrame, scores: DataFrame, top: int = 5) -> DataFrame:
    """One JSON document per model: graph statistics, best paths, score statistics; inputs keyed by ``model``."""
    best = (
        paths.where(F.col("rank") <= top).groupBy("model")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "path", "score"))).alias("top_paths"))
    )
    graph = stats.select("model", F.struct(*[c for c in stats.columns if c != "model"]).alias("graph"))
    score = scores.select("model", F.struct(*[c for c in scores.columns if c != "model"]).alias("anomalies"))
    return graph.join(score, "model", "full").join(best, "model", "left").select(
        "model", F.to_json(F.struct("model", "graph", "anomalies", "top_paths")).alias("value")
    )


def save_attack_summary(summary: DataFrame, path: str) -> None:
    summary.select("model", "value").write.mode("overwrite").partitionBy("model").text(path)


def _escaped(text):
    out = F.regexp_replace(text, "&", "&amp;")
    for raw, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.regexp_replace(out, raw, name)
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML document as ``(section, key, value)`` lines; sorted by section and key it is a whole file.

    Nodes are ``(entity_key, entity_type)``, edges ``(src_key, dst_key, event_type, ts_s, score)``.
    """
    spark = nodes.sparkSession
    head = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
        '<key id="node_type" for="node" attr.name="node_type" attr.type="string"/>',
        '<key id="event_type" for="edge" attr.name="event_type" attr.type="string"/>',
        '<key id="timestamp" for="edge" attr.name="timestamp" attr.type="double"/>',
        '<key id="anomaly_score" for="edge" attr.name="anomaly_score" attr.type="double"/>',
        '<graph edgedefault="directed">',
    ]
    fixed = [(0, f"{i:02d}", line) for i, line in enumerate(head)] + [(3, "0", "</graph>"), (3, "1", "</graphml>")]
    frame = spark.createDataFrame(fixed, "section int, key string, value string")
    node_lines = nodes.select(
        F.lit(1).alias("section"), F.col("entity_key").alias("key"),
        F.format_string('<node id="%s"><data key="node_type">%s</data></node>', _escaped("entity_key"), _escaped("entity_type")).alias("value"),
    )
    edge_lines = edges.select(
        F.lit(2).alias("section"), F.concat_ws("\u0001", "src_key", "dst_key").alias("key"),
        F.format_string(
            '<edge source="%s" target="%s"><data key="event_type">%s</data><data key="timestamp">%s</data>'
            '<data key="anomaly_score">%s</data></edge>',
            _escaped("src_key"), _escaped("dst_key"), _escaped("event_type"),
            F.col("ts_s").cast("decimal(20,6)").cast("string"), F.col("score").cast("string"),
        ).alias("value"),
    )
    return frame.unionByName(node_lines).unionByName(edge_lines)


def export_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Part files that concatenate, in name order, to one GraphML document."""
    graphml_lines(nodes, edges).orderBy("section", "key").select("value").write.mode("overwrite").text(path)


def _complete(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize(df: DataFrame, name: str, overwrite: bool = False) -> DataFrame:
    """A stage's table in the shared folder: written once, read back by later runs, redone with ``overwrite``."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/spoorline/stages/{name}"
    if overwrite or not _complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_metadata(spark: SparkSession, seconds: dict[str, float], config: dict[str, str] | None = None) -> DataFrame:
    """One row per finished stage: name, seconds and the run's configuration."""
    rows = [(i, stage, float(s)) for i, (stage, s) in enumerate(seconds.items())]
    table = spark.createDataFrame(rows, "position int, stage string, seconds double")
    settings = [F.lit(x) for kv in (config or {}).items() for x in kv]
    return table.withColumn("config", F.create_map(*settings) if settings else F.create_map().cast("map<string,string>"))


def save_run_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").json(path)
