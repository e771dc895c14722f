"""Exact vector neighbourhoods: k nearest neighbours and contrastive sums, in blocks of bounded size.

Work is cut into (block of base rows) × (chunk of query rows) tasks of about ``BLOCK`` rows each side; a task returns
one reduced row set per query, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.session import cut

BLOCK = 4096


def _tiles(base: DataFrame, queries: DataFrame, cell: str, base_id: str, query_id: str):
    """Both sides keyed by ``(cell, block, chunk)``: base rows repeat per chunk, query rows per block."""
    blocks = base.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    chunks = queries.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    sizes = blocks.join(chunks, cell)

    def spread(df, own, other, n_own, n_other, key):
        return (
            df.join(sizes, cell)
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
            .drop("blocks", "chunks")
        )

    left = spread(base, "block", "chunk", "blocks", "chunks", base_id)
    right = spread(queries, "chunk", "block", "chunks", "blocks", query_id)
    return left, right


def knn_anomaly(queries: DataFrame, base: DataFrame, k: int = 20, id_column: str = "vec_id", vec: str = "vec") -> DataFrame:
    """Mean cosine distance of each query vector to its ``k`` nearest base vectors; exact.

    Every tile of base rows meets every tile of queries in one matrix product, and a tile returns its k best per
    query. The work grows with the product of both sides: the queries are the stated set to be scored.
    """
    unit = lambda df: df.select(F.col(id_column).alias("id"), V.unit(F.col(vec)).alias("u"))
    base, queries = cut(unit(base)), cut(unit(queries))
    n = base.count()
    if n == 0:
        raise ValueError("no base vectors")
    k = min(k, n)
    blocks, chunks = math.ceil(n / BLOCK), max(1, math.ceil(queries.count() / BLOCK))
    tile = lambda count: F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = base.select("id", "u", tile(blocks).alias("block"), spread(chunks).alias("chunk"))
    right = queries.select("id", "u", tile(chunks).alias("chunk"), spread(blocks).alias("block"))

    def nearest(b, q):
        if not len(b) or not len(q):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        x, y = np.vstack(q["u"].to_numpy()), np.vstack(b["u"].to_numpy())
        d = 1.0 - x @ y.T
        top = min(k, d.shape[1])
        best = np.partition(d, top - 1, axis=1)[:, :top]
        return pd.DataFrame({"id": np.repeat(q["id"].to_numpy(), top), "distance": best.ravel()})

    keys = ["block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, "id long, distance double")
    order = Window.partitionBy("id").orderBy("distance")
    closest = found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    return closest.groupBy(F.col("id").alias(id_column)).agg(F.avg("distance").alias("score"))


def temporal_contrast(vectors: DataFrame, temperature: float = 0.07, key: str = "entity_key") -> DataFrame:
    """InfoNCE term per node and window: own similarity to the previous window against all of that window.

    ``loss`` is −(own − log Σ exp) over cosine similarities divided by the temperature. The sum runs over every
    node of the previous window, so this is a training loss for windows of moderate size; scoring a large graph
    uses ``temporal_similarity``, which joins each node with itself only.
    """
    unit = vectors.select(F.col(key).alias("id"), "window_id", V.unit(F.col("vec")).alias("u"))
    before = cut(unit.select(F.col("id").alias("id"), (F.col("window_id") + 1).alias("window_id"), F.col("u").alias("u")))
    own = cut(
        unit.join(before.select("id", "window_id", F.col("u").alias("b")), ["id", "window_id"])
        .withColumn("own", V.dot(F.col("u"), F.col("b")) / temperature).drop("b")
    )
    left, right = _tiles(before, own, "window_id", "id", "id")
    top = 1.0 / temperature  # no cosine exceeds 1

    def sums(b, q):
        if not len(b) or not len(q):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("id", "int64"), ("window_id", "int64"), ("own", "float64"), ("s", "float64"))})
        s = np.exp(np.vstack(q["u"].to_numpy()) @ np.vstack(b["u"].to_numpy()).T / temperature - top).sum(1)
        return pd.DataFrame({"id": q["id"].to_numpy(), "window_id": q["window_id"].to_numpy(), "own": q["own"].to_numpy(), "s": s})

    keys = ["window_id", "block", "chunk"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(sums, "id long, window_id long, own double, s double")
    return parts.groupBy(F.col("id").alias(key), "window_id").agg(
        F.max("own").alias("own"), (F.log(F.sum("s")) + top).alias("log_sum")
    ).withColumn("loss", F.col("log_sum") - F.col("own"))
