"""Edge and node anomaly scores from vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.operators.propagate import Layers, mlp


def with_endpoints(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Edges with ``h_src.*`` / ``h_dst.*`` of both endpoints; edges with an unknown endpoint are dropped."""
    columns = columns or ("vec",)
    src = nodes.select(F.col("entity_key").alias("src_key"), F.struct(*columns).alias("h_src"))
    dst = nodes.select(F.col("entity_key").alias("dst_key"), F.struct(*columns).alias("h_dst"))
    return edges.join(src, "src_key").join(dst, "dst_key")


def class_scores(logits: Column, kind: str = "classification", classes: int = 2) -> Column:
    """classification: P(class 1) of two, else the softmax vector; binary: sigmoid; regression: as is."""
    if kind == "classification":
        return V.softmax(logits)[1] if classes == 2 else V.softmax(logits)
    return V.sigmoid(logits[0]) if kind == "binary" else logits


def edge_score_mlp(
    edges: DataFrame, nodes: DataFrame, layers: Layers, kind: str = "classification", edge_vec: str | None = None
) -> DataFrame:
    """MLP over source ‖ target (‖ edge) vectors."""
    parts = [F.col("h_src.vec"), F.col("h_dst.vec")] + ([F.col(edge_vec)] if edge_vec else [])
    logits = mlp(F.concat(*parts), layers)
    return with_endpoints(edges, nodes).withColumn("score", class_scores(logits, kind, len(layers[-1][0]))).drop("h_src", "h_dst")


def node_class_probs(nodes: DataFrame, layers: Layers) -> DataFrame:
    return nodes.withColumn("probs", V.softmax(mlp(F.col("vec"), layers)))


def temporal_similarity(vectors: DataFrame, similarity: str = "cosine", temperature: float = 0.07) -> DataFrame:
    """Similarity of a node's vector with its own vector one window earlier, over the temperature."""
    before = vectors.select("entity_key", (F.col("window_id") + 1).alias("window_id"), F.col("vec").alias("before"))
    fn = V.cosine if similarity == "cosine" else V.dot
    return vectors.join(before, ["entity_key", "window_id"]).withColumn(
        "similarity", fn(F.col("vec"), F.col("before")) / temperature
    ).drop("before")


def reconstruction_error(df: DataFrame, vec: str, rebuilt: str) -> DataFrame:
    """L2 norm of the difference per row."""
    return df.withColumn("score", V.distance(F.col(vec), F.col(rebuilt)))


def reconstruction_loss(df: DataFrame, vec: str, rebuilt: str) -> DataFrame:
    """Mean squared, absolute and cosine loss over a table."""
    a, b = F.col(vec), F.col(rebuilt)
    squares = V.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    absolute = V.total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return df.agg(
        (F.sum(squares) / F.sum(F.size(a))).alias("mse"), (F.sum(absolute) / F.sum(F.size(a))).alias("mae"),
        F.avg(1.0 - V.cosine(a, b)).alias("cosine"),
    )


def pca_reconstruct(df: DataFrame, vec: str, k: int, out: str = "rebuilt") -> DataFrame:
    """Projection of each vector on the first ``k`` principal directions and back."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    held = df.withColumn("__v", array_to_vector(vec))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(held)
    directions = model.pc.toArray().tolist()
    return model.transform(held).withColumn(out, V.matvec(directions, vector_to_array("__p"))).drop("__v", "__p")


def centroid_distance(df: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """L2 distance to the mean vector of the rows labelled 0 (the origin if there are none)."""
    mean = V.reduce_columns(vec, dim, lambda x: F.coalesce(F.avg(x), F.lit(0.0)))
    centre = df.where("label = 0").agg(mean.alias("c")).scalar()
    return df.withColumn("__c", centre).withColumn("score", V.distance(F.col(vec), F.col("__c"))).drop("__c")


def inner_product_score(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return with_endpoints(edges, nodes).withColumn(
        "score", V.sigmoid(V.dot(F.col("h_src.vec"), F.col("h_dst.vec")))
    ).drop("h_src", "h_dst")


def cosine_edge_anomaly(edges: DataFrame, nodes: DataFrame, cut: float = 0.5) -> DataFrame:
    """``1 - cos`` of the endpoints; norms are taken once per node."""
    normed = nodes.withColumn("norm", V.norm(F.col("vec")))
    joined = with_endpoints(edges, normed, "vec", "norm")
    cos = V.dot(F.col("h_src.vec"), F.col("h_dst.vec")) / F.greatest(F.col("h_src.norm") * F.col("h_dst.norm"), F.lit(1e-8))
    return joined.withColumn("score", 1.0 - cos).withColumn(
        "prediction", F.when(F.col("score") > cut, 1).otherwise(0)
    ).drop("h_src", "h_dst")


def endpoint_mean_score(edges: DataFrame, node_scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean of the endpoints' node scores."""
    joined = with_endpoints(edges, node_scores, "node_score")
    return joined.withColumn("score", (F.col("h_src.node_score") + F.col("h_dst.node_score")) / 2.0).withColumn(
        "prediction", F.when(F.col("score") > cut, 1).otherwise(0)
    ).drop("h_src", "h_dst")


def predict_vector(vec: Column, cut: float = 0.5) -> Column:
    """One entry: above the cut; several: position of the largest; none or NULL: 0."""
    many = V.argmax(vec)
    one = F.when(vec[0] > cut, 1).otherwise(0)
    return F.when(F.size(vec) > 1, many).when(F.size(vec) == 1, one).otherwise(0)


def losses(df: DataFrame, target: str = "label", score: str = "score", logits: str | None = None) -> DataFrame:
    """Mean squared, absolute and log loss and accuracy of scores in [0, 1]; with logits also the cross-entropy."""
    y, p = F.col(target).cast("double"), F.least(F.greatest(F.col(score), F.lit(1e-12)), F.lit(1 - 1e-12))
    hit = F.when(F.col(score) > 0.5, 1.0).otherwise(0.0)
    out = [
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("mse"), F.avg(F.abs(F.col(score) - y)).alias("l1"),
        F.avg(-(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("bce"),
        F.avg(F.when(hit == y, 1.0).otherwise(0.0)).alias("accuracy"),
    ]
    if logits:
        picked = F.element_at(V.softmax(F.col(logits)), F.col(target).cast("int") + 1)
        out.append(F.avg(-F.log(picked)).alias("cross_entropy"))
    return df.agg(*out)


def select_primary(outputs: DataFrame, decoders: Sequence[str], primary: str = "primary") -> DataFrame:
    """Rows of the ``primary`` decoder, or of the first listed one where there is no such decoder."""
    return outputs.where(F.col("decoder") == (primary if primary in decoders else decoders[0]))


def semi_supervised_loss(df: DataFrame, reconstruction: str = "score", class_loss: str = "class_loss") -> DataFrame:
    """Reconstruction loss over all rows plus class loss over the labelled ones (0 if none is)."""
    labelled = F.avg(F.when(F.col("label").isNotNull(), F.col(class_loss)))
    return df.agg((F.avg(reconstruction) + F.coalesce(labelled, F.lit(0.0))).alias("loss"))


def score_with_model(edges: DataFrame, fn: Callable, columns: Sequence[str], schema: str, window: Sequence[str] = ()) -> DataFrame:
    """Scores by a user's model, of ``schema``.

    Without ``window`` the model sees rows one by one: ``fn(pandas batch) -> pandas batch``. With the columns that name
    a window or graph it is called once for each, ``fn(key, iterator of Arrow batches) -> iterator of Arrow batches``:
    all batches of a window come one after the other, so it may look at the whole graph, count before it scores, or
    stream a window larger than memory. Windows are one task's work, as their model wants them; null keys are a window.
    """
    if not window:
        def run(batches):
            for batch in batches:
                yield fn(batch)

        return edges.select(*columns).mapInPandas(run, schema)

    def whole(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(tuple(k.as_py() for k in key), batches)

    # Spark reads the kind of function from the types themselves, not from their names
    whole.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return edges.select(*{c: None for c in (*window, *columns)}).groupBy(*window).applyInArrow(whole, schema)
