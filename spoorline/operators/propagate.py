"""Neighbourhood propagation with given weights: node vectors from joins and combinable sums over edges.

Nodes are ``(entity_key, vec)``, edges ``(src_key, dst_key, …)``; messages flow from source to target. Parallel
edges count as often as they occur but travel as one row with a multiplicity, and sums combine before the
shuffle, so a hub costs its distinct neighbours only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.functions.draws import draw
from spoorline.operators.ranking import first_per_group
from spoorline.session import cut

Matrix = Sequence[Sequence[float]]
Layers = Sequence[tuple[Matrix, Sequence[float]]]


def collapse(edges: DataFrame, *extra: str) -> DataFrame:
    return edges.groupBy("src_key", "dst_key", *extra).agg(F.count(F.lit(1)).alias("n"))


def _as_src(nodes: DataFrame, *columns: str) -> DataFrame:
    return nodes.select(F.col("entity_key").alias("src_key"), *columns)


def neighbour_sum(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Sum and number of incoming neighbour vectors per target."""
    messages = collapse(edges).join(_as_src(nodes, "vec"), "src_key")
    sums = V.reduce_columns("vec", dim, lambda x: F.sum(F.col("n") * x))
    return messages.groupBy(F.col("dst_key").alias("entity_key")).agg(sums.alias("agg"), F.sum("n").alias("n"))


def sage_mean(
    nodes: DataFrame, edges: DataFrame, w_root: Matrix, w_neigh: Matrix, bias: Sequence[float] | None = None,
    activation: str = "identity",
) -> DataFrame:
    """``W1·x + W2·mean(in-neighbours) + b``; a node without in-edges keeps its own transform."""
    dim = len(w_neigh[0])
    sums = neighbour_sum(nodes, edges, dim)
    mean = F.coalesce(V.scale(F.col("agg"), 1.0 / F.col("n")), V.zeros(dim))
    out = V.add(V.matvec(w_root, F.col("vec"), bias), V.matvec(w_neigh, mean))
    return nodes.join(sums, "entity_key", "left").withColumn("vec", V.activate_all(activation, out)).drop("agg", "n")


def gin_sum(nodes: DataFrame, edges: DataFrame, layers: Layers, eps: float = 0.0, activation: str = "relu") -> DataFrame:
    """MLP over ``(1 + eps)·x + Σ in-neighbours``."""
    dim = len(layers[0][0][0])
    sums = neighbour_sum(nodes, edges, dim)
    mixed = V.add(V.scale(F.col("vec"), 1.0 + eps), F.coalesce("agg", V.zeros(dim)))
    return nodes.join(sums, "entity_key", "left").withColumn("vec", mlp(mixed, layers, activation)).drop("agg", "n")


def _softmax_sum(scored: DataFrame, dim: int) -> DataFrame:
    """Softmax of ``e`` over each target's rows (weight ``n``), then the weighted sum of ``msg``."""
    top = scored.groupBy("dst_key").agg(F.max("e").alias("top"))
    weighed = scored.join(top, "dst_key").withColumn("w", F.col("n") * F.exp(F.col("e") - F.col("top")))
    sums = V.reduce_columns("msg", dim, lambda x: F.sum(F.col("w") * x))
    return weighed.groupBy("dst_key").agg(sums.alias("s"), F.sum("w").alias("z")).select(
        F.col("dst_key").alias("entity_key"), V.scale(F.col("s"), 1.0 / F.col("z")).alias("agg")
    )


def gat_attention(
    nodes: DataFrame, edges: DataFrame, heads: Sequence[dict], concat: bool = True, slope: float = 0.2,
    bias: Sequence[float] | None = None,
) -> DataFrame:
    """Graph attention; each head is ``{"w": matrix, "a_src": vector, "a_dst": vector}``.

    Own self-loops are replaced by exactly one per node, then per target softmax(LeakyReLU(score)).
    """
    pairs = collapse(edges.where(F.col("src_key") != F.col("dst_key")))
    loops = nodes.select(F.col("entity_key").alias("src_key"), F.col("entity_key").alias("dst_key"), F.lit(1).cast("long").alias("n"))
    pairs = pairs.unionByName(loops)
    # all heads travel in one row: their messages end to end, one source and one target term each
    messages = [V.matvec(head["w"], F.col("vec")) for head in heads]
    h = cut(nodes.select(
        "entity_key", F.concat(*messages).alias("msg"),
        F.array(*[V.dot(m, V.literal(head["a_src"])) for m, head in zip(messages, heads)]).alias("s"),
        F.array(*[V.dot(m, V.literal(head["a_dst"])) for m, head in zip(messages, heads)]).alias("t"),
    ))
    raw = F.zip_with("s", "t", lambda s, t: s + t)
    scored = cut(
        pairs.join(_as_src(h, "msg", "s"), "src_key").join(h.select(F.col("entity_key").alias("dst_key"), "t"), "dst_key")
        .select("dst_key", "n", "msg", F.transform(raw, lambda e: F.when(e >= 0, e).otherwise(e * slope)).alias("e"))
    )
    many = range(len(heads))
    top = scored.groupBy("dst_key").agg(F.array(*[F.max(F.col("e")[i]) for i in many]).alias("top"))
    weighed = scored.join(top, "dst_key").withColumn("w", F.zip_with("e", "top", lambda e, t: F.col("n") * F.exp(e - t)))
    sums, at = [], 0
    for i, head in enumerate(heads):
        own = [F.sum(F.col("w")[i] * F.col("msg")[at + j]) / F.sum(F.col("w")[i]) for j in range(len(head["w"]))]
        sums.append(F.array(*own).alias(f"h{i}"))
        at += len(head["w"])
    out = weighed.groupBy(F.col("dst_key").alias("entity_key")).agg(*sums)
    parts = [F.col(f"h{i}") for i in many]
    vec = F.concat(*parts) if concat else combine(parts, "mean")
    return out.select("entity_key", (V.add(vec, V.literal(bias)) if bias else vec).alias("vec"))


def transformer_attention(
    nodes: DataFrame, edges: DataFrame, w_query: Matrix, w_key: Matrix, w_value: Matrix, w_skip: Matrix,
    w_edge: Matrix | None = None, edge_vec: str = "edge_vec",
) -> DataFrame:
    """``W_skip·x + Σ α (value + edge)`` with α = softmax(query·(key + edge)/√d) over incoming edges."""
    dim = len(w_value)
    extra = [edge_vec] if w_edge else []
    h = nodes.select(
        "entity_key", V.matvec(w_query, F.col("vec")).alias("q"), V.matvec(w_key, F.col("vec")).alias("k"),
        V.matvec(w_value, F.col("vec")).alias("v"),
    )
    pairs = collapse(edges, *extra).join(_as_src(h, "k", "v"), "src_key").join(
        h.select(F.col("entity_key").alias("dst_key"), "q"), "dst_key"
    )
    key, value = F.col("k"), F.col("v")
    if w_edge:
        e = V.matvec(w_edge, F.col(edge_vec))
        key, value = V.add(key, e), V.add(value, e)
    scored = cut(pairs.select("dst_key", "n", (V.dot(F.col("q"), key) / float(dim) ** 0.5).alias("e"), value.alias("msg")))
    own = V.matvec(w_skip, F.col("vec"))
    return nodes.join(_softmax_sum(scored, dim), "entity_key", "left").select(
        "entity_key", F.coalesce(V.add(own, F.col("agg")), own).alias("vec")
    )


def time_encode(t: Column, w: Sequence[float], b: Sequence[float]) -> Column:
    return F.zip_with(V.literal(w), V.literal(b), lambda x, y: F.cos(x * t + y))


def linear(vec: Column, weights: Matrix, bias: Sequence[float] | None = None) -> Column:
    return V.matvec(weights, vec, bias)


def mlp(vec: Column, layers: Layers, activation: str = "relu", final: str = "identity") -> Column:
    """Dense layers with the activation between them and ``final`` after the last."""
    for i, (weights, bias) in enumerate(layers):
        vec = V.activate_all(activation if i < len(layers) - 1 else final, linear(vec, weights, bias))
    return vec


def project(vec: Column, dim: int, weights: Matrix | None) -> Column:
    """The vector itself when it already has ``dim`` entries, else its linear projection."""
    return vec if weights is None or len(weights[0]) == dim == len(weights) else linear(vec, weights)


def pool(nodes: DataFrame, dim: int, how: str = "mean", by: Sequence[str] = ("window_id",)) -> DataFrame:
    """One vector per graph: sum, mean or max over its nodes."""
    fn = {"sum": F.sum, "mean": F.avg, "max": F.max}[how]
    return nodes.groupBy(*by).agg(V.reduce_columns("vec", dim, fn).alias("vec"))


def combine(vecs: Sequence[Column], how: str = "concat") -> Column:
    """Several vectors of a row as one: concat, sum, mean or max."""
    if how == "concat":
        return F.concat(*vecs)
    out = vecs[0]
    for v in vecs[1:]:
        out = F.zip_with(out, v, lambda a, b: F.greatest(a, b)) if how == "max" else V.add(out, v)
    return V.scale(out, 1.0 / len(vecs)) if how == "mean" else out


def feature_norm(df: DataFrame, vec: str, dim: int, kind: str = "batch", eps: float = 1e-5) -> DataFrame:
    """``batch``: per entry over all rows; ``layer`` / ``instance``: per row over its entries."""
    if kind in ("layer", "instance"):
        return df.withColumn(vec, V.standardise(F.col(vec), eps))
    if kind != "batch":
        return df
    stats = df.agg(F.struct(
        V.reduce_columns(vec, dim, F.avg).alias("m"), V.reduce_columns(vec, dim, F.var_pop).alias("v")
    )).scalar()
    centred = F.zip_with(F.col(vec), F.col("__s.m"), lambda x, m: x - m)
    return df.withColumn("__s", stats).withColumn(
        vec, F.zip_with(centred, F.col("__s.v"), lambda x, v: x / F.sqrt(v + F.lit(eps)))
    ).drop("__s")


def residual(x: Column, h: Column, layer: int = 1) -> Column:
    """``h + x`` where the shapes match, from the second layer on."""
    if layer == 0:
        return h
    return F.when(F.size(x) == F.size(h), V.add(x, h)).otherwise(h)


def sample_neighbors(edges: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """At most ``k`` incoming edges per target, chosen by hash (a sampling operator)."""
    return first_per_group(edges, ["dst_key"], [draw(seed, "event_id"), F.col("event_id")], k)


def layer_outputs(nodes: DataFrame, layers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Vectors after every layer, ``layer`` = 1, 2, …; each layer is frozen as the next one reads it again."""
    outputs = []
    for i, layer in enumerate(layers):
        nodes = cut(layer(nodes))
        outputs.append(nodes.select(F.lit(i + 1).alias("layer"), "entity_key", "vec"))
    out = outputs[0]
    for more in outputs[1:]:
        out = out.unionByName(more)
    return out
