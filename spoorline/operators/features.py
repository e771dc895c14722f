"""Node and edge features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.functions.draws import draw
from spoorline.functions.vocab import EDGE_CODES, NODE_CODES, lookup
from spoorline.operators.ranking import global_rank
from spoorline.session import cut

NODE_DIM = 128
EDGE_DIM = 64


def dense_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Distinct values in sorted order with codes 0..n-1."""
    return global_rank(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], code)


def onehot(df: DataFrame, column: str, vocabulary: Sequence[str] | None = None, out: str = "onehot") -> DataFrame:
    """One-hot vector over the sorted vocabulary (a type column's distinct values unless given).

    A type vocabulary is small by nature; it is read as one sorted array by a scalar sub-query. Unknown and
    NULL give the zero vector.
    """
    if vocabulary is None:
        vocab = df.select(column).distinct().agg(F.sort_array(F.collect_set(column))).scalar()
    else:
        vocab = F.array(*[F.lit(v) for v in sorted(vocabulary)])
    return df.withColumn("__vocab", vocab).withColumn(
        out, F.transform("__vocab", lambda v: F.when(v.eqNullSafe(F.col(column)), 1.0).otherwise(0.0))
    ).drop("__vocab")


def random_features(df: DataFrame, key: str, dim: int, seed: int = 42, out: str = "vec") -> DataFrame:
    """Standard normal vector per key, a function of key and seed only (not of the partitioning)."""
    def gauss(i: Column) -> Column:
        return F.sqrt(-2.0 * F.log(1.0 - draw(seed, key, i, F.lit(0)))) * F.cos(6.283185307179586 * draw(seed, key, i, F.lit(1)))

    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), gauss))


def node_type_code(kind: Column) -> Column:
    return lookup(NODE_CODES, kind, 0.0)


def edge_type_code(kind: Column) -> Column:
    return lookup(EDGE_CODES, kind, 0.0)


def _padded(head: list[Column], dim: int) -> Column:
    head = head[:dim]
    return F.concat(F.array(*head), V.zeros(dim - len(head)))


def node_features(nodes: DataFrame, numeric: Sequence[Column | str] = (), dim: int = NODE_DIM, out: str = "x") -> DataFrame:
    """Type code in slot 0, the named numeric attributes in the following slots, zeros beyond."""
    return nodes.withColumn(out, _padded([node_type_code(F.col("entity_type")), *numeric_attributes(numeric)], dim))


def numeric_attributes(columns: Sequence[Column | str]) -> list[Column]:
    """The columns as doubles; what is no number becomes 0."""
    as_columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    return [F.coalesce(c.try_cast("double"), F.lit(0.0)) for c in as_columns]


def time_of_day(ts: Column) -> Column:
    """Share of the day in [0, 1); 0 where there is no positive timestamp."""
    return F.when(ts > 0, F.pmod(ts, F.lit(86400.0)) / 86400.0).otherwise(F.lit(0.0))


def edge_features(edges: DataFrame, dim: int = EDGE_DIM, out: str = "edge_attr") -> DataFrame:
    """Event code in slot 0, time of day in slot 1, zeros beyond."""
    return edges.withColumn(out, _padded([edge_type_code(F.col("event_type")), time_of_day(F.col("ts_s"))], dim))


def edge_feature_lookup(edges: DataFrame, type_vectors: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """The type's vector per edge (zeros when unknown); edges with an unknown endpoint are dropped."""
    known = nodes.select("entity_key")
    return (
        edges.join(known.withColumnRenamed("entity_key", "src_key"), "src_key", "left_semi")
        .join(known.withColumnRenamed("entity_key", "dst_key"), "dst_key", "left_semi")
        .join(type_vectors, "event_type", "left")
        .withColumn("vec", F.coalesce("vec", V.zeros(dim)))
    )


def edge_index(edges: DataFrame, codes: DataFrame) -> DataFrame:
    """Edges as code pairs with their label."""
    src = codes.withColumnsRenamed({"entity_key": "src_key", "code": "src"})
    dst = codes.withColumnsRenamed({"entity_key": "dst_key", "code": "dst"})
    return edges.join(src, "src_key").join(dst, "dst_key").select("event_id", "src", "dst", "label")


def degrees(edges: DataFrame, src: str = "src_key", dst: str = "dst_key") -> DataFrame:
    """In, out and total degree per node in one scan and one combinable aggregation."""
    ends = F.array(
        F.struct(F.col(src).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col(dst).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return (
        edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.node").alias("node"))
        .agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
        .withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    )


# edges that a task holds of those that can close a triangle, and of those that can be its other sides
CLOSING_EDGES, OPEN_EDGES, LEAST_EDGES = 2_000_000, 1_000_000, 100_000
WEDGES = 1 << 21  # looked up at a time


def _triangles(parts: int, nodes: int):
    """Per node its triangles ``a < b < c`` where b lies in this part: looks up c among the later neighbours of b."""

    def run(key, lists: pa.Table, closing: pa.Table) -> pa.Table:
        if not len(lists) or not len(closing):
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        heads = np.unique(closing.column("b").to_numpy())
        column = closing.column("cs").combine_chunks()
        held = np.repeat(np.searchsorted(heads, closing.column("b").to_numpy()), np.diff(column.offsets.to_numpy()))
        pairs = np.sort(held * nodes + column.flatten().to_numpy())
        column = lists.column("bs").combine_chunks()
        ends, flat = np.cumsum(np.diff(column.offsets.to_numpy()).astype(np.int64)), column.flatten().to_numpy()
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at = np.searchsorted(heads, flat)
        known = (flat % parts == key[0].as_py()) & (heads[np.minimum(at, len(heads) - 1)] == flat)
        rows = np.flatnonzero(known & (np.arange(len(flat)) + 1 < ends[owner]))
        total = np.cumsum(ends[owner[rows]] - rows - 1)
        found, first = [], 0
        while first < len(rows):
            done = total[first - 1] if first else 0
            last = max(int(np.searchsorted(total, done + WEDGES, side="right")), first + 1)
            some = rows[first:last]
            size = ends[owner[some]] - some - 1
            row = np.repeat(some, size)
            c = flat[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + row + 1]
            wanted = at[row] * nodes + c
            hit = pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted
            found.append(np.unique(np.r_[lists.column("a").to_numpy()[owner[row[hit]]], flat[row[hit]], c[hit]], return_counts=True))
            first = last
        node, place = np.unique(np.concatenate([x for x, _ in found] or [flat[:0]]), return_inverse=True)
        n = np.bincount(place, np.concatenate([x for _, x in found] or [flat[:0]]), len(node)).astype(np.int64)
        return pa.table({"node": node, "n": n})

    return run


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient on the undirected simple graph of ``(src_key, dst_key)``.

    Nodes are numbered by degree and edges point from lower to higher number, which leaves a node at most sqrt(2m) of them.
    A triangle's last edge begins at a node that others point to; only such edges are copied, to the tasks that hold the
    nodes' lists, and a list goes to the parts of these edges that begin at one of its nodes. Wedges are looked up where
    they arise and never travel: with few closing edges, as between hubs, the shuffle is in proportion to the edges.
    """
    simple = cut(
        edges.where(F.col("src_key") != F.col("dst_key"))
        .select(F.least("src_key", "dst_key").alias("u"), F.greatest("src_key", "dst_key").alias("v")).distinct()
    )
    degree = simple.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    codes = cut(global_rank(degree, ["d", "node"], "code"))
    cu, cv = (codes.select(F.col("node").alias(c), F.col("code").alias(f"c{c}")) for c in "uv")
    oriented = simple.join(cu, "u").join(cv, "v").select(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b"))
    lists = cut(oriented.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("bs")))
    heads = lists.select(F.explode("bs").alias("a")).distinct()
    closing = cut(lists.join(heads, "a", "left_semi").select(F.col("a").alias("b"), F.col("bs").alias("cs")))
    size = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0]
    m, k = size(lists, "bs"), size(closing, "cs")
    # closing edges are cut into parts; copies for smaller tasks are made while they are no more rows than the edges
    parts = -(-k // CLOSING_EDGES) or 1
    copies = max(-(-m // OPEN_EDGES), min(-(-m // LEAST_EDGES), m // max(k, 1)), 1)
    part = F.explode(F.array_distinct(F.transform("bs", lambda b: b % parts))).alias("part")
    sides = lists.where(F.size("bs") > 1).select(part, F.pmod(F.xxhash64("a"), F.lit(copies)).alias("copy"), "a", "bs")
    ends = closing.select((F.col("b") % parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "b", "cs")
    met = sides.groupBy("part", "copy").cogroup(ends.groupBy("part", "copy")).applyInArrow(_triangles(parts, codes.count()), "node long, n long")
    triangles = met.groupBy(F.col("node").alias("code")).agg(F.sum("n").alias("triangles"))
    possible = F.col("d") * (F.col("d") - 1)
    return codes.join(triangles, "code", "left").fillna(0, ["triangles"]).select(
        "node", F.col("d").alias("degree"), "triangles",
        F.when(F.col("d") > 1, 2.0 * F.col("triangles") / possible).otherwise(0.0).alias("clustering"),
    )


def edge_frequency(edges: DataFrame, keys: Sequence[str] = ("src_key", "dst_key")) -> DataFrame:
    """Count, first, last and duration per pair (or pair and type)."""
    return edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts")
    ).withColumn("duration", F.col("last_ts") - F.col("first_ts"))


def calendar_features(edges: DataFrame) -> DataFrame:
    """Hour of day and day of week (1 = Sunday) in UTC, from the epoch seconds."""
    day = F.floor(F.col("ts_s") / 86400)
    return edges.withColumns({
        "hour": F.floor(F.pmod(F.col("ts_s"), F.lit(86400.0)) / 3600).cast("int"),
        # the epoch began on a Thursday
        "day_of_week": (F.pmod(day + 4, F.lit(7)) + 1).cast("int"),
    })


def time_delta(edges: DataFrame, keys: Sequence[str] = ("src_key",), cap: float = 86400.0, slice_seconds: float = 3600.0) -> DataFrame:
    """Seconds since the previous event of the same key, at most ``cap``; NULL for the first one.

    A key's history is cut into time slices, so one busy key is many small windows; the event before a slice is
    the latest one of the key's previous slice, found on the small per-slice table.
    """
    keys = list(keys)
    sliced = edges.withColumn("__slice", F.floor(F.col("ts_s") / slice_seconds))
    ends = sliced.groupBy(*keys, "__slice").agg(F.max("ts_s").alias("__end"))
    previous = ends.withColumn(
        "__before", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__slice"))
    ).drop("__end")
    inside = Window.partitionBy(*keys, "__slice").orderBy("ts_s", "event_id")
    gap = F.col("ts_s") - F.coalesce("__lag", "__before")
    return (
        sliced.withColumn("__lag", F.lag("ts_s").over(inside))
        .join(previous, [*keys, "__slice"])
        .withColumn("time_delta", F.when(gap > cap, F.lit(float(cap))).otherwise(gap))
        .drop("__slice", "__lag", "__before")
    )


def normalize(df: DataFrame, columns: Sequence[str], method: str = "zscore") -> DataFrame:
    """Columns by z-score, min-max or log1p; the statistics are one scalar sub-query over all columns."""
    if method == "log":
        return df.withColumns({c: F.log1p(c) for c in columns})
    stats = df.agg(F.struct(*[
        fn(c).alias(f"{tag}_{c}") for c in columns
        for tag, fn in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    ])).scalar()
    out = {}
    for c in columns:
        if method == "zscore":
            spread = stats[f"std_{c}"]
            out[c] = F.when(spread > 0, (F.col(c) - stats[f"mean_{c}"]) / spread).otherwise(0.0)
        elif method == "minmax":
            spread = stats[f"max_{c}"] - stats[f"min_{c}"]
            out[c] = F.when(spread > 0, (F.col(c) - stats[f"min_{c}"]) / spread).otherwise(0.0)
        else:
            raise ValueError(f"unknown method {method!r}")
    return df.withColumns(out)


def text_tokens(df: DataFrame, column: str, out: str = "tokens") -> DataFrame:
    """Lower-case tokens of a name, path or command line."""
    parts = F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}_]+")
    return df.withColumn(out, F.filter(parts, lambda t: t != ""))


def text_features(df: DataFrame, column: str, key: str, dim: int = 256) -> DataFrame:
    """TF-IDF of hashed tokens of the whole text, sparse: ``(key, i, x)`` for the entries that are not 0.

    ``x`` is the count of the tokens in bucket i times ln((texts + 1) / (texts with the bucket + 1)).
    """
    tokens = text_tokens(df.select(key, column), column, "__tokens")
    counts = tokens.select(key, F.explode("__tokens").alias("__token")).groupBy(key, "__token").agg(F.count(F.lit(1)).alias("__n"))
    bucket = F.floor(draw(0, "__token") * dim).alias("i")
    found = cut(counts.groupBy(key, bucket).agg(F.sum("__n").alias("__n")))
    # one row per bucket, stored so that it is broadcast by its size
    seen = cut(found.groupBy("i").agg(F.count(F.lit(1)).alias("__d")))
    idf = F.log((df.agg(F.count(F.lit(1))).scalar() + 1) / (F.col("__d") + 1))
    return found.join(seen, "i").select(key, "i", (F.col("__n") * idf).alias("x"))


# a table that is sent to all tasks holds this many numbers at most
SENT_NUMBERS = 1 << 21


def _contexts(df: DataFrame, column: str, window: int) -> DataFrame:
    """``(word, o1, o2, ...)``: every place of a word with the words within ``window`` places of it, null beyond the text."""
    moved = [F.col("__t")]
    for o in range(1, window + 1):
        moved += [F.concat(F.array_repeat(F.lit(None).cast("string"), o), "__t"), F.slice("__t", o + 1, F.greatest(F.size("__t") - o, F.lit(0)))]
    names = ["word", *[f"o{i}" for i in range(1, len(moved))]]
    zipped = F.arrays_zip(*[m.alias(n) for m, n in zip(moved, names)])
    tokens = text_tokens(df.select(column), column, "__t").where(F.size("__t") > 1)
    return tokens.select(F.inline(zipped).alias(*names)).where("word is not null")


def _sign_bits(word: str, dim: int, seed: int) -> list[Column]:
    """A word's random index vector: hexadecimal digits of md5s, 15 to a long; an entry's sign is the first bit of its digit."""
    digits = F.concat(*[F.md5(F.concat_ws("|", F.col(word), F.lit(str(seed)), F.lit(str(i)))) for i in range((dim + 31) // 32)])
    return [F.conv(F.substring(digits, i + 1, 15), 16, 10).cast("long").alias(f"b{i // 15}") for i in range(0, dim, 15)]


def _sign(i: int) -> Column:
    """Entry ``i`` of the index vector, -1 or 1."""
    return F.shiftright(f"b{i // 15}", 4 * (14 - i % 15) + 3).bitwiseAND(F.lit(1)) * 2.0 - 1.0


def _commonest(weights: DataFrame, n: int) -> Column:
    """Marks at most ``n`` of the commonest words: those above a step of their count, eight steps to a doubling."""
    step = F.floor(F.log2("all") * 8)
    least, held = None, 0
    for r in sorted(weights.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > n:
            break
        least = r["step"]
    return F.lit(False) if least is None else step >= least


def _word_vectors(df: DataFrame, column: str, dim: int, window: int, seed: int, sent: int) -> DataFrame:
    """``(word, sent, vec)``, see ``word_vectors``; ``sent`` marks the commonest words, of which all tasks can hold vectors."""
    contexts = _contexts(df, column, window)
    beside = [c for c in contexts.columns if c != "word"]
    met = sum((F.when(F.col(c).isNull(), 0).otherwise(1) for c in beside), F.lit(0))
    counted = contexts.select(F.col("word").alias("other"), met.alias("n")).groupBy("other").agg(F.sum("n").alias("all"))
    weights = cut(counted.select("other", "all", (1.0 / F.sqrt(F.col("all").cast("double"))).alias("weight"), *_sign_bits("other", dim, seed)))
    weights = weights.withColumn("sent", _commonest(weights, max(sent // dim, 0)))
    common, rest = weights.where("sent").drop("sent", "all"), weights.where("not sent").drop("sent", "all")
    contexts = contexts.withColumnRenamed("word", "other")
    pulls = ["word", "weight", *[c for c in weights.columns if c.startswith("b")]]
    each = F.explode(F.array(*beside)).alias("word")
    # a common word's pull is known to every task, so its meetings add up before the shuffle; only the meetings with others travel
    near = contexts.join(F.broadcast(common), "other").select(each, *pulls[1:])
    far = contexts.join(F.broadcast(common.select("other")), "other", "left_anti").select("other", each).where("word is not null").join(rest, "other").select(*pulls)
    sums = near.where("word is not null").unionByName(far).groupBy("word").agg(*[F.sum(F.col("weight") * _sign(i)).alias(f"x{i}") for i in range(dim)])
    vec = F.array(*[F.col(f"x{i}") for i in range(dim)])
    raw = sums.select("word", vec.alias("vec")).withColumn("len", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)))
    unit = F.transform("vec", lambda x: F.when(F.col("len") > 1e-12, x / F.col("len")).otherwise(F.lit(0.0)))
    marked = F.broadcast(common.select(F.col("other").alias("word"), F.lit(True).alias("sent")))
    return raw.join(marked, "word", "left").select("word", F.coalesce("sent", F.lit(False)).alias("sent"), unit.alias("vec"))


def word_vectors(df: DataFrame, column: str, dim: int = 16, window: int = 2, seed: int = 42, sent: int = SENT_NUMBERS) -> DataFrame:
    """``(word, vec)``: unit vectors by random indexing over all texts.

    A word's vector adds up the index vectors of the words within ``window`` places of it, each weighed by how often
    they meet over the root of how often the other word meets any. This is a random projection of the whole table of
    co-occurrences, so words of like contexts lie close, and neither the table nor the vocabulary is held anywhere.
    The weights of the commonest words, ``sent`` numbers in all, go to every task; all other words meet theirs in joins.
    """
    return _word_vectors(df, column, dim, window, seed, sent).select("word", "vec")


def text_embeddings(df: DataFrame, column: str, key: str, dim: int = 16, window: int = 2, seed: int = 42, out: str = "vec", sent: int = SENT_NUMBERS) -> DataFrame:
    """``(key, out)``: mean of the word vectors over all words of the text, repeated ones as often as they occur.

    Null and empty texts and texts of a lone unknown word get the zero vector. Texts of one key count as one text. The
    commonest words' vectors are sent to every task, where a text's words add up; only the other words travel.
    """
    vectors = cut(_word_vectors(df, column, dim, window, seed, sent))
    common, rest = vectors.where("sent").select("word", "vec"), vectors.where("not sent").select("word", "vec")
    words = text_tokens(df.select(key, column), column, "__t").select(key, F.explode("__t").alias("word"))
    near = words.join(F.broadcast(common), "word").select(key, "vec")
    far = words.join(F.broadcast(common.select("word")), "word", "left_anti").join(rest, "word").select(key, "vec")
    sums = near.unionByName(far).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("vec")[i]).alias(f"x{i}") for i in range(dim)])
    mean = F.array(*[F.col(f"x{i}") / F.col("n") for i in range(dim)])
    zero = F.array(*[F.lit(0.0)] * dim)
    return df.select(key).distinct().join(sums.select(key, mean.alias(out)), key, "left").withColumn(out, F.coalesce(out, zero))


def mask_features(df: DataFrame, key: str, vec: str, rate: float, seed: int = 42) -> DataFrame:
    """Zero the vector of a share of the rows, chosen by key; ``masked`` tells which."""
    return df.withColumn("masked", draw(seed, key) < rate).withColumn(
        vec, F.when(F.col("masked"), F.transform(vec, lambda x: F.lit(0.0))).otherwise(F.col(vec))
    )


def featurize(df: DataFrame, fn=None) -> DataFrame:
    """Hook between extraction and scoring: the features unchanged unless ``fn`` is given."""
    return df if fn is None else df.transform(fn)
