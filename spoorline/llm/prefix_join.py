"""N-gram Jaccard join by filtering under several global token orders; for similarities at which the segments of ``ngram_join`` hold too few tokens.

If two sets reach the similarity t, their first |x| - ceil(t|x|) + 1 tokens in *any* common order of all tokens share
one token. Each order here puts the tokens whose salted hash falls in one share of the hash range first, the rarest
ahead, and all others after them by hash. One scan under the first order drops every document whose whole prefix
occurs nowhere else (all others are marked in a bitmap of bounded size). Under each order the rest is chained by shared prefix tokens, and the filters are intersected:
documents stay candidates of each other only if they are chained under *every* order. Linked documents are never
separated, and no pair is listed. Each surviving class is verified exactly, in pairs of bounded blocks; a
block pair returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.llm.textops import Words, flat, list_values, long_lists, mix64, pieces, shingles
from spoorline.operators.graphalgo import connected_components
from spoorline.session import cut, stage

SALTS = (0x51ED270B7F4A7C15, 0x2545F4914F6CDD1D, 0x6A09E667F3BCC909)
BLOCK_TOKENS, BLOCK_SETS = 1 << 16, 512
MAX_ACTIVE_BITS = 27  # 16 MB; above it more texts pass to the exact filters, none fewer
# names of token nodes lie above all set ids
TOKEN_NODE = 1 << 62


def prefix_length(n: int, num: int, den: int) -> int:
    """n - ceil(num * n / den) + 1."""
    return n + (-num * n) // den + 1


def _prefix(n: Column, num: int, den: int) -> Column:
    return n + 1 - F.floor((n * num + den - 1) / den).cast("long")


def _posted(tokens: np.ndarray, salt: int, bound: int, need: int) -> np.ndarray:
    """Hash-ordered 63-bit names of the tokens below ``bound``, and as many more as the prefix needs."""
    names = np.sort(mix64(tokens ^ np.uint64(salt)) >> np.uint64(1))
    return names[: max(need, int(np.searchsorted(names, np.uint64(bound))))]


def _bound(num: int, den: int) -> int:
    """Share of the hash range ranked by frequency: one and three quarter prefixes."""
    return int(min(1.0, 1.75 * (den - num) / den) * 2**63)


def _token_sets(column, k: int) -> Iterator[np.ndarray]:
    data, offsets = flat(column)
    for i, j in pieces(offsets):
        yield from shingles(Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), k)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    hi = mix64(s ^ np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64)
    lo = mix64(s ^ np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64)
    return int(hi.view(np.int64)), int(lo.view(np.int64))


def _first_order(k: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            n, hi, lo, posts = [], [], [], []
            for s in _token_sets(batch.column("__text"), k):
                a, b = _prints(s)
                n.append(len(s)), hi.append(a), lo.append(b)
                posts.append(_posted(s, SALTS[0], _bound(num, den), prefix_length(len(s), num, den)) if len(s) else s)
            own = [batch.column(c) for c in ("__id", "__key")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), long_lists(posts)], ["__id", "__key", "n", "hi", "lo", "post"])

    return run


def active_bits(keys: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of text keys, of a bounded size; a text that shares its bit with another passes too."""
    n = keys.count()
    bits = min(MAX_ACTIVE_BITS, max(10, (16 * n).bit_length()))
    at = F.col("__key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(__key & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def in_bits(key: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit keys may be among those of the bitmap."""
    at = key.view(np.uint64) & np.uint64(64 * len(active) - 1)
    return (active[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _active_sets(k: int, active):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bits(batch.column("__key").to_numpy(), active.value)))
            n, hi, lo, tokens = [], [], [], []
            for s in _token_sets(batch.column("__text"), k):
                a, b = _prints(s)
                n.append(len(s)), hi.append(a), lo.append(b), tokens.append(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), long_lists(tokens)], ["n", "hi", "lo", "tokens"])

    return run


def _all_orders(num: int, den: int):
    """Per set and order the posted tokens."""

    def run(batches):
        for batch in batches:
            values, offsets = list_values(batch.column("tokens"))
            sets = [values[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]
            for i, salt in enumerate(SALTS):
                posts = [_posted(s, salt, _bound(num, den), prefix_length(len(s), num, den)) for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.array(np.full(len(sets), i, np.int32)), long_lists(posts)], ["sid", "n", "o", "post"])

    return run


def _classes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``(sid, cls)``: sets are of one class if shared prefix tokens chain them under every order; lone sets are left out.

    The graphs of all orders are closed in one go, as disjoint parts of one graph.
    """
    orders = len(SALTS)
    posted = sets.select("sid", "n", "tokens").mapInArrow(_all_orders(num, den), "sid long, n long, o int, post array<long>")
    each = posted.select("sid", "n", "o", F.size("post").alias("m"), F.explode("post").alias("tok"))
    shared = each.groupBy("o", "tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # tokens of one poster come first in the order and connect nothing; they only use up places of the prefix
    per = Window.partitionBy("sid", "o")
    first = F.struct(F.when(F.col("tok") < F.lit(_bound(num, den)), F.col("c")).otherwise(F.lit(1 << 62)), "tok")
    kept = (
        each.join(shared, ["o", "tok"])
        .withColumn("r", F.row_number().over(per.orderBy(first)))
        .withColumn("lone", F.col("m") - F.count(F.lit(1)).over(per))
        .where(F.col("r") <= _prefix(F.col("n"), num, den) - F.col("lone"))
    )
    node = F.xxhash64("o", "tok").bitwiseAND(F.lit(TOKEN_NODE - 1)).bitwiseOR(F.lit(TOKEN_NODE))
    edges = cut(kept.select((F.col("sid") * orders + F.col("o")).alias("src_key"), node.alias("dst_key")))
    chained = connected_components(edges)
    both = chained.where(F.col("node") < F.lit(TOKEN_NODE)).select(F.expr(f"node div {orders}").alias("sid"), (F.col("node") % orders).alias("o"), "component")
    parts = [F.max(F.when(F.col("o") == i, F.col("component"))).alias(f"c{i}") for i in range(orders)]
    met = both.groupBy("sid").agg(*parts).where(" and ".join(f"c{i} is not null" for i in range(orders)))
    classes = cut(met.select("sid", F.xxhash64(*[f"c{i}" for i in range(orders)]).alias("cls")))
    many = classes.groupBy("cls").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return classes.join(many, "cls", "left_semi")


def _overlaps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs of sets, from 0/1 matrices of bounded width."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.argsort(tokens, kind="stable")
    sorted_tokens = tokens[order]
    fresh = np.r_[True, sorted_tokens[1:] != sorted_tokens[:-1]]
    token = np.cumsum(fresh) - 1
    often = np.bincount(token) > 1
    keep = often[token]
    column, row = (np.cumsum(often) - 1)[token[keep]], owner[order][keep]
    total, out = int(often.sum()), np.zeros((n, n), np.float32)
    for low in range(0, total, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        block = np.zeros((n, min(4096, total - low)), np.float32)
        block[row[a:b], column[a:b] - low] = 1
        out += block @ block.T
    return out


def _forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric 0/1 matrix."""
    u, v, seen = [], [], np.zeros(len(linked), bool)
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            x = todo.pop()
            fresh = np.flatnonzero(linked[x] & ~seen)
            seen[fresh] = True
            u += [x] * len(fresh)
            v += fresh.tolist()
            todo += fresh.tolist()
    return u, v


def _verify(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        sid, block = group.column("sid").to_numpy(), group.column("block").to_numpy()
        tokens, offsets = list_values(group.column("tokens"))
        size = np.diff(offsets).astype(np.float64)
        common = _overlaps(tokens, offsets).astype(np.float64)
        linked = den * common >= num * (size[:, None] + size[None, :] - common)
        if group.column("bi")[0].as_py() != group.column("bj")[0].as_py():
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, False)
        u, v = _forest(linked)
        return pa.table({"src_key": sid[u], "dst_key": sid[v]}) if u else pa.table({"src_key": pa.array([], pa.int64()), "dst_key": pa.array([], pa.int64())})

    return run


def _links(sets: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links inside the classes, a spanning forest per block pair."""
    members = sets.join(classes, "sid").select("sid", "cls", "n", "tokens")
    volume = cut(members.groupBy("cls").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("nb")))
    blocks = (
        members.join(volume, "cls")
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("cls", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "sid", "tokens")
    )
    return blocks.groupBy("cls", "bi", "bj").applyInArrow(_verify(num, den), "src_key long, dst_key long")


def jaccard_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of documents linked by ``den * |x & y| >= num * |x | y|`` over distinct k-word shingles.

    Returns ``(id_column, n_shingles, component_id, group, text_key)``, one row per row of ``docs`` (repeated rows
    stay), with the smallest id reachable by links, the row's own included. ``group`` names the linked rows also where ids are null;
    it is null for rows without candidates. ``text_key`` is a hash of the text. A text of fewer than k words is one
    shingle; a null or blank text has none and links with nothing. Rows without an id take part but name no group unless all its ids are null.
    Ids are integers; other columns of ``docs`` are ignored, whatever their names. An empty table gives no rows.
    """
    with stage(docs.sparkSession) as scope:
        return scope.keep(_groups(docs, k, num, den, id_column, text_column))


def _groups(docs: DataFrame, k: int, num: int, den: int, id_column: str, text_column: str) -> DataFrame:
    source = docs.select(
        F.col(id_column).cast("long").alias("__id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"),
    ).withColumn("__key", F.xxhash64("__text"))
    with stage(docs.sparkSession) as scan:
        scanned = cut(
            source.mapInArrow(_first_order(k, num, den), "__id long, __key long, n long, hi long, lo long, post array<long>")
            .withColumn("uid", F.monotonically_increasing_id())
        )
        lone = (
            scanned.select("uid", F.explode("post").alias("tok")).groupBy("tok")
            .agg(F.count(F.lit(1)).alias("c"), F.min("uid").alias("uid")).where("c = 1")
            .groupBy("uid").agg(F.count(F.lit(1)).alias("lone"))
        )
        active = cut(
            scanned.where("n > 0").select("uid", "__key", "n").join(lone, "uid", "left")
            .where(F.coalesce("lone", F.lit(0)) < _prefix(F.col("n"), num, den)).select("__key").distinct()
        )
        bits = active_bits(active)
        plain = scan.keep(scanned.drop("post", "uid"))
    sets = cut(
        source.mapInArrow(_active_sets(k, docs.sparkSession.sparkContext.broadcast(bits)), "n long, hi long, lo long, tokens array<long>")
        .where("n > 0").dropDuplicates(["hi", "lo", "n"]).withColumn("sid", F.monotonically_increasing_id())
    )
    with stage(docs.sparkSession) as chain:
        links = chain.keep(_links(sets, cut(_classes(sets, num, den)), num, den))
    groups = connected_components(links)
    root = F.coalesce("component", "sid").alias("root")
    named = cut(sets.select("hi", "lo", "n", "sid").join(groups.withColumnRenamed("node", "sid"), "sid", "left").select("hi", "lo", "n", root))
    rows = cut(plain.join(named, ["hi", "lo", "n"], "left").select("__id", "__key", "n", "root"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("__id").alias("least"))
    found = rows.where("root is null").withColumn("component_id", F.col("__id")).unionByName(
        rows.where("root is not null").join(least, "root").withColumn("component_id", F.col("least")).drop("least"))
    return found.select(F.col("__id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("root").alias("group"), F.col("__key").alias("text_key"))
