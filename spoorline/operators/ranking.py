"""Order statistics and global ranks that never sort a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.session import cut

ACCURACY = 100_000
# up to this many rows per group the planner cuts groups before the shuffle
GROUP_LIMIT = 1000


def _ranged(df: DataFrame, order_by: Sequence[Column]) -> DataFrame:
    """Rows range-partitioned and sorted, frozen with partition number and position in it."""
    laid_out = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    return (
        cut(laid_out)
        .withColumn("__part", F.shiftright("__at", 33))
        .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    )


def _before(parts: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Per partition, the sums over all earlier partitions; one row per partition, so it may be broadcast."""
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__part").agg(*[c.alias(f"__t_{n}") for n, c in sums.items()])
    return totals.select(
        "__part",
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums],
    )


def global_rank(df: DataFrame, order_by: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """0-based position in the total order of ``order_by`` (must be unique per row).

    Range exchange, frozen rows, then partition offsets: every task sees one range only.
    """
    parts = _ranged(df, _columns(order_by))
    offsets = _before(parts, {"n": F.count(F.lit(1))})
    return (
        parts.join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__b_n") + F.col("__at"))
        .drop("__part", "__at", "__b_n")
    )


def group_rank(
    df: DataFrame, per: Sequence[str], order_by: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """0-based position inside each ``per`` group; a group of any size is spread over many tasks."""
    ranked = global_rank(df, [F.col(c) for c in per] + _columns(order_by), "__g")
    # one row per group, stored so that the planner knows its size
    first = cut(ranked.groupBy(*per).agg(F.min("__g").alias("__g0")))
    return (
        ranked.join(first, list(per)).withColumn(name, F.col("__g") - F.col("__g0")).drop("__g", "__g0")
    )


def first_per_group(df: DataFrame, per: Sequence[str], order_by: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group.

    A small ``n`` is cut in every task before the shuffle (window group limit); a large one uses spread ranks, so
    a huge group is never sorted in one task.
    """
    if n > GROUP_LIMIT:
        return group_rank(df, per, order_by, "__r").where(F.col("__r") < n).drop("__r")
    order = Window.partitionBy(*per).orderBy(*_columns(order_by))
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def running_sums(df: DataFrame, order_by: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """Inclusive running totals ``{new: source}`` in the total order of ``order_by`` (unique per row)."""
    order = _columns(order_by)
    parts = _ranged(df, order)
    offsets = _before(parts, {new: F.sum(src) for new, src in sums.items()})
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(offsets), "__part")
    for new, src in sums.items():
        out = out.withColumn(new, F.sum(src).over(inside) + F.col(f"__b_{new}"))
    return out.drop("__part", "__at", *[f"__b_{n}" for n in sums])


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated percentiles, rows ``(*by, p, value)``, in two column-pruned scans.

    A quantile sketch (error 1e-5 of the rows) brackets each wanted rank; the second scan counts the rows
    below each bracket and groups the few values inside it, so no task holds more than the brackets. Groups of
    up to ``ACCURACY`` rows, where that error is under one row, are grouped by value as a whole instead.
    """
    by, probs = list(by), [float(p) for p in probs]
    margin = 3.0 / ACCURACY
    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-margin, margin)]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    sketch = rows.groupBy(*by).agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", edges, ACCURACY).alias("q")
    ).alias("__s"))
    if by:
        # one row per group, stored so that the planner broadcasts it when it is small
        sketch = cut(sketch)

    def with_sketch(table: DataFrame) -> DataFrame:
        return table.join(sketch, by) if by else table.withColumn("__s", sketch.scalar())

    v, small = F.col("__v"), F.col("__s.n") <= ACCURACY
    passed = sum((F.when(v >= F.col("__s.q")[2 * i], 1).otherwise(0) for i in range(len(probs))), F.lit(0))
    left = sum((F.when(v > F.col("__s.q")[2 * i + 1], 1).otherwise(0) for i in range(len(probs))), F.lit(0))
    # slots grow with the value: gaps between brackets keep their count only, brackets their distinct values
    slotted = with_sketch(rows).select(*by, v, small.alias("__all"), passed.alias("__in"), left.alias("__out"))
    counted = (
        slotted.select(
            *by, F.when(F.col("__all"), 0).otherwise(F.col("__in") + F.col("__out")).alias("__slot"),
            F.when(F.col("__all") | (F.col("__in") > F.col("__out")), v).alias("__v"),
        )
        .groupBy(*by, "__slot", "__v").agg(F.count(F.lit(1)).alias("__c"))
    )
    slots = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.groupBy(*by, "__slot").agg(F.sum("__c").alias("__t")).select(
        *by, "__slot", F.coalesce(F.sum("__t").over(slots), F.lit(0)).alias("__before")
    )
    if not by:
        # at most two slots per wanted percentile and one more
        before = F.broadcast(before)
    upto = Window.partitionBy(*by, "__slot").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    running = with_sketch(
        counted.withColumn("__run", F.sum("__c").over(upto)).join(before, [*by, "__slot"])
        .withColumn("__cum", F.col("__run") + F.col("__before"))
    )
    found = []
    for p in probs:
        at = p * (F.col("__s.n") - 1)
        found.append(F.struct(
            F.lit(p).alias("p"), F.max(at).alias("at"),
            F.min(F.when(F.col("__cum") > F.floor(at), v)).alias("lo"),
            F.min(F.when(F.col("__cum") > F.ceil(at), v)).alias("hi"),
        ))
    out = running.groupBy(*by).agg(F.array(*found).alias("__f")).select(*by, F.inline("__f"))
    return out.where(F.col("at").isNotNull()).select(
        *by, "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("value")
    )


def percentile_of(df: DataFrame, value: str, p: float) -> Column:
    """One exact percentile as a scalar sub-query."""
    return exact_percentiles(df, value, [p]).select("value").scalar()


def _columns(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]
