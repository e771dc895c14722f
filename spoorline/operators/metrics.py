"""Score statistics, thresholds, ranking and detection metrics over ``(score, label)`` tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spoorline.operators.ranking import exact_percentiles, percentile_of, running_sums

PERCENTILES = (0.5, 0.9, 0.95, 0.99, 0.995, 0.999)
BANDS = (0.9, 0.95, 0.99, 0.999)


def percentile_struct(df: DataFrame, value: str, probs: Sequence[float]) -> Column:
    """All wanted percentiles as one scalar sub-query; ``result[i]`` belongs to ``probs[i]``."""
    rows = exact_percentiles(df, value, probs)
    return rows.agg(F.sort_array(F.collect_list(F.struct("p", "value")))["value"].alias("v")).scalar()


def score_stats(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, population deviation, min, max and exact median."""
    stats = scores.groupBy(*by).agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"),
        F.min("score").alias("min"), F.max("score").alias("max"),
    )
    if by:
        median = exact_percentiles(scores, "score", [0.5], by).select(*by, F.col("value").alias("median"))
        return stats.join(median, list(by), "left")
    return stats.withColumn("median", percentile_of(scores, "score", 0.5))


def percentiles(scores: DataFrame, probs: Sequence[float] = PERCENTILES, by: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(scores, "score", probs, by)


def separation_ratio(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Deviation over mean; 0 where the mean is not positive."""
    mean, std = F.avg("score"), F.stddev_pop("score")
    return scores.groupBy(*by).agg(F.when(mean > 0, std / mean).otherwise(0.0).alias("separation"))


def counts_beyond(scores: DataFrame, probs: Sequence[float] = BANDS, inclusive: bool = True) -> DataFrame:
    """Number of scores at or above (``inclusive=False``: above) each percentile of all scores."""
    cuts = percentile_struct(scores, "score", sorted(probs))
    beyond = (lambda c: F.col("score") >= c) if inclusive else (lambda c: F.col("score") > c)
    counted = scores.withColumn("__cuts", cuts).agg(*[
        F.count_if(beyond(F.col("__cuts")[i])).alias(f"n{i}") for i in range(len(probs))
    ])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"n{i}").alias("n")) for i, p in enumerate(sorted(probs))])
    return counted.select(F.inline(pairs))


def top_k(scores: DataFrame, k: int = 100, key: str = "event_id") -> DataFrame:
    """The k best scores with rank 1..k, ties by descending key."""
    order = [F.desc("score"), F.desc(key)]
    best = scores.where(F.col("score").isNotNull()).orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def predict(score: Column, cut: float = 0.5) -> Column:
    return F.when(score > cut, 1).otherwise(0)


def confusion(df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", label: str = "label") -> DataFrame:
    hit, real = F.col(prediction) == 1, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~hit & ~real).alias("tn"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(hit & real).alias("tp"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1, false and true positive rate of a confusion table; x/0 is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({
        "accuracy": _ratio(tn + tp, tn + fp + fn + tp),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": _ratio(fp, fp + tn),
        "tpr": _ratio(tp, tp + fn),
        "detection_rate": _ratio(tp, tp + fn),
    })


def curve_points(df: DataFrame) -> DataFrame:
    """Per distinct score, descending: positives, negatives and both running totals."""
    groups = df.where(F.col("score").isNotNull()).groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"),
        F.lit(1).cast("long").alias("one"),
    )
    return running_sums(groups, [F.desc("score")], {"tp": "pos", "fp": "neg", "point": "one"}).drop("one")


def _class_totals(df: DataFrame) -> Column:
    return df.where(F.col("score").isNotNull()).agg(F.struct(
        F.count_if(F.col("label") == 1).cast("double").alias("p"),
        F.count_if(F.col("label") != 1).cast("double").alias("n"),
    )).scalar()


def auroc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve by rank sums with ties shared; NULL unless both classes occur."""
    t = _class_totals(df)
    wins = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2))
    points = curve_points(df).withColumns({"p": t["p"], "n": t["n"]})
    return points.agg(wins.alias("w"), F.max("p").alias("p"), F.max("n").alias("n")).select(
        F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auroc")
    )


def average_precision(df: DataFrame) -> DataFrame:
    """Precision weighted by the gain in recall over distinct scores."""
    t = _class_totals(df)
    gain = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    return curve_points(df).agg(F.sum(gain).alias("s")).select(
        F.when(t["p"] > 0, F.col("s") / t["p"]).otherwise(0.0).alias("average_precision")
    )


def roc_curve(df: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    """``(threshold, fpr, tpr)`` per distinct score after a leading (0, 0) at an infinite threshold."""
    t = _class_totals(df)
    points = curve_points(df)
    if drop_intermediate:
        following = points.select((F.col("point") - 1).alias("point"), F.col("pos").alias("npos"), F.col("neg").alias("nneg"))
        same = F.col("npos").eqNullSafe(F.col("pos")) & F.col("nneg").eqNullSafe(F.col("neg"))
        points = points.join(following, "point", "left").where(~same)
    curve = points.select(
        F.col("score").alias("threshold"), (F.col("fp") / F.nullif(t["n"], F.lit(0.0))).alias("fpr"),
        (F.col("tp") / F.nullif(t["p"], F.lit(0.0))).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(curve)


def pr_curve(df: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, closed by (1, 0) without a threshold."""
    t = _class_totals(df)
    curve = curve_points(df).select(
        F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(t["p"] > 0, F.col("tp") / t["p"]).otherwise(1.0).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return curve.unionByName(end)


def youden_threshold(df: DataFrame) -> DataFrame:
    """Threshold with the largest tpr − fpr; of equals the highest."""
    return roc_curve(df).agg(
        F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("threshold"))).alias("b")
    ).select("b.threshold", "b.j")


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] | None = None) -> DataFrame:
    """Metrics at each threshold (score strictly above), all counted in one pass."""
    cuts = [i / 10 for i in range(11)] if thresholds is None else list(thresholds)
    real = F.col("label") == 1
    counts = df.agg(
        F.count_if(real).alias("p"), F.count_if(~real).alias("n"),
        *[F.count_if((F.col("score") > c) & real).alias(f"tp{i}") for i, c in enumerate(cuts)],
        *[F.count_if((F.col("score") > c) & ~real).alias(f"fp{i}") for i, c in enumerate(cuts)],
    )
    table = F.array(*[
        F.struct(
            F.lit(float(c)).alias("threshold"), (F.col("n") - F.col(f"fp{i}")).alias("tn"), F.col(f"fp{i}").alias("fp"),
            (F.col("p") - F.col(f"tp{i}")).alias("fn"), F.col(f"tp{i}").alias("tp"),
        ) for i, c in enumerate(cuts)
    ])
    return classification_metrics(counts.select(F.inline(table)))


def median_metrics(df: DataFrame) -> DataFrame:
    """Rows (graphs) above the median score predicted positive, then the metrics, and both areas over all scores."""
    cut = percentile_of(df, "score", 0.5)
    rates = classification_metrics(confusion(df.withColumn("prediction", F.when(F.col("score") > cut, 1).otherwise(0))))
    return rates.withColumns({"auroc": auroc(df).scalar(), "average_precision": average_precision(df).scalar()})


def entity_level_metrics(df: DataFrame) -> DataFrame:
    """As ``median_metrics``; all zeros unless both classes and at least two benign entities occur."""
    enough = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") >= 2)
    out = median_metrics(df)
    rates = [c for c in out.columns if c not in ("tn", "fp", "fn", "tp")]
    return out.withColumns({c: F.when(enough, F.col(c)).otherwise(0.0) for c in rates})


def severity_band(scores: DataFrame) -> DataFrame:
    """critical / high / medium / elevated at p99.9 / p99 / p95 / p90 of all scores, else normal."""
    cuts = percentile_struct(scores, "score", BANDS)
    s = F.col("score")
    band = (
        F.when(s >= F.col("__c")[3], "critical").when(s >= F.col("__c")[2], "high")
        .when(s >= F.col("__c")[1], "medium").when(s >= F.col("__c")[0], "elevated").otherwise("normal")
    )
    return scores.withColumn("__c", cuts).withColumn("band", band).drop("__c")


def threshold(scores: DataFrame, method: str = "percentile", value: float = 0.95) -> Column:
    """Cut by ``percentile`` (share), ``fixed`` (value), or ``auto`` (Youden's J on labelled scores)."""
    if method == "fixed":
        return F.lit(float(value))
    if method == "percentile":
        return percentile_of(scores, "score", value)
    if method in ("auto", "adaptive"):
        return youden_threshold(scores).select("threshold").scalar()
    raise ValueError(f"unknown method {method!r}")
