import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.operators import analysis as A
from spoorline.operators import metrics as M
from spoorline.operators import ranking

PROBS = [0.0, 0.1, 0.5, 0.9, 0.99, 0.999, 1.0]


@pytest.mark.parametrize("n", [1, 2, 11, 12, 49, 50, 51, 52, 333])
def test_percentiles_with_and_without_brackets(spark, monkeypatch, n):
    # a coarse sketch makes brackets matter from 51 rows on
    monkeypatch.setattr(ranking, "ACCURACY", 50)
    x = np.random.default_rng(n).exponential(size=n).round(1 if n % 2 else 6)
    df = spark.createDataFrame([(float(v),) for v in x], "score double")
    got = {r.p: r.value for r in ranking.exact_percentiles(df, "score", PROBS).collect()}
    assert np.allclose([got[p] for p in PROBS], np.percentile(x, np.array(PROBS) * 100))


def test_percentiles_by_group_and_hot_value(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ACCURACY", 100)
    rows = [("a", float(i % 7)) for i in range(500)] + [("b", 3.0)] * 900 + [("b", float(i)) for i in range(40)] + [("c", 1.5)]
    df = spark.createDataFrame(rows, "model string, score double")
    got = {(r.model, r.p): r.value for r in ranking.exact_percentiles(df, "score", [0.5, 0.99], ["model"]).collect()}
    for model in "abc":
        x = [s for m, s in rows if m == model]
        for p in (0.5, 0.99):
            assert got[model, p] == pytest.approx(np.percentile(x, p * 100))


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(3)], "event_id long, score double")
    assert [r.event_id for r in M.top_k(df, 2).orderBy("rank").collect()] == [2, 1]


def test_zero_scores_and_constant_model(spark):
    df = spark.createDataFrame([("m", 1, 0.0), ("m", 2, 0.0)], "model string, event_id long, score double")
    assert M.separation_ratio(df).first().separation == 0
    three = df.withColumn("score", F.lit(3.0))
    assert [r.score for r in A.ensemble(three).collect()] == [0.0, 0.0]


def test_no_positives(spark):
    df = spark.createDataFrame([(0.2, 0, 0), (0.9, 0, 1)], "score double, label int, prediction int")
    r = M.classification_metrics(M.confusion(df)).first()
    assert (r.precision, r.recall, r.f1, r.fpr) == (0, 0, 0, 0.5)
    assert M.auroc(df).first().auroc is None


def test_curves_against_brute_force(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 20, 200) / 20, rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    pos, neg = score[label == 1], score[label == 0]
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert M.auroc(df).first().auroc == pytest.approx(wins)
    cuts = sorted(set(score), reverse=True)
    recall = [0.0] + [(pos >= c).mean() for c in cuts]
    precision = [label[score >= c].mean() for c in cuts]
    assert M.average_precision(df).first().average_precision == pytest.approx(sum((recall[i + 1] - recall[i]) * p for i, p in enumerate(precision)))
    roc = M.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert [r.tpr for r in roc] == pytest.approx([0.0] + [(pos >= c).mean() for c in cuts])
    j = [(pos >= c).mean() - (neg >= c).mean() for c in cuts]
    assert M.youden_threshold(df).first().threshold == pytest.approx(cuts[int(np.argmax(j))]) or max(j) <= 0


def test_sweep_is_monotone(spark):
    df = spark.createDataFrame([(i / 50, i % 2) for i in range(50)], "score double, label int")
    rows = M.threshold_sweep(df).orderBy("threshold").collect()
    assert len(rows) == 11 and all(a.tp >= b.tp and a.fp >= b.fp for a, b in zip(rows, rows[1:]))
    assert all(r.tp + r.fn == 25 and r.fp + r.tn == 25 for r in rows)


def test_entity_level_needs_both_classes(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 0), (0.8, 0)], "score double, label int")
    assert M.entity_level_metrics(df).first().accuracy == 0.0


def test_missing_event_is_reported(spark, events):
    scores = spark.createDataFrame([(0, 1.0), (99, 2.0)], "event_id long, score double")
    entities = spark.createDataFrame([("p:1", {"a": "1"})], "entity_key string, attributes map<string,string>")
    got = {r.event_id: r for r in A.anomaly_details(scores, events([("p:1", "f:1", 0)]), entities, 5).collect()}
    assert got[99].error == "event not found" and got[0].error is None and got[0].src_attributes == {"a": "1"}


def test_best_epoch_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, "m", 2.0), (2, "m", 5.0), (3, "m", 5.0)], "epoch int, metric string, value double")
    assert A.best_epoch(df).first().epoch == 2
    assert A.best_epoch(df, higher_is_better=False).first().epoch == 1
