"""Score statistics, metrics and reports (inventory group H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.operators import analysis as A
from spoorline.operators import metrics as M
from spoorline.operators.registry import entity_registry
from spoorline.plans.fixtures import SCORES_SQL, prov_events, prov_scores
from spoorline.plans.graph_queries import entity_records
from spoorline.plans.registry import pe, query, r6

PROBS = "[0.5,0.9,0.95,0.99,0.995,0.999]"


def rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


@query("suspicious_hours", pe("""select bucket, n, entities, avg_score, above from (
  select cast(floor(ts_s/3600)*3600 as bigint) as bucket, count(*) as n, count(distinct src_key) as entities, round(avg(score),6) as avg_score,
   count(*) filter (score > (select quantile_cont(score,0.99) from pe)) as above from pe group by 1) order by avg_score desc, bucket limit 10"""))
def suspicious_hours(spark, sf):
    events = prov_events(spark, sf)
    sources = events.groupBy((F.floor(F.col("ts_s") / 3600) * 3600).alias("bucket")).agg(F.countDistinct("src_key").alias("entities"))
    profile = rounded(A.temporal_profile(events), "avg_score")
    return profile.join(sources, "bucket").orderBy(F.desc("avg_score"), "bucket").limit(10).select(
        "bucket", "n", "entities", "avg_score", "above"
    )


@query("score_stats", pe("""select model, count(*) as n, round(avg(score),6) as mean, round(stddev_pop(score),6) as std, min(score) as min, max(score) as max,
  round(median(score),6) as median from sc group by 1""", SCORES_SQL))
def score_stats(spark, sf):
    return rounded(M.score_stats(prov_scores(spark, sf), ["model"]), "mean", "std", "median")


@query("percentiles", pe(f"select unnest({PROBS})::double as p, round(unnest(quantile_cont(score,{PROBS})),6) as value from pe"))
def percentiles(spark, sf):
    return rounded(M.percentiles(prov_events(spark, sf)), "value")


@query("separation", pe("select model, round(stddev_pop(score)/avg(score),6) as separation from sc group by 1", SCORES_SQL))
def separation(spark, sf):
    return rounded(M.separation_ratio(prov_scores(spark, sf), ["model"]), "separation")


_BEYOND = "select p::double as p, (select count(*) from pe where score {op} q) as n from (select unnest([0.9,0.95,0.99,0.999]) as p, unnest(quantile_cont(score,[0.9,0.95,0.99,0.999])) as q from pe)"


@query("counts_ge", pe(_BEYOND.format(op=">=")))
def counts_ge(spark, sf):
    return M.counts_beyond(prov_events(spark, sf))


@query("counts_gt", pe(_BEYOND.format(op=">")))
def counts_gt(spark, sf):
    return M.counts_beyond(prov_events(spark, sf), inclusive=False)


@query("top_k", pe("select event_id, score, cast(row_number() over (order by score desc, event_id desc) as integer) as rank from pe qualify rank <= 100"))
def top_k(spark, sf):
    return M.top_k(prov_events(spark, sf).select("event_id", "score"), 100)


_CONF = """conf as (select count(*) filter (pr=0 and label=0) as tn, count(*) filter (pr=1 and label=0) as fp,
  count(*) filter (pr=0 and label=1) as fn, count(*) filter (pr=1 and label=1) as tp from (select label, case when score>60 then 1 else 0 end as pr from pe))"""
_RATES = """round((tn+tp)/(tn+fp+fn+tp),6) as accuracy, round(coalesce(tp/nullif(tp+fp,0),0),6) as precision, round(coalesce(tp/nullif(tp+fn,0),0),6) as recall,
  round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) as f1, round(coalesce(fp/nullif(fp+tn,0),0),6) as fpr, round(coalesce(tp/nullif(tp+fn,0),0),6) as tpr,
  round(coalesce(tp/nullif(tp+fn,0),0),6) as detection_rate"""
RATES = ("accuracy", "precision", "recall", "f1", "fpr", "tpr", "detection_rate")


def predicted(spark, sf):
    return prov_events(spark, sf).withColumn("prediction", M.predict(F.col("score"), 60))


@query("confusion", pe("select tn, fp, fn, tp from conf", _CONF))
def confusion(spark, sf):
    return M.confusion(predicted(spark, sf))


@query("class_metrics", pe(f"select tn, fp, fn, tp, {_RATES} from conf", _CONF))
def class_metrics(spark, sf):
    return rounded(M.classification_metrics(M.confusion(predicted(spark, sf))), *RATES)


CURVE = """tot as (select count(*) filter (label=1) as p, count(*) filter (label=0) as n from pe),
 grp as (select score, count(*) filter (label=1) as pos, count(*) filter (label=0) as neg from pe group by 1),
 cv as materialized (select score, pos, neg, sum(pos) over (order by score desc)::double as tp, sum(neg) over (order by score desc)::double as fp, p, n from grp, tot)"""


@query("auroc", pe("select round(sum(pos*(n-fp+neg/2))/max(p*n),6) as auroc from cv", CURVE))
def auroc(spark, sf):
    return rounded(M.auroc(prov_events(spark, sf)), "auroc")


@query("avg_precision", pe("select round(sum(pos/p*tp/(tp+fp)),6) as average_precision from cv", CURVE))
def avg_precision(spark, sf):
    return rounded(M.average_precision(prov_events(spark, sf)), "average_precision")


@query("roc", pe("select 'infinity'::double as threshold, 0.0::double as fpr, 0.0::double as tpr union all select score, round(fp/n,6), round(tp/p,6) from cv", CURVE))
def roc(spark, sf):
    return rounded(M.roc_curve(prov_events(spark, sf)), "fpr", "tpr")


@query("roc_reduced", pe("""select 'infinity'::double as threshold, 0.0::double as fpr, 0.0::double as tpr union all
  select score, round(fp/n,6), round(tp/p,6) from (select *, lead(pos) over (order by score desc) as np, lead(neg) over (order by score desc) as nn from cv)
  where not (np is not distinct from pos and nn is not distinct from neg)""", CURVE))
def roc_reduced(spark, sf):
    return rounded(M.roc_curve(prov_events(spark, sf), drop_intermediate=True), "fpr", "tpr")


@query("pr", pe("select score as threshold, round(tp/(tp+fp),6) as precision, round(tp/p,6) as recall from cv union all select null, 1.0, 0.0", CURVE))
def pr(spark, sf):
    return rounded(M.pr_curve(prov_events(spark, sf)), "precision", "recall")


@query("youden", pe("select score as threshold, round(tp/p-fp/n,6) as j from cv order by tp/p-fp/n desc, score desc limit 1", CURVE))
def youden(spark, sf):
    return rounded(M.youden_threshold(prov_events(spark, sf)), "j")


@query("threshold_sweep", pe(f"""select threshold, tn, fp, fn, tp, {_RATES} from (select t/10.0 as th0, (t/10.0)::double as threshold, count(*) filter (score/600<=t/10.0 and label=0) as tn,
  count(*) filter (score/600>t/10.0 and label=0) as fp, count(*) filter (score/600<=t/10.0 and label=1) as fn, count(*) filter (score/600>t/10.0 and label=1) as tp
  from pe, range(0,11) r(t) group by t)"""))
def threshold_sweep(spark, sf):
    scaled = prov_events(spark, sf).withColumn("score", F.col("score") / 600)
    return rounded(M.threshold_sweep(scaled), *RATES)


_MEDIAN = """conf as (select count(*) filter (pr=0 and label=0) as tn, count(*) filter (pr=1 and label=0) as fp, count(*) filter (pr=0 and label=1) as fn,
  count(*) filter (pr=1 and label=1) as tp from (select label, case when score > (select median(score) from g) then 1 else 0 end as pr from g))"""


_AREAS = """, areas as (select round(sum(pos*(n-fp+neg/2))/max(p*n),6) as auroc, round(sum(pos/p*tp/(tp+fp)),6) as average_precision from (
  select score, pos, neg, sum(pos) over (order by score desc)::double as tp, sum(neg) over (order by score desc)::double as fp, sum(pos) over ()::double as p, sum(neg) over ()::double as n
  from (select score, count(*) filter (label=1) as pos, count(*) filter (label=0) as neg from g group by 1)))"""


@query("graph_level", pe(f"select tn, fp, fn, tp, {_RATES}, auroc, average_precision from conf, areas",
       "g as materialized (select floor(ts_s/3600) as w, avg(score) as score, case when sum(label)>=3 then 1 else 0 end as label from pe group by 1)," + _MEDIAN + _AREAS))
def graph_level(spark, sf):
    graphs = prov_events(spark, sf).groupBy(F.floor(F.col("ts_s") / 3600).alias("graph")).agg(
        F.avg("score").alias("score"), F.when(F.sum("label") >= 3, 1).otherwise(0).alias("label")
    )
    return rounded(M.median_metrics(graphs), *RATES, "auroc", "average_precision")


@query("entity_level", pe(f"select tn, fp, fn, tp, {_RATES}, auroc, average_precision from conf, areas",
       "g as materialized (select src_key, max(score) as score, case when sum(label)>=5 then 1 else 0 end as label from pe group by 1)," + _MEDIAN + _AREAS))
def entity_level(spark, sf):
    entities = prov_events(spark, sf).groupBy("src_key").agg(
        F.max("score").alias("score"), F.when(F.sum("label") >= 5, 1).otherwise(0).alias("label")
    )
    return rounded(M.entity_level_metrics(entities), *RATES, "auroc", "average_precision")


@query("ensemble", pe("""select event_id, round(avg((score-lo)/(hi-lo+1e-10)),6) as score, count(*) as models from sc
  join (select model, min(score) lo, max(score) hi from sc group by 1) using (model) group by 1""", SCORES_SQL))
def ensemble(spark, sf):
    return rounded(A.ensemble(prov_scores(spark, sf), require_all=True), "score")


@query("temporal_profile", pe("""select cast(floor(ts_s/3600)*3600 as bigint) as bucket, count(*) as n, round(avg(score),6) as avg_score, max(score) as max_score,
  round(stddev_pop(score),6) as std_score, count(*) filter (score > (select quantile_cont(score,0.99) from pe)) as above from pe where ts_s>0 group by 1"""))
def temporal_profile(spark, sf):
    return rounded(A.temporal_profile(prov_events(spark, sf)), "avg_score", "std_score")


@query("anomaly_details", pe("""select event_id, score as anomaly_score, cast(row_number() over (order by score desc, event_id desc) as integer) as rank, event_type, src_key, dst_key,
  split_part(src_key,':',1) as src_type, split_part(dst_key,':',1) as dst_type,
  (select count(distinct p.event_type) from pe p where p.src_key=pe.src_key or p.dst_key=pe.src_key) as src_attrs from pe qualify rank<=100"""))
def anomaly_details(spark, sf):
    events = prov_events(spark, sf)
    entities = entity_registry(entity_records(spark, sf))
    return A.anomaly_details(events.select("event_id", "score"), events, entities).select(
        "event_id", "anomaly_score", "rank", "event_type", "src_key", "dst_key", "src_type", "dst_type",
        F.size("src_attributes").cast("long").alias("src_attrs"),
    )


@query("rank_models", pe("""select model, round(sep,6) as separation, critical, high, case when sep is null then 'failed' else 'ok' end as status,
  cast(row_number() over (order by sep desc nulls last, model) as integer) as rank from (
   select model, stddev_pop(score)/avg(score) as sep, count(*) filter (score>=p999) as critical, count(*) filter (score>=p99) as high from sc
   join (select model, quantile_cont(score,0.99) p99, quantile_cont(score,0.999) p999 from sc group by 1) using (model) group by 1
   union all select 'm4', null, null, null)""", SCORES_SQL))
def rank_models(spark, sf):
    return rounded(A.rank_models(prov_scores(spark, sf), ["m1", "m2", "m3", "m4"]), "separation")


@query("severity", pe("""select event_id, case when score>=q[4] then 'critical' when score>=q[3] then 'high' when score>=q[2] then 'medium' when score>=q[1] then 'elevated'
  else 'normal' end as band from pe, (select quantile_cont(score,[0.9,0.95,0.99,0.999]) as q from pe)"""))
def severity(spark, sf):
    return M.severity_band(prov_events(spark, sf)).select("event_id", "band")


@query("consensus", pe("""select event_id, count(distinct model) as votes, string_agg(distinct model, ',' order by model) as models from sc
  join (select model, quantile_cont(score,0.95) q from sc group by 1) using (model) where score>=q group by 1 having count(distinct model)>=2""", SCORES_SQL))
def consensus(spark, sf):
    return A.consensus(prov_scores(spark, sf)).withColumn("models", F.concat_ws(",", "models"))


HITS = "hits as (select * from pe where score >= (select quantile_cont(score,0.95) from pe))"


@query("suspicious_entities", pe("""select entity_key, count(*) as anomalies, max(score) as max_score, split_part(entity_key,':',1) as entity_type from (
  select src_key as entity_key, score from hits union all select dst_key, score from hits where src_key<>dst_key) group by 1""", HITS))
def suspicious_entities(spark, sf):
    return A.suspicious_entities(prov_events(spark, sf))


@query("pattern_profile", pe("""select event_type, target_type, count(*) as n, count(*) filter (hit) as anomalies, cast(grouping_id(event_type,target_type) as integer) as level,
  round(count(*) filter (hit)/count(*)/(select avg(case when hit then 1.0 else 0.0 end) from t),6) as lift from t group by cube(event_type, target_type)""",
  "t as (select event_type, split_part(dst_key,':',1) as target_type, score >= (select quantile_cont(score,0.95) from pe) as hit from pe)"))
def pattern_profile(spark, sf):
    return rounded(A.pattern_profile(prov_events(spark, sf)), "lift")


@query("hourly_daily", pe("""select cast(floor(ts_s/86400) as bigint) as day, cast(floor(ts_s/3600) - 24*floor(ts_s/86400) as integer) as hour, count(*) as n from hits group by rollup(1,2)""".replace("rollup(1,2)", "rollup(cast(floor(ts_s/86400) as bigint), cast(floor(ts_s/3600) - 24*floor(ts_s/86400) as integer))"), HITS))
def hourly_daily(spark, sf):
    return A.hourly_daily(prov_events(spark, sf))


def history_rows(spark, sf):
    """Days as epochs; the score and the positive rate as metrics, several values per epoch."""
    pairs = F.array(
        F.struct(F.lit("score").alias("metric"), F.col("score").alias("value")),
        F.struct(F.lit("positive").alias("metric"), F.col("label").cast("double").alias("value")),
    )
    return prov_events(spark, sf).select(
        F.floor(F.col("ts_s") / 86400).alias("epoch"), F.explode(pairs).alias("m")
    ).select("epoch", "m.metric", "m.value")


_HIST = """h as (select cast(floor(ts_s/86400) as bigint) as epoch, 'score' as metric, avg(score) as value from pe group by 1
  union all select cast(floor(ts_s/86400) as bigint), 'positive', avg(label::double) from pe group by 1)"""


@query("history", pe("select epoch, metric, round(value,6) as value from h", _HIST))
def history(spark, sf):
    return rounded(A.history_means(history_rows(spark, sf)), "value")


@query("best_epoch", pe("select metric, epoch, round(value,6) as value from h qualify row_number() over (partition by metric order by value desc, epoch)=1", _HIST))
def best_epoch(spark, sf):
    return rounded(A.best_epoch(history_rows(spark, sf)), "value")
