"""Data preparation (inventory group J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.functions.draws import draw_sql
from spoorline.operators import graph as G
from spoorline.operators import prep as P
from spoorline.operators.features import degrees
from spoorline.plans.fixtures import prov_events, table
from spoorline.plans.graph_queries import DAYS, T0, day_windows
from spoorline.plans.registry import pe, query, r6


@query("dedupe_events", pe("select src_key, dst_key, event_type, min(event_id) as event_id from pe group by 1,2,3"))
def dedupe_events(spark, sf):
    # as parsed events, with a map column
    events = prov_events(spark, sf).select("event_id", "ts_s", "src_key", "dst_key", "event_type", F.create_map(F.lit("k"), F.col("k").cast("string")).alias("attributes"))
    return P.remove_duplicates(events, ["src_key", "dst_key", "event_type"]).select("src_key", "dst_key", "event_type", "event_id")


def gaps(spark, sf):
    return prov_events(spark, sf).select(
        "event_id", F.when(F.col("k") >= 10, F.col("k")).alias("k"), F.when(F.col("score") < 100, F.col("score")).alias("score")
    )


@query("handle_missing", pe("""select 'skip' as policy, count(*) as n, round(sum(score),4) as total from pe where k>=10 and score<100
  union all select 'fill', count(*), round(sum(case when score<100 then score else 100 end),4) from pe union all select 'ignore', count(*), round(sum(case when score<100 then score end),4) from pe"""))
def handle_missing(spark, sf):
    out = None
    for policy in ("skip", "fill", "ignore"):
        kept = P.handle_missing(gaps(spark, sf), policy, fill={"k": -1, "score": 100.0})
        row = kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total")).select(F.lit(policy).alias("policy"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("min_degree", pe("""select event_id from pe where src_key in (select v from d where n>=avgn) and dst_key in (select v from d where n>=avgn)""",
       "d as (select v, count(*) as n, avg(count(*)) over () as avgn from (select src_key as v from pe union all select dst_key from pe) group by 1)"))
def min_degree(spark, sf):
    events = prov_events(spark, sf)
    mean = degrees(events).agg(F.ceil(F.avg("degree")).alias("n")).first()["n"]
    return P.min_degree(events, int(mean)).select("event_id")


_ENT = """ent as materialized (select src_key as e, max(case when event_type='view' then round(score*20) end) as a, min(case when event_type='click' then round(score*20) end) as b from pe group by 1)"""


@query("resolve_by_fields", pe("select a as entity_key, min(b) as canonical from reach group by 1", _ENT + """,
  lk as materialized (select x.e as u, y.e as v from ent x join ent y on x.a=y.a union select x.e, y.e from ent x join ent y on x.b=y.b),
  reach as (select e as a, e as b from ent union select r.a, lk.v from reach r join lk on lk.u=r.b)"""))
def resolve_by_fields(spark, sf):
    score = F.round(F.col("score") * 20)
    entities = prov_events(spark, sf).groupBy(F.col("src_key").alias("entity_key")).agg(
        F.max(F.when(F.col("event_type") == "view", score)).alias("a"), F.min(F.when(F.col("event_type") == "click", score)).alias("b")
    )
    return P.resolve_by_fields(entities, ["a", "b"])


@query("filter_actions", pe("select event_id, event_type from pe where event_type in ('view','click','error') and event_type not in (select 'click')"))
def filter_actions(spark, sf):
    deny = spark.createDataFrame([("click",)], "event_type string")
    return P.filter_actions(prov_events(spark, sf), ["view", "click", "error"], deny).select("event_id", "event_type")


@query("first_n", pe("select event_id from pe order by ts_s, event_id limit 500"))
def first_n(spark, sf):
    return P.sample(prov_events(spark, sf), 500).select("event_id")


@query("random_sample", pe(f"select event_id, event_type from pe where {draw_sql(42, 'event_id')} < 0.1"))
def random_sample(spark, sf):
    return P.sample(prov_events(spark, sf), share=0.1, method="random").select("event_id", "event_type")


@query("random_split", pe(f"""select graph_id, case when row_number() over (order by {draw_sql(42, 'graph_id')}, graph_id) <= floor(count(*) over ()*0.8) then 'train' else 'val' end as split
  from (select distinct window_id as graph_id from wd)""", DAYS))
def random_split(spark, sf):
    graphs = day_windows(spark, sf).select(F.col("window_id").alias("graph_id")).distinct()
    return P.random_split(graphs).select("graph_id", "split")


@query("temporal_split", pe("""select event_id, case when r < floor(n*0.7) then 'train' when r < floor(n*(0.7+0.15)) then 'val' else 'test' end as split from (
  select event_id, row_number() over (order by ts_s, event_id)-1 as r, count(*) over () as n from pe)"""))
def temporal_split(spark, sf):
    return P.temporal_split(prov_events(spark, sf)).select("event_id", "split")


@query("temporal_split_days", pe(f"""select event_id, case when d<20 then 'train' when d<24 then 'val' when d<28 then 'test' end as split from (select event_id, floor((ts_s-{T0})/86400) as d from pe)"""))
def temporal_split_days(spark, sf):
    return P.temporal_split(prov_events(spark, sf), days=[20, 4, 4]).select("event_id", "split")


@query("balance", pe("""select 'under' as method, event_id, label, 1::bigint as copies from ranked, goal where r < least
  union all select 'over', event_id, label, cast(most//n + case when r < most % n then 1 else 0 end as bigint) from ranked, goal""", f"""
  ranked as (select event_id, label, row_number() over (partition by label order by {draw_sql(42, 'event_id')}, event_id)-1 as r, count(*) over (partition by label) as n from pe),
  goal as (select min(n) as least, max(n) as most from ranked)"""))
def balance(spark, sf):
    events = prov_events(spark, sf).select("event_id", "label")
    parts = [
        P.balance(events, method).groupBy("event_id", "label").agg(F.count(F.lit(1)).alias("copies")).select(F.lit(method).alias("method"), "*")
        for method in ("under", "over")
    ]
    return parts[0].unionByName(parts[1])


# attack intervals: from each hour's best scored event of a day to two hours later, one per day
_IV = "iv as (select ts_s as s, ts_s+7200 as e from pe qualify row_number() over (partition by floor(ts_s/86400) order by score desc, event_id desc)=1)"


@query("label_windows", pe("select event_id, case when exists (select 1 from iv where ts_s between s and e) then 1 else 0 end as label from pe", _IV))
def label_windows(spark, sf):
    events = prov_events(spark, sf)
    best = events.groupBy(F.floor(F.col("ts_s") / 86400).alias("day")).agg(F.max(F.struct("score", "event_id", "ts_s")).alias("b"))
    intervals = best.select(F.col("b.ts_s").alias("start_s"), (F.col("b.ts_s") + 7200).alias("end_s"))
    return P.label_attack_windows(events.drop("label"), intervals).select("event_id", "label")


@query("dataset_stats", pe("""select 'edge_type' as section, event_type as name, count(*)::double as value from pe group by 2
  union all select 'node_type', split_part(k,':',1), count(*)::double from (select src_key as k from pe union select dst_key from pe) group by 2
  union all select 'time', n, round(v,6) from (select unnest(['min_ts','max_ts','hours','days']) as n, unnest([min(ts_s),max(ts_s),(max(ts_s)-min(ts_s))/3600,(max(ts_s)-min(ts_s))/86400]) as v from pe)"""))
def dataset_stats(spark, sf):
    return P.dataset_stats(prov_events(spark, sf)).withColumn("value", r6("value"))


@query("validate", pe("""select 'null_key' as rule, count(*) filter (k>=98) as violations from pe union all select 'null_type', 0 union all select 'null_time', 0 union all select 'negative_time', 0
  union all select 'self_loop', count(*) from pe where src_key=dst_key and k<98
  union all select 'dangling_end', count(*) from pe where split_part(dst_key,':',1)='network' and k<98 union all select 'repeated_id', 0
  union all select 'time_order', count(*) from (select ts_s, max(ts_s) over (order by event_id rows between unbounded preceding and 1 preceding) as m from pe) where ts_s < m"""))
def validate(spark, sf):
    events = prov_events(spark, sf).withColumn("dst_key", F.when(F.col("k") < 98, F.col("dst_key")))
    keys = G.endpoints(prov_events(spark, sf)).select("entity_key").distinct()
    return P.validate(events, keys.where("entity_key not like 'network:%'"))


@query("negative_samples", pe("""select src_key, cast(sum(least(2, (select count(*) from nn) - d)) as bigint) as n, cast(sum(least(2, (select count(*) from nn) - d)) as bigint) as distinct_n, 0::bigint as hits
  from pe join held using (src_key) group by 1""", """nn as (select src_key as v from pe union select dst_key from pe),
  held as (select src_key, count(distinct v) as d from (select src_key, dst_key as v from pe union all select src_key, src_key from pe) group by 1)"""))
def negative_samples(spark, sf):
    events = prov_events(spark, sf).select("event_id", "src_key", "dst_key")
    nodes = G.endpoints(prov_events(spark, sf)).select("entity_key").distinct()
    drawn = P.negative_samples(events, nodes, 2)
    own = events.select("src_key", F.col("src_key").alias("dst_key"))
    real = events.select("src_key", "dst_key").unionByName(own).distinct().withColumn("hit", F.lit(1))
    return drawn.join(real, ["src_key", "dst_key"], "left").groupBy("src_key").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id", "dst_key").alias("distinct_n"), F.count("hit").alias("hits")
    )


@query("stratified_split", pe("""select event_id, case when r < floor(n*0.7) then 'train' when r < floor(n*(0.7+0.15)) then 'val' else 'test' end as split from (
  select event_id, row_number() over (partition by label order by ts_s, event_id)-1 as r, count(*) over (partition by label) as n from pe)"""))
def stratified_split(spark, sf):
    return P.stratified_split(prov_events(spark, sf)).select("event_id", "split")


@query("label_subset", pe(f"select event_id, case when {draw_sql(42, 'event_id')} < 0.2 then label end as label from pe"))
def label_subset(spark, sf):
    return P.label_subset(prov_events(spark, sf).select("event_id", "label"), 0.2)


@query("detect_mode", pe("select case when bool_or(label<>0) then 'supervised' else 'unsupervised' end as mode from pe"))
def detect_mode(spark, sf):
    return P.detect_mode(prov_events(spark, sf))
