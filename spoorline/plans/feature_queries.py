"""Node and edge features (inventory group E)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from spoorline.operators import features as X
from spoorline.operators import graph as G
from spoorline.functions.draws import draw_sql
from spoorline.plans.fixtures import prov_events, prov_vectors, table
from spoorline.plans.registry import pe, query, r6

KEYS = "keys as materialized (select src_key as entity_key from pe union select dst_key from pe)"
CODES = f"{KEYS}, codes as materialized (select entity_key, row_number() over (order by entity_key)-1 as code from keys)"


def keys(spark, sf):
    return G.endpoints(prov_events(spark, sf)).select("entity_key").distinct().withColumn(
        "entity_type", G.entity_type(F.col("entity_key"))
    )


@query("onehot_nodes", pe("""select entity_key, i-1 as slot, case when t.list[i]=split_part(entity_key,':',1) then 1.0::double else 0.0::double end as x
  from keys, (select list_sort(list(distinct split_part(entity_key,':',1))) as list from keys) t, range(1,4) r(i)""", KEYS))
def onehot_nodes(spark, sf):
    return X.onehot(keys(spark, sf), "entity_type").select("entity_key", F.posexplode("onehot").alias("slot", "x")).withColumn(
        "slot", F.col("slot").cast("long")
    )


@query("onehot_edges", pe("""select t.list[j] as event_type, i-1 as slot, case when i=j then 1.0::double else 0.0::double end as x
  from (select list_sort(list(distinct event_type)) as list from pe) t, range(1,6) r(i), range(1,6) s(j)"""))
def onehot_edges(spark, sf):
    types = prov_events(spark, sf).select("event_type").distinct()
    return X.onehot(types, "event_type").select("event_type", F.posexplode("onehot").alias("slot", "x")).withColumn(
        "slot", F.col("slot").cast("long")
    )


@query("random_features", pe(f"""select entity_key, i, round(sqrt(-2.0*ln(1.0-{draw_sql(42, 'entity_key', 'i', '0')}))*cos(6.283185307179586*{draw_sql(42, 'entity_key', 'i', '1')}),6) as x
  from (select src_key as entity_key from pe union select dst_key from pe), range(0,16) r(i)"""))
def random_features(spark, sf):
    entries = X.random_features(keys(spark, sf), "entity_key", 16).select("entity_key", F.posexplode("vec").alias("i", "x"))
    return entries.select("entity_key", F.col("i").cast("long").alias("i"), r6("x").alias("x"))


@query("dense_codes", pe("select 'node' as kind, entity_key as value, code from codes union all select 'edge', event_type, row_number() over (order by event_type)-1 from (select distinct event_type from pe)", CODES))
def dense_codes(spark, sf):
    events = prov_events(spark, sf)
    nodes = X.dense_codes(keys(spark, sf), "entity_key").select(F.lit("node").alias("kind"), F.col("entity_key").alias("value"), "code")
    return nodes.unionByName(
        X.dense_codes(events, "event_type").select(F.lit("edge").alias("kind"), F.col("event_type").alias("value"), "code")
    )


@query("type_codes", pe("""select entity_key, case split_part(entity_key,':',1) when 'process' then 1.0::double when 'file' then 2.0::double
  when 'network' then 3.0::double else 0.0::double end as code, 128::bigint as dim from keys""", KEYS))
def type_codes(spark, sf):
    return X.node_features(keys(spark, sf)).select(
        "entity_key", F.col("x")[0].alias("code"), F.size("x").cast("long").alias("dim")
    )


# event types of the fixture as audit event names, so that the code table applies
AUDIT = {"view": "read", "click": "write", "purchase": "sendto", "signup": "fork", "error": "exit"}
AUDIT_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in AUDIT.items()) + " end"


def audit_events(spark, sf):
    mapping = F.create_map(*[F.lit(x) for kv in AUDIT.items() for x in kv])
    return prov_events(spark, sf).withColumn("event_type", mapping[F.col("event_type")])


@query("edge_codes", pe("""select event_id, case event_type when 'view' then 3.0::double when 'click' then 4.0::double when 'purchase' then 9.0::double
  when 'signup' then 2.0::double else 0.0::double end as code, round((ts_s - 86400*floor(ts_s/86400))/86400.0,6) as time_of_day, 64::bigint as dim from pe"""))
def edge_codes(spark, sf):
    return X.edge_features(audit_events(spark, sf)).select(
        "event_id", F.col("edge_attr")[0].alias("code"), r6(F.col("edge_attr")[1]).alias("time_of_day"),
        F.size("edge_attr").cast("long").alias("dim"),
    )


@query("numeric_attrs", pe("""select entity_key, round(a,6) as a1, round(b,6) as a2, 0.0::double as a3 from
  (select src_key as entity_key, max(score) as a, cast(count(*) as double) as b from pe group by 1)"""))
def numeric_attrs(spark, sf):
    stats = prov_events(spark, sf).groupBy(F.col("src_key").alias("entity_key")).agg(
        F.max("score").cast("string").alias("a"), F.count(F.lit(1)).alias("b"), F.lit("n/a").alias("c")
    ).withColumn("entity_type", G.entity_type(F.col("entity_key")))
    x = X.node_features(stats, ["a", "b", "c"])
    return x.select("entity_key", *[r6(F.col("x")[i]).alias(f"a{i}") for i in (1, 2, 3)])


@query("time_of_day", pe("select event_id, round((ts_s - 86400*floor(ts_s/86400))/86400.0,6) as tod from pe"))
def time_of_day(spark, sf):
    return prov_events(spark, sf).select("event_id", r6(X.time_of_day(F.col("ts_s"))).alias("tod"))


# only some types have a vector, only some processes are known nodes: both sides of the look-up show
_EF = "vec as (select * from (values ('click',[1.0,0.5]),('error',[0.0,2.0])) v(event_type, vec))"


@query("edge_features", pe("""select event_id, cast(coalesce(vec[1],0) as double) as x0, cast(coalesce(vec[2],0) as double) as x1 from pe left join vec using (event_type)
  where src_key in (select 'process:'||vec_id from embeddings where label=0) """, _EF))
def edge_features(spark, sf):
    vectors = spark.createDataFrame([("click", [1.0, 0.5]), ("error", [0.0, 2.0])], "event_type string, vec array<double>")
    events = prov_events(spark, sf)
    known = prov_vectors(spark, sf).where("label = 0").select("entity_key").unionByName(
        events.select(F.col("dst_key").alias("entity_key")).where("entity_key not like 'process:%'")
    ).distinct()
    targets = events.select(F.col("dst_key").alias("entity_key")).distinct()
    nodes = known.unionByName(targets).distinct()
    # a source is known only by its vector, a target always
    sources = events.join(known.withColumnRenamed("entity_key", "src_key"), "src_key", "left_semi")
    return X.edge_feature_lookup(sources, vectors, nodes, 2).select(
        "event_id", F.col("vec")[0].alias("x0"), F.col("vec")[1].alias("x1")
    )


@query("edge_index", pe("select event_id, a.code as src, b.code as dst, label from pe join codes a on a.entity_key=src_key join codes b on b.entity_key=dst_key", CODES))
def edge_index(spark, sf):
    return X.edge_index(prov_events(spark, sf), X.dense_codes(keys(spark, sf), "entity_key"))


@query("degrees", pe("""select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree, cast(sum(i+o) as bigint) as degree
  from (select src_key as node, 0 as i, 1 as o from pe union all select dst_key, 1, 0 from pe) group by 1"""))
def degrees(spark, sf):
    return X.degrees(prov_events(spark, sf))


@query("clustering_coefficient", pe("""select d.node, d.d as degree, coalesce(t.t,0) as triangles, case when d.d>1 then round(2.0*coalesce(t.t,0)/(d.d*(d.d-1)),6) else 0.0::double end as clustering
  from (select u as node, count(*) as d from both_dir group by 1) d left join (
    select a.u as node, count(*)//2 as t from both_dir a join both_dir b on a.v=b.u join both_dir c on c.u=b.v and c.v=a.u group by 1) t on t.node=d.node""",
  """both_dir as materialized (select distinct src_key as u, dst_key as v from pe where src_key<>dst_key union select dst_key, src_key from pe where src_key<>dst_key)"""))
def clustering_coefficient(spark, sf):
    return X.clustering_coefficient(prov_events(spark, sf)).withColumn("clustering", r6("clustering"))


@query("edge_frequency", pe("""select src_key, dst_key, event_type, count(*) as n, round(min(ts_s),6) as first_ts, round(max(ts_s),6) as last_ts,
  round(max(ts_s)-min(ts_s),4) as duration from pe group by 1,2,3"""))
def edge_frequency(spark, sf):
    return X.edge_frequency(prov_events(spark, sf), ["src_key", "dst_key", "event_type"]).withColumns(
        {"first_ts": r6("first_ts"), "last_ts": r6("last_ts"), "duration": F.round("duration", 4)}
    )


@query("calendar", pe("""select event_id, cast(extract(hour from ts) as integer) as hour, cast(extract(dow from ts)+1 as integer) as day_of_week from events"""))
def calendar(spark, sf):
    return X.calendar_features(prov_events(spark, sf)).select("event_id", "hour", "day_of_week")


_DELTA = "select event_id, round(case when d>86400 then 86400 else d end,4) as time_delta from (select event_id, ts_s - lag(ts_s) over (partition by {keys} order by ts_s, event_id) as d from pe)"


@query("time_delta", pe(_DELTA.format(keys="src_key")))
def time_delta(spark, sf):
    return X.time_delta(prov_events(spark, sf)).select("event_id", F.round("time_delta", 4).alias("time_delta"))


@query("time_delta_pair", pe(_DELTA.format(keys="src_key, dst_key")))
def time_delta_pair(spark, sf):
    return X.time_delta(prov_events(spark, sf), ["src_key", "dst_key"]).select("event_id", F.round("time_delta", 4).alias("time_delta"))


@query("normalize", pe("""select event_id, round((score-m)/s,6) as z, round((score-lo)/(hi-lo),6) as u, round(ln(1+score),6) as l
  from pe, (select avg(score) m, stddev_pop(score) s, min(score) lo, max(score) hi from pe)"""))
def normalize(spark, sf):
    events = prov_events(spark, sf).select("event_id", F.col("score").alias("z"), F.col("score").alias("u"), F.col("score").alias("l"))
    out = X.normalize(X.normalize(X.normalize(events, ["z"]), ["u"], "minmax"), ["l"], "log")
    return out.select("event_id", r6("z").alias("z"), r6("u").alias("u"), r6("l").alias("l"))


@query("text_features", rf"""with t as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')) as w from documents),
  f as (select doc_id, cast(floor({draw_sql(0, 'w')}*64) as bigint) as i, count(*) as n from t group by 1, 2),
  d as (select i, count(*) as d from f group by 1)
  select doc_id, i, round(n*ln(((select count(*) from documents)+1)/(d+1)),6) as x from f join d using (i)""")
def text_features(spark, sf):
    return X.text_features(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", 64).withColumn("x", r6("x"))


@query("mask_features", f"""select entity_key, i-1 as i, m as masked, round(case when m then 0.0 else cast(embedding[i] as double) end,6) as x
  from (select 'process:'||vec_id as entity_key, embedding, {draw_sql(42, "'process:'||vec_id")} < 0.5 as m from embeddings), range(1,65) r(i)""")
def mask_features(spark, sf):
    masked = X.mask_features(prov_vectors(spark, sf), "entity_key", "vec", 0.5).select("entity_key", "masked", F.posexplode("vec").alias("i", "x"))
    return masked.select("entity_key", F.col("i").cast("long").alias("i"), "masked", r6("x").alias("x"))


@query("featurize_hook", pe("select 'process:'||vec_id as entity_key, i-1 as i, round(cast(embedding[i] as double),6) as x from embeddings, range(1,65) r(i)"))
def featurize_hook(spark, sf):
    entries = X.featurize(prov_vectors(spark, sf)).select("entity_key", F.posexplode("vec").alias("i", "x"))
    return entries.select("entity_key", F.col("i").cast("long").alias("i"), r6("x").alias("x"))
