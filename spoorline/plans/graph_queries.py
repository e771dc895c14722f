"""Graph construction, set operations and windows (inventory group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.operators import graph as G
from spoorline.operators import windows as W
from spoorline.operators.registry import entity_registry
from spoorline.plans.fixtures import prov_events, prov_scores, SCORES_SQL
from spoorline.plans.registry import pe, query, r6

DAY = 86400
T0 = "(select min(ts_s) from pe)"
DAYS = f"wd as materialized (select *, cast(floor((ts_s-{T0})/86400.0) as bigint) as window_id from pe)"
ENDS = "ends as (select src_key as entity_key, ts_s, event_id, 0 as side from pe union all select dst_key, ts_s, event_id, 1 from pe)"
NODES = f"""{ENDS}, nodes as materialized (select row_number() over (order by t)-1 as node_id, entity_key,
  split_part(entity_key,':',1) as entity_type, t.ts_s as first_ts
  from (select entity_key, min(row(ts_s,event_id,side)::struct(ts_s double, event_id bigint, side int)) as t from ends group by 1))"""
TYPES = """types as (select event_type, row_number() over (order by t)-1 as edge_type_id
  from (select event_type, min(row(ts_s,event_id)) as t from pe where src_key<>dst_key group by 1))"""
DAY_NODES = f"""{DAYS}, dends as (select window_id, src_key as entity_key, ts_s, event_id, 0 as side from wd union all
  select window_id, dst_key, ts_s, event_id, 1 from wd),
 dnodes as materialized (select window_id, entity_key, row_number() over (partition by window_id order by t)-1 as node_id
  from (select window_id, entity_key, min(row(ts_s,event_id,side)) as t from dends group by 1,2))"""
DIGRAPH = """dg as materialized (select src_key, dst_key, event_id, event_type, ts_s, score from pe
  qualify row_number() over (partition by src_key,dst_key order by event_id desc)=1)"""


def day_windows(spark, sf):
    return W.tumbling_windows(prov_events(spark, sf), DAY)


@query("nodes", pe("select node_id, entity_key, entity_type, round(first_ts,6) as first_ts from nodes", NODES))
def nodes(spark, sf):
    return G.build_nodes(prov_events(spark, sf)).withColumn("first_ts", r6("first_ts"))


@query("edge_type_dict", pe("select event_type, edge_type_id from types", TYPES))
def edge_type_dict(spark, sf):
    return G.edge_type_dict(G.remove_self_loops(prov_events(spark, sf)))


@query("edges", pe("""select event_id as edge_id, a.node_id as src, b.node_id as dst, edge_type_id, pe.event_type, round(ts_s,6) as ts_s
  from pe join nodes a on a.entity_key=src_key join nodes b on b.entity_key=dst_key join types t on t.event_type=pe.event_type
  where src_key<>dst_key""", NODES + "," + TYPES))
def edges(spark, sf):
    events = prov_events(spark, sf)
    kept = G.remove_self_loops(events)
    return G.build_edges(kept, G.build_nodes(events), G.edge_type_dict(kept)).withColumn("ts_s", r6("ts_s"))


@query("sort_by_time", pe("select event_id, row_number() over (order by ts_s, event_id)-1 as position from pe"))
def sort_by_time(spark, sf):
    return W.load_order(prov_events(spark, sf)).select("event_id", "position")


@query("drop_dangling", pe("""select event_type, count(*) as n from pe where event_type <> 'error' or k >= 50 group by 1"""))
def drop_dangling(spark, sf):
    events = prov_events(spark, sf).withColumn(
        "dst_key", F.when((F.col("event_type") != "error") | (F.col("k") >= 50), F.col("dst_key"))
    )
    return G.drop_dangling(events).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("self_loop_free", pe("select event_id, src_key, dst_key, event_type from pe where src_key<>dst_key"))
def self_loop_free(spark, sf):
    return G.remove_self_loops(prov_events(spark, sf)).select("event_id", "src_key", "dst_key", "event_type")


_STATS = """select 'edge' as kind, event_type as type, count(*) as n, round(100.0*count(*)/(select count(*) from pe where src_key<>dst_key),6) as percent
  from pe where src_key<>dst_key group by 2
  union all select 'node', split_part(entity_key,':',1), count(*), round(100.0*count(*)/(select count(*) from dn),6) from dn group by 2"""


@query("type_stats", pe(_STATS, "dn as (select src_key as entity_key from pe union select dst_key from pe)"))
def type_stats(spark, sf):
    events = prov_events(spark, sf)
    edge_stats = G.type_stats(G.remove_self_loops(events), "event_type")
    keys = G.endpoints(events).select("entity_key").distinct()
    node_stats = G.type_stats(keys.select(G.entity_type(F.col("entity_key")).alias("entity_type")), "entity_type")
    return (
        edge_stats.select(F.lit("edge").alias("kind"), "*").unionByName(node_stats.select(F.lit("node").alias("kind"), "*"))
        .withColumn("percent", r6("percent"))
    )


@query("top_destinations", pe("""select type, n, round(100.0*n/(select count(*) from pe),6) as percent from (
  select type, n from r where rn<=20 union all select '(other)', cast(sum(n) as bigint) from r where rn>20)""",
  "r as (select dst_key as type, count(*) as n, row_number() over (order by count(*) desc, dst_key) as rn from pe group by 1)"))
def top_destinations(spark, sf):
    return G.type_stats(prov_events(spark, sf), "dst_key").withColumn("percent", r6("percent"))


@query("time_range", pe("""select round(min(ts_s),6) as min_ts, round(max(ts_s),6) as max_ts,
  round((max(ts_s)-min(ts_s))/3600,6) as hours, round((max(ts_s)-min(ts_s))/86400,6) as days from pe"""))
def time_range(spark, sf):
    out = G.time_range(prov_events(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


def entity_records(spark, sf):
    """Entity records as the events show them: the event type tells which attribute ``k`` sets."""
    events = prov_events(spark, sf)
    return G.endpoints(events.withColumn("dst_key", F.col("dst_key"))).join(
        events.select("event_id", F.create_map("event_type", F.col("k").cast("string")).alias("attributes")), "event_id"
    ).select(
        "entity_key", G.entity_type(F.col("entity_key")).alias("entity_type"), "attributes",
        F.lit("events").alias("file"), (F.col("event_id") * 2 + F.col("side")).alias("pos"),
    )


_ATTRS = f"""{ENDS}, last as (select entity_key, e.event_type as attribute, cast(k as varchar) as value
  from ends join (select event_id, event_type, k from pe) e using (event_id)
  qualify row_number() over (partition by entity_key, e.event_type order by event_id*2+side desc)=1)"""


@query("entity_registry", pe("select entity_key, split_part(entity_key,':',1) as entity_type, attribute, value from last", _ATTRS))
def entity_registry_query(spark, sf):
    return entity_registry(entity_records(spark, sf)).select(
        "entity_key", "entity_type", F.explode("attributes").alias("attribute", "value")
    )


@query("node_attributes", pe("""select nodes.node_id, nodes.entity_key, attribute, value from nodes join last using (entity_key)""",
       _ATTRS + ", " + NODES.replace(ENDS + ",", "")))
def node_attributes(spark, sf):
    nodes = G.build_nodes(prov_events(spark, sf))
    out = G.node_attributes(nodes, entity_registry(entity_records(spark, sf)))
    return out.select("node_id", "entity_key", F.explode("attributes").alias("attribute", "value"))


@query("node_lookup", pe("""select node_id, split_part(entity_key,':',2) as entity_id, entity_type,
  (select count(*) from last where last.entity_key=nodes.entity_key) as num_attributes from nodes""",
       _ATTRS + ", " + NODES.replace(ENDS + ",", "")))
def node_lookup(spark, sf):
    nodes = G.build_nodes(prov_events(spark, sf))
    return G.node_lookup(nodes, entity_registry(entity_records(spark, sf))).select(
        "node_id", "entity_id", "entity_type", F.size("attributes").cast("long").alias("num_attributes")
    )


@query("tumbling", pe(f"""select cast(floor((ts_s-{T0})/3600.0) as bigint) as window_id, event_type, count(*) as n,
  count(distinct src_key) as sources, round(min(ts_s),6) as first_ts from pe group by 1,2"""))
def tumbling(spark, sf):
    return (
        W.tumbling_windows(prov_events(spark, sf), 3600).groupBy("window_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src_key").alias("sources"), r6(F.min("ts_s")).alias("first_ts"))
    )


@query("per_window_ids", pe("select window_id, entity_key, node_id from dnodes", DAY_NODES))
def per_window_ids(spark, sf):
    return G.build_nodes(day_windows(spark, sf), ["window_id"]).select("window_id", "entity_key", "node_id")


@query("per_window_edges", pe("""select e.window_id, event_id as edge_id, a.node_id as src, b.node_id as dst, e.event_type, edge_type_id
  from wd e join dnodes a on a.window_id=e.window_id and a.entity_key=src_key join dnodes b on b.window_id=e.window_id and b.entity_key=dst_key
  join dtypes t on t.window_id=e.window_id and t.event_type=e.event_type where src_key<>dst_key""", DAY_NODES + """,
  dtypes as (select window_id, event_type, row_number() over (partition by window_id order by t)-1 as edge_type_id from
   (select window_id, event_type, min(row(ts_s,event_id)) as t from wd where src_key<>dst_key group by 1,2))"""))
def per_window_edges(spark, sf):
    return day_graph_edges(spark, sf).select("window_id", "edge_id", "src", "dst", "event_type", "edge_type_id")


def day_graph_edges(spark, sf, keep=()):
    events = day_windows(spark, sf)
    kept = G.remove_self_loops(events)
    per = ["window_id"]
    return G.build_edges(kept, G.build_nodes(events, per), G.edge_type_dict(kept, per), per, keep)


@query("window_sizes", pe("""select count(*) as windows, min(n) as min_events, max(n) as max_events, cast(floor(avg(n)) as bigint) as avg_events
  from (select count(*) as n from wd group by window_id)""", DAYS))
def window_sizes(spark, sf):
    return W.window_sizes(day_windows(spark, sf))


_TOTALS = """select 'graphs' as kind, cast(null as varchar) as type, count(distinct window_id) as n from wd
 union all select 'events', event_type, count(*) from wd group by rollup(event_type)
 union all select 'nodes', t, count(*) from (select distinct window_id, entity_key, split_part(entity_key,':',1) as t from
   (select window_id, src_key as entity_key from wd union all select window_id, dst_key from wd)) group by rollup(t)
 union all select 'edges', event_type, count(*) from wd where src_key<>dst_key group by rollup(event_type)"""


@query("totals", pe(_TOTALS, DAYS))
def totals(spark, sf):
    windowed = day_windows(spark, sf)
    return W.totals(windowed, G.remove_self_loops(windowed))


@query("sliding", pe(f"""select win as window_id, round({T0}+win*1800.0,6) as window_start, count(*) as num_edges, count(distinct dst_key) as targets
 from (select *, unnest(range(greatest(cast(floor((ts_s-{T0}-3600.0)/1800.0) as bigint)+1, 0), cast(floor((ts_s-{T0})/1800.0) as bigint)+1)) as win from pe)
 group by 1"""))
def sliding(spark, sf):
    slid = W.sliding_windows(prov_events(spark, sf), 3600, stride=1800)
    return slid.groupBy("window_id", r6("window_start").alias("window_start")).agg(
        F.count(F.lit(1)).alias("num_edges"), F.countDistinct("dst_key").alias("targets")
    )


@query("undirected", pe("""select a, b, count(*) as n from (select src_key as a, dst_key as b from pe union all select dst_key, src_key from pe) group by 1,2"""))
def undirected(spark, sf):
    both = G.to_undirected(prov_events(spark, sf), "src_key", "dst_key")
    return both.groupBy(F.col("src_key").alias("a"), F.col("dst_key").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_edges", pe("""select window_id, src_key as src, dst_key as dst, event_type, min(event_id) as edge_id, round(min(ts_s),6) as ts_s
  from wd group by 1,2,3,4""", DAYS))
def dedupe_edges(spark, sf):
    windowed = day_windows(spark, sf).select(
        "window_id", F.col("src_key").alias("src"), F.col("dst_key").alias("dst"), "event_type",
        F.col("event_id").alias("edge_id"), "ts_s", F.create_map(F.lit("k"), F.col("k").cast("string")).alias("attributes"),
    )
    return G.transform_graph(windowed, "deduplicate", ["window_id"]).withColumn("ts_s", r6("ts_s")).drop("attributes")


@query("attach_scores", pe("""select pe.event_id, src_key, dst_key, round(s.score,6) as score from pe join sc s on s.event_id=pe.event_id and s.model='m3'
  where src_key<>dst_key""", SCORES_SQL))
def attach_scores(spark, sf):
    edges = G.remove_self_loops(prov_events(spark, sf)).select("event_id", "src_key", "dst_key")
    scores = prov_scores(spark, sf).where("model = 'm3'").select("event_id", r6("score").alias("score"))
    return G.attach_scores(edges, scores, "event_id")


@query("simple_digraph", pe("""select src_key, dst_key, event_id, event_type, score, coalesce(t.entity_type,'unknown') as dst_type
  from dg left join (select distinct src_key, split_part(src_key,':',1) as entity_type from pe) t on t.src_key=dg.dst_key""".replace("select src_key,", "select dg.src_key,", 1), DIGRAPH))
def simple_digraph(spark, sf):
    events = prov_events(spark, sf)
    graph = G.simple_digraph(events)
    sources = events.select(F.col("src_key").alias("entity_key"), G.entity_type(F.col("src_key")).alias("entity_type")).distinct()
    typed = G.digraph_nodes(graph, sources).select(F.col("entity_key").alias("dst_key"), F.col("entity_type").alias("dst_type"))
    return graph.join(typed, "dst_key").select("src_key", "dst_key", "event_id", "event_type", "score", "dst_type")


@query("simple_digraph_max", pe("select src_key, dst_key, max(score) as score, count(*) as parallel from pe group by 1,2"))
def simple_digraph_max(spark, sf):
    events = prov_events(spark, sf)
    counts = events.groupBy("src_key", "dst_key").agg(F.count(F.lit(1)).alias("parallel"))
    return G.simple_digraph(events, "max_score").select("src_key", "dst_key", "score").join(counts, ["src_key", "dst_key"])


@query("min_events_windows", pe("""select window_id, count(*) as n from (select *, cast(floor((ts_s-(select min(ts_s) from pe))/3600.0) as bigint) as window_id from pe)
  group by 1 having count(*) >= 12"""))
def min_events_windows(spark, sf):
    kept = W.filter_small_windows(W.tumbling_windows(prov_events(spark, sf), 3600), 12)
    return kept.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))


@query("limit_windows", pe("select window_id, event_id from wd where window_id in (select distinct window_id from wd order by 1 limit 5)", DAYS))
def limit_windows(spark, sf):
    return W.limit_windows(day_windows(spark, sf), 5).select("window_id", "event_id")


@query("snapshots", pe("select snapshot, count(*) as n, round(avg(score),6) as mean_score, min(event_id) as first_event from (select *, ntile(7) over (order by ts_s, event_id)-1 as snapshot from pe) group by 1"))
def snapshots(spark, sf):
    snapped = W.snapshots(prov_events(spark, sf), 7)
    sizes = snapped.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return sizes.join(W.pool_snapshots(snapped, "score", "mean"), "snapshot").select(
        "snapshot", "n", r6("score").alias("mean_score"), "first_event"
    )


@query("temporal_batches", pe("""select batch, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from
  (select event_id, cast(floor((row_number() over (order by ts_s, event_id)-1)/1024) as bigint) as batch from pe) group by 1"""))
def temporal_batches(spark, sf):
    return W.temporal_batches(prov_events(spark, sf), 1024).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")
    )


@query("self_loops_added", pe("""select src_key, count(*) as out_edges from (select src_key, dst_key from pe where src_key<>dst_key
  union all select k, k from (select src_key as k from pe union select dst_key from pe)) group by 1"""))
def self_loops_added(spark, sf):
    events = prov_events(spark, sf)
    nodes = G.endpoints(events).select("entity_key").distinct()
    return G.add_self_loops(G.remove_self_loops(events), nodes).groupBy("src_key").agg(F.count(F.lit(1)).alias("out_edges"))


@query("batch_offsets", pe("""select window_id, batch, edge_id, a + off as src, b + off as dst from (
   select w.window_id, event_id as edge_id, a.node_id as a, b.node_id as b, batch, off from wd w join dnodes a on a.window_id=w.window_id and a.entity_key=src_key
   join dnodes b on b.window_id=w.window_id and b.entity_key=dst_key join offs o on o.window_id=w.window_id where src_key<>dst_key)""", DAY_NODES + """,
  sizes as (select window_id, count(*) as m, (row_number() over (order by window_id)-1)//8 as batch from dnodes
     where window_id in (select window_id from wd where src_key<>dst_key) group by 1),
  offs as (select window_id, batch, cast(coalesce(sum(m) over (partition by batch order by window_id rows between unbounded preceding and 1 preceding),0) as bigint) as off from sizes)"""))
def batch_offsets(spark, sf):
    events = day_windows(spark, sf)
    nodes = G.build_nodes(events, ["window_id"])
    _, edges = W.batch_graphs(nodes, day_graph_edges(spark, sf), 8)
    return edges.select("window_id", "batch", "edge_id", "src", "dst")


@query("cap_nodes", pe("""select e.window_id, count(*) as edges_kept from de e join kept a on a.window_id=e.window_id and a.node_id=e.src
  join kept b on b.window_id=e.window_id and b.node_id=e.dst group by 1""", DAY_NODES + """,
  de as (select e.window_id, event_id, a.node_id as src, b.node_id as dst from wd e join dnodes a on a.window_id=e.window_id and a.entity_key=src_key
     join dnodes b on b.window_id=e.window_id and b.entity_key=dst_key where src_key<>dst_key),
  kept as (select n.window_id, n.node_id from dnodes n left join (select window_id, v, count(*) as d from (select window_id, src as v from de union all
     select window_id, dst from de) group by 1,2) g on g.window_id=n.window_id and g.v=n.node_id
     qualify row_number() over (partition by n.window_id order by coalesce(d,0) desc, n.node_id) <= 40)"""))
def cap_nodes(spark, sf):
    nodes = G.build_nodes(day_windows(spark, sf), ["window_id"])
    _, edges = G.cap_nodes(nodes, day_graph_edges(spark, sf), 40)
    return edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("edges_kept"))
