"""Attack graph reconstruction and graph measures (inventory groups I and E12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.operators import attack as K
from spoorline.operators import graph as G
from spoorline.operators import graphalgo as A
from spoorline.operators.ranking import percentile_of
from spoorline.plans.fixtures import prov_events
from spoorline.plans.graph_queries import DIGRAPH
from spoorline.plans.registry import pe, query, r6
from spoorline.session import cut
from spoorline.sources import sinks
from spoorline.plans.metric_queries import rounded

LEVELS = 12

THR = f"{DIGRAPH}, thr as materialized (select quantile_cont(score,0.95) as t from pe), an as materialized (select dg.* from dg, thr where score>=t)"


def _step(name, near, far, frontier, members):
    return f"""{name} as materialized (select * exclude r from (select dg.*, row_number() over (partition by {near} order by score desc, event_id desc) as r from dg where {near} in (select v from {frontier})) x, thr
    where r<=10 and (score>0.3*t or {far} in (select v from {members})))"""


AG = f"""{THR},
 tp as materialized (select * from an order by score desc, event_id desc limit 100),
 seeds as materialized (select distinct unnest([src_key,dst_key]) as v from (select * from tp order by score desc, event_id desc limit 50)),
 m0 as materialized (select distinct unnest([src_key,dst_key]) as v from tp),
 {_step('b1', 'dst_key', 'src_key', 'seeds', 'm0')}, m1 as materialized (select v from m0 union select src_key from b1),
 q1 as materialized (select src_key as v from b1 except select v from seeds), {_step('b2', 'dst_key', 'src_key', 'q1', 'm1')},
 m2 as materialized (select v from m1 union select src_key from b2),
 {_step('f1', 'src_key', 'dst_key', 'seeds', 'm2')}, m3 as materialized (select v from m2 union select dst_key from f1),
 q2 as materialized (select dst_key as v from f1 except select v from seeds), {_step('f2', 'src_key', 'dst_key', 'q2', 'm3')},
 age as materialized (select src_key, dst_key, event_id, event_type, ts_s, score, case max(p) when 0 then 'seed' when 1 then 'backward' else 'forward' end as provenance from (
   select * , 0 as p from tp union all select * exclude t, 1 from b1 union all select * exclude t, 1 from b2 union all select * exclude t, 2 from f1 union all select * exclude t, 2 from f2) group by all),
 agn as materialized (select v as entity_key, split_part(v,':',1) as entity_type from (select v from m3 union select dst_key from f2))"""

def attack_graph(spark, sf):
    events = prov_events(spark, sf)
    threshold = events.select(percentile_of(events, "score", 0.95).alias("t")).limit(1).first()["t"]
    return K.reconstruct(G.simple_digraph(events), threshold)


def digraph(spark, sf):
    return G.simple_digraph(prov_events(spark, sf))


@query("anomalous_edges", pe("select src_key, dst_key, event_id, score from an", THR))
def anomalous_edges(spark, sf):
    events = prov_events(spark, sf)
    cut_at = percentile_of(events, "score", 0.95)
    return K.anomalous_edges(G.simple_digraph(events), cut_at).select("src_key", "dst_key", "event_id", "score")


@query("seed_subgraph", pe("select src_key, dst_key, event_id, score from an order by score desc, event_id desc limit 100", THR))
def seed_subgraph(spark, sf):
    events = prov_events(spark, sf)
    found = K.anomalous_edges(G.simple_digraph(events), percentile_of(events, "score", 0.95))
    return K.seed_subgraph(found).select("src_key", "dst_key", "event_id", "score")


@query("seed_nodes", pe("select v as entity_key from seeds", AG))
def seed_nodes(spark, sf):
    events = prov_events(spark, sf)
    return K.seed_nodes(K.anomalous_edges(G.simple_digraph(events), percentile_of(events, "score", 0.95)))


@query("expand_backward", pe("select src_key, dst_key, event_id, 1 as level from b1 union all select src_key, dst_key, event_id, 2 from b2", AG))
def expand_backward(spark, sf):
    return attack_graph(spark, sf).backward.select("src_key", "dst_key", "event_id", "level")


@query("expand_forward", pe("select src_key, dst_key, event_id, 1 as level from f1 union all select src_key, dst_key, event_id, 2 from f2", AG))
def expand_forward(spark, sf):
    return attack_graph(spark, sf).forward.select("src_key", "dst_key", "event_id", "level")


@query("attack_edges", pe("select src_key, dst_key, event_id, score, provenance from age", AG))
def attack_edges(spark, sf):
    return attack_graph(spark, sf).edges.select("src_key", "dst_key", "event_id", "score", "provenance")


@query("cluster_entity", pe("select entity_key, entity_type as cluster from agn", AG))
def cluster_entity(spark, sf):
    return K.cluster_entity(attack_graph(spark, sf).nodes).select("entity_key", "cluster")


@query("cluster_time", pe("""select entity_key, case when t is null then 'time_unknown' else 'time_'||cast(floor((t-lo)/w) as bigint) end as cluster from agn
  left join (select src_key as entity_key, avg(ts_s) as t from age group by 1) using (entity_key), (select min(ts_s) as lo, (max(ts_s)-min(ts_s))/10 as w from age)""", AG))
def cluster_time(spark, sf):
    ag = attack_graph(spark, sf)
    return K.cluster_time(ag.nodes, ag.edges).select("entity_key", "cluster")


REACH = """und as materialized (select src_key as u, dst_key as v from age union select dst_key, src_key from age),
 reach as (select entity_key as a, entity_key as b from agn union select r.a, und.v from reach r join und on und.u=r.b),
 comp as materialized (select a as node, min(b) as component from reach group by 1)"""


@query("components", pe("select node as entity_key, component from comp", f"""kk as (select src_key as e from pe union select dst_key from pe),
  und as materialized (select src_key as u, dst_key as v from pe union select dst_key, src_key from pe),
  reach as (select e as a, e as b from kk union select r.a, und.v from reach r join und on und.u=r.b),
  comp as (select a as node, min(b) as component from reach group by 1)"""))
def components(spark, sf):
    return A.connected_components(prov_events(spark, sf).select("src_key", "dst_key")).select(F.col("node").alias("entity_key"), "component")


@query("cluster_path", pe("select node as entity_key, 'path_'||(dense_rank() over (order by component)-1) as cluster from comp", AG + "," + REACH))
def cluster_path(spark, sf):
    ag = attack_graph(spark, sf)
    return K.cluster_path(ag.nodes, ag.edges).select("entity_key", "cluster")


@query("ag_degrees", pe("""select entity_key, (select count(*) from age where dst_key=entity_key) as in_degree, (select count(*) from age where src_key=entity_key) as out_degree from agn""", AG))
def ag_degrees(spark, sf):
    ag = attack_graph(spark, sf)
    return K.graph_degrees(ag.nodes, ag.edges).select("entity_key", "in_degree", "out_degree")


def pagerank_sql(nodes, edges, rounds=100):
    return f"""prp as materialized (select distinct src_key, dst_key from {edges}),
 prw as materialized (select src_key, dst_key, 0.85/count(*) over (partition by src_key) as share from prp union all select entity_key, entity_key, 0.0 from {nodes}),
 pri as (select 0 as r, entity_key as node, 0.15::double as y from {nodes} union all
   select p.r+1, w.dst_key, 0.15::double+sum(w.share*p.y) from pri p join prw w on w.src_key=p.node where p.r<{rounds} group by p.r, w.dst_key),
 pgr as materialized (select node as entity_key, y/sum(y) over () as pagerank from pri where r={rounds})"""


@query("pagerank", pe("select entity_key, round(pagerank,6) as pagerank from pgr", AG + "," + pagerank_sql("agn", "age")))
def pagerank(spark, sf):
    ag = attack_graph(spark, sf)
    return rounded(A.pagerank(ag.edges, ag.nodes, tol=1e-10), "pagerank")


@query("pagerank_feature", pe("select entity_key, round(pagerank,6) as pagerank from pgr",
       "alln as (select src_key as entity_key from pe union select dst_key from pe)," + pagerank_sql("alln", "pe")))
def pagerank_feature(spark, sf):
    events = prov_events(spark, sf)
    nodes = G.endpoints(events).select("entity_key").distinct()
    return rounded(A.pagerank(events, nodes, tol=1e-10), "pagerank")


def brandes_sql(k=LEVELS):
    parts = ["adj as materialized (select src_key as v, dst_key as w from age where src_key<>dst_key union select dst_key, src_key from age where src_key<>dst_key)",
             "l0 as materialized (select entity_key as s, entity_key as v, 1.0::double as sigma from agn)"]
    for i in range(1, k + 1):
        seen = " union all ".join(f"select s, v from l{j}" for j in range(i))
        parts.append(f"l{i} as materialized (select x.s, a.w as v, sum(x.sigma) as sigma from l{i - 1} x join adj a on a.v=x.v where (x.s, a.w) not in ({seen}) group by 1,2)")
    parts.append(f"d{k} as materialized (select s, v, sigma, 0.0::double as d from l{k})")
    for i in range(k - 1, 0, -1):
        parts.append(f"""d{i} as materialized (select l.s, l.v, l.sigma, coalesce(c.d,0.0)::double as d from l{i} l left join (
          select l2.s, l2.v, sum(l2.sigma/x.sigma*(1+x.d)) as d from d{i + 1} x join adj a on a.w=x.v join l{i} l2 on l2.s=x.s and l2.v=a.v group by 1,2) c on c.s=l.s and c.v=l.v)""")
    total = " union all ".join(f"select v, d from d{i}" for i in range(1, k + 1))
    parts.append(f"""btw as materialized (select entity_key, coalesce(b.d,0.0)/((n-1)*(n-2)) as betweenness from agn left join (select v, sum(d) as d from ({total}) group by 1) b on b.v=agn.entity_key,
      (select count(*)::double as n from agn))""")
    return ",\n".join(parts)


BTW = AG + ",\n" + brandes_sql()
IMP = BTW + "," + pagerank_sql("agn", "age") + ", imp as materialized (select entity_key, betweenness, pagerank, 0.5*betweenness+0.5*pagerank as importance from btw join pgr using (entity_key))"
KEYS = IMP + ", keys as materialized (select entity_key, round(importance,9) as i9, cast(row_number() over (order by round(importance,9) desc, entity_key) as integer) as rank from imp qualify rank<=15)"


@query("betweenness", pe("select entity_key, round(betweenness,6) as betweenness from btw", BTW))
def betweenness(spark, sf):
    ag = attack_graph(spark, sf)
    return rounded(A.betweenness(ag.edges, ag.nodes), "betweenness")


def scored_nodes(spark, sf):
    ag = attack_graph(spark, sf)
    return cut(K.importance(ag.nodes, ag.edges, tol=1e-11))


@query("importance", pe("select entity_key, round(importance,6) as importance from imp", IMP))
def importance(spark, sf):
    return rounded(scored_nodes(spark, sf).select("entity_key", "importance"), "importance")


@query("key_nodes", pe("select entity_key, rank from keys", KEYS))
def key_nodes(spark, sf):
    return K.key_nodes(scored_nodes(spark, sf), 15, places=9).select("entity_key", "rank")


_PATHS = KEYS + """, sp as (select [entity_key] as path, []::double[] as scores, rank as fr, entity_key as last from keys
  union all select list_append(path, dst_key), list_append(scores, score), fr, dst_key from sp join (select * from age where src_key<>dst_key) e on e.src_key=sp.last
    where len(path)<=6 and not list_contains(path, dst_key)),
 scp as materialized (select path[1] as first, last, path, (0.7*list_max(scores)+0.3*list_avg(scores))/log2(len(path)+1) as score from sp join keys on keys.entity_key=sp.last where len(path)>=2 and keys.rank>fr),
 bp as materialized (select * from scp qualify row_number() over (partition by first, last order by round(score,9) desc, path)<=3)"""


def paths(spark, sf):
    ag = attack_graph(spark, sf)
    keys = K.key_nodes(scored_nodes(spark, sf), 15, places=9)
    return K.attack_paths(ag.edges, keys, places=9)


@query("simple_paths", pe("select first, last, count(*) as paths, max(len(path)) as longest from scp group by 1,2", _PATHS))
def simple_paths(spark, sf):
    ag = attack_graph(spark, sf)
    keys = K.key_nodes(scored_nodes(spark, sf), 15, places=9)
    every = A.simple_paths(ag.edges, keys)
    return every.groupBy("first", "last").agg(F.count(F.lit(1)).alias("paths"), F.max(F.size("path")).cast("long").alias("longest"))


@query("path_scores", pe("select array_to_string(path,'>') as path, round(score,6) as score, len(path) as length from bp", _PATHS))
def path_scores(spark, sf):
    return paths(spark, sf).select(F.array_join("path", ">").alias("path"), r6("score").alias("score"), F.col("length").cast("long").alias("length"))


_TOP = _PATHS + ", tops as materialized (select *, cast(row_number() over (order by round(score,9) desc, path) as integer) as rank from bp qualify rank<=10)"


@query("top_paths", pe("select rank, array_to_string(path,'>') as path, round(score,6) as score from tops", _TOP))
def top_paths(spark, sf):
    return K.top_paths(paths(spark, sf), places=9).select("rank", F.array_join("path", ">").alias("path"), r6("score").alias("score"))


@query("path_details", pe("""select t.rank, p.i-1 as pos, t.path[p.i] as src_key, split_part(t.path[p.i],':',1) as entity_type, round(imp.importance,6) as importance, age.dst_key, age.event_type, round(age.score,6) as edge_score
  from tops t, range(1,8) p(i) join imp on imp.entity_key=t.path[p.i] left join age on age.src_key=t.path[p.i] and age.dst_key=t.path[p.i+1] where p.i<=len(t.path)""", _TOP))
def path_details(spark, sf):
    ag = attack_graph(spark, sf)
    best = cut(K.top_paths(paths(spark, sf), places=9))
    detail = K.path_details(best, scored_nodes(spark, sf), ag.edges)
    node, edge = F.col("n"), F.try_element_at("edges", F.col("n.pos") + 1)
    return detail.select("rank", "edges", F.explode("nodes").alias("n")).select(
        "rank", node["pos"].cast("long").alias("pos"), node["entity_key"].alias("src_key"), node["entity_type"].alias("entity_type"),
        r6(node["importance"]).alias("importance"), edge["dst_key"].alias("dst_key"), edge["event_type"].alias("event_type"),
        r6(edge["score"]).alias("edge_score"),
    )


@query("graph_stats", pe("select (select count(*) from agn) as nodes, (select count(*) from age) as edges, (select count(distinct component) from comp) as components, round((select count(*) from age)/((select count(*) from agn)*((select count(*) from agn)-1)),6) as density", AG + "," + REACH))
def graph_stats(spark, sf):
    ag = attack_graph(spark, sf)
    return rounded(K.graph_stats(ag.nodes, ag.edges), "density").select("nodes", "edges", "components", "density")


@query("edge_band", pe("select src_key, dst_key, case when score/(select max(score) from pe)>0.8 then 'high' when score/(select max(score) from pe)>0.5 then 'medium' else 'low' end as band from dg", DIGRAPH))
def edge_band(spark, sf):
    events = prov_events(spark, sf)
    top = events.agg(F.max("score")).scalar()
    return G.simple_digraph(events).select("src_key", "dst_key", K.edge_band(F.col("score") / top).alias("band"))


@query("display_name", """select doc_id, case when length(substr(text,1,50))>40 then substr(text,1,37)||'...' else substr(text,1,50) end as short from documents""")
def display_name(spark, sf):
    from spoorline.plans.fixtures import table

    return table(spark, sf, "documents").select("doc_id", K.display_name(F.col("text")).alias("short"))


@query("composition", pe("""select 'node' as kind, entity_type as type, count(*) as n from agn group by 2 union all select 'edge', event_type, count(*) from age group by 2
  union all select 'span', 'seconds', cast(floor(max(ts_s)-min(ts_s)) as bigint) from age""", AG))
def composition(spark, sf):
    ag = attack_graph(spark, sf)
    one = K.composition(ag.nodes, ag.edges)
    nodes = one.select(F.lit("node").alias("kind"), F.explode("node_types").alias("type", "n"))
    edges = one.select(F.lit("edge").alias("kind"), F.explode("edge_types").alias("type", "n"))
    span = one.select(F.lit("span").alias("kind"), F.lit("seconds").alias("type"), F.floor(F.col("last_ts") - F.col("first_ts")).alias("n"))
    return nodes.unionByName(edges).unionByName(span)


@query("trace", pe("select anomaly, hop, event_id, src_key, dst_key, score from tr", f"""{THR}, bst as materialized (select * from dg where score>=0.5 and src_key<>dst_key qualify row_number() over (partition by dst_key order by score desc, event_id desc)=1),
  tr as (select event_id as anomaly, 0 as hop, event_id, src_key, dst_key, score, [src_key,dst_key] as path from an
   union all select anomaly, hop+1, b.event_id, b.src_key, b.dst_key, b.score, list_append(path, b.src_key) from tr join bst b on b.dst_key=tr.src_key where hop<5 and not list_contains(path, b.src_key))"""))
def trace(spark, sf):
    events = prov_events(spark, sf)
    graph = cut(G.simple_digraph(events))
    starts = K.anomalous_edges(graph, percentile_of(events, "score", 0.95))
    return K.trace(graph, starts).select("anomaly", "hop", "event_id", "src_key", "dst_key", "score")


@query("attack_summary_json", pe("""select 'm1' as model, (select count(*) from agn) as nodes, (select count(*) from age) as edges, (select count(*) from pe) as events, (select count(*) from tops where rank<=5) as listed_paths,
  (select round(max(score),6) from bp) as best_path""", _TOP))
def attack_summary_json(spark, sf):
    from spoorline.operators.metrics import score_stats
    from spoorline.session import scratch_path

    ag = attack_graph(spark, sf)
    best = K.top_paths(paths(spark, sf), places=9)
    name = F.lit("m1").alias("model")
    summary = sinks.attack_summary(
        K.graph_stats(ag.nodes, ag.edges).select(name, "*"), best.select(name, "*"),
        score_stats(prov_events(spark, sf)).select(name, "*"),
    )
    path = scratch_path(spark, "summary")
    sinks.save_attack_summary(summary, path)
    v = F.from_json("value", "graph struct<nodes:long,edges:long>, anomalies struct<n:long>, top_paths array<struct<rank:int,score:double>>")
    return spark.read.text(path).select("model", v.alias("v")).select(
        "model", "v.graph.nodes", "v.graph.edges", F.col("v.anomalies.n").alias("events"), F.size("v.top_paths").cast("long").alias("listed_paths"),
        r6(F.array_max("v.top_paths.score")).alias("best_path"),
    )
