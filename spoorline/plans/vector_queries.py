"""Neighbourhood propagation and scoring with small fixed weights (inventory groups F and G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.functions import vectors as V
from spoorline.functions.draws import draw_sql
from spoorline.operators import metrics as M
from spoorline.operators import neighbours as N
from spoorline.operators import propagate as P
from spoorline.operators import scoring as S
from spoorline.plans.fixtures import SCORES_SQL, VECTORS_SQL, node_vectors, prov_events, prov_scores, prov_vectors
from spoorline.plans.registry import pe, query, r6
from spoorline.session import cut

SIZE = 64  # entries of a given vector


def weights(rows, columns, seed):
    """Small example weights by formula, the same for both engines."""
    return [[((seed + 7 * i + 3 * j + i * j) % 11 - 5) / 20 for j in range(columns)] for i in range(rows)]


A, B = weights(2, SIZE, 1), weights(2, SIZE, 4)
BIAS = [0.1, -0.2]
C = [[0.5, -1.0], [0.75, 0.25]]


def numbers(row):
    return "[" + ", ".join(map(repr, row)) + "]::double[]"


def mv(w, v, b=None):
    """SQL list of ``W v + b``."""
    rows = [f"list_dot_product({numbers(row)}, {v})" for row in w]
    return "[" + ", ".join(f"{r}{f' + ({b[i]})' if b else ''}" for i, r in enumerate(rows)) + "]"


def each(template, sep=", "):
    """The template for every entry, its 1-based position at ``#``."""
    return sep.join(template.replace("#", str(i)) for i in range(1, SIZE + 1))


ZEROS = numbers([0.0] * SIZE)


def act(lst, body):
    return f"list_transform({lst}, lambda x: {body})"


RELU = "greatest(x, 0.0::double)"
VV = VECTORS_SQL
MEAN = f"""{VV}, msg as (select dst_key as entity_key, [{each('avg(v.vec[#])')}] as mean, [{each('sum(v.vec[#])')}] as s
  from pe join nn v on v.entity_key=src_key group by 1),
 n as materialized (select nn.entity_key, vec, coalesce(mean,{ZEROS}) as mean, coalesce(s,{ZEROS}) as s from nn left join msg using (entity_key))"""


def entries(df, *keep, vec="vec"):
    """One row per vector entry, for comparison."""
    return df.select(*keep, F.posexplode(vec).alias("i", "x")).select(*keep, F.col("i").cast("long").alias("i"), r6("x").alias("x"))


def out(keep, source, dim=2):
    return f"select {keep}, i-1 as i, round(o[i],6) as x from ({source}), range(1,{dim + 1}) r(i)"


def nodes(spark, sf):
    return node_vectors(spark, sf)


def edges(spark, sf):
    return prov_events(spark, sf).select("event_id", "src_key", "dst_key", "label")


_SAGE = "list_transform([{0}], lambda x: greatest(x,0.0::double))".format(
    ", ".join(f"{mv([A[i]], 'vec')[1:-1]} + {mv([B[i]], 'mean')[1:-1]} + ({BIAS[i]})" for i in range(2)))


@query("sage_layer", pe(out("entity_key", f"select entity_key, {_SAGE} as o from n"), MEAN))
def sage_layer(spark, sf):
    return entries(P.sage_mean(nodes(spark, sf), edges(spark, sf), A, B, BIAS, "relu"), "entity_key")


_MIXED = f"[{each('1.1*vec[#]+s[#]')}]"


@query("gin_layer", pe(out("entity_key", f"select entity_key, {mv(C, 'h')} as o from (select entity_key, {act(mv(A, 'm', BIAS), RELU)} as h from (select entity_key, {_MIXED} as m from n))"), MEAN))
def gin_layer(spark, sf):
    layers = [(A, BIAS), (C, [0.0, 0.0])]
    return entries(P.gin_sum(nodes(spark, sf), edges(spark, sf), layers, 0.1), "entity_key")


_HEADS = [{"w": A, "a_src": [0.5, -0.5], "a_dst": [1.0, 0.25]}, {"w": B, "a_src": [-0.25, 0.75], "a_dst": [0.5, 0.5]}]


def _gat_head(i):
    h = _HEADS[i]
    s = mv([h["a_src"]], f"a.h{i}")[1:-1]
    t = mv([h["a_dst"]], f"b.h{i}")[1:-1]
    return f"""e{i} as (select dst_key, a.h{i} as m, case when {s}+{t}>=0 then {s}+{t} else 0.2*({s}+{t}) end as e from pairs
      join hh a on a.entity_key=src_key join hh b on b.entity_key=dst_key),
     g{i} as (select dst_key as entity_key, [sum(exp(e-t)*m[1])/sum(exp(e-t)), sum(exp(e-t)*m[2])/sum(exp(e-t))] as o{i} from e{i}
       join (select dst_key, max(e) as t from e{i} group by 1) using (dst_key) group by 1)"""


_GAT = f"""{VV}, hh as (select entity_key, {mv(A, 'vec')} as h0, {mv(B, 'vec')} as h1 from nn),
  pairs as (select src_key, dst_key from pe where src_key<>dst_key union all select entity_key, entity_key from nn), {_gat_head(0)}, {_gat_head(1)}"""


@query("gat_layer", pe(out("entity_key", "select entity_key, list_concat(o0,o1) as o from g0 join g1 using (entity_key)", 4), _GAT))
def gat_layer(spark, sf):
    return entries(P.gat_attention(nodes(spark, sf), edges(spark, sf), _HEADS), "entity_key")


_WE = [[0.5], [-1.0]]
_TR = f"""{VV}, hh as (select entity_key, {mv(A, 'vec')} as q, {mv(B, 'vec')} as k, {mv(A, 'vec', BIAS)} as v0 from nn),
  pairs as (select src_key, dst_key, score/500.0 as t from pe),
  e as (select dst_key, (b.q[1]*(a.k[1]+0.5*t) + b.q[2]*(a.k[2]-t))/sqrt(2.0) as e, [a.k[1]+0.5*t, a.k[2]-t] as m from pairs
    join hh a on a.entity_key=src_key join hh b on b.entity_key=dst_key),
  g as (select dst_key as entity_key, [sum(exp(e-t)*m[1])/sum(exp(e-t)), sum(exp(e-t)*m[2])/sum(exp(e-t))] as o from e
    join (select dst_key, max(e) as t from e group by 1) using (dst_key) group by 1)"""


@query("transformer_layer", pe(out("entity_key", f"select entity_key, [{mv([A[0]], 'vec')[1:-1]} + coalesce(o[1],0), {mv([A[1]], 'vec')[1:-1]} + coalesce(o[2],0)] as o from nn left join g using (entity_key)"), _TR))
def transformer_layer(spark, sf):
    typed = prov_events(spark, sf).select("src_key", "dst_key", F.array(F.col("score") / 500.0).alias("edge_vec"))
    return entries(P.transformer_attention(nodes(spark, sf), typed, A, B, B, A, _WE), "entity_key")


@query("time_encode", pe(out("event_id", "select event_id, [cos(0.001*t+0.5), cos(0.1*t-1.0)] as o from (select event_id, ts_s-1704067200 as t from pe)")))
def time_encode(spark, sf):
    t = F.col("ts_s") - 1704067200
    return entries(prov_events(spark, sf).select("event_id", P.time_encode(t, [0.001, 0.1], [0.5, -1.0]).alias("vec")), "event_id")


@query("mlp", pe(out("entity_key", f"select entity_key, {act(mv(C, 'h', BIAS), '1/(1+exp(-x))')} as o from (select entity_key, {act(mv(A, 'vec', BIAS), RELU)} as h from nn)"), VV))
def mlp(spark, sf):
    out_vec = P.mlp(F.col("vec"), [(A, BIAS), (C, BIAS)], final="sigmoid")
    return entries(nodes(spark, sf).select("entity_key", out_vec.alias("vec")), "entity_key")


@query("pool", pe("select how, label, i-1 as i, round(case how when 'sum' then s[i] when 'mean' then s[i]/n else m[i] end,6) as x from (select label, count(*) as n, [" + each("sum(vec[#])") + "] as s, [" + each("max(vec[#])") + "] as m from vv group by 1), (values ('sum'),('mean'),('max')) h(how), range(1,65) r(i)", VV))
def pool(spark, sf):
    vectors = prov_vectors(spark, sf)
    parts = [
        entries(P.pool(vectors, SIZE, how, ["label"]).withColumn("how", F.lit(how)), "how", "label") for how in ("sum", "mean", "max")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_COMB = """select entity_key, how, i-1 as i, round(case how when 'sum' then a[i]+b[i] when 'mean' then (a[i]+b[i])/2 when 'max' then greatest(a[i],b[i]) else list_concat(a,b)[i] end,6) as x
 from (select entity_key, {a} as a, {b} as b from nn), (values ('concat',4),('sum',2),('mean',2),('max',2)) h(how,len), range(1,5) r(i) where i<=len"""


@query("combine", pe(_COMB.format(a=mv(A, "vec"), b=mv(B, "vec")), VV))
def combine(spark, sf):
    both = nodes(spark, sf).select("entity_key", V.matvec(A, F.col("vec")).alias("a"), V.matvec(B, F.col("vec")).alias("b"))
    forms = F.array(*[
        F.struct(F.lit(how).alias("how"), P.combine([F.col("a"), F.col("b")], how).alias("vec")) for how in ("concat", "sum", "mean", "max")
    ])
    return entries(both.select("entity_key", F.inline(forms)), "entity_key", "how")


_ERF = "(sign(z)*(1-((((1.061405429*t-1.453152027)*t+1.421413741)*t-0.284496736)*t+0.254829592)*t*exp(-z*z)))"
_ACTS = {
    "relu": "greatest(x,0.0::double)", "leaky_relu": "case when x>=0 then x else 0.01*x end", "prelu": "case when x>=0 then x else 0.25*x end",
    "elu": "case when x>0 then x else exp(x)-1 end", "gelu": f"0.5*x*(1+{_ERF})", "tanh": "tanh(x)", "sigmoid": "1/(1+exp(-x))",
    "identity": "x", "no_such_name": "greatest(x,0.0::double)",
}


@query("activations", pe("select event_id, " + ", ".join(f"round({b},6)+0.0 as {n}" for n, b in _ACTS.items()) +
       " from (select event_id, x, x/sqrt(2.0) as z, 1/(1+0.3275911*abs(x/sqrt(2.0))) as t from (select event_id, (score-50)/25.0 as x from pe))"))
def activations(spark, sf):
    x = (F.col("score") - 50) / 25.0
    return prov_events(spark, sf).select("event_id", *[(r6(V.activate(n, x)) + 0.0).alias(n) for n in _ACTS])


_NORM = f"""st as (select [{each('avg(vec[#])')}] as m, [{each('var_pop(vec[#])')}] as s from nn),
 rw as (select entity_key, vec, list_avg(vec) as m, list_var_pop(vec) as s from nn)"""


@query("feature_norm", pe("""select entity_key, 'batch' as kind, i-1 as i, round((vec[i]-m[i])/sqrt(s[i]+1e-5),6) as x from nn, st, range(1,65) r(i)
  union all select entity_key, 'layer', i-1, round((vec[i]-m)/sqrt(s+1e-5),6) from rw, range(1,65) r(i)""", VV + "," + _NORM))
def feature_norm(spark, sf):
    parts = [entries(P.feature_norm(nodes(spark, sf), "vec", SIZE, k).withColumn("kind", F.lit(k)), "entity_key", "kind") for k in ("batch", "layer")]
    return parts[0].unionByName(parts[1])


@query("residual", pe(out("entity_key", f"select entity_key, [h[1]+g[1], h[2]+g[2]] as o from (select entity_key, {mv(A, 'vec')} as h, {mv(C, mv(A, 'vec'))} as g from nn)"), VV))
def residual(spark, sf):
    h = V.matvec(A, F.col("vec"))
    return entries(nodes(spark, sf).select("entity_key", P.residual(h, V.matvec(C, h)).alias("vec")), "entity_key")


@query("sample_neighbors", pe(f"select dst_key, event_id from pe qualify row_number() over (partition by dst_key order by {draw_sql(42, 'event_id')}, event_id) <= 10"))
def sample_neighbors(spark, sf):
    return P.sample_neighbors(prov_events(spark, sf), 10).select("dst_key", "event_id")


_L2 = f"""{MEAN}, l1 as materialized (select entity_key, {_SAGE} as o from n),
 m2 as (select dst_key as entity_key, [avg(l.o[1]), avg(l.o[2])] as mean from pe join l1 l on l.entity_key=src_key group by 1),
 l2 as (select entity_key, [{mv([C[0]], 'o')[1:-1]} + {mv([C[1]], 'mean')[1:-1]}, {mv([C[1]], 'o')[1:-1]} + {mv([C[0]], 'mean')[1:-1]}] as o from (
   select l1.entity_key, o, coalesce(mean,[0.0,0.0]::double[]) as mean from l1 left join m2 using (entity_key)))"""


@query("layer_outputs", pe("select 1 as layer, " + out("entity_key", "select * from l1")[7:] + " union all select 2, " + out("entity_key", "select * from l2")[7:], _L2))
def layer_outputs(spark, sf):
    graph = edges(spark, sf)
    layers = [
        lambda x: P.sage_mean(x, graph, A, B, BIAS, "relu"),
        lambda x: P.sage_mean(x, graph, C, [C[1], C[0]]),
    ]
    return entries(P.layer_outputs(nodes(spark, sf), layers), "layer", "entity_key")


# scoring -----------------------------------------------------------------------------------------------------

ENDS = f"{VV}, ee as materialized (select event_id, pe.label, a.vec as s, b.vec as d from pe join nn a on a.entity_key=src_key join nn b on b.entity_key=dst_key)"
MLP6 = [(weights(2, 2 * SIZE, 2), BIAS), (C, [0.0, 0.1])]
_LOGITS = f"select event_id, label, {mv(C, 'h', [0.0, 0.1])} as g from (select event_id, label, {act(mv(MLP6[0][0], 'list_concat(s,d)', BIAS), RELU)} as h from ee)"


@query("edge_mlp", pe(f"select event_id, round(1/(1+exp(g[1]-g[2])),6) as score, round(1/(1+exp(-g[1])),6) as binary_score, round(g[2],6) as raw from ({_LOGITS})", ENDS))
def edge_mlp(spark, sf):
    logits = S.edge_score_mlp(edges(spark, sf), nodes(spark, sf), MLP6, "regression").withColumnRenamed("score", "logits")
    heads = {kind: S.class_scores(F.col("logits"), kind) for kind in ("classification", "binary")}
    return logits.select("event_id", r6(heads["classification"]).alias("score"), r6(heads["binary"]).alias("binary_score"), r6(F.col("logits")[1]).alias("raw"))


@query("node_probs", pe(out("entity_key", f"select entity_key, [exp(g[1])/(exp(g[1])+exp(g[2])), exp(g[2])/(exp(g[1])+exp(g[2]))] as o from (select entity_key, {mv(A, 'vec', BIAS)} as g from nn)"), VV))
def node_probs(spark, sf):
    return entries(S.node_class_probs(nodes(spark, sf), [(A, BIAS)]), "entity_key", vec="probs")


def windowed_vectors(spark, sf):
    """Consecutive vectors of one entity as its windows: ids 2e and 2e + 1 belong to entity e."""
    return prov_vectors(spark, sf).select(
        F.floor(F.col("vec_id") / 2).alias("entity_key"), (F.col("vec_id") % 2).alias("window_id"), "vec_id", "vec"
    )


_COS = "(list_dot_product(a.vec,b.vec)/greatest(sqrt(list_dot_product(a.vec,a.vec))*sqrt(list_dot_product(b.vec,b.vec)),1e-8))"


@query("temporal_similarity", pe(f"select a.vec_id//2 as entity_key, a.vec_id%2 as window_id, round({_COS}/0.07,6) as similarity from vv a join vv b on b.vec_id=a.vec_id-1 and a.vec_id%2=1", VV))
def temporal_similarity(spark, sf):
    out_df = S.temporal_similarity(windowed_vectors(spark, sf))
    return out_df.select("entity_key", "window_id", r6("similarity").alias("similarity"))


# every entry is rebuilt from itself and its right neighbour
_RW = [[0.9 if j == i else 0.1 if j == (i + 1) % SIZE else 0.0 for j in range(SIZE)] for i in range(SIZE)]
_RE = f"rb as materialized (select vec_id, vec, [{', '.join(f'0.9*vec[{i + 1}]+0.1*vec[{(i + 1) % SIZE + 1}]' for i in range(SIZE))}] as r from vv)"


def rebuilt(spark, sf):
    return prov_vectors(spark, sf).withColumn("rebuilt", V.matvec(_RW, F.col("vec")))


@query("reconstruction_error", pe("select vec_id, round(list_distance(vec,r),6) as score from rb", VV + "," + _RE))
def reconstruction_error(spark, sf):
    return S.reconstruction_error(rebuilt(spark, sf), "vec", "rebuilt").select("vec_id", r6("score").alias("score"))


@query("reconstruction_loss", pe("""select round(avg(pow(vec[i]-r[i],2)),6) as mse, round(avg(abs(vec[i]-r[i])),6) as mae,
  (select round(avg(1-list_dot_product(vec,r)/greatest(sqrt(list_dot_product(vec,vec))*sqrt(list_dot_product(r,r)),1e-8)),6) from rb) as cosine from rb, range(1,65) t(i)""", VV + "," + _RE))
def reconstruction_loss(spark, sf):
    losses = S.reconstruction_loss(rebuilt(spark, sf), "vec", "rebuilt")
    return losses.select(*[r6(c).alias(c) for c in losses.columns])


@query("pca_reconstruction", "select vec_id, 0.0::double as whole, true as shrinks from embeddings")
def pca_reconstruction(spark, sf):
    """With all directions a vector is rebuilt exactly, and more directions never rebuild it worse."""
    vectors = prov_vectors(spark, sf).select("vec_id", "vec")
    errors = {k: S.reconstruction_error(S.pca_reconstruct(vectors, "vec", k), "vec", "rebuilt").select("vec_id", F.col("score").alias(f"e{k}")) for k in (8, 32, SIZE)}
    both = errors[8].join(errors[32], "vec_id").join(errors[SIZE], "vec_id")
    return both.select("vec_id", (F.round(f"e{SIZE}", 5) + 0.0).alias("whole"), ((F.col("e8") >= F.col("e32") - 1e-9) & (F.col("e32") >= F.col(f"e{SIZE}") - 1e-9)).alias("shrinks"))


@query("centroid_distance", pe(f"select vec_id, round(list_distance(vec,c),6) as score from vv, (select [{each('avg(vec[#])')}] as c from vv where label=0)", VV))
def centroid_distance(spark, sf):
    return S.centroid_distance(prov_vectors(spark, sf), SIZE).select("vec_id", r6("score").alias("score"))


@query("inner_product", pe("select event_id, round(1/(1+exp(-list_dot_product(s,d))),6) as score from ee", ENDS))
def inner_product(spark, sf):
    return S.inner_product_score(edges(spark, sf), nodes(spark, sf)).select("event_id", r6("score").alias("score"))


_CEA = """select event_id, round(sc,6) as score, cast(sc>0.5 as integer) as prediction from (select event_id,
  1-list_dot_product(s,d)/greatest(sqrt(list_dot_product(s,s))*sqrt(list_dot_product(d,d)),1e-8) as sc from ee)"""


@query("cosine_anomaly", pe(_CEA, ENDS))
def cosine_anomaly(spark, sf):
    return S.cosine_edge_anomaly(edges(spark, sf), nodes(spark, sf)).select("event_id", r6("score").alias("score"), "prediction")


@query("endpoint_mean", pe("select event_id, round((list_max(s)+list_max(d))/2,6) as score, cast((list_max(s)+list_max(d))/2>0.5 as integer) as prediction from ee", ENDS))
def endpoint_mean(spark, sf):
    scored = nodes(spark, sf).select("entity_key", F.array_max("vec").alias("node_score"))
    return S.endpoint_mean_score(edges(spark, sf), scored).select("event_id", r6("score").alias("score"), "prediction")


@query("predict", pe("select event_id, cast(score/100>0.5 as integer) as one, cast(case when score>=k and score>=50 then 0 when k>=50 then 1 else 2 end as integer) as many, 0 as none from pe"))
def predict(spark, sf):
    many = F.array("score", F.col("k").cast("double"), F.lit(50.0))
    return prov_events(spark, sf).select(
        "event_id", S.predict_vector(F.array(F.col("score") / 100)).alias("one"),
        S.predict_vector(F.when(F.col("score") >= F.col("k"), many).otherwise(F.array(F.lit(-1.0), F.col("k").cast("double"), F.lit(50.0)))).alias("many"),
        S.predict_vector(F.array().cast("array<double>")).alias("none"),
    )


_P = "least(greatest(p,1e-12),1-1e-12)"


@query("losses", pe(f"""select round(avg(pow(p-label,2)),6) as mse, round(avg(abs(p-label)),6) as l1, round(avg(-(label*ln({_P})+(1-label)*ln(1-{_P}))),6) as bce,
  round(avg(case when cast(p>0.5 as integer)=label then 1.0 else 0.0 end),6) as accuracy,
  round(avg(-ln(exp(case label when 0 then 1-p else 2*p end)/(exp(1-p)+exp(2*p)))),6) as cross_entropy from (select label, score/600 as p from pe)"""))
def losses(spark, sf):
    p = F.col("score") / 600
    df = prov_events(spark, sf).select("label", p.alias("score"), F.array(1.0 - p, 2.0 * p).alias("logits"))
    out_df = S.losses(df, logits="logits")
    return out_df.select(*[r6(c).alias(c) for c in out_df.columns])


@query("threshold", pe("""select event_id, cast(score > (select quantile_cont(score,0.95) from pe) as integer) as by_percentile, cast(score>60 as integer) as fixed,
  cast(score > (select score from (select score, sum(case when label=1 then 1 else 0 end) over o / (select sum(label) from pe) - sum(case when label=0 then 1 else 0 end) over o / (select count(*)-sum(label) from pe) as j
    from pe window o as (order by score desc)) order by j desc, score desc limit 1) as integer) as auto from pe"""))
def threshold(spark, sf):
    events = prov_events(spark, sf).select("event_id", "score", "label")
    cuts = {"by_percentile": M.threshold(events), "fixed": M.threshold(events, "fixed", 60.0), "auto": M.threshold(events, "auto")}
    return events.select("event_id", *[F.when(F.col("score") > c, 1).otherwise(0).alias(n) for n, c in cuts.items()])


@query("primary", pe("select event_id, round(score,6) as score from sc where model='m2'", SCORES_SQL))
def primary(spark, sf):
    outputs = prov_scores(spark, sf).withColumnRenamed("model", "decoder")
    return S.select_primary(outputs, ["m2", "m1", "m3"]).select("event_id", r6("score").alias("score"))


@query("semi_supervised_loss", pe("select round(avg(score) + avg(case when event_type='error' then abs(score-60) end),6) as loss from pe"))
def semi_supervised_loss(spark, sf):
    df = prov_events(spark, sf).select(
        "score", F.abs(F.col("score") - 60).alias("class_loss"), F.when(F.col("event_type") == "error", F.col("label")).alias("label")
    )
    return S.semi_supervised_loss(df).select(r6("loss").alias("loss"))


@query("score_with_model", pe("select event_id, round(score*2+label,6) as score from pe"))
def score_with_model(spark, sf):
    def model(batch):
        return batch[["event_id"]].assign(score=(batch["score"] * 2 + batch["label"]).round(6))

    return S.score_with_model(prov_events(spark, sf), model, ["event_id", "score", "label"], "event_id long, score double")


@query("score_windows", pe("""select event_id, n as nodes, e as edges from (select *, cast(floor(ts_s/3600) as bigint) as w from pe)
  join (select w, count(distinct v) as n from (select cast(floor(ts_s/3600) as bigint) as w, unnest([src_key, dst_key]) as v from pe) group by 1) using (w)
  join (select cast(floor(ts_s/3600) as bigint) as w, count(*) as e from pe group by 1) using (w)"""))
def score_windows(spark, sf):
    """A model that needs whole windows: nodes and edges of each event's hour."""
    def model(key, batches):
        import pyarrow as pa

        held, nodes = [], set()
        for batch in batches:
            nodes.update(batch.column("src_key").to_pylist(), batch.column("dst_key").to_pylist())
            held.append(batch.column("event_id"))
        edges = sum(map(len, held))
        for ids in held:
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(nodes)] * len(ids)), pa.array([edges] * len(ids))], ["event_id", "nodes", "edges"])

    hours = prov_events(spark, sf).withColumn("hour", F.floor(F.col("ts_s") / 3600))
    return S.score_with_model(hours, model, ["event_id", "src_key", "dst_key"], "event_id long, nodes long, edges long", ["hour"])


@query("knn_anomaly", """with u as materialized (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as vec from embeddings),
  d as (select a.vec_id, 1-list_dot_product(a.vec,b.vec)/(sqrt(list_dot_product(a.vec,a.vec))*sqrt(list_dot_product(b.vec,b.vec))) as d from u a, u b where b.label=0)
  select vec_id, round(avg(d),6) as score from (select * from d qualify row_number() over (partition by vec_id order by d)<=20) group by 1""")
def knn_anomaly(spark, sf):
    vectors = prov_vectors(spark, sf)
    return N.knn_anomaly(vectors, vectors.where("label = 0"), 20).select("vec_id", r6("score").alias("score"))


@query("temporal_contrast", pe(f"""select a.vec_id//2 as entity_key, 1::bigint as window_id, round(ls - {_COS}/0.07, 6) as loss from vv a join vv b on b.vec_id=a.vec_id-1 and a.vec_id%2=1
  join (select a.vec_id, ln(sum(exp({_COS}/0.07))) as ls from vv a, vv b where a.vec_id%2=1 and b.vec_id%2=0 group by 1) l on l.vec_id=a.vec_id""", VV))
def temporal_contrast(spark, sf):
    return N.temporal_contrast(windowed_vectors(spark, sf)).select("entity_key", "window_id", r6("loss").alias("loss"))


_DIM = 8
_TEXT_VECTORS = f"""with t as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') as t from documents),
  p as (select unnest(list_zip(t[1:len(t)-1], t[2:])) as p from t union all select unnest(list_zip(t[1:len(t)-2], t[3:])) from t where len(t) > 2),
  m as materialized (select p[1] as a, p[2] as b, count(*) as n from p where p[1] is not null and p[2] is not null group by 1, 2),
  s as materialized (select a as word, b as other, n from m union all select b, a, n from m),
  w as materialized (select other, 1.0 / sqrt(sum(n)::double) as weight, md5(other || '|42|0') as h from s group by 1),
  v as materialized (select word, {", ".join(f"sum(n * weight * case when substr(h, {i + 1}, 1) < '8' then -1.0::double else 1.0::double end) as x{i}" for i in range(_DIM))} from s join w using (other) group by 1),
  u as materialized (select word, sqrt({" + ".join(f"x{i}*x{i}" for i in range(_DIM))}) as len, [{", ".join(f"x{i}" for i in range(_DIM))}] as x from v),
  c as (select doc_id, unnest(t) as word from t),
  d as (select doc_id, {", ".join(f"sum(case when len > 1e-12 then x[{i + 1}] / len else 0 end) / count(*) as y{i}" for i in range(_DIM))} from c join u using (word) group by 1)
  select doc_id, {", ".join(f"round(coalesce(y{i}, 0), 5) + 0 as y{i}" for i in range(_DIM))} from documents left join d using (doc_id)"""


@query("text_embeddings", _TEXT_VECTORS)
def text_embeddings(spark, sf):
    from spoorline.operators.features import text_embeddings as embed
    from spoorline.plans.fixtures import table

    out = embed(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", _DIM)
    return out.select("doc_id", *[(F.round(F.col("vec")[i], 5) + F.lit(0.0)).alias(f"y{i}") for i in range(_DIM)])


@query("graph_to_metrics", pe("""select tn, fp, fn, tp, round(coalesce(tp/nullif(tp+fp,0),0),6) as precision, round(coalesce(tp/nullif(tp+fn,0),0),6) as recall, round(p95,6) as p95, round(auroc,6) as auroc
  from (select count(*) filter (score<=p95 and label=0) as tn, count(*) filter (score>p95 and label=0) as fp, count(*) filter (score<=p95 and label=1) as fn, count(*) filter (score>p95 and label=1) as tp, max(p95) as p95 from scored, cutoff),
   (select sum(pos*(n-fp+neg/2))/max(p*n) as auroc from (select pos, neg, sum(neg) over (order by score desc)::double as fp, sum(pos) over ()::double as p, sum(neg) over ()::double as n
     from (select score, count(*) filter (label=1) as pos, count(*) filter (label=0) as neg from scored group by 1)))""", f"""{MEAN},
  h as materialized (select entity_key, {_SAGE} as o from n),
  scored as materialized (select event_id, label, round(1-list_dot_product(a.o,b.o)/greatest(sqrt(list_dot_product(a.o,a.o))*sqrt(list_dot_product(b.o,b.o)),1e-8),6) as score
    from pe join h a on a.entity_key=src_key join h b on b.entity_key=dst_key),
  cutoff as (select quantile_cont(score,0.95) as p95 from scored)"""))
def graph_to_metrics(spark, sf):
    """Node vectors, one message-passing layer, cosine scores of the edges, their percentile and the detection metrics."""
    encoded = cut(P.sage_mean(nodes(spark, sf), edges(spark, sf), A, B, BIAS, "relu"))
    scored = cut(S.cosine_edge_anomaly(edges(spark, sf), encoded).select("event_id", "label", r6("score").alias("score")))
    limit = M.threshold(scored)
    counted = M.confusion(scored.withColumn("prediction", F.when(F.col("score") > limit, 1).otherwise(0)))
    return M.classification_metrics(counted).select(
        "tn", "fp", "fn", "tp", r6("precision").alias("precision"), r6("recall").alias("recall"), r6(limit).alias("p95"), r6(M.auroc(scored).scalar()).alias("auroc"))
