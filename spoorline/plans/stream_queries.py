"""Streams over the given event table, run to the end of the available data (inventory group L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.operators.ranking import exact_percentiles
from spoorline.operators.records import parse
from spoorline.plans.fixtures import prov_events, table
from spoorline.plans.record_queries import _K, _P, _FILE_ID, _NET_ID, _PROC_ID, raw_cdm_entities, raw_cdm_events
from spoorline.plans.registry import pe, query, r6
from spoorline.session import scratch_path
from spoorline.streaming import resolve
from spoorline.streaming import streams as S
from spoorline.functions.times import ntz_micros


def event_stream(spark, sf):
    """The events table as a stream of provenance events."""
    schema = table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type").isin("view", "click"), "file:").when(F.col("event_type") == "purchase", "network:").otherwise("process:")
    return rows.select(
        "event_id", (ntz_micros("ts") / 1e6).alias("ts_s"), F.concat(F.lit("process:"), "user_id").alias("src_key"),
        F.concat(kind, k).alias("dst_key"), "event_type", F.col("value").alias("score"),
    )


def finished(spark, df, name):
    path = scratch_path(spark, name)
    S.run_available(df, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def closed(spark, sf, build, name):
    """A windowed stream run over all data, then once more past its end, so that no window stays open."""
    path = scratch_path(spark, name)
    events = event_stream(spark, sf)
    out = build(S.with_end(events, f"{path}/end"))
    S.run_available(out, f"{path}/out", f"{path}/checkpoint")
    S.end_of_data(events, f"{path}/end")
    S.run_available(out, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("stream_events", "select event_type, count(*) as n, count(distinct user_id) as users from events group by 1")
def stream_events(spark, sf):
    from spoorline.operators.records import get
    from spoorline.plans.record_queries import raw_ecs

    source = scratch_path(spark, "live")
    raw_ecs(spark, sf).select(F.explode(F.array(F.concat("raw", F.lit(",")), F.lit("{bad"))).alias("value")).write.text(source)
    out = S.stream_events(spark, source).select(get("v", "event", "action").alias("event_type"), get("v", "user", "name").alias("user"))
    return finished(spark, out, "records").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users"))


@query("stream_counts", pe("""select cast(floor(ts_s/3600)*3600 as bigint) as window_start, cast(floor(ts_s/3600)*3600+3600 as bigint) as window_end, event_type, count(*) as n
  from pe group by 1,2,3"""))
def stream_counts(spark, sf):
    return closed(spark, sf, S.stream_window_counts, "counts")


@query("stream_sliding", pe("""select w as window_start, w+3600 as window_end, event_type, count(*) as n from (select *, unnest([cast(floor(ts_s/1800)*1800 as bigint), cast(floor(ts_s/1800)*1800-1800 as bigint)]) as w from pe)
  group by 1,2,3"""))
def stream_sliding(spark, sf):
    return closed(spark, sf, lambda events: S.stream_window_counts(events, "1 hour", "30 minutes"), "sliding")


@query("stream_dedupe", pe("select distinct src_key, dst_key, event_type from pe"))
def stream_dedupe(spark, sf):
    # a delay longer than the data makes the result independent of how files arrive
    out = S.stream_dedupe(event_stream(spark, sf), ["src_key", "dst_key", "event_type"], "60 days")
    return finished(spark, out.select("src_key", "dst_key", "event_type"), "dedupe")


@query("stream_dedupe_windows", pe("select distinct cast(floor(ts_s/3600)*3600 as bigint) as window_start, dst_key, event_type from pe"))
def stream_dedupe_windows(spark, sf):
    def build(events):
        first = S.stream_dedupe_windows(events, ["dst_key", "event_type"])
        return first.where("event_id is not null").select(F.unix_seconds("window.start").alias("window_start"), "dst_key", "event_type")

    return closed(spark, sf, build, "dedupe-windows")


@query("stream_sessions", pe("""select src_key, min(us) as session_start, max(us)+1800000000 as session_end, count(*) as n, max(score) as max_score from (
   select *, sum(brk) over (partition by src_key order by us) as s from (select *, case when us - lag(us) over (partition by src_key order by us) < 1800000000 then 0 else 1 end as brk
     from (select src_key, score, epoch_us(e.ts) as us from pe join events e using (event_id))))
  group by src_key, s"""))
def stream_sessions(spark, sf):
    return closed(spark, sf, S.stream_sessions, "sessions")


@query("stream_alerts", pe("select event_id, event_type, round(score-q,6) as excess from pe join (select event_type, quantile_cont(score,0.99) as q from pe group by 1) using (event_type) where score>=q"))
def stream_alerts(spark, sf):
    path = scratch_path(spark, "baseline")
    exact_percentiles(prov_events(spark, sf), "score", [0.99], ["event_type"]).select(
        "event_type", F.col("value").alias("threshold")
    ).write.parquet(path)
    out = S.stream_alerts(event_stream(spark, sf), spark.read.parquet(path))
    return finished(spark, out.select("event_id", "event_type", r6("excess").alias("excess")), "alerts")


@query("stream_resolve", pe("select 'E'||event_id as event_id, a.key as src_key, b.key as dst_key from p join ids a on a.uuid=src_uuid join ids b on b.uuid=dst_uuid",
       f"{_P}, {_K}, ids as (select uuid, kind||':'||case kind when 'process' then {_PROC_ID} when 'file' then {_FILE_ID} else {_NET_ID} end as key from kk where not (kind='file' and n between 95 and 99))"))
def stream_resolve(spark, sf):
    root = scratch_path(spark, "resolve")
    raw_cdm_events(spark, sf).select("raw").write.text(f"{root}/in")
    raw_cdm_entities(spark, sf).select("raw").write.mode("append").text(f"{root}/in")
    records = S.stream_events(spark, f"{root}/in", maxFilesPerTrigger="4")
    resolve.stream_resolve(records, f"{root}/table", f"{root}/checkpoint")
    return resolve.resolved(spark, f"{root}/table").select("event_id", "src_key", "dst_key")
