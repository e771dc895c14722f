"""Records rendered from the events table, parsed back and compared (inventory groups A, B and C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoorline.functions.times import ntz_micros, to_epoch
from spoorline.operators import analysis, cdm, ecs, metrics, records as R
from spoorline.operators import graph as G
from spoorline.operators import normalize as N
from spoorline.operators.registry import entity_registry
from spoorline.operators.windows import totals, tumbling_windows
from spoorline.plans.fixtures import SCORES_SQL, prov_events, prov_scores, prov_vectors, table
from spoorline.plans.graph_queries import DAYS, DAY_NODES, DIGRAPH, day_graph_edges, day_windows
from spoorline.plans.registry import pe, query, r6
from spoorline.session import scratch_path
from spoorline.sources import readers, sinks

UUID = cdm.UUID


def base(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"),
        ntz_micros("ts").alias("us"), F.concat(F.regexp_replace(F.col("ts").cast("string"), " ", "T"), F.lit("Z")).alias("iso"),
    )


BASE = """b as materialized (select event_id, user_id, event_type, value, cast(json_extract_string(props,'$.k') as bigint) as k, epoch_us(ts) as us,
  regexp_replace(printf('%d.%06d', epoch_us(ts)//1000000, epoch_us(ts)%1000000), '0+$', '') as t0 from events)"""
SECONDS = "case when t0 like '%.' then t0||'0' else t0 end"


def of(select, ctes=""):
    return f"with {BASE}{',' if ctes else ''} {ctes} {select}"


def struct(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def text(template, *columns):
    return F.format_string(template, *columns)


# Elastic-style records: files, networks, processes, and one category without a target ---------------------------


def raw_ecs(spark, sf):
    kind, k = F.col("event_type"), F.col("k")
    known = F.col("user_id") % 3 != 0
    process = struct(
        entity_id=F.when(known, text("p%d", "user_id")).otherwise(""), executable=text("/bin/u%d", "user_id"),
        pid=F.col("user_id"), name=text("u%d", "user_id"),
        parent=struct(executable=F.lit("/sbin/parent"), pid=k, name=F.lit("parent")),
    )

    def record(event, **more):
        return F.to_json(struct(**{"@timestamp": F.col("iso")}, event=event, process=process, user=struct(name=text("u%d", "user_id")), **more))

    def event(*category):
        listed = F.array(*[F.lit(c) for c in category])
        return struct(action=kind, category=listed, outcome=F.lit("success"))

    scalar = struct(action=kind, category=F.lit("process"), outcome=F.lit("failure"))
    raw = (
        F.when(kind == "view", record(event("file", "web"), file=struct(path=text("/data/%d", "k"), name=text("%d", "k"), extension=F.lit("dat"))))
        .when(kind == "click", record(event("file"), file=struct(name=text("f%d", "k"))))
        .when(kind == "purchase", record(
            event("network"), destination=struct(ip=text("10.0.0.%d", "k"), port=F.when(k % 2 == 1, 443)),
            source=struct(ip=F.lit("10.1.1.1"), port=F.lit(9)), network=struct(transport=F.lit("tcp"))))
        .when((kind == "signup") & (k >= 90), record(event("iam"), host=struct(hostname=F.lit("h1"))))
        .when(kind == "signup", record(event("process"), host=struct(hostname=F.lit("h1"))))
        .otherwise(record(scalar))
    )
    return base(spark, sf).select(F.lit("ecs").alias("file"), F.col("event_id").alias("pos"), raw.alias("raw"))


ECS_SRC = "case when user_id%3<>0 then 'p'||user_id else '/bin/u'||user_id||':'||user_id end"
ECS_DST = """case when event_type='view' then 'file:/data/'||k when event_type='click' then 'file:f'||k
  when event_type='purchase' then 'network:10.0.0.'||k||case when k%2=1 then ':443' else '' end
  when event_type='signup' and k>=90 then null else 'process:/sbin/parent:'||k end"""


@query("ecs_events", of(f"""select {SECONDS}||'_'||{ECS_SRC}||'_'||event_type as event_id, event_type, 'process:'||{ECS_SRC} as src_key, {ECS_DST} as dst_key,
  round(us/1e6,6) as ts_s, case event_type when 'view' then 'file' when 'click' then 'file' when 'purchase' then 'network' when 'error' then 'process' else case when k>=90 then 'iam' else 'process' end end as category,
  'u'||user_id as user_name, case when event_type='signup' then 'h1' else '' end as host,
  case when event_type='signup' and k>=90 then 'missing_target' else 'parsed' end as status from b"""))
def ecs_events(spark, sf):
    out = ecs.events(raw_ecs(spark, sf))
    a = F.col("attributes")
    return out.select(
        "event_id", "event_type", "src_key", "dst_key", r6("ts_s").alias("ts_s"), "category", a["user"].alias("user_name"),
        a["host"].alias("host"), "status",
    )


_ECS_ENT = f"""ends as (select 'process:'||{ECS_SRC} as entity_key, event_id*2 as pos, 'pid' as k1, cast(user_id as varchar) as v1, 'name' as k2, 'u'||user_id as v2 from b
  union all select dst, event_id*2+1, case kind when 'file' then 'path' when 'network' then 'dest_port' else 'pid' end, case when event_type='view' then '/data/'||k
    when event_type='click' then 'f'||k when event_type='purchase' then case when k%2=1 then '443' else '' end else cast(k as varchar) end,
    case kind when 'network' then 'transport' else 'name' end, case event_type when 'view' then cast(k as varchar) when 'click' then 'f'||k when 'purchase' then 'tcp' else 'parent' end
  from (select *, {ECS_DST} as dst, split_part({ECS_DST},':',1) as kind from b) where dst is not null)"""


@query("ecs_entities", of("select entity_key, split_part(entity_key,':',1) as entity_type, count(*) as occurrences, arg_max(v1,pos) as first_value, arg_max(v2,pos) as second_value from ends group by 1", _ECS_ENT))
def ecs_entities(spark, sf):
    registry = entity_registry(R.event_entities(ecs.events(raw_ecs(spark, sf))))
    a = F.col("attributes")
    first = F.when(F.col("entity_type") == "file", a["path"]).when(F.col("entity_type") == "network", a["dest_port"]).otherwise(a["pid"])
    second = F.when(F.col("entity_type") == "network", a["transport"]).otherwise(a["name"])
    return registry.select("entity_key", "entity_type", "occurrences", first.alias("first_value"), second.alias("second_value"))


@query("parse_report", of("""select 'status' as metric, case when event_type='signup' and k>=90 then 'missing_target' else 'parsed' end as value, count(*) as n from b group by 2
  union all select 'event', event_type, count(*) from b where not (event_type='signup' and k>=90) group by 2"""))
def parse_report(spark, sf):
    return R.parse_report(ecs.events(raw_ecs(spark, sf)))


@query("event_ids", of(f"select {SECONDS}||'_'||user_id||'_'||event_type as event_id from b"))
def event_ids(spark, sf):
    events = prov_events(spark, sf)
    return events.select(R.synth_event_id(F.col("ts_s"), F.col("user_id").cast("string"), F.col("event_type")).alias("event_id"))


@query("extract_attributes", of("""select event_id, 'u'||user_id as user_name, case when event_type in ('view','click') then case when event_type='view' then cast(k as varchar) else 'f'||k end end as file_name,
  cast(k as varchar) as parent_pid from b"""))
def extract_attributes(spark, sf):
    out = R.extract_attributes(R.parse(raw_ecs(spark, sf)), ["user.name", "file.name", "process.parent.pid", "no.such"])
    a = F.col("attributes")
    return out.select(
        F.col("pos").alias("event_id"), a["user.name"].alias("user_name"), a["file.name"].alias("file_name"),
        a["process.parent.pid"].alias("parent_pid"),
    )


@query("require_fields", of("select event_id, event_type in ('view','click') as has_file, true as has_event from b"))
def require_fields(spark, sf):
    parsed = R.parse(raw_ecs(spark, sf))
    both = R.require_fields(R.require_fields(parsed, ["process", "file"]).withColumnRenamed("valid", "has_file"), ["event", "@timestamp"])
    return both.select(F.col("pos").alias("event_id"), "has_file", F.col("valid").alias("has_event"))


# audit records ---------------------------------------------------------------------------------------------------


def wrapped(kind, record):
    inner = F.struct(record.alias(f"com.bbn.tc.schema.avro.cdm18.{kind}"))
    return F.to_json(F.struct(inner.alias("datum"), F.lit("18").alias("CDMVersion"), F.lit("SOURCE").alias("source")))


def union_uuid(column):
    return F.struct(column.alias(UUID))


CDM_TYPES = {"view": "EVENT_READ", "click": "EVENT_WRITE", "purchase": "EVENT_SENDTO", "signup": "EVENT_FORK", "error": "EVENT_WEIRD"}


def raw_cdm_events(spark, sf):
    events = base(spark, sf)
    prov = prov_events(spark, sf).select("event_id", "src_key", "dst_key")
    kind = F.create_map(*[F.lit(x) for kv in CDM_TYPES.items() for x in kv])[F.col("event_type")]
    common = dict(
        uuid=text("E%d", "event_id"), type=kind, timestampNanos=F.col("us") * 1000, subject=union_uuid(F.md5("src_key")),
        threadId=F.col("k"), sequence=F.col("event_id"),
    )
    target = F.md5("dst_key")
    plain = wrapped("Event", struct(**common, predicateObject=target))
    single = wrapped("Event", struct(**common, predicateObject=union_uuid(target)))
    double = wrapped("Event", struct(
        **common, predicateObject=union_uuid(target), predicateObject2=union_uuid(F.md5(text("file:%d", F.col("k") + 1)))
    ))
    raw = F.when(F.col("event_type") == "purchase", plain).when(F.col("event_type") == "click", double).otherwise(single)
    return events.join(prov, "event_id").select(F.lit("cdm").alias("file"), (F.col("event_id") + 10_000_000).alias("pos"), raw.alias("raw"))


def raw_cdm_entities(spark, sf):
    """One record per entity of the events; files 95..99 are left out so that some events do not resolve."""
    keys = G.endpoints(prov_events(spark, sf)).select("entity_key").distinct()
    n = F.substring_index("entity_key", ":", -1).cast("long")
    kind = F.substring_index("entity_key", ":", 1)
    uuid = F.md5("entity_key")
    path = text("/data/%d", n)
    subject = wrapped("Subject", struct(
        uuid=uuid, type=F.lit("SUBJECT_PROCESS"), cid=F.when(n % 4 != 0, n), cmdLine=text("run %d", n),
        parentSubject=union_uuid(F.md5(F.lit("process:1")))))
    flow = wrapped("NetFlowObject", struct(
        uuid=uuid, srcAddress=F.lit("10.0.0.1"), srcPort=n, destAddress=text("8.8.8.%d", n), destPort=F.lit(53), ipProtocol=F.lit(17)))

    def file(properties):
        return wrapped("FileObject", struct(uuid=uuid, baseObject=struct(properties=properties), fileDescriptor=n))

    raw = (
        F.when(kind == "process", subject).when(kind == "network", flow)
        .when(n < 5, file(struct(map=struct(owner=F.lit("root")))))
        .when(n < 10, file(struct(map=struct(path=path))))
        .otherwise(file(struct(path=path)))
    )
    missing = (kind == "file") & n.between(95, 99)
    return keys.where(~missing).select(F.lit("cdm").alias("file"), F.xxhash64("entity_key").alias("pos"), raw.alias("raw"))


def raw_cdm_others(spark, sf):
    """Principals, memory, source/sink and registry records and hosts from users, targets and event types."""
    events = base(spark, sf)
    users = events.select("user_id").distinct()
    targets = events.select("k").distinct()
    kinds = events.select("event_type").distinct()
    uuid = F.md5(text("principal:%d", "user_id"))
    other = F.md5(text("object:%d", "k"))
    objects = (
        F.when(F.col("k") % 3 == 0, wrapped("MemoryObject", struct(uuid=other, memoryAddress=F.col("k"))))
        .when(F.col("k") % 3 == 1, wrapped("SrcSinkObject", struct(uuid=other, type=F.lit("SRCSINK_UNKNOWN"))))
        .otherwise(wrapped("RegistryKeyObject", struct(uuid=other, key=text("HK/%d", "k"))))
    )
    return (
        users.select(F.col("user_id").alias("pos"), wrapped("Principal", struct(uuid=uuid, username=text("u%d", "user_id"))).alias("raw"))
        .unionByName(targets.select((F.col("k") + 1_000_000).alias("pos"), objects.alias("raw")))
        .unionByName(kinds.select(F.xxhash64("event_type").alias("pos"), wrapped("Host", struct(
            uuid=F.md5("event_type"), hostName=F.col("event_type"), hostType=F.lit("HOST_DESKTOP"), osDetails=F.lit("BSD"),
            interfaces=F.array(struct(name=F.lit("em0"))))).alias("raw")))
        .select(F.lit("cdm").alias("file"), "pos", "raw")
    )


def cdm_records(spark, sf):
    return R.parse(
        raw_cdm_events(spark, sf).unionByName(raw_cdm_entities(spark, sf)).unionByName(raw_cdm_others(spark, sf))
    )


_TYPE = "case event_type when 'view' then 'read' when 'click' then 'write' when 'purchase' then 'sendto' when 'signup' then 'fork' else 'other' end"
_CDM = "case event_type when 'view' then 'EVENT_READ' when 'click' then 'EVENT_WRITE' when 'purchase' then 'EVENT_SENDTO' when 'signup' then 'EVENT_FORK' else 'EVENT_WEIRD' end"
_P = f"p as (select pe.*, md5(src_key) as src_uuid, md5(dst_key) as dst_uuid, {_TYPE} as short, {_CDM} as cdm from pe)"


@query("cdm_events", pe("""select 'E'||event_id as event_id, short as event_type, round(ts_s,6) as ts_s, src_uuid, dst_uuid, cdm as cdm_type, cast(k as varchar) as thread_id,
  cast(event_id as varchar) as sequence from p""", _P))
def cdm_events(spark, sf):
    a = F.col("attributes")
    return cdm.events(cdm_records(spark, sf)).select(
        "event_id", "event_type", r6("ts_s").alias("ts_s"), "src_uuid", "dst_uuid", a["cdm_type"].alias("cdm_type"),
        a["thread_id"].alias("thread_id"), a["sequence"].alias("sequence"),
    )


@query("cdm_second_object", pe("""select 'E'||event_id as event_id, dst_uuid from p union all select 'E'||event_id, md5('file:'||(k+1)) from p where event_type='click'""", _P))
def cdm_second_object(spark, sf):
    return cdm.second_object(cdm.events(cdm_records(spark, sf)), expand=True).select("event_id", "dst_uuid")


_K = "kk as (select entity_key, split_part(entity_key,':',1) as kind, cast(split_part(entity_key,':',2) as bigint) as n, md5(entity_key) as uuid from (select src_key as entity_key from pe union select dst_key from pe))"
_PROC_ID = "case when n%4<>0 then 'pid_'||n||'_'||substr(uuid,1,8) else uuid end"
_FILE_ID = "case when n<5 then uuid else '/data/'||n end"
_NET_ID = "'10.0.0.1:'||n||'-8.8.8.'||n||':53'"


@query("cdm_subjects", pe(f"select 'process:'||{_PROC_ID} as entity_key, uuid, case when n%4<>0 then cast(n as varchar) end as pid, 'run '||n as cmdline, md5('process:1') as parent_subject from kk where kind='process'", _K))
def cdm_subjects(spark, sf):
    a = F.col("attributes")
    return cdm.subjects(cdm_records(spark, sf)).select(
        "entity_key", "uuid", a["pid"].alias("pid"), a["cmdline"].alias("cmdline"), a["parent_subject"].alias("parent_subject")
    )


@query("cdm_files", pe(f"select 'file:'||{_FILE_ID} as entity_key, uuid, cast(n as varchar) as descriptor from kk where kind='file' and n not between 95 and 99", _K))
def cdm_files(spark, sf):
    return cdm.files(cdm_records(spark, sf)).select("entity_key", "uuid", F.col("attributes")["file_descriptor"].alias("descriptor"))


@query("cdm_netflows", pe(f"select 'network:'||{_NET_ID} as entity_key, uuid, '8.8.8.'||n as dest_address, '17' as protocol from kk where kind='network'", _K))
def cdm_netflows(spark, sf):
    a = F.col("attributes")
    return cdm.netflows(cdm_records(spark, sf)).select(
        "entity_key", "uuid", a["dest_address"].alias("dest_address"), a["protocol"].alias("protocol")
    )


@query("cdm_other", of("""select 'principal' as entity_type, md5('principal:'||user_id) as entity_id, 'u'||user_id as detail from (select distinct user_id from b)
  union all select case k%3 when 0 then 'memory' when 1 then 'socket' else 'registry' end, md5('object:'||k), case k%3 when 0 then cast(k as varchar) when 1 then 'SRCSINK_UNKNOWN' else 'HK/'||k end from (select distinct k from b)"""))
def cdm_other(spark, sf):
    a = F.col("attributes")
    return cdm.other_entities(cdm_records(spark, sf)).select(
        "entity_type", "entity_id", F.coalesce(a["username"], a["memoryAddress"], a["key"], a["type"]).alias("detail")
    )


@query("cdm_hosts", of("select event_type as hostname, md5(event_type) as uuid, 'BSD' as os, '[{\"name\":\"em0\"}]' as interfaces from b group by 1"))
def cdm_hosts(spark, sf):
    return cdm.hosts(cdm_records(spark, sf)).select("hostname", "uuid", "os", "interfaces")


@query("cdm_record_types", pe("""select 'Event' as record_type, count(*) as n from pe union all select case kind when 'process' then 'Subject' when 'file' then 'FileObject' else 'NetFlowObject' end, count(*) from kk
  where not (kind='file' and n between 95 and 99) group by 1 union all select 'Principal', count(distinct user_id) from pe union all select 'Host', count(distinct event_type) from pe
  union all select case k%3 when 0 then 'MemoryObject' when 1 then 'SrcSinkObject' else 'RegistryKeyObject' end, count(distinct k) from pe group by 1""", _K))
def cdm_record_types(spark, sf):
    return cdm.record_types(cdm_records(spark, sf))


@query("cdm_infer_type", of("""select event_id, case when event_type='view' and k>=20 then 'Event' when event_type='view' then 'FileObject' when event_type='click' then 'Subject'
  when event_type='purchase' then 'NetFlowObject' when event_type='signup' then 'Host' when k<50 then 'Principal' else 'unknown' end as record_type from b"""))
def cdm_infer_type(spark, sf):
    kind, k = F.col("event_type"), F.col("k")

    def bare(**fields):
        return F.to_json(struct(datum=struct(**fields)))

    raw = (
        F.when((kind == "view") & (k >= 20), bare(type=F.lit("EVENT_READ"), pid=k))
        .when(kind == "view", bare(baseObject=struct(properties=struct(path=F.lit("/x")))))
        .when(kind == "click", bare(cid=k)).when(kind == "purchase", bare(srcAddress=F.lit("a"), destAddress=F.lit("b")))
        .when(kind == "signup", bare(hostName=F.lit("h"), hostType=F.lit("t")))
        .when(k < 50, bare(username=F.lit("u"))).otherwise(bare(foo=k))
    )
    rows = base(spark, sf).select(F.lit("f").alias("file"), F.col("event_id").alias("pos"), raw.alias("raw"))
    return cdm.unwrap(R.parse(rows)).select(F.col("pos").alias("event_id"), "record_type")


@query("map_event_type", pe(f"select short as event_type, count(*) as n from p group by 1", _P))
def map_event_type(spark, sf):
    mapping = F.create_map(*[F.lit(x) for kv in CDM_TYPES.items() for x in kv])
    events = prov_events(spark, sf).select(cdm.map_event_type(mapping[F.col("event_type")]).alias("event_type"))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("map_entity_type", pe("select case kind when 'process' then 'process' when 'file' then 'file' when 'network' then 'netthing' end as entity_type, count(*) as n from kk group by 1", _K))
def map_entity_type(spark, sf):
    classes = F.create_map(*[F.lit(x) for x in ("process", "Subject", "file", "FileObject", "network", "NetThing")])
    keys = G.endpoints(prov_events(spark, sf)).select("entity_key").distinct()
    kind = cdm.map_entity_type(classes[F.substring_index("entity_key", ":", 1)])
    return keys.select(kind.alias("entity_type")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


_RES = f"""{_P}, {_K}, ids as (select uuid, kind||':'||case kind when 'process' then {_PROC_ID} when 'file' then {_FILE_ID} else {_NET_ID} end as key from kk where not (kind='file' and n between 95 and 99)),
  res as (select p.event_id, p.event_type, a.key as src_key, b.key as dst_key from p left join ids a on a.uuid=src_uuid left join ids b on b.uuid=dst_uuid)"""


def resolved(spark, sf):
    records = cdm_records(spark, sf)
    return cdm.resolve_entities(cdm.events(records), cdm.entities(records))


@query("resolve_entities", pe("select 'E'||event_id as event_id, src_key, dst_key from res where src_key is not null and dst_key is not null", _RES))
def resolve_entities(spark, sf):
    return resolved(spark, sf).where("status = 'parsed'").select("event_id", "src_key", "dst_key")


@query("unresolved_events", pe("select event_type, count(*) as n from (select case event_type when 'view' then 'read' else 'write' end as event_type from res where dst_key is null) group by 1", _RES))
def unresolved_events(spark, sf):
    return resolved(spark, sf).where("status = 'missing_entities'").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# generic records and files ---------------------------------------------------------------------------------------


def raw_custom(spark, sf):
    ts = F.when(F.col("event_id") % 3 == 0, F.col("iso")).when(F.col("event_id") % 3 == 1, F.floor(F.col("us") / 1000).cast("string")).otherwise(
        (F.col("us") * 1000).cast("string"))
    plain = F.to_json(struct(when=ts, actor=text("u%d", "user_id"), object=text("f%d", "k"), verb=F.col("event_type")))
    nested = F.to_json(struct(
        when=ts, actor=struct(id=text("u%d", "user_id"), type=F.lit("process")), object=struct(name=text("f%d", "k"), type=F.lit("file"), size=F.col("k")),
        verb=F.when(F.col("event_type") != "error", F.col("event_type"))))
    raw = F.when(F.col("event_id") % 7 == 0, plain).otherwise(nested)
    return base(spark, sf).select(F.lit("custom").alias("file"), F.col("event_id").alias("pos"), raw.alias("raw"))


@query("custom_json", of("""select event_id as pos, case when event_id%7=0 then event_type when event_type='error' then 'unknown' else event_type end as event_type,
  case when event_id%7=0 then 'entity:u'||user_id else 'process:u'||user_id end as src_key, case when event_id%7=0 then 'entity:f'||k else 'file:f'||k end as dst_key,
  case when event_id%3=1 then round((us//1000)/1e3,6) else round(us/1e6,6) end as ts_s, case when event_id%7<>0 then cast(k as varchar) end as size from b"""))
def custom_json(spark, sf):
    out = R.custom_events(R.parse(raw_custom(spark, sf)), "when", "actor", "object", "verb")
    return out.select("pos", "event_type", "src_key", "dst_key", r6("ts_s").alias("ts_s"), F.col("dst_attributes")["size"].alias("size"))


@query("to_epoch", of("""select event_id, case event_id%5 when 0 then round(us/1e6,6) when 1 then round((us//1000)/1e3,6) when 2 then round((us//1000000)*1.0,6)::double
  when 3 then round(us/1e6,6) end as ts_s from b"""))
def to_epoch_query(spark, sf):
    form = F.col("event_id") % 5
    us = F.col("us")
    written = (
        F.when(form == 0, (us * 1000).cast("string")).when(form == 1, F.floor(us / 1000).cast("string"))
        .when(form == 2, F.floor(us / 1_000_000).cast("string")).when(form == 3, F.col("iso")).otherwise("x")
    )
    return base(spark, sf).select("event_id", r6(to_epoch(written)).alias("ts_s"))


def mixed_records(spark, sf):
    return raw_ecs(spark, sf).unionByName(raw_cdm_events(spark, sf)).unionByName(raw_custom(spark, sf))


@query("detect_format", of("select file, format, n from (values ('ecs','ecs'),('cdm','cdm'),('custom','custom')) t(file, format), (select count(*) as n from b)"))
def detect_format(spark, sf):
    marked = R.with_format(R.parse(mixed_records(spark, sf)))
    return marked.groupBy("file", "format").agg(F.count(F.lit(1)).alias("n"))


@query("limit_records", of("select event_type as file, event_id from b qualify row_number() over (partition by event_type order by event_id) <= 50"))
def limit_records(spark, sf):
    rows = base(spark, sf).select(F.col("event_type").alias("file"), F.col("event_id").alias("pos"))
    return R.limit_records_per_file(rows, 50).select("file", F.col("pos").alias("event_id"))


@query("ndjson_tolerant", of("select event_type, count(*) as n, count(distinct user_id) as users from b group by 1"))
def ndjson_tolerant(spark, sf):
    path = scratch_path(spark, "ndjson")
    # some records have repeated keys and numbers that are not finite
    odd = F.regexp_replace("raw", r"^\{", r'{"again": 1, "again": [NaN, -Infinity], "words": "NaN, \\"Infinity\\"",')
    raw = F.when(F.col("pos") % 2 == 1, odd).otherwise(F.col("raw"))
    noise = F.array(
        F.lit("["), F.lit(""), F.lit("{bad"), F.concat(F.lit("  "), raw, F.lit(",")), F.lit("]"), F.lit('"x": 1}'), F.lit("42 z"), F.lit("42"),
        F.lit('{"a":1}{"a":2}'), F.lit('{"a":1},"b":2'), F.lit('{}],[{}'))
    raw_ecs(spark, sf).select(F.explode(noise).alias("value")).write.text(path)
    records = readers.read_ndjson(spark, path)
    return records.select(R.get("v", "event", "action").alias("event_type"), R.get("v", "user", "name").alias("user")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user").alias("users")
    )


@query("json_array", of("select cast(event_id//100 as varchar) as file, row_number() over (partition by event_id//100 order by event_id)-1 as pos, event_type from b"))
def json_array(spark, sf):
    def chunks(rows):
        return rows.groupBy(F.floor(F.col("pos") / 100).cast("string").alias("file")).agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("pos", "raw")))["raw"], ",\n").alias("body")
        )

    path = scratch_path(spark, "arrays")
    # one pretty-printed array per file, and files that only start like one
    body = F.concat(F.lit("[\n"), "body", F.lit("\n]"))
    out = chunks(raw_ecs(spark, sf)).select("file", body.alias("value")).write.partitionBy("file")
    # tasks put their files in place themselves, the driver does not move one after the other
    out.option("lineSep", "\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    chunks(raw_ecs(spark, sf).limit(100)).limit(1).select(F.lit("broken").alias("file"), F.concat(body, F.lit("]")).alias("value")).write.mode("append").partitionBy("file").text(path)
    records = readers.read_json_array(spark, path)
    return records.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("file"), "pos", R.get("v", "event", "action").alias("event_type"))


@query("route_extension", """select page_id, case when regexp_matches(lower(n), '\\.(bin|avro|dat)$') or contains(lower(n), '.bin') then 'avro' else 'json' end as reader
  from (select page_id, regexp_extract(url || case page_id % 3 when 0 then '.bin.' || page_id when 1 then '/x.json' else '.AVRO' end, '[^/]*$') as n from pages)""")
def route_extension(spark, sf):
    ending = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(".bin."), "page_id")).when(F.col("page_id") % 3 == 1, "/x.json").otherwise(".AVRO")
    return table(spark, sf, "pages").select("page_id", readers.route_by_extension(F.concat("url", ending)).alias("reader"))


@query("dataset_type", """select doc_id, case when regexp_matches(p, 'darpa|ta1-|cadets|theia|trace|clearscope') then 'darpa' when regexp_matches(p, 'soc|elastic|endpoint') then 'custom_soc' else 'custom' end as dataset
  from (select doc_id, lower('/in/' || source || case doc_id % 4 when 0 then '/TA1-x' when 1 then '/Elastic' when 2 then '/theia' else '' end || '/' || doc_id || '.json') as p from documents)""")
def dataset_type(spark, sf):
    part = F.when(F.col("doc_id") % 4 == 0, "/TA1-x").when(F.col("doc_id") % 4 == 1, "/Elastic").when(F.col("doc_id") % 4 == 2, "/theia").otherwise("")
    path = F.concat(F.lit("/in/"), "source", part, F.lit("/"), "doc_id", F.lit(".json"))
    return table(spark, sf, "documents").select("doc_id", readers.detect_dataset_type(path).alias("dataset"))


@query("read_many", of("""select event_type, count(*) as n, 4::bigint as read, 1::bigint as missing, 1::bigint as failed from b group by 1"""))
def read_many(spark, sf):
    root = scratch_path(spark, "many")
    rows = raw_ecs(spark, sf).select("raw", (F.col("pos") % 4).alias("part"), "pos")
    # lines, a pretty-printed array, one object, text named as a container, and a file without a record
    # every file of lines begins in the middle of a record
    rows.where("part < 2").select(F.explode(F.array(F.lit('rest": 1}'), "raw")).alias("value")).write.text(f"{root}/lines")
    listed = F.array_join(F.sort_array(F.collect_list(F.struct("pos", "raw")))["raw"], ",\n")
    rows.where("part = 2 and pos > 2").agg(F.concat(F.lit("[\n"), listed, F.lit("\n]")).alias("value")).write.text(f"{root}/array")
    rows.where("part = 2 and pos = 2").select(F.regexp_replace("raw", "^\\{", "{\n").alias("value")).coalesce(1).write.text(f"{root}/object")
    rows.where("part = 3").select("raw").coalesce(1).write.text(f"{root}/fake.bin")
    rows.limit(1).select(F.lit('{"a":1}{"a":2}').alias("value")).write.text(f"{root}/broken")
    records, counts = readers.read_many(spark, [f"{root}/{p}" for p in ("lines", "nowhere", "array", "object", "fake.bin", "broken")])
    out = records.select(R.get("v", "event", "action").alias("event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({c: F.lit(counts[c]).cast("long") for c in ("read", "missing", "failed")})


def type_files(spark, sf):
    """A folder with one small JSON file per event type."""
    root = scratch_path(spark, "files")
    counts = base(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.partitionBy("event_type").json(root)
    return root


FOLDER = r"event_type=([a-z]+)/"


@query("discover_files", of("select event_type, count(distinct event_type) as files from b group by 1"))
def discover_files(spark, sf):
    files = readers.discover_files(spark, type_files(spark, sf), sub_level=True)
    return files.groupBy(F.regexp_extract("path", FOLDER, 1).alias("event_type")).agg(F.count(F.lit(1)).alias("files"))


@query("limit_files", of("select event_type from b group by 1 order by 1 limit 3"))
def limit_files(spark, sf):
    files = readers.discover_files(spark, type_files(spark, sf), sub_level=True)
    return readers.limit_files(files, 3).select(F.regexp_extract("path", FOLDER, 1).alias("event_type"))


@query("csv_roundtrip", of("select event_id, user_id, event_type, round(value,6) as value from b"))
def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    base(spark, sf).select("event_id", "user_id", "event_type", "value").write.option("header", "true").csv(path)
    rows = readers.read_table(spark, path, "csv")
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type",
        F.round(F.col("value").cast("double"), 6).alias("value"),
    )


@query("graph_roundtrip", pe("""select e.window_id, event_id as edge_id, a.node_id as src, b.node_id as dst, (select count(*) from dnodes) as all_nodes
  from wd e join dnodes a on a.window_id=e.window_id and a.entity_key=src_key join dnodes b on b.window_id=e.window_id and b.entity_key=dst_key where src_key<>dst_key""", DAY_NODES))
def graph_roundtrip(spark, sf):
    path = scratch_path(spark, "graph")
    windowed = day_windows(spark, sf)
    sinks.save_graphs(
        G.build_nodes(windowed, ["window_id"]), day_graph_edges(spark, sf), path, totals(windowed, G.remove_self_loops(windowed))
    )
    nodes, edges = readers.load_graph(spark, path)
    count = nodes.agg(F.count(F.lit(1))).scalar()
    return edges.select(F.col("window_id").cast("long").alias("window_id"), "edge_id", "src", "dst", count.alias("all_nodes"))


@query("scores_roundtrip", pe("select event_id, round(score,6) as score, label from sc where model='m3'", SCORES_SQL))
def scores_roundtrip(spark, sf):
    path = scratch_path(spark, "scores")
    sinks.save_scores(prov_scores(spark, sf), path)
    return readers.load_scores(spark, path, "m3").select("event_id", r6("score").alias("score"), "label")


_LABELS = f"""{DAYS}, dl as (select window_id as graph_id, case when sum(label)>(select count(*)/count(distinct cast(floor(ts_s/3600) as bigint)) from pe) then 1 else 0 end as label from wd group by 1)"""


@query("load_labels", pe("select graph_id, label from dl", _LABELS))
def load_labels(spark, sf):
    windowed = day_windows(spark, sf)
    cut = prov_events(spark, sf).agg(F.count(F.lit(1)) / F.countDistinct(F.floor(F.col("ts_s") / 3600))).scalar()
    days = windowed.groupBy(F.col("window_id").alias("graph_id")).agg(F.sum("label").alias("positives"))
    # one label document, one entry per day; days without positives are left to the default
    marked = days.where(F.col("positives") > cut).agg(F.map_from_entries(F.collect_list(F.struct("graph_id", F.lit(1)))).alias("m"))
    path = scratch_path(spark, "labels")
    marked.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return readers.load_labels(spark, path, days)


@query("load_embeddings", pe("""select entity_key, e.vec_id is not null as found, i-1 as i, round(cast(e.embedding[i] as double),6) as x
  from range(1,65) r(i), (select src_key as entity_key from pe union select dst_key from pe) k left join embeddings e on 'process:'||e.vec_id=k.entity_key"""))
def load_embeddings(spark, sf):
    path = scratch_path(spark, "vectors")
    vectors = prov_vectors(spark, sf)
    vectors.select("entity_key", "vec").write.parquet(path)
    nodes = G.endpoints(prov_events(spark, sf)).select("entity_key").distinct()
    known = vectors.select("entity_key", F.lit(True).alias("found"))
    out = readers.load_embeddings(spark, path, nodes, 64).join(known, "entity_key", "left")
    found = F.coalesce("found", F.lit(False))
    return out.select(
        "entity_key", found.alias("found"), F.posexplode("vec").alias("i", "x")
    ).select("entity_key", "found", F.col("i").cast("long").alias("i"), F.when(F.col("found"), r6("x")).alias("x"))


@query("materialize_roundtrip", pe("select src_key, count(*) as n from pe group by 1"))
def materialize_roundtrip(spark, sf):
    counts = prov_events(spark, sf).groupBy("src_key").agg(F.count(F.lit(1)).alias("n"))
    name = scratch_path(spark, "stage").rsplit("/", 1)[-1]
    sinks.materialize(counts, name)
    # the second call finds the stage's table and must not run its own input
    return sinks.materialize(counts.where("n < 0"), name)


@query("graphml_lines", pe("""select 1 as section, count(*) as lines, md5(string_agg(md5(l), '' order by md5(l))) as digest from (select '<node id="'||k||'"><data key="node_type">'||split_part(k,':',1)||'</data></node>' as l
   from (select src_key as k from pe union select dst_key from pe))
  union all select 2, count(*), md5(string_agg(md5(l), '' order by md5(l))) from (select '<edge source="'||src_key||'" target="'||dst_key||'"><data key="event_type">'||event_type||'</data><data key="timestamp">'||
   cast(ts_s as decimal(20,6))||'</data><data key="anomaly_score">'||score||'</data></edge>' as l from dg)""".replace("md5(string_agg(md5(l), '' order by md5(l)))", "cast(sum(('0x'||substr(md5(l),1,8))::bigint) as bigint)"), DIGRAPH))
def graphml_lines(spark, sf):
    events = prov_events(spark, sf)
    nodes = G.endpoints(events).select("entity_key").distinct().withColumn("entity_type", G.entity_type(F.col("entity_key")))
    path = scratch_path(spark, "graphml")
    sinks.export_graphml(nodes, G.simple_digraph(events), path)
    lines = spark.read.text(path).where("value like '<node%' or value like '<edge%'")
    digest = F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long")
    return lines.groupBy(F.when(F.col("value").startswith("<node"), 1).otherwise(2).alias("section")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(digest).alias("digest")
    )


@query("top_anomalies_json", pe("""select 'top' as report, cast(event_id as varchar) as item, score as value from (select event_id, score from pe order by score desc, event_id desc limit 100)
  union all select 'hours', cast(bucket as varchar), value from (select cast(floor(ts_s/3600)*3600 as bigint) as bucket, round(avg(score),6) as value, avg(score) as a from pe group by 1 order by a desc, bucket limit 50)"""))
def top_anomalies_json(spark, sf):
    root = scratch_path(spark, "reports")
    events = prov_events(spark, sf)
    sinks.save_top_anomalies(metrics.top_k(events.select("event_id", "score")), f"{root}/top")
    sinks.save_temporal(analysis.temporal_profile(events), f"{root}/hours")
    top = spark.read.schema("event_id long, score double, rank int").json(f"{root}/top")
    hours = spark.read.schema("bucket long, avg_score double").json(f"{root}/hours")
    return top.select(F.lit("top").alias("report"), F.col("event_id").cast("string").alias("item"), F.col("score").alias("value")).unionByName(
        hours.select(F.lit("hours").alias("report"), F.col("bucket").cast("string").alias("item"), r6("avg_score").alias("value"))
    )


@query("evaluation_json", pe("select model, count(*) as n, round(avg(score),6) as mean, round(median(score),6) as median from sc group by 1", SCORES_SQL))
def evaluation_json(spark, sf):
    path = scratch_path(spark, "evaluation")
    stats = metrics.score_stats(prov_scores(spark, sf), ["model"])
    for model in ("m1", "m2", "m3"):  # one run per model, as separate evaluations do
        sinks.save_evaluation(stats.where(F.col("model") == model), path)
    saved = spark.read.schema("n long, mean double, median double, model string").json(path)
    return saved.select("model", "n", r6("mean").alias("mean"), r6("median").alias("median"))


@query("run_metadata", "select position::integer as position, stage, '3600' as window_seconds, n as events from (values (0,'load'),(1,'window')) v(position,stage), (select count(*) as n from events)")
def run_metadata(spark, sf):
    import time

    seconds = {}
    for stage, df in (("load", prov_events(spark, sf)), ("window", tumbling_windows(prov_events(spark, sf)))):
        start = time.time()
        events = df.count()
        seconds[stage] = time.time() - start
    path = scratch_path(spark, "metadata")
    sinks.save_run_metadata(sinks.run_metadata(spark, seconds, {"window_seconds": "3600", "events": str(events)}), path)
    stored = spark.read.schema("position int, stage string, seconds double, config map<string,string>").json(path).where("seconds >= 0")
    return stored.select("position", "stage", F.col("config")["window_seconds"].alias("window_seconds"), F.col("config")["events"].cast("long").alias("events"))


def written(spark, rows, name):
    path = scratch_path(spark, name)
    rows.select("raw").repartition(8).write.text(path)
    return path


@query("logs_to_graphs", pe("""select window_id, (select count(*) from n2 where n2.window_id=w.window_id) as nodes, count(*) filter (src<>dst) as edges from w group by 1""", _RES.replace("res as (select p.event_id,", "res as (select p.ts_s, p.event_id,") + """,
  ok as materialized (select ts_s, src_key as src, dst_key as dst from res where src_key is not null and dst_key is not null),
  w as materialized (select *, cast(floor((ts_s-(select min(ts_s) from ok))/86400) as bigint) as window_id from ok),
  n2 as materialized (select window_id, src as k from w union select window_id, dst from w)"""))
def logs_to_graphs(spark, sf):
    """Audit record text files read, resolved, windowed by day and turned into node and edge tables."""
    path = written(spark, raw_cdm_events(spark, sf).unionByName(raw_cdm_entities(spark, sf)), "logs")
    return graph_sizes(*N.build_graphs(N.normalize(readers.read_ndjson(spark, path), ["cdm"])[0], 86400))


def graph_sizes(nodes, edges):
    n = nodes.groupBy("window_id").agg(F.count(F.lit(1)).alias("nodes"))
    return n.join(edges.groupBy("window_id").agg(F.count(F.lit(1)).alias("edges")), "window_id", "left").fillna(0, ["edges"])


@query("normalize_mixed", of("""select case file when 'cdm' then 'cdm' else file end as file, status, count(*) as n from (
   select 'ecs' as file, case when event_type='signup' and k>=90 then 'missing_target' else 'parsed' end as status from b
   union all select 'custom', 'parsed' from b union all select 'cdm', case when event_type in ('view','click') and k between 95 and 99 then 'missing_entities' else 'parsed' end from b) group by 1,2"""))
def normalize_mixed(spark, sf):
    records = R.parse(mixed_records(spark, sf).unionByName(raw_cdm_entities(spark, sf)))
    schema = {"timestamp_field": "when", "source_field": "actor", "target_field": "object", "event_type_field": "verb"}
    events, _ = N.normalize(records, custom_schema=schema)
    return events.groupBy("file", "status").agg(F.count(F.lit(1)).alias("n"))


if readers.avro_on_class_path():

    @query("avro_roundtrip", of("select event_type, count(*) as n from b group by 1"))
    def avro_roundtrip(spark, sf):
        path = scratch_path(spark, "avro")
        base(spark, sf).select("event_id", "event_type").write.format("avro").save(path)
        return readers.read_avro(spark, path).select(R.get("v", "datum", "event_type").alias("event_type")).groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n")
        )
