"""Elastic-style records: process sources, targets by category, events.

The fields are fixed, so the text is read straight into a struct (one typed parse per record); numbers and lists
arrive as text where a field may hold either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.times import to_epoch
from spoorline.operators.records import once, synth_event_id

_PROCESS = "entity_id:string,executable:string,name:string,pid:string"
SCHEMA = (
    "`@timestamp` string, event struct<action:string,category:string,outcome:string>, "
    f"process struct<{_PROCESS},parent:struct<{_PROCESS}>>, "
    "file struct<path:string,name:string,extension:string>, source struct<ip:string,port:string>, "
    "destination struct<ip:string,port:string>, network struct<transport:string>, user struct<name:string>, "
    "host struct<hostname:string>, _bad string"
)


def field(path: str, default: str = "") -> Column:
    return F.coalesce(F.col(f"j.{path}"), F.lit(default))


def process_id(path: str) -> Column:
    """The entity id, or ``executable:pid`` where it is missing or empty."""
    fallback = F.concat(field(f"{path}.executable", "unknown"), F.lit(":"), field(f"{path}.pid"))
    return F.coalesce(F.nullif(F.col(f"j.{path}.entity_id"), F.lit("")), fallback)


def _map(**values: Column) -> Column:
    return F.create_map(*[x for k, c in values.items() for x in (F.lit(k), c)])


def source_attributes() -> Column:
    return _map(
        name=field("process.name"), executable=field("process.executable"), pid=field("process.pid"),
        ppid=field("process.parent.pid"),
    )


def file_target() -> Column:
    path = F.coalesce("j.file.path", "j.file.name", F.lit(""))
    return F.struct(
        F.concat(F.lit("file:"), path).alias("key"),
        _map(path=path, name=field("file.name"), extension=field("file.extension")).alias("attributes"),
    )


def network_target() -> Column:
    ip, port = field("destination.ip"), field("destination.port")
    ident = F.when((port != "") & (port != "0"), F.concat(ip, F.lit(":"), port)).otherwise(ip)
    return F.struct(
        F.concat(F.lit("network:"), ident).alias("key"),
        _map(
            dest_ip=ip, dest_port=port, src_ip=field("source.ip"), src_port=field("source.port"),
            transport=field("network.transport"),
        ).alias("attributes"),
    )


def parent_target() -> Column:
    return F.struct(
        F.concat(F.lit("process:"), process_id("process.parent")).alias("key"),
        _map(
            name=field("process.parent.name"), executable=field("process.parent.executable"), pid=field("process.parent.pid")
        ).alias("attributes"),
    )


def category() -> Column:
    """The scalar category or the first of a list, ``unknown`` when absent or empty."""
    text = F.col("j.event.category")
    first = F.when(text.startswith("["), F.get_json_object(text, "$[0]")).otherwise(text)
    return F.coalesce(first, F.lit("unknown"))


def events(records: DataFrame, compat: bool = False) -> DataFrame:
    """All records ``(file, pos, raw)`` as event rows.

    Categories without a target have status ``missing_target``, text that is no JSON object ``bad_json``.
    """
    target = (
        F.when(F.col("category") == "file", file_target())
        .when(F.col("category") == "network", network_target())
        .when(F.col("category") == "process", parent_target())
    )
    parsed = once(
        records.select("file", "pos", "raw"), j=F.from_json("raw", SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    ).drop("raw")
    fielded = once(
        parsed, category=category(), source_id=process_id("process"), ts_s=to_epoch(field("@timestamp"), compat),
        event_type=field("event.action", "unknown"),
    )
    return once(fielded, t=target).select(
        "file", "pos", synth_event_id(F.col("ts_s"), F.col("source_id"), F.col("event_type")).alias("event_id"),
        "event_type", "category", F.concat(F.lit("process:"), "source_id").alias("src_key"), F.col("t.key").alias("dst_key"),
        "ts_s",
        _map(
            category=F.col("category"), user=field("user.name"), host=field("host.hostname"), outcome=field("event.outcome")
        ).alias("attributes"),
        source_attributes().alias("src_attributes"), F.col("t.attributes").alias("dst_attributes"),
        F.when(F.col("j").isNull() | F.col("j._bad").isNotNull(), "bad_json").when(F.col("t").isNull(), "missing_target")
        .when(F.col("ts_s").isNull(), "bad_timestamp").otherwise("parsed").alias("status"),
    )
