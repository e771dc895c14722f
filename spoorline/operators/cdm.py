"""Audit records of the CDM format: events, entities, hosts, and uuid resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.times import to_epoch
from spoorline.functions.vocab import CDM_PREFIX, ENTITY_TYPES, EVENT_TYPES, lookup
from spoorline.operators.records import as_map, attribute_map, get, has, once

UUID = "com.bbn.tc.schema.avro.cdm18.UUID"


def infer_type(d: str = "datum") -> Column:
    """Record class of a bare record from its fields; the order of the tests matters."""
    return (
        F.when(get(d, "type").isin(list(EVENT_TYPES)), "Event")
        .when(has(d, "pid") | has(d, "ppid") | has(d, "cid") | has(d, "cmdLine") | has(d, "parentSubject"), "Subject")
        .when(has(d, "fileDescriptor") | F.coalesce(get(d, "baseObject"), F.lit("")).contains("path"), "FileObject")
        .when(has(d, "srcAddress") & has(d, "destAddress"), "NetFlowObject")
        .when(has(d, "hostName") & has(d, "hostType"), "Host")
        .when(has(d, "username"), "Principal")
        .otherwise("unknown")
    )


def unwrap(records: DataFrame) -> DataFrame:
    """Adds ``rec`` (the record) and ``record_type``: the wrapper's class, or inferred for a bare record.

    Records that are unwrapped already stay as they are, so a stored unwrapped table serves all readers.
    """
    if "rec" in records.columns:
        return records
    fields = F.try_variant_get("v", "$.datum", "map<string,variant>")
    opened = once(records, datum=get("v", "datum", kind="variant"), fields=fields).where(F.col("datum").isNotNull())
    key = F.try_element_at(F.filter(F.map_keys("fields"), lambda k: k.startswith(CDM_PREFIX)), F.lit(1))
    keyed = once(opened, wrapper=key)
    bare = F.col("wrapper").isNull()
    return once(
        keyed,
        rec=F.when(bare, F.col("datum")).otherwise(F.try_element_at("fields", F.col("wrapper"))),
        record_type=F.when(bare, infer_type()).otherwise(F.substring_index("wrapper", ".", -1)),
    ).drop("datum", "fields", "wrapper")


def reference(field: str) -> Column:
    """A uuid given as plain text or wrapped in the union key."""
    return F.coalesce(get("rec", field, UUID), get("rec", field))


def map_event_type(kind: Column) -> Column:
    return lookup(EVENT_TYPES, kind, "other")


def map_entity_type(record_type: Column) -> Column:
    """Entity type of a record class; an unlisted class keeps its lower-case name."""
    return F.coalesce(lookup(ENTITY_TYPES, record_type, None), F.lower(record_type))


def _event(compat: bool) -> list[Column]:
    """The columns of an event record before resolution."""
    kind = F.coalesce(get("rec", "type"), F.lit("EVENT_OTHER"))
    return [
        F.col("file"), F.col("pos"), F.coalesce(get("rec", "uuid"), F.lit("")).alias("event_id"), map_event_type(kind).alias("event_type"),
        to_epoch(F.coalesce(get("rec", "timestampNanos"), F.lit("0")), compat).alias("ts_s"),
        reference("subject").alias("src_uuid"), reference("predicateObject").alias("dst_uuid"),
        attribute_map(
            cdm_type=kind, predicate_object2=reference("predicateObject2"), thread_id=get("rec", "threadId"),
            sequence=get("rec", "sequence"), properties=get("rec", "properties"),
        ).alias("attributes"),
    ]


def events(records: DataFrame, compat: bool = False) -> DataFrame:
    """Event records before resolution: both uuids, mapped type, time and attributes."""
    return unwrap(records).where("record_type = 'Event'").select(*_event(compat))


def _entity(uuid: Column) -> tuple[Column, Column]:
    """Id and attributes of an entity record."""
    kind = F.col("record_type")
    pid = F.coalesce(get("rec", "pid"), get("rec", "cid"))
    path = F.coalesce(get("rec", "baseObject", "properties", "path"), get("rec", "baseObject", "properties", "map", "path"))
    flow = {
        "src_address": get("rec", "srcAddress"), "src_port": get("rec", "srcPort"),
        "dest_address": get("rec", "destAddress"), "dest_port": get("rec", "destPort"),
    }
    part = {k: F.coalesce(c, F.lit("None")) for k, c in flow.items()}
    entity_id = (
        F.when((kind == "Subject") & pid.isNotNull(), F.concat_ws("_", F.lit("pid"), pid, F.substring(uuid, 1, 8)))
        .when(kind == "FileObject", F.coalesce(F.nullif(path, F.lit("")), uuid))
        .when(kind == "NetFlowObject", F.concat(
            part["src_address"], F.lit(":"), part["src_port"], F.lit("-"), part["dest_address"], F.lit(":"), part["dest_port"]))
        .otherwise(uuid)
    )
    attributes = (
        F.when(kind == "Subject", attribute_map(
            pid=pid, ppid=get("rec", "ppid"), cid=get("rec", "cid"), cmdline=get("rec", "cmdLine"),
            properties=get("rec", "properties"), local_principal=reference("localPrincipal"),
            parent_subject=reference("parentSubject")))
        .when(kind == "FileObject", attribute_map(
            path=path, file_descriptor=get("rec", "fileDescriptor"), properties=get("rec", "baseObject", "properties")))
        .when(kind == "NetFlowObject", attribute_map(**flow, protocol=get("rec", "ipProtocol")))
        .otherwise(as_map(F.col("rec")))
    )
    return entity_id, attributes


def entities(records: DataFrame) -> DataFrame:
    """All entity records in one projection: ``(entity_key, entity_id, entity_type, uuid, attributes, file, pos)``."""
    kind, uuid = F.col("record_type"), F.col("uuid")
    entity_id, attributes = _entity(uuid)
    return (
        unwrap(records).where(kind.isin(list(ENTITY_TYPES)))
        .withColumn("uuid", get("rec", "uuid")).where(uuid.isNotNull() & (uuid != ""))
        .select(
            entity_id.alias("entity_id"), map_entity_type(kind).alias("entity_type"), "uuid",
            attributes.alias("attributes"), "file", "pos",
        )
        .withColumn("entity_key", F.concat_ws(":", "entity_type", "entity_id"))
    )


def events_and_entities(records: DataFrame) -> DataFrame:
    """The rows of ``events`` and ``entities``, as ``(event, uuid, entity_key, file, pos)``: an event's columns are in ``event``,
    which an entity's row has not. Every record is read and opened once, also in a stream."""
    kind, uuid = F.col("record_type"), F.col("uuid")
    is_event = kind == "Event"
    opened = unwrap(records).withColumn("uuid", get("rec", "uuid")).where(is_event | (kind.isin(list(ENTITY_TYPES)) & uuid.isNotNull() & (uuid != "")))
    entity_id, _ = _entity(uuid)
    return once(
        opened, event=F.when(is_event, F.struct(*_event(False))),
        entity_key=F.when(~is_event, F.concat_ws(":", map_entity_type(kind), entity_id)),
    ).select("event", F.when(~is_event, uuid).alias("uuid"), "entity_key", "file", "pos")


def subjects(records: DataFrame) -> DataFrame:
    return entities(records).where("entity_type = 'process'")


def files(records: DataFrame) -> DataFrame:
    return entities(records).where("entity_type = 'file'")


def netflows(records: DataFrame) -> DataFrame:
    return entities(records).where("entity_type = 'network'")


def other_entities(records: DataFrame) -> DataFrame:
    """Memory, source/sink, principal and registry records: id is the uuid, attributes the whole record."""
    return entities(records).where(~F.col("entity_type").isin("process", "file", "network"))


def hosts(records: DataFrame) -> DataFrame:
    return unwrap(records).where("record_type = 'Host'").select(
        F.coalesce(get("rec", "hostName"), F.lit("")).alias("hostname"), F.coalesce(get("rec", "uuid"), F.lit("")).alias("uuid"),
        F.coalesce(get("rec", "osDetails"), F.lit("")).alias("os"), get("rec", "interfaces").alias("interfaces"), "file", "pos",
    )


def record_types(records: DataFrame) -> DataFrame:
    """Records per class."""
    return unwrap(records).groupBy("record_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "record_type")


def resolve_entities(event_table: DataFrame, entity_table: DataFrame, strict_order: bool = False) -> DataFrame:
    """Events with both entity keys and a status, ``parsed`` or ``missing_entities``.

    Joins on the uuid whatever the order of records; ``strict_order`` resolves only to entities that were
    recorded before the event. The latest record of a uuid names its entity.
    """
    by_uuid = entity_table.groupBy("uuid").agg(
        F.max_by("entity_key", F.struct("file", "pos")).alias("key"), F.min(F.struct("file", "pos")).alias("since")
    )
    out = event_table
    for side in ("src", "dst"):
        named = by_uuid.withColumnsRenamed({"uuid": f"{side}_uuid", "key": f"{side}_key", "since": f"{side}_since"})
        out = out.join(named, f"{side}_uuid", "left")
        if strict_order:
            seen = F.col(f"{side}_since") < F.struct("file", "pos")
            out = out.withColumn(f"{side}_key", F.when(seen, F.col(f"{side}_key")))
    resolved = F.col("src_key").isNotNull() & F.col("dst_key").isNotNull()
    return out.drop("src_since", "dst_since").withColumn(
        "status", F.when(resolved, "parsed").otherwise("missing_entities")
    )


def second_object(event_table: DataFrame, expand: bool = False) -> DataFrame:
    """The second object's uuid as a column; ``expand`` adds one event row per second object."""
    second = F.col("attributes")["predicate_object2"]
    if not expand:
        return event_table.withColumn("dst2_uuid", second)
    targets = F.array_compact(F.array("dst_uuid", second))
    return event_table.withColumn("dst_uuid", F.explode(targets))
