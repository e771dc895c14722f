"""Semi-structured records: one parse into VARIANT, format detection, generic JSON mapping, parse reports.

Record tables are ``(file, pos, raw, v)``: ``pos`` orders the records of a file, ``v`` is the parsed record.
Event tables are ``(file, pos, event_id, event_type, src_key, dst_key, ts_s, attributes, status)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoorline.functions.times import to_epoch
from spoorline.operators.ranking import first_per_group
from spoorline.session import cut

ATTRIBUTES = "map<string,string>"

# Record classes that tell the audit format.
CDM_CLASSES = ["Event", "Subject", "FileObject", "NetFlowObject", "Host", "Principal"]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds costly columns so that they are evaluated once per row.

    A generator over a one-element array keeps later filters from being pushed below it, which would evaluate
    the columns a second time inside the filter.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# a JSON string, or one of the number words that JSON does not know but log writers use
_WORDS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(?<![A-Za-z0-9_])-?(?:NaN|Infinity)(?![A-Za-z0-9_])'


def finite(raw: Column) -> Column:
    """The text with the words ``NaN`` and ``Infinity`` outside strings as ``null``."""
    marked = F.regexp_replace(raw, _WORDS, "$1\u0001")
    named = F.replace(F.replace(marked, F.lit('"\u0001'), F.lit('"')), F.lit("\u0001"), F.lit("null"))
    return F.when((raw.contains("NaN") | raw.contains("Infinity")) & ~raw.contains("\u0001"), named).otherwise(raw)


def strictly(raw: Column) -> tuple[Column, Column]:
    """The text wrapped and parsed, and a test of the result that holds only if all of the text is one JSON value.

    The parser accepts text that merely starts with a value. Closed between a bracket and a number of its own, only a
    whole value leaves exactly two elements, the second being that number. Of a repeated key the last value counts
    (``session.configure``); numbers that are not finite become null.
    """
    own = F.xxhash64(raw)
    wrapped = F.try_parse_json(F.concat(F.lit("["), finite(raw), F.lit(","), own.cast("string"), F.lit("]")))
    return wrapped, lambda w: (F.try_variant_get(w, "$[1]", "bigint") == own) & F.try_variant_get(w, "$[2]", "variant").isNull()


def parse(records: DataFrame) -> DataFrame:
    """Adds the record parsed once as VARIANT; text that is not one JSON object from end to end is dropped."""
    wrapped, whole = strictly(F.col("raw"))
    held = once(records.where(F.trim("raw").startswith("{")), __w=wrapped)
    return held.where(whole(F.col("__w"))).withColumn("v", F.try_variant_get("__w", "$[0]", "variant")).drop("__w")


def get(v: Column | str, *path: str, kind: str = "string") -> Column:
    """Value at a path of (possibly dotted) keys, NULL when absent."""
    return F.try_variant_get(v, "$" + "".join(f'["{key}"]' for key in path), kind)


def has(v: Column | str, *path: str) -> Column:
    return get(v, *path, kind="variant").isNotNull()


def text(v: Column | str, *path: str, default: str = "") -> Column:
    return F.coalesce(get(v, *path), F.lit(default))


def as_map(v: Column) -> Column:
    """An object's fields as a string map (nested values as JSON text)."""
    return F.coalesce(F.try_variant_get(v, "$", ATTRIBUTES), F.create_map().cast(ATTRIBUTES))


def attribute_map(**values: Column) -> Column:
    """String map of the non-NULL values."""
    pairs = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in values.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def record_format(v: Column) -> Column:
    """``cdm``, ``ecs`` or ``custom`` by the fields of one record."""
    known = F.lit(False)
    for name in CDM_CLASSES:
        known = known | has(v, "datum", f"com.bbn.tc.schema.avro.cdm18.{name}")
    cdm = has(v, "datum") & (known | has(v, "CDMVersion") | has(v, "source"))
    ecs = has(v, "@timestamp") & (has(v, "event") | has(v, "data_stream") | has(v, "ecs"))
    return F.when(cdm, "cdm").when(ecs, "ecs").otherwise("custom")


def detect_format(records: DataFrame) -> DataFrame:
    """Format per file, from its first record."""
    return records.groupBy("file").agg(F.min_by(record_format(F.col("v")), "pos").alias("format"))


def with_format(records: DataFrame) -> DataFrame:
    """Adds the format of the record's file. The parsed records are stored once: formats and all later readers read that."""
    stored = cut(records.withColumn("__own", record_format(F.col("v"))))
    formats = cut(stored.groupBy("file").agg(F.min_by("__own", "pos").alias("format")))
    return stored.drop("__own").join(formats, "file")


def limit_records_per_file(records: DataFrame, n: int) -> DataFrame:
    """The first ``n`` records read of each file, whether or not they become events."""
    return first_per_group(records, ["file"], ["pos"], n)


def seconds_text(ts: Column) -> Column:
    """Unix seconds as shortest decimal text with at least one decimal."""
    fixed = ts.cast("decimal(20,6)").cast("string")
    trimmed = F.regexp_replace(fixed, "0+$", "")
    return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)


def synth_event_id(ts: Column, source_id: Column, event_type: Column) -> Column:
    return F.concat_ws("_", seconds_text(ts), source_id, event_type)


def require_fields(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Marks records that hold every required top-level field."""
    ok = F.lit(True)
    for field in fields:
        ok = ok & has("v", field)
    return records.withColumn("valid", ok)


def extract_attributes(records: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Listed dotted fields as an attribute map; absent ones are left out."""
    return records.withColumn("attributes", attribute_map(**{p: get("v", *p.split(".")) for p in paths}))


def custom_events(
    records: DataFrame, timestamp_field: str = "timestamp", source_field: str = "source",
    target_field: str = "target", event_type_field: str = "type", compat: bool = False,
) -> DataFrame:
    """Generic JSON with configurable field names; an endpoint is a string or an object with id / name / type."""
    def endpoint(field: str) -> Column:
        value = get("v", field, kind="variant")
        is_object = F.expr(f"schema_of_variant(try_variant_get(v, '$[\"{field}\"]', 'variant'))").startswith("OBJECT")
        ident = F.when(is_object | value.isNull(), F.coalesce(get("v", field, "id"), get("v", field, "name"), F.lit("unknown")))
        return F.struct(
            ident.otherwise(get("v", field)).alias("id"),
            F.when(is_object, text("v", field, "type", default="entity")).otherwise(F.lit("entity")).alias("type"),
            F.when(is_object, as_map(value)).otherwise(F.create_map().cast(ATTRIBUTES)).alias("attributes"),
        )

    ts = to_epoch(F.coalesce(get("v", timestamp_field), F.lit("0")), compat)
    return (
        records.withColumns({"s": endpoint(source_field), "t": endpoint(target_field), "ts_s": ts})
        .withColumn("event_type", text("v", event_type_field, default="unknown"))
        .select(
            "file", "pos", synth_event_id(F.col("ts_s"), F.col("s.id"), F.col("event_type")).alias("event_id"), "event_type",
            F.concat_ws(":", "s.type", "s.id").alias("src_key"), F.concat_ws(":", "t.type", "t.id").alias("dst_key"),
            "ts_s", as_map(F.col("v")).alias("attributes"), F.col("s.attributes").alias("src_attributes"),
            F.col("t.attributes").alias("dst_attributes"),
            F.when(F.col("ts_s").isNull(), "bad_timestamp").otherwise("parsed").alias("status"),
        )
    )


def event_entities(events: DataFrame) -> DataFrame:
    """Entity records seen by events that carry both ends' attributes: input of ``entity_registry``."""
    ends = F.array(
        F.struct(F.col("src_key").alias("entity_key"), F.col("src_attributes").alias("attributes"), F.lit(0).alias("side")),
        F.struct(F.col("dst_key").alias("entity_key"), F.col("dst_attributes").alias("attributes"), F.lit(1).alias("side")),
    )
    return (
        events.select("file", "pos", F.explode(ends).alias("e")).where(F.col("e.entity_key").isNotNull())
        .select(
            "e.entity_key", F.substring_index("e.entity_key", ":", 1).alias("entity_type"), "e.attributes", "file",
            (F.col("pos") * 2 + F.col("e.side")).alias("pos"),
        )
    )


def parse_report(events: DataFrame, category: str = "event_type") -> DataFrame:
    """Counts per status and, for parsed events, per category, descending."""
    entry = F.array(
        F.struct(F.lit("status").alias("metric"), F.col("status").alias("value")),
        F.when(F.col("status") == "parsed", F.struct(F.lit("event").alias("metric"), F.col(category).alias("value"))),
    )
    return (
        events.select(F.explode(F.array_compact(entry)).alias("m")).groupBy("m.metric", "m.value")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "metric", "value")
    )
