"""From records of any known format to resolved events, entities and windowed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorline.operators import cdm, ecs
from spoorline.operators import graph as G
from spoorline.operators.records import custom_events, event_entities, with_format
from spoorline.operators.windows import tumbling_windows
from spoorline.session import cut

EVENT_COLUMNS = ["file", "pos", "event_id", "event_type", "src_key", "dst_key", "ts_s", "attributes", "status"]

# format name → (events with both keys and a status, entity records); users may add their own
def _cdm(records: DataFrame, _) -> tuple[DataFrame, DataFrame]:
    """The text is read and parsed once: the unwrapped records are stored, events and entities read them."""
    opened = cut(cdm.unwrap(records).select("file", "pos", "rec", "record_type"))
    entities = cut(cdm.entities(opened))
    return cdm.resolve_entities(cdm.events(opened), entities), entities.select("entity_key", "entity_type", "attributes", "file", "pos")


def _stored(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    events = cut(events)
    return events, event_entities(events)


FORMATS = {
    "cdm": _cdm,
    "ecs": lambda r, _: _stored(ecs.events(r)),
    "custom": lambda r, schema: _stored(custom_events(r, **schema)),
}


def normalize(
    records: DataFrame, formats: list[str] | None = None, custom_schema: dict[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(events, entities)`` of parsed records; each file's format comes from its first record.

    ``formats`` names the only formats to expect; with a single one nothing is sniffed. ``custom_schema`` holds
    the field names of the generic format.
    """
    wanted = formats or list(FORMATS)
    if len(wanted) > 1:
        records = with_format(records)
    events, entities = None, None
    for name in wanted:
        rows = records if len(wanted) == 1 else records.where(F.col("format") == name).drop("format")
        e, n = FORMATS[name](rows, custom_schema or {})
        e = e.select(EVENT_COLUMNS)
        events = e if events is None else events.unionByName(e)
        entities = n if entities is None else entities.unionByName(n)
    return events, entities


def build_graphs(events: DataFrame, window_seconds: float = 3600) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` per time window of the parsed events; self-loops become nodes but no edges.

    The parsed events are stored once: windows, nodes, types and edges all read them again.
    """
    per = ["window_id"]
    parsed = events.where("status = 'parsed' and ts_s is not null")
    windowed = tumbling_windows(cut(parsed.select("event_id", "event_type", "src_key", "dst_key", "ts_s")), window_seconds)
    kept = G.remove_self_loops(windowed)
    nodes = G.build_nodes(windowed, per)
    return nodes, G.build_edges(kept, nodes, G.edge_type_dict(kept, per), per)
