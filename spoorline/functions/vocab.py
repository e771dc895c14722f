"""Vocabularies of the record formats and code tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Audit-record classes and the entity types they denote.
ENTITY_TYPES = {
    "Subject": "process",
    "FileObject": "file",
    "NetFlowObject": "network",
    "MemoryObject": "memory",
    "SrcSinkObject": "socket",
    "Principal": "principal",
    "RegistryKeyObject": "registry",
}

# Audit event types and their short names.
EVENT_TYPES = {
    "EVENT_EXECUTE": "exec",
    "EVENT_FORK": "fork",
    "EVENT_CLONE": "clone",
    "EVENT_EXIT": "exit",
    "EVENT_READ": "read",
    "EVENT_WRITE": "write",
    "EVENT_OPEN": "open",
    "EVENT_CLOSE": "close",
    "EVENT_MMAP": "mmap",
    "EVENT_CONNECT": "connect",
    "EVENT_ACCEPT": "accept",
    "EVENT_SENDTO": "sendto",
    "EVENT_RECVFROM": "recvfrom",
    "EVENT_SENDMSG": "sendmsg",
    "EVENT_RECVMSG": "recvmsg",
    "EVENT_RENAME": "rename",
    "EVENT_LINK": "link",
    "EVENT_UNLINK": "unlink",
    "EVENT_CREATE_OBJECT": "create",
    "EVENT_MODIFY_FILE_ATTRIBUTES": "modify_attr",
    "EVENT_LOADLIBRARY": "loadlib",
    "EVENT_OTHER": "other",
}

# Numeric code of an entity type in the node features.
NODE_CODES = {
    "process": 1.0,
    "file": 2.0,
    "network": 3.0,
    "socket": 4.0,
    "memory": 5.0,
    "registry": 6.0,
    "principal": 7.0,
}

# Numeric code of an event type in the edge features.
EDGE_CODES = {
    "exec": 1.0,
    "fork": 2.0,
    "read": 3.0,
    "write": 4.0,
    "open": 5.0,
    "close": 6.0,
    "connect": 7.0,
    "accept": 8.0,
    "send": 9.0,
    "sendto": 9.0,
    "sendmsg": 9.0,
    "recv": 10.0,
    "recvfrom": 10.0,
    "recvmsg": 10.0,
}

CDM_PREFIX = "com.bbn.tc.schema.avro.cdm"


def lookup(mapping: dict, key: Column, default) -> Column:
    """Value of a literal map at ``key``, else ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
