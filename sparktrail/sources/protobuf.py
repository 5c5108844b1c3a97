"""Log exports in protobuf, as the JSON that the same request would have: both go through one normaliser."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: the fields of the public log export messages that are read, by number: (name, kind, repeated)
ANY: dict = {1: ("stringValue", "text", False), 2: ("boolValue", "bool", False), 3: ("intValue", "int", False), 4: ("doubleValue", "double", False), 7: ("bytesValue", "bytes", False)}
KEY_VALUE = {1: ("key", "text", False), 2: ("value", ANY, False)}
ANY[5] = ("arrayValue", {1: ("values", ANY, True)}, False)
ANY[6] = ("kvlistValue", {1: ("values", KEY_VALUE, True)}, False)
RECORD = {
    1: ("timeUnixNano", "fixed", False), 11: ("observedTimeUnixNano", "fixed", False), 5: ("body", ANY, False), 6: ("attributes", KEY_VALUE, True),
    9: ("traceId", "hex", False), 10: ("spanId", "hex", False), 12: ("eventName", "text", False),
}
SCOPE_LOGS = {2: ("logRecords", RECORD, True)}
RESOURCE_LOGS = {1: ("resource", {1: ("attributes", KEY_VALUE, True)}, False), 2: ("scopeLogs", SCOPE_LOGS, True)}
REQUEST = {1: ("resourceLogs", RESOURCE_LOGS, True)}

#: Messages may hold messages up to this depth; deeper ones are malformed.
DEEPEST = 32


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        if shift >= 70:
            raise ValueError("varint too long")


def decode(data: memoryview, fields: dict, depth: int = 0) -> dict:
    """A message's known fields; others are skipped. ValueError for what isn't a message."""
    if depth > DEEPEST:
        raise ValueError("too deep")
    out: dict = {}
    at = 0
    try:
        while at < len(data):
            tag, at = _varint(data, at)
            wire, known = tag & 7, fields.get(tag >> 3)
            if wire == 0:
                value, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
                value, at = bytes(data[at : at + size]), at + size
            elif wire == 2:
                size, at = _varint(data, at)
                value, at = data[at : at + size], at + size
                if len(value) < size:
                    raise ValueError("cut off")
            else:
                raise ValueError("unknown wire type")
            if at > len(data):
                raise ValueError("cut off")
            if known is None:
                continue
            name, kind, repeated = known
            if (wire == 2) != (kind in ("text", "bytes", "hex") or isinstance(kind, dict)) or (wire == 0) != (kind in ("bool", "int")):
                raise ValueError("another wire type than the field has")
            made = _value(value, kind, depth)
            if repeated:
                out.setdefault(name, []).append(made)
            else:
                out[name] = made
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(str(e)) from e
    return out


def _value(value, kind, depth: int):
    if isinstance(kind, dict):
        return decode(value, kind, depth + 1)
    if kind == "text":
        return bytes(value).decode()
    if kind == "bytes":
        return base64.b64encode(value).decode()
    if kind == "hex":
        return bytes(value).hex()
    if kind == "bool":
        return value != 0
    if kind == "double":
        return struct.unpack("<d", value)[0]
    return str(value - (1 << 64) if kind == "int" and value >= 1 << 63 else value if kind == "int" else struct.unpack("<Q", value)[0])


def as_json(raw: DataFrame) -> DataFrame:
    """raw's column body (binary, log export requests in protobuf) as JSON texts; null for malformed and null bodies.

    Other columns stay. Numbers of 64 bits are texts in that JSON, ids are hexadecimal; numbers that JSON lacks go as texts.
    """
    names, at = raw.columns, raw.columns.index("body")

    def text(body: bytes | None) -> str | None:
        if body is None:
            return None
        try:
            return json.dumps(_finite(decode(memoryview(body), REQUEST)))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([text(x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'body' else f.dataType.simpleString()}" for f in raw.schema)
    return raw.mapInArrow(run, fields)


def _finite(x):
    if isinstance(x, dict):
        return {k: _finite(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_finite(v) for v in x]
    return x if not isinstance(x, float) or abs(x) < float("inf") else str(x)
