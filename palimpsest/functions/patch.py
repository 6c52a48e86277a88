"""The binary patch body: magic, version, three reserved bytes, a count, then offset, length and bytes of each edit, big-endian."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F, types as T

#: Fixed values of the format: magic, version, the most edits and the largest body.
MAGIC, VERSION, MOST_EDITS, MOST_BYTES = b"VFSP", 1, 10_000, 64 << 20


class PatchError(ValueError):
    pass


def encode(edits: list[tuple[int, bytes]]) -> bytes:
    return b"".join([MAGIC, bytes([VERSION, 0, 0, 0]), struct.pack(">I", len(edits)), *(struct.pack(">QQ", off, len(data)) + data for off, data in edits)])


def decode(body: bytes) -> list[tuple[int, bytes]]:
    """The edits, or a PatchError that names the first fault."""
    if len(body) > MOST_BYTES:
        raise PatchError("too large")
    if len(body) < 12:
        raise PatchError("truncated")
    magic, version, reserved, count = body[:4], body[4], body[5:8], struct.unpack(">I", body[8:12])[0]
    for wrong, fault in ((magic != MAGIC, "magic"), (version != VERSION, "version"), (any(reserved), "reserved"), (not 1 <= count <= MOST_EDITS, "count")):
        if wrong:
            raise PatchError(fault)
    at, out = 12, []
    for i in range(count):
        if len(body) - at < 16:
            raise PatchError(f"edit {i} truncated")
        offset, n = struct.unpack(">QQ", body[at : at + 16])
        at += 16
        if len(body) - at < n:
            raise PatchError(f"edit {i} truncated")
        if offset + n >= 1 << 64:
            raise PatchError(f"edit {i} overflow")
        out.append((offset, body[at : at + n]))
        at += n
    if at != len(body):
        raise PatchError("trailing")
    return out


def _decoded(body: bytes | None) -> dict | None:
    if body is None:
        return None
    try:
        return {"error": None, "edits": [{"ord": i, "off": off, "data": data} for i, (off, data) in enumerate(decode(body))]}
    except PatchError as fault:
        return {"error": str(fault), "edits": []}


_EDIT = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("off", T.LongType()), T.StructField("data", T.BinaryType())])
_RESULT = T.StructType([T.StructField("error", T.StringType()), T.StructField("edits", T.ArrayType(_EDIT))])


@F.pandas_udf(_RESULT)
def decode_patch(body: pd.Series) -> pd.DataFrame:
    """error, or null and the edits."""
    found = [_decoded(b) or {"error": None, "edits": None} for b in body]
    return pd.DataFrame({"error": [f["error"] for f in found], "edits": [f["edits"] for f in found]})


@F.pandas_udf(T.BinaryType())
def encode_patch(edits: pd.Series) -> pd.Series:
    """A body from an array of structs (off, data)."""
    return edits.map(lambda xs: None if xs is None else encode([(int(x["off"]), bytes(x["data"])) for x in xs]))
