"""Checksums that Spark lacks, from tables built by rule; batches come as Arrow arrays."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: The reflected polynomials of CRC-32C and of CRC-64/NVME.
CRC32C, CRC64 = 0x82F63B78, 0x9A6C9329AC4BC9B5
PIECE = 65536


@cache
def table(polynomial: int) -> tuple[int, ...]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (polynomial if byte & 1 else 0)
        out.append(byte)
    return tuple(out)


def crc(data: bytes, polynomial: int, bits: int) -> int:
    entries, value = table(polynomial), (1 << bits) - 1
    for byte in data:
        value = entries[(value ^ byte) & 255] ^ value >> 8
    return value ^ (1 << bits) - 1


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else crc(b, CRC32C, 32)).astype("Int64")


@F.pandas_udf(T.StringType())
def crc64nvme(data: pd.Series) -> pd.Series:
    """Sixteen hex digits, as a signed long would turn negative."""
    return data.map(lambda b: None if b is None else format(crc(b, CRC64, 64), "016x"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def crc32c_pieces(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else [crc(b[a : a + PIECE], CRC32C, 32) for a in range(0, len(b), PIECE)])


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def checksums(data: Column) -> dict[str, Column]:
    """All checksums an upload may carry; three are built in."""
    return {"crc32": F.crc32(data), "crc32c": crc32c(data), "crc64": crc64nvme(data), "sha1": F.sha1(data), "sha256": F.sha2(data, 256)}
