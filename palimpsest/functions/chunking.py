"""Content-defined chunking as FastCDC's 2020 paper has it: a gear hash that takes two bytes a step, and a mask of more bits
before the normal size than after it (normalisation level 1).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.session import send_package

LEAST, NORMAL, MOST = 256 << 10, 2 << 20, 16 << 20
#: The ranges that the least, normal and largest sizes may be in.
RANGES = ((64, 1 << 20), (256, 4 << 20), (1024, 16 << 20))
#: The gear table's rule: the first eight bytes of the MD5 of 64 times the byte.
_GEAR = [int.from_bytes(hashlib.md5(bytes([b]) * 64, usedforsecurity=False).digest()[:8], "big") for b in range(256)]
_ALL = (1 << 64) - 1
_TWICE = [x << 1 & _ALL for x in _GEAR]
#: The published masks of 5 to 25 bits.
MASKS = (
    0x0000000001804110, 0x0000000001803110, 0x0000000018035100, 0x0000001800035300, 0x0000019000353000, 0x0000590003530000, 0x0000D90003530000,
    0x0000D90103530000, 0x0000D90303530000, 0x0000D90313530000, 0x0000D90F03530000, 0x0000D90303537000, 0x0000D90703537000, 0x0000D90707537000,
    0x0000D91707537000, 0x0000D91747537000, 0x0000D91767537000, 0x0000D93767537000, 0x0000D93777537000, 0x0000D93777577000, 0x0000DB3777577000,
)


def sizes_fit(least: Column, normal: Column, most: Column) -> Column:
    """Whether sizes are even, each in its range, and in order; false where one is null."""
    each = [(n >= low) & (n <= high) & (n % 2 == 0) for n, (low, high) in zip((least, normal, most), RANGES, strict=True)]
    return F.coalesce(each[0] & each[1] & each[2] & (least <= normal) & (normal <= most), F.lit(False))


def check_sizes(least: int, normal: int, most: int) -> None:
    """The same for one set of sizes, as an error."""
    if not least <= normal <= most or any(not low <= n <= high or n % 2 for n, (low, high) in zip((least, normal, most), RANGES, strict=True)):
        raise ValueError(f"bad chunk sizes {least}, {normal}, {most}")


def _masks(normal: int) -> tuple[int, int]:
    """The masks before and after the normal size: one bit more and one bit less than its logarithm, rounded."""
    bits = round(math.log2(normal))
    return MASKS[bits + 1 - 5], MASKS[bits - 1 - 5]


def first_cut(data: memoryview | bytes, least: int, normal: int, most: int, strict: int, loose: int) -> int:
    """The length of the first chunk of data that goes on long enough or ends here."""
    size = min(len(data), most)
    if size <= least:
        return size
    middle, value = min(normal, size), 0
    for mask, begin, end in ((strict, least // 2, middle // 2), (loose, middle // 2, size // 2)):
        shifted = mask << 1 & _ALL
        for i in range(begin, end):
            value = (value << 2) + _TWICE[data[2 * i]] & _ALL
            if not value & shifted:
                return 2 * i
            value = value + _GEAR[data[2 * i + 1]] & _ALL
            if not value & mask:
                return 2 * i + 1
    return size


def chunks(data: bytes, least: int = LEAST, normal: int = NORMAL, most: int = MOST) -> list[bytes]:
    return list(stream_chunks([data], least, normal, most))


def stream_chunks(pieces: Iterable[bytes], least: int = LEAST, normal: int = NORMAL, most: int = MOST) -> Iterator[bytes]:
    """The same chunks whatever pieces the content comes in; at most `most` bytes beyond a piece are held."""
    check_sizes(least, normal, most)
    strict, loose = _masks(normal)
    held = b""
    for piece in pieces:
        held += piece
        while len(held) >= most:
            cut = first_cut(held, least, normal, most, strict, loose)
            yield held[:cut]
            held = held[cut:]
    while held:
        cut = first_cut(held, least, normal, most, strict, loose)
        yield held[:cut]
        held = held[cut:]


def shards(df: DataFrame, id_col: str, data_col: str, least: int = LEAST, normal: int = NORMAL, most: int = MOST) -> DataFrame:
    """id, pos, n and hash of each chunk of binary content."""
    check_sizes(least, normal, most)
    send_package(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def cut(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else chunks(b, least, normal, most))

    found = df.select(id_col, F.posexplode(cut(data_col)).alias("pos", "bytes"))
    return found.select(id_col, "pos", F.octet_length("bytes").cast("long").alias("n"), F.sha2("bytes", 256).alias("hash"))
