"""Paths into JSON and XML, dates, checked arithmetic and seeded bytes."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_STEP = re.compile(r"\['([^']*)'\]|\[(-?\d+)\]|\.([^.\[]+)")
LARGEST = (1 << 64) - 1


def _steps(path: str) -> list[str | int | None]:
    """Names and indices of a path that begins with $; an error where it has anything else."""
    if not path.startswith("$"):
        raise ValueError(f"JSON path {path!r} must start with $")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise ValueError(f"bad JSON path {path!r}")
        out.append((m[0][0], int(m[2]) if m[2] is not None else m[1] if m[1] is not None else m[3]))
        at = m.end()
    return out


def _followed(value: object, steps: list) -> object:
    for how, step in steps:
        if isinstance(step, int):
            value = value[step] if isinstance(value, list) and -len(value) <= step < len(value) else None
        elif how == "." and step == "length" and isinstance(value, list | str):
            value = len(value)
        else:
            value = value.get(step) if isinstance(value, dict) else None
        if value is None:
            return None
    return value


def json_path(path: str) -> Callable[[Column | str], Column]:
    """What a path leads to in JSON texts: strings as they are, all else as JSON; null where it leads nowhere.

    $.name, $['name'], $[index], from the end if negative, and .length of arrays and strings. Null and broken texts give null.
    """
    steps = _steps(path)

    @F.pandas_udf(T.StringType())
    def found(text: pd.Series) -> pd.Series:
        def one(doc: str | None) -> str | None:
            try:
                value = None if doc is None else _followed(json.loads(doc), steps)
            except ValueError:
                return None
            return value if value is None or isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)

        return text.map(one)

    return found


def xml_path(path: str) -> Callable[[Column | str], Column]:
    """The texts of all elements that a path of names, from the root on, leads to, in their order; namespaces don't matter.

    Null texts give null, broken ones and those of another root an empty array.
    """
    first, *rest = path.split("/")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(text: pd.Series) -> pd.Series:
        name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

        def one(doc: str | None) -> list[str] | None:
            if doc is None:
                return None
            try:
                nodes = [ET.fromstring(doc)]
            except ET.ParseError:
                return []
            if name(nodes[0]) != first:
                return []
            for part in rest:
                nodes = [c for n in nodes for c in n if name(c) == part]
            return ["".join(n.itertext()) for n in nodes]

        return text.map(one)

    return found


def http_date(time: Column) -> Column:
    """A timestamp without time zone, which counts as UTC, in the form of Last-Modified."""
    return F.date_format(time, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def iso_millis(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def instant(text: Column) -> Column:
    """Unix seconds or RFC 3339 with an offset, as RFC 3339 in UTC with microseconds; null for anything else."""
    seconds = F.timestamp_seconds(text.try_cast("long"))
    given = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.upper(text).try_cast("timestamp"))
    utc = F.to_utc_timestamp(F.when(text.rlike("^[0-9]+$"), seconds).otherwise(given), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def checked_add(a: Column, b: Column) -> Column:
    """The sum of two unsigned 64-bit numbers, null where it has no room in one."""
    total = a.cast("decimal(20, 0)") + b.cast("decimal(20, 0)")
    return F.when(total <= F.lit(str(LARGEST)).cast("decimal(20, 0)"), total.cast("decimal(20, 0)"))


def part_size(size: Column, least: int, most_parts: int = 10_000) -> Column:
    """Bytes of a part so that so many parts hold the whole: the size divided and rounded up, or the least."""
    return F.greatest(F.lit(least).cast("long"), F.floor((size + (most_parts - 1)) / most_parts).cast("long"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def seeded_hex(tag: str, seed: Column, size: Column) -> Column:
    """`size` bytes that follow from a seed, in hex: SHA-256 of a tag, the seed and 0, 1, 2... one after the other."""
    eight = lambda n: F.lpad(F.hex(n.cast("long")), 16, "0")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda i: F.sha2(F.unhex(F.concat(F.lit(tag.encode().hex()), eight(seed), eight(i))), 256))
    return F.substring(F.array_join(blocks, ""), F.lit(1), (2 * size).cast("int"))
