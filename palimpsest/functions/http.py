"""Conditions, ranges and classes of requests, and rules of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME_BYTES, KEY_BYTES = 255, 1024


def name_error(name: Column) -> Column:
    """The first rule that a name breaks, or ok."""
    return (
        F.when(name == "", "empty").when(F.octet_length(name) > NAME_BYTES, "too long").when(F.instr(name, "/") + F.instr(name, "\x00") > 0, "bad character")
        .when(name.isin(".", ".."), "dot").otherwise("ok")
    )


def key_error(key: Column) -> Column:
    """The first rule that a key breaks, or ok; segments are looked at from the left."""
    body = F.when(key.endswith("/"), F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key)
    bad = F.filter(F.transform(F.split(body, "/"), lambda s: F.when(s == "", F.lit("empty segment")).otherwise(name_error(s))), lambda e: e != "ok")
    return F.when(F.octet_length(key) > KEY_BYTES, "key too long").when(key == "", "ok").when(F.size(bad) > 0, F.try_element_at(bad, F.lit(1))).otherwise("ok")


def etag_matches(header: Column, etag: Column) -> Column:
    """If-Match takes a list of validators, weak ones too, or a star."""
    return F.exists(F.split(header, ","), lambda m: (F.trim(m) == "*") | (F.trim(m) == etag) | (F.regexp_replace(F.trim(m), "^(W/)+", "") == etag))


def precondition(exists: Column, head: Column, etag: Column, if_version: Column, if_match: Column, if_none_match_any: Column) -> Column:
    fails = (
        (~exists & (if_version.isNotNull() | if_match.isNotNull())) | (exists & F.coalesce(if_none_match_any, F.lit(False)))
        | (exists & F.coalesce(if_version != head, F.lit(False))) | (exists & F.coalesce(~etag_matches(if_match, etag), F.lit(False)))
    )
    return F.when(fails, F.lit(412)).otherwise(F.lit(200))


def conditional_get(etag: Column, seconds: Column, if_match: Column, if_unmodified: Column, if_none_match: Column, if_modified: Column) -> Column:
    """412, 304 or 200; times are whole seconds, and a validator given makes its date condition void."""
    listed = lambda h: F.exists(F.split(h, ","), lambda m: (F.trim(m) == "*") | (F.trim(m) == etag))
    return (
        F.when(if_match.isNotNull() & ~listed(if_match), F.lit(412)).when(if_match.isNull() & (seconds > if_unmodified), F.lit(412))
        .when(if_none_match.isNotNull() & listed(if_none_match), F.lit(304)).when(if_none_match.isNull() & (seconds <= if_modified), F.lit(304)).otherwise(F.lit(200))
    )


def byte_range(header: Column, size: Column) -> Column:
    """status, start, stop (inclusive): 206 with a range, 200 for the whole, 416 where it can't be satisfied."""
    a, b = F.trim(F.regexp_extract(header, "^bytes=([^-]*)-", 1)), F.trim(F.regexp_extract(header, "^bytes=[^-]*-(.*)$", 1))
    na, nb = a.try_cast("long"), b.try_cast("long")
    last = F.greatest(size - 1, F.lit(0))
    whole = ~F.coalesce(header.startswith("bytes="), F.lit(False)) | F.contains(header, F.lit(",")) | ((a != "") & (b != "") & (nb < na))
    start = F.when(a == "", F.greatest(size - nb, F.lit(0))).otherwise(na)
    stop = F.when((a == "") | (b == ""), last).otherwise(F.least(nb, last))
    wrong = ~header.rlike("^bytes=[^-]*-") | ((a != "") & na.isNull()) | ((b != "") & nb.isNull()) | ((a == "") & (b == "")) | ((a == "") & (nb == 0)) | (size == 0) | (start >= size)
    answer = lambda status, x, y: F.struct(F.lit(status).alias("status"), x.alias("start"), y.alias("stop"))
    none = F.lit(0).cast("long")
    return F.when(whole, answer(200, none, last.cast("long"))).when(wrong, answer(416, none, none)).otherwise(answer(206, start.cast("long"), stop.cast("long")))


def octal_mode(mode: Column, kind: Column) -> Column:
    """The mode in four octal digits; 0755 for folders and 0644 for others where none is given."""
    return F.lpad(F.conv(F.coalesce(mode, F.when(kind == "folder", F.lit(493)).otherwise(F.lit(420))).cast("string"), 10, 8), 4, "0")


def content_type(given: Column, kind: Column) -> Column:
    return F.coalesce(given, F.when(kind == "folder", "application/x-directory").otherwise("binary/octet-stream"))


def operation(method: Column, key: Column, query: Column, copy_source: Column, drive: Column | None = None, extension: str = "x-ext-") -> Column:
    """The class of a request. query: its parameters' names as an array; extension: what extension parameters begin with."""
    has = lambda n: F.array_contains(query, n)
    extended = F.exists(query, lambda q: q.startswith(extension))
    in_drive = F.coalesce(drive, F.lit("d")) != "" if drive is not None else F.lit(True)
    on_drive = (
        F.when((method == "GET") & has("uploads"), "multipart").when((method == "GET") & extended, "extension").when((method == "GET") & (has("versioning") | has("location")), "drive").when(method == "GET", "list")
        .when((method == "POST") & has("delete"), "delete").when((method == "POST") & has(f"{extension}undelete"), "drive").when(method.isin("PUT", "HEAD", "DELETE"), "drive").otherwise("other")
    )
    on_key = (
        F.when(has("uploadId") | has("uploads"), "multipart").when(extended, "extension").when(method == "GET", "get").when(method == "HEAD", "head")
        .when((method == "PUT") & copy_source, "copy").when(method == "PUT", "put").when(method == "DELETE", "delete").otherwise("other")
    )
    return F.when(~in_drive & (method == "GET"), "list drives").when(~in_drive, "other").when(key == "", on_drive).otherwise(on_key)


def percent_decoded(text: Column) -> Column:
    """Percent-decoding in which a plus stays a plus."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def human_bytes(n: Column) -> Column:
    """Bytes as B, or with one decimal as KiB to TiB; a half of a tenth goes to the even one, as printf has it, and not up."""
    steps = [("TiB", 40), ("GiB", 30), ("MiB", 20), ("KiB", 10)]
    out = F.when(F.lit(False), "")
    exact = n.cast("double").cast("long")
    for unit, bits in steps:
        rest = exact.bitwiseAND(F.lit((1 << bits) - 1)) * 10
        tenth, left, half = F.shiftright(rest, bits), rest.bitwiseAND(F.lit((1 << bits) - 1)), 1 << (bits - 1)
        tenth = tenth + ((left > half) | ((left == half) & (tenth % 2 == 1))).cast("long")
        whole = F.shiftright(exact, bits) + F.when(tenth == 10, 1).otherwise(0)
        out = out.when(n >= (1 << bits), F.concat(whole.cast("string"), F.lit("."), (tenth % 10).cast("string"), F.lit(f" {unit}")))
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def xml_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def backoff_ms(n: Column) -> Column:
    """Milliseconds to wait after n failures, doubling up to 30 seconds."""
    return F.least(F.lit(250) * F.pow(F.lit(2), F.least(n, F.lit(10))), F.lit(30000)).cast("long")
