"""Listings: keys by prefix, rolled up at the delimiter, page by page; versions, histories, deleted objects.

A page is a keyset: rows after a key, in order, one more than asked for, so top-k never sorts the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.operators.tree import has_children

MAX_KEYS = 1000


def max_keys(asked: Column) -> Column:
    return F.least(F.coalesce(asked, F.lit(MAX_KEYS)), F.lit(MAX_KEYS))


def list_keys(keyed: DataFrame, entries: DataFrame, prefix: str = "", delimited: bool = False, after: str | None = None, limit: int = MAX_KEYS) -> DataFrame:
    """kind (object or prefix), key, oid and truncated: files and empty folders of a subtree, or a folder's direct children."""
    full = has_children(entries).withColumn("full", F.lit(True))
    rows = keyed.where(F.col("key").startswith(prefix)).join(full, "oid", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    base = prefix[: prefix.rfind("/") + 1]
    own = (F.col("key") == base) & ~F.col("full")
    rest = F.substring("key", len(base) + 1, 1 << 20)
    if delimited:
        direct = (rest != "") & ~F.regexp_replace(rest, "/$", "").contains("/")
        rows = rows.where(direct | own).withColumn("what", F.when((F.col("kind") == "folder") & ~own, "prefix").otherwise("object"))
    else:
        rows = rows.where((F.col("kind") != "folder") | ~F.col("full")).withColumn("what", F.lit("object"))
    if after is not None:
        rows = rows.where(F.col("key") > after)
    page = rows.orderBy("key").limit(limit + 1).select(F.col("what").alias("kind"), "key", "oid")
    place = F.row_number().over(Window.orderBy("key"))  # over at most limit + 1 rows
    return page.withColumn("place", place).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).where(F.col("place") <= limit).drop("place")


def common_prefixes(keyed: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rolled-up prefixes: the first segment after the prefix of all keys that go on after it."""
    rest = F.substring(F.col(key), len(prefix) + 1, 1 << 20)
    return keyed.where(F.col(key).startswith(prefix) & (F.instr(rest, "/") > 0)).select(F.concat(F.lit(prefix), F.substring_index(rest, "/", 1), F.lit("/")).alias("prefix")).distinct()


def token_of(key: Column) -> Column:
    """A continuation token: the last key in URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(key, "UTF-8")), "+/", "-_"), F.lit("="))


def key_of_token(token: Column) -> Column:
    plain = F.translate(token, "-_", "+/")
    return F.decode(F.unbase64(F.rpad(plain, (F.length(plain) + F.pmod(-F.length(plain), F.lit(4))).cast("int"), "=")), "UTF-8")


def versions(keyed: DataFrame, history: DataFrame, content_ops: list[str]) -> DataFrame:
    """key, seq, idx, op, size and is_latest: content versions of live keys, the newest first in each key."""
    rows = keyed.select("oid", "key").join(history.where(F.col("op").isin(content_ops)), "oid")
    newest = Window.partitionBy("oid").orderBy(F.desc("seq"), F.desc("idx"))
    return rows.withColumn("is_latest", F.row_number().over(newest) == 1).select("key", "seq", "idx", "op", "size", "is_latest")


def after_version(rows: DataFrame, key: str, seq: int, idx: int) -> DataFrame:
    """The page after a two-part marker: later keys, and older versions of the key itself."""
    older = (F.col("seq") < seq) | ((F.col("seq") == seq) & (F.col("idx") < idx))
    return rows.where((F.col("key") > key) | ((F.col("key") == key) & older))


def history(rows: DataFrame, offset: int = 0, limit: int = MAX_KEYS) -> DataFrame:
    """Versions of each object, the oldest first, from an offset; is_latest marks the last one listed."""
    order = Window.partitionBy("oid").orderBy("seq", "idx")
    page = rows.withColumn("n", F.row_number().over(order) - 1).where((F.col("n") >= offset) & (F.col("n") < offset + limit))
    return page.withColumn("is_latest", F.lead("seq").over(order).isNull())


def deleted(removed: DataFrame, prefix: str = "", after: str | None = None, limit: int = MAX_KEYS) -> DataFrame:
    """Recently deleted objects in key order; the token is a key and exclusive, so equal keys past a page's end are skipped."""
    rows = removed.where(F.col("key").startswith(prefix))
    rows = rows if after is None else rows.where(F.col("key") > after)
    return rows.orderBy("key", "oid").limit(limit)


def page(rows: DataFrame, order: list[str], limit: int, **after: object) -> DataFrame:
    """A keyset page of any table: the rows whose order columns come after the values given."""
    past = F.lit(False)
    equal = F.lit(True)
    for name in order:
        if name in after:
            past = past | (equal & (F.col(name) > F.lit(after[name])))
            equal = equal & (F.col(name) == F.lit(after[name]))
    rows = rows.where(past) if after else rows
    return rows.orderBy(*order).limit(limit)
