"""The algebra of content: extents, byte ranges, edits, shards and their sums."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palimpsest.operators.order import pass_over
from palimpsest.session import send_package

#: Content up to this many bytes may be held in a descriptor.
INLINE_BYTES = 4096
BLOCK_BYTES = 8 << 20


def length() -> Column:
    """Bytes of an extent: a shard's n or a run's z."""
    return F.coalesce("n", "z", F.lit(0))


def bounds(extents: DataFrame) -> DataFrame:
    """Extents (oid, pos, s, n, z) with the offsets at which each starts and stops."""
    stop = F.sum(length()).over(Window.partitionBy("oid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return extents.withColumn("stop", stop).withColumn("start", F.col("stop") - length())


def normalize(extents: DataFrame) -> DataFrame:
    """Without empty extents, and with neighbouring zero runs merged; pos counts anew from 0."""
    w = Window.partitionBy("oid").orderBy("pos")
    rows = extents.where(length() > 0).withColumn("new", F.when(F.col("z").isNull() | F.lag("z").over(w).isNull(), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("oid", "run").agg(F.max("s").alias("s"), F.max("n").alias("n"), F.sum("z").alias("z")).select("oid", (F.col("run") - 1).alias("pos"), "s", "n", "z")


def read_plan(extents: DataFrame, asked: DataFrame) -> DataFrame:
    """The pieces of extents that hold each range asked for (oid, start, len); none where it reaches past the end."""
    at = bounds(extents)
    total = at.groupBy("oid").agg(F.max("stop").alias("total"))
    want = asked.join(total, "oid").where(F.col("start") + F.col("len") <= F.col("total")).select("oid", F.col("start").alias("want"), (F.col("start") + F.col("len")).alias("end"))
    hit = at.join(want, "oid").where((F.col("stop") > F.col("want")) & (F.col("start") < F.col("end")))
    begin, finish = F.greatest("want", "start"), F.least("end", "stop")
    return hit.select("oid", "want", "pos", F.when(F.col("s").isNotNull(), F.col("s")).otherwise("zeros").alias("source"), (begin - F.col("start")).alias("offset"), (finish - begin).alias("len"))


def needed_shards(extents: DataFrame, edits: DataFrame) -> DataFrame:
    """Shards an edit (oid, start, end) may read: those it overlaps, one before and two after."""
    at = bounds(extents).withColumn("i", F.row_number().over(Window.partitionBy("oid").orderBy("pos")) - 1)
    around = at.join(edits.withColumnsRenamed({"start": "from", "end": "to"}), "oid").groupBy("oid", "from", "to").agg(
        F.min(F.when(F.col("stop") > F.col("from"), F.col("i"))).alias("lo"), F.coalesce(F.max(F.when(F.col("start") < F.col("to"), F.col("i") + 1)), F.lit(0)).alias("hi"), F.count("*").alias("count"))
    lo = F.coalesce("lo", "count")
    around = around.select("oid", "from", "to", F.greatest(lo - 1, F.lit(0)).alias("lo"), (F.greatest("hi", lo) + 2).alias("hi"))
    return at.join(around, "oid").where((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")) & F.col("s").isNotNull()).select("oid", F.col("from").alias("start"), F.col("to").alias("end"), F.col("s").alias("hash")).distinct()


def splice(content: Column, start: Column, remove: Column, insert: Column) -> Column:
    """Binary content with `remove` bytes at `start` replaced."""
    return F.overlay(content, insert, (start + 1).cast("int"), remove.cast("int"))


def write_at(content: Column, start: Column, data: Column) -> Column:
    """Binary content written at an offset; zeros fill what lies between its end and the offset."""
    padded = F.rpad(content, F.greatest(F.octet_length(content), start.cast("int")), F.lit(b"\x00"))
    return F.overlay(padded, data, (start + 1).cast("int"))


def set_size(content: Column, size: Column) -> Column:
    """Binary content cut off or filled with zeros."""
    return F.when(F.octet_length(content) >= size, F.substring(content, F.lit(1), size.cast("int"))).otherwise(F.rpad(content, size.cast("int"), F.lit(b"\x00")))


@F.pandas_udf(T.BinaryType())
def _edited(content: pd.Series, edits: pd.Series) -> pd.Series:
    out = []
    for base, own in zip(content, edits, strict=True):
        if base is None or own is None:
            out.append(base)
            continue
        buffer = bytearray(base)
        for edit in own:
            at, data = int(edit["off"]), edit["data"]
            buffer.extend(bytes(max(0, at - len(buffer))))
            buffer[at : at + len(data)] = data
        out.append(bytes(buffer))
    return pd.Series(out, dtype=object)


def apply_edits(content: DataFrame, edits: DataFrame) -> DataFrame:
    """content (doc_id, bytes) after its edits (doc_id, ord, off, data: binary) in order, later ones winning.

    Each document is copied once, whatever its edits; null content stays null.
    """
    send_package(content.sparkSession)
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "off", "data"))).alias("edits"))
    rows = content.join(lists, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("edits").isNull(), F.col("bytes")).otherwise(_edited("bytes", "edits")).alias("bytes"))


def default_size(content: DataFrame, edits: DataFrame) -> DataFrame:
    """A patched object's size where none is given: that before or the furthest end of an edit."""
    far = edits.groupBy("doc_id").agg(F.max(F.col("off") + F.col("len")).alias("far"))
    return content.join(far, "doc_id", "left").select("doc_id", F.greatest("size", "far").alias("size"))


def materialize(pieces: DataFrame) -> DataFrame:
    """The text whose pieces (doc_id, pos, bytes) these are."""
    return pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "bytes"))), lambda p: p["bytes"]), "").alias("text"))


def etag(extents: DataFrame, tag: bytes = b"inline\x00") -> DataFrame:
    """A validator of each content from its extents: SHA-256 over a tag and every extent's kind, hash and length, big-endian.

    One pass over each object's extents in order, so that they need not fit in a row.
    """
    eight = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    one = F.when(F.col("s").isNotNull(), F.concat(F.encode(F.lit("s"), "UTF-8"), F.unhex("s"), eight(F.col("n")))).otherwise(F.concat(F.encode(F.lit("z"), "UTF-8"), eight(F.col("z"))))
    rows = extents.select("oid", F.col("pos").cast("long").alias("pos"), one.alias("x"))
    ends = rows.select("oid").distinct().select("oid", F.lit((1 << 63) - 1).alias("pos"), F.lit(None).cast("binary").alias("x"))

    def begin() -> Callable[[pd.DataFrame], pd.DataFrame]:
        digest = hashlib.sha256(tag)

        def step(found: pd.DataFrame) -> pd.DataFrame:
            out = []
            for x in found["x"]:
                if x is None:
                    out.append(digest.hexdigest())
                else:
                    digest.update(x)
            return pd.DataFrame({"oid": [found["oid"].iloc[0]] * len(out), "etag": out})

        return step

    return pass_over(rows.unionByName(ends), "oid", ["pos"], extents.select("oid", F.lit("").alias("etag")).schema, begin)


def cut_fixed(text: Column, size: int) -> Column:
    """Pieces of a fixed number of characters."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(text, (i * size + 1).cast("int"), F.lit(size)))


def object_path(hash_col: str = "hash") -> Column:
    h = F.col(hash_col)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)


def blocks_of(asked: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """The cache blocks of each range (oid, start, len), and the part of each."""
    end = F.col("start") + F.col("len")
    rows = asked.where("len > 0").select("oid", "start", end.alias("end"), F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + len - 1) div {block}"))).alias("block"))
    begin, finish = F.greatest("start", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    return rows.select("oid", "start", "block", (begin - F.col("block") * block).alias("offset"), (finish - begin).alias("len"))


def overlay_extents(extents: DataFrame) -> DataFrame:
    """What shows of each key's extents (key, ord, start, stop) where later ones lie over earlier ones.

    One pass over a key's extents by start, with a heap of those not yet passed, the last on top: n log n for n extents,
    and only those that overlap one place are held. Touching parts of one ord join; empty extents show nowhere.
    """
    rows = extents.select("key", "ord", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where("start < stop")
    ends = rows.select("key").distinct().select("key", F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.lit((1 << 63) - 1).alias("start"), F.lit(None).cast("long").alias("stop"))
    schema = rows.select("key", "start", "stop", "ord").schema

    def begin() -> Callable[[pd.DataFrame], pd.DataFrame]:
        heap: list[tuple[int, int]] = []
        at, shown = 0, None

        def step(found: pd.DataFrame) -> pd.DataFrame:
            nonlocal at, shown
            out: list[tuple[int, int, int]] = []
            for order, start, stop in zip(found["ord"], found["start"], found["stop"], strict=True):
                while heap and at < start:
                    if heap[0][1] <= at:
                        heapq.heappop(heap)
                        continue
                    until = min(heap[0][1], start)
                    if shown and shown[2] == -heap[0][0] and shown[1] == at:
                        shown = (shown[0], until, shown[2])
                    else:
                        out += [shown] if shown else []
                        shown = (at, until, -heap[0][0])
                    at = until
                at = max(at, start)
                if pd.isna(stop):
                    out += [shown] if shown else []
                else:
                    heapq.heappush(heap, (-int(order), int(stop)))
            return pd.DataFrame({"key": found["key"].iloc[0], "start": [a for a, _, _ in out], "stop": [b for _, b, _ in out], "ord": [o for _, _, o in out]})

        return step

    return pass_over(rows.unionByName(ends), "key", ["start"], schema, begin)


def dedup(refs: DataFrame) -> DataFrame:
    """Logical and unique bytes of each drive, and those no other drive holds. refs: drive, hash, n, one row for each pair."""
    shared = refs.groupBy("hash").agg(F.count("*").alias("drives"))
    return refs.join(shared, "hash").groupBy("drive").agg(F.sum("n").alias("bytes"), F.count("*").alias("shards"), F.sum(F.when(F.col("drives") == 1, F.col("n")).otherwise(0)).alias("own_bytes"))


def flatten(pages: DataFrame, root: str) -> DataFrame:
    """The extents a manifest tree's root reaches, in order. pages: page, pos, child (null in a leaf), s, n."""
    from palimpsest.operators.tree import _recursive

    return _recursive(pages, """with recursive walk as (
        select array(cast(pos as int)) as path, child, s, n from {pages} where page = {root}
        union all select concat(w.path, array(cast(p.pos as int))), p.child, p.s, p.n from walk w join {pages} p on p.page = w.child)
        select path, s, n from walk where child is null""", pages=pages, root=root)
