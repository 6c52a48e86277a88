"""The ordered change feed: what each transaction changed, resuming, expiry and invalidations; batch and streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from palimpsest.operators.state import CHANGE, contiguous
from palimpsest.operators.temporal import whole_batches
from palimpsest.operators.transactions import merge
from palimpsest.session import kept

FEED_KEEP, POLL_CHANGES = 10_000, 1000


def feed_of(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The feed's changes of each transaction, in order.

    changes: seq, idx, target, op, oid, what (target, create, other). before, after: seq, idx, oid, key, kind, at the
    transaction. Legs: 0 folders made on the way; 1 what was taken out, children first; 2 the target; 3 the others,
    folders first. Only each transaction's own changes are ordered, so nothing is sorted as a whole.
    """
    was, now = before.withColumnsRenamed({"key": "was", "kind": "kind_was"}), after.withColumnsRenamed({"key": "is", "kind": "kind_is"})
    rows = changes.join(was, ["seq", "idx", "oid"], "left").join(now, ["seq", "idx", "oid"], "left")
    target, create = F.col("what") == "target", (F.col("what") == "create") & (F.col("kind_is") == "folder") & F.col("was").isNull()
    gone, other = (F.col("what") == "other") & F.col("was").isNotNull() & F.col("is").isNull(), (F.col("what") == "other") & F.col("was").isNotNull() & F.col("is").isNotNull()
    leg = F.when(create, 0).when(gone, 1).when(target, 2).when(other, 3)
    key = F.when(gone | (target & (F.col("op") == "delete")), F.col("was")).otherwise(F.col("is"))
    from_key = F.when(target & (F.col("op") == "rename"), F.col("was")).when(other & (F.col("was") != F.col("is")), F.col("was"))
    op = F.when(create, "create").when(gone, "delete").otherwise(F.col("op"))
    out = rows.select("seq", "idx", leg.alias("leg"), op.alias("op"), key.alias("key"), from_key.alias("from_key"), "oid", F.coalesce("kind_is", "kind_was", F.lit("file")).alias("kind")).where("leg is not null and key is not null")
    order = Window.partitionBy("seq", "idx").orderBy("leg", F.when(F.col("leg") == 1, F.col("key")).desc(), F.when(F.col("leg") != 1, F.col("key")))
    return out.withColumn("place", F.row_number().over(order) - 1)


def changes_since(feed: DataFrame, since: int, floor: int) -> DataFrame:
    """The feed after `since`; with expired true and no rows' worth of changes where they are no longer held."""
    if since < floor:
        return feed.limit(0).withColumn("expired", F.lit(True))
    return feed.where(F.col("seq") > since).withColumn("expired", F.lit(False))


def invalidations(changes: DataFrame) -> DataFrame:
    """what (object or subtree) and key that a batch of changes makes stale, each once. changes: op, key, from_key, kind."""
    folder = (F.col("kind") == "folder") | F.col("key").endswith("/")
    as_folder = lambda k: F.when(k.endswith("/"), k).otherwise(F.concat(k, F.lit("/")))
    item = lambda what, key, when: F.when(when & key.isNotNull(), F.struct(F.lit(what).alias("what"), key.alias("key")))
    both = F.col("op").isin("rename", "delete", "restore")
    yes = F.lit(True)
    stale = F.array(item("object", F.col("from_key"), yes), item("subtree", as_folder(F.col("from_key")), folder), item("object", F.col("key"), yes), item("subtree", as_folder(F.col("key")), folder & both))
    return changes.select(F.explode(F.array_compact(stale)).alias("x")).select("x.*").distinct()


def affected(keyed: DataFrame, stale: DataFrame) -> DataFrame:
    """Objects that invalidations touch: those at a key, and all at or under a subtree's, by a join on every folder above."""
    from palimpsest.operators.tree import ancestor_keys

    at = keyed.join(stale.where("what = 'object'").select("key"), "key", "left_semi").select("oid")
    under = ancestor_keys(keyed, "key", "oid").join(stale.where("what = 'subtree'").select(F.col("key").alias("folder")), "folder", "left_semi").select("oid")
    return at.unionByName(under).distinct()


def read_log_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New commit files of a log folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger)).json(path)


def _kept_state(spark: SparkSession, folder: str, batch: int) -> str | None:
    """Where the newest state that a batch before this one left is; states are named by their batch."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    done = [int(x.getPath().getName()) for x in system.listStatus(where) if system.exists(jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    for old in sorted(n for n in done if n < batch)[:-2]:
        system.delete(jvm.org.apache.hadoop.fs.Path(where, str(old)), True)
    return f"{folder}/{max(n for n in done if n < batch)}" if any(n < batch for n in done) else None


def watch(log: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, after: int = 0, available_now: bool = True):
    """Delivers each commit once, in order of seq, after a position; a restart resumes from the checkpoint.

    The position decides, not the time of arrival: commits up to the first number missing are delivered, those after it
    are kept in the checkpoint's folder until it comes, however late; what was delivered and comes again is dropped.
    """
    spark = log.sparkSession

    def step(df: DataFrame, batch: int) -> None:
        before = _kept_state(spark, f"{checkpoint}/position", batch)
        reached, waiting = after, df
        if before is not None:
            held = spark.read.schema(df.schema).parquet(f"{before}/waiting")
            reached = spark.read.parquet(f"{before}/reached").first()["seq"]
            waiting = df.unionByName(held)
        waiting = kept(waiting.where(F.col("seq") > reached).dropDuplicates(["seq"]))
        ready = contiguous(waiting, reached)
        last = ready.agg(F.max("seq").alias("seq")).first()["seq"]
        if last is not None:
            deliver(ready.orderBy("seq"), batch)
        last = reached if last is None else last
        now = f"{checkpoint}/position/{batch}"
        waiting.where(F.col("seq") > last).write.mode("overwrite").parquet(f"{now}/waiting")
        spark.createDataFrame([(last,)], "seq long").coalesce(1).write.mode("overwrite").parquet(f"{now}/reached")
        spark.createDataFrame([], "x int").write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(now)

    writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def _versioned(changes: DataFrame, members: list[str]) -> DataFrame:
    """Objects with each member beside the change that gave it, so that what comes late still finds its place."""
    given = lambda value, when: F.when(when, F.struct(*CHANGE, value.alias("value")))
    rows = changes.select(
        "oid", F.struct("seq", "idx").alias("head"), given(F.col("time"), F.lit(True)).alias("time"), given(F.col("what"), F.col("what").isin("create", "remove")).alias("linked"),
        *[given(F.col(m), F.col(m).isNotNull()).alias(m) for m in members])
    return _latest(rows)


def _latest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("oid").agg(*[F.max(c).alias(c) for c in rows.columns if c != "oid"])


def fold_stream(changes: DataFrame, members: list[str], checkpoint: str, available_now: bool = True):
    """Objects kept up to date with a stream of changes, in whatever order they come: each batch is folded and merged.

    changes: seq, idx, chg, time, oid, what and the members, of types that have an order. The objects are a table in the
    checkpoint's folder, read by folded(); a batch that runs again, or changes that come again, alter nothing, and no
    row passes through the driver.
    """
    spark = changes.sparkSession

    def step(df: DataFrame, batch: int) -> None:
        before = _kept_state(spark, f"{checkpoint}/objects", batch)
        objects = _versioned(df, members)
        objects = objects if before is None else _latest(spark.read.parquet(before).unionByName(objects))
        objects.write.mode("overwrite").parquet(f"{checkpoint}/objects/{batch}")

    writer = changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def folded(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The objects that fold_stream() has kept up to its last batch: oid, head, time, linked and the members."""
    rows = spark.read.parquet(_kept_state(spark, f"{checkpoint}/objects", 1 << 62))
    return rows.select("oid", "head", *[F.col(f"{c}.value").alias(c) for c in rows.columns if c not in ("oid", "head")])


def poll(changes: DataFrame, since: int, limit: int = POLL_CHANGES) -> DataFrame:
    """The changes after `since`, of whole batches while they are at most `limit` together; the first batch however large."""
    later = changes.where(F.col("seq") > since)
    sizes = later.groupBy("seq").agg(F.count("*").alias("n")).withColumn("drive", F.lit(""))
    return later.join(whole_batches(sizes, "drive", limit).select("seq"), "seq", "left_semi")


def relist(since: int, floor: int, listing: DataFrame, listed_at: int, held: DataFrame, changes: DataFrame, members: list[str]) -> DataFrame:
    """A reader's objects brought up to date. held: what it has, as of `since`; floor: the last number the feed no longer has.

    Where the feed still has all after `since`, its changes are merged to what the reader holds. Else that is given up
    for the listing, which is as of `listed_at`, and the changes after it.
    """
    base, start = (held, since) if since >= floor else (listing, listed_at)
    return merge(base, changes.where(F.col("seq") > start), members)


def parse_sse(lines: DataFrame) -> DataFrame:
    """stream, event: id and data of server-sent events from numbered lines (stream, n, line); comments say nothing.

    An event ends at an empty line; of several data lines the event's data is their join by newlines.
    """
    w = Window.partitionBy("stream").orderBy("n")
    rows = lines.withColumn("event", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("line <> '' and not startswith(line, ':')")
    field, value = F.substring_index("line", ":", 1), F.regexp_replace(F.expr("substr(line, length(substring_index(line, ':', 1)) + 2)"), "^ ", "")
    rows = rows.select("stream", "event", "n", field.alias("field"), value.alias("value"))
    data = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == "data", F.struct("n", "value")))), lambda x: x["value"]), "\n")
    return rows.groupBy("stream", "event").agg(F.max_by(F.when(F.col("field") == "id", F.col("value")), F.when(F.col("field") == "id", F.col("n"))).alias("id"), data.alias("data"))


def format_sse(changes: DataFrame) -> DataFrame:
    """seq, event: a server-sent event for each batch, its changes (seq, place, op, key) as JSON lines."""
    line = F.concat(F.lit("data: "), F.to_json(F.struct("op", "key")))
    rows = changes.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("xs"))
    return rows.select("seq", F.concat(F.lit("id: "), F.col("seq").cast("string"), F.lit("\n"), F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), F.lit("\n\n")).alias("event"))
