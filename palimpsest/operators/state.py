"""Folds of the ordered log into tables: entries, objects, history and removed, at any version.

Every fold is keyed by object (or drive), so state is partitioned by it and a hot drive's objects still spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A version is the pair (seq, idx); its order is that of the pair, never of its text.
VERSION = ("seq", "idx")
CHANGE = ("seq", "idx", "chg")


def version(*names: str) -> Column:
    return F.struct(*(names or VERSION))


def explode_log(commits: DataFrame) -> DataFrame:
    """commits (seq, time, txns: array of structs) as one row for each transaction, in order, idx from 0."""
    return commits.select("seq", "time", F.posexplode("txns").alias("idx", "txn")).select("seq", F.col("idx").cast("int").alias("idx"), "time", "txn.*")


def pack_log(txns: DataFrame, members: list[str]) -> DataFrame:
    """Transactions as commits, the inverse of explode_log."""
    return txns.groupBy("seq").agg(F.min("time").alias("time"), F.transform(F.sort_array(F.collect_list(F.struct("idx", *members))), lambda t: F.struct(*(t[m].alias(m) for m in members))).alias("txns"))


def contiguous(log: DataFrame, after: int, order: str = "seq") -> DataFrame:
    """The log after `after` up to its first gap.

    The gap is found on the distinct numbers alone, summed up by ranges of 65,536, so no task sorts the whole log: a
    range is whole if its count and its least and largest numbers agree, and only the first that is not is sorted.
    """
    numbers = log.where(F.col(order) > after).select(order).distinct().withColumn("r", F.floor((F.col(order) - after - 1) / 65536))
    ranges = numbers.groupBy("r").agg(F.count("*").alias("n"))
    before = log.sparkSession.range(1).select(F.lit(-1).cast("long").alias("r"), F.lit(65536).cast("long").alias("n"))
    counted = ranges.unionAll(before)
    missing = counted.select((F.col("r") + 1).alias("r")).join(ranges, "r", "left_anti")
    broken = counted.where("n < 65536").select("r").unionAll(missing.select("r")).agg(F.min("r").alias("r"))
    inside = numbers.join(F.broadcast(broken), "r", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy(order)))
    reached = inside.agg(F.max(F.when(F.col(order) - after - F.col("r") * 65536 == F.col("n"), F.col(order))).alias("last"))
    stop = broken.crossJoin(F.broadcast(reached)).select(F.coalesce("last", F.lit(after) + F.col("r") * 65536).alias("stop"))  # one row each
    return log.where(F.col(order) > after).join(F.broadcast(stop), F.col(order) <= F.col("stop")).drop("stop")


def fold(changes: DataFrame, members: list[str], at: Column | None = None) -> DataFrame:
    """Objects after the changes: each member as it was last given, head and time of the last change.

    max_by with a null-skipping order folds map-side, so a hot object shuffles one row for each task.
    """
    rows = changes if at is None else changes.where(at)
    order = F.struct(*CHANGE)
    given = [F.max_by(m, F.when(F.col(m).isNotNull(), order)).alias(m) for m in members]
    return rows.groupBy("oid").agg(*given, F.max(F.struct(*VERSION)).alias("head"), F.max_by("time", order).alias("time"), F.max_by("what", F.when(F.col("what").isin("create", "remove"), order)).alias("linked"))


def history_of(changes: DataFrame, members: list[str]) -> DataFrame:
    """Every version of every object with the members it carries over from versions before."""
    w = Window.partitionBy("oid").orderBy(*CHANGE).rowsBetween(Window.unboundedPreceding, 0)
    return changes.withColumns({m: F.last(m, ignorenulls=True).over(w) for m in members})


def linked(objects: DataFrame) -> DataFrame:
    """The objects in the namespace: those created and not removed since."""
    return objects.where("linked = 'create'")


def removed(objects: DataFrame) -> DataFrame:
    return objects.where("linked = 'remove'")


def removed_rows(changes: DataFrame) -> DataFrame:
    """oid, seq, idx, last_seq, last_idx, time of removed objects: the version that took each out, and its version before."""
    gone = F.max_by(version(), F.when(F.col("what").isin("create", "remove"), F.struct(*CHANGE)))
    linked_ = F.max_by("what", F.when(F.col("what").isin("create", "remove"), F.struct(*CHANGE)))
    out = changes.groupBy("oid").agg(gone.alias("gone"), linked_.alias("linked"), F.max_by("time", F.when(F.col("what") == "remove", F.struct(*CHANGE))).alias("time")).where("linked = 'remove'")
    before = changes.join(out.select("oid", "gone"), "oid").where(version() < F.col("gone")).groupBy("oid").agg(F.max(version()).alias("last"))
    return out.join(before, "oid", "left").select("oid", "gone.seq", "gone.idx", F.col("last.seq").alias("last_seq"), F.col("last.idx").alias("last_idx"), "time")


def single_versions(changes: DataFrame, txns: DataFrame) -> DataFrame:
    """oid, head, versions: without the multi-object flag only a transaction's target gets a version, but all it touches take it as head.

    txns: seq, idx, target.
    """
    heads = changes.groupBy("oid").agg(F.max(version()).alias("head"))
    counts = txns.groupBy(F.col("target").alias("oid")).agg(F.count("*").alias("versions"))
    return heads.join(counts, "oid", "left").fillna({"versions": 0})


def changed_shape(before: DataFrame, after: DataFrame, members: list[str]) -> DataFrame:
    """What a multi-object version records: objects whose members differ, and delete for those taken out.

    Maps can't be compared; give their sorted entries.
    """
    b, a = before.select("oid", F.struct(*members).alias("was")), after.select("oid", F.struct(*members).alias("is"))
    both = b.join(a, "oid", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("is"))).select("oid", F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull(), "create").otherwise("write").alias("op"))


def fork(parent: DataFrame, child: DataFrame, seq: int) -> DataFrame:
    """A fork's log: its parent's up to `seq`, then its own; nothing is copied."""
    return parent.where(F.col("seq") <= seq).unionByName(child.where(F.col("seq") > seq))


def live_forks(drives: DataFrame) -> DataFrame:
    """drive, fork: the live forks of each drive, whether or not the drive itself still lives."""
    return drives.where("not deleted and fork_of is not null").select(F.col("fork_of").alias("drive"), F.col("drive").alias("fork"))


def spill(extents: DataFrame, data: str = "d") -> DataFrame:
    """Inline extents as shard extents that hold the same bytes."""
    return extents.withColumns({"s": F.when(F.col(data).isNotNull(), F.sha2(data, 256)).otherwise(F.col("s")), "n": F.when(F.col(data).isNotNull(), F.octet_length(data).cast("long")).otherwise(F.col("n"))}).drop(data)


def violations(log: DataFrame) -> DataFrame:
    """Rows at which the log breaks its order: a gap or repeat in seq, or time going back.

    Each row is compared with the row that has the number before, by a join on seq, so nothing is sorted in one task.
    """
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("time").alias("earlier")).distinct()
    first = log.agg(F.min("seq").alias("first"))
    rows = log.join(before, "seq", "left").join(F.broadcast(first))
    return rows.where((F.col("earlier").isNull() & (F.col("seq") > F.col("first"))) | (F.col("time") < F.col("earlier"))).select("seq", F.when(F.col("earlier").isNull(), "gap").otherwise("time").alias("fault"))


def with_spilled(objects: DataFrame, spilled: DataFrame) -> DataFrame:
    """Objects with spilled content swapped in where the content is still what was spilled. spilled: oid, was, content."""
    rows = objects.join(spilled.withColumnsRenamed({"content": "__content", "was": "__was"}), "oid", "left")
    return rows.withColumn("content", F.when(F.col("content") == F.col("__was"), F.col("__content")).otherwise(F.col("content"))).drop("__content", "__was")
