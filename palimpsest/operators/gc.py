"""Two-phase garbage collection as set algebra over hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mark(live: DataFrame) -> DataFrame:
    """Hashes that any live drive refers to."""
    return live.select("hash").distinct()


def candidates(stored: DataFrame, refs: DataFrame, cutoff: str) -> DataFrame:
    """Stored hashes that nothing refers to and that are older than the cutoff."""
    return stored.join(refs, "hash", "left_anti").where(F.col("modified") < F.lit(cutoff).cast("timestamp_ntz"))


def confirm(stored: DataFrame, proposed: DataFrame, refs: DataFrame, marked: str) -> DataFrame:
    """Candidates still unreferenced and not written again since the mark, floored to its second."""
    since = F.date_trunc("second", F.lit(marked).cast("timestamp_ntz")).cast("timestamp_ntz")
    return stored.join(proposed.select("hash"), "hash", "left_semi").join(refs, "hash", "left_anti").where(F.col("modified") < since)


def report(objects: DataFrame) -> DataFrame:
    """Distinct hashes and bytes; of a hash stored as shard and page the shard's size counts. objects: hash, size, place."""
    one = objects.groupBy("hash").agg(F.min_by("size", "place").alias("size"))
    return one.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def dangling(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Referenced hashes that are not stored; a safe collection leaves none."""
    return refs.select("hash").join(stored.select("hash"), "hash", "left_anti").distinct()


def expire(rows: DataFrame, time: str, now: str, days: int) -> DataFrame:
    """Rows strictly older than so many days."""
    return rows.where(F.lit(now).cast("timestamp_ntz") - F.col(time) > F.expr(f"interval '{days}' day"))


def phase(state: Column, modified: Column, t1: Column, grace: Column, now: Column) -> Column:
    """What a step does with a run in this state; grace is in seconds."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))
    due = F.unix_timestamp(t1.cast("timestamp")) + grace
    return (
        F.when(state.isNull(), "mark").when((state == "marking") & (age > grace), "mark again").when(state == "marking", "busy")
        .when((state == "waiting") & (F.unix_timestamp(now.cast("timestamp")) >= due), "sweep").when(state == "waiting", "waiting").when(state == "deleting", "sweep")
    )


def admission(wanted: DataFrame, proposed: DataFrame, rescued: DataFrame, known: DataFrame, run_phase: str) -> DataFrame:
    """What a writer has to do for each hash: wait, nothing (rescued or reuse), rescue, or upload."""
    flag = lambda df, name: df.select("hash").distinct().withColumn(name, F.lit(True))
    rows = wanted.join(flag(proposed, "c"), "hash", "left").join(flag(rescued, "r"), "hash", "left").join(flag(known, "k"), "hash", "left")
    deleting = F.lit(run_phase == "deleting")
    return rows.select("hash", F.when(F.col("c") & deleting, "wait").when(F.col("c") & F.col("r"), "rescued").when(F.col("c"), "rescue").when(F.col("k"), "reuse").otherwise("upload").alias("action"))
