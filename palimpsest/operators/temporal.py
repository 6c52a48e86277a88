"""As-of reads, validity intervals and the other computations on ordered rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from palimpsest.operators.order import running


def as_of(history: DataFrame, instant: str) -> DataFrame:
    """Each object's latest version not after the instant; of equal times the highest version. Folds map-side."""
    rows = history.where(F.col("time") <= F.lit(instant).cast("timestamp_ntz"))
    return rows.groupBy("oid").agg(F.max(F.struct("time", "seq", "idx", "op", "size")).alias("v")).select("oid", "v.*")


def as_of_many(history: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (oid, at) with the version each saw, one pass: questions and versions in one order, the last version carried.

    One sort by object instead of a range join, so many instants cost no more than few.
    """
    versions = history.select("oid", F.col("time").alias("at"), F.lit(0).alias("ask"), F.struct("seq", "idx").alias("v"))
    questions = asked.select("oid", "at", F.lit(1).alias("ask"), F.lit(None).cast("struct<seq: bigint, idx: int>").alias("v"))
    w = Window.partitionBy("oid").orderBy("at", "ask", "v").rowsBetween(Window.unboundedPreceding, 0)
    return versions.unionByName(questions).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("ask = 1").select("oid", "at", "v.seq", "v.idx")


def validity(history: DataFrame) -> DataFrame:
    """Each version with the time the next one took over."""
    return history.withColumn("until", F.lead("time").over(Window.partitionBy("oid").orderBy("seq", "idx")))


def numbered(history: DataFrame) -> DataFrame:
    return history.withColumn("n", F.row_number().over(Window.partitionBy("oid").orderBy("seq", "idx")))


def latest_flag(history: DataFrame) -> DataFrame:
    return history.withColumn("is_latest", F.lead("seq").over(Window.partitionBy("oid").orderBy("seq", "idx")).isNull())


def size_deltas(history: DataFrame) -> DataFrame:
    return history.withColumn("delta", F.col("size") - F.coalesce(F.lag("size").over(Window.partitionBy("oid").orderBy("seq", "idx")), F.lit(0)))


def monotone(rows: DataFrame, key: str) -> DataFrame:
    """Times that never go back: each the largest so far of its key."""
    return rows.withColumn("clamped", F.max("time").over(Window.partitionBy(key).orderBy("seq", "idx").rowsBetween(Window.unboundedPreceding, 0)))


def islands(ranges: DataFrame, key: str, start: str = "start", stop: str = "stop") -> DataFrame:
    """Overlapping ranges of a key merged; ranges that only touch stay apart."""
    w = Window.partitionBy(key).orderBy(start, stop)
    far = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(far.isNull() | (F.col(start) >= far), 1).otherwise(0))
    grouped = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("island")


def covered(ranges: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Whether the ranges of each key leave no gap in 0..size."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    far = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    holes = ranges.withColumn("hole", F.col("start") > far).groupBy(key).agg(F.max("hole").alias("hole"), F.max("stop").alias("stop"))
    return sizes.join(holes, key, "left").select(key, ((F.col("size") == 0) | (~F.coalesce("hole", F.lit(True)) & (F.col("stop") >= F.col("size")))).alias("covered"))


def newest(rows: DataFrame, keep: int, order: str = "seq", key: str | None = None) -> DataFrame:
    """The last `keep` rows of each key by `order`."""
    if key is None:
        return rows.orderBy(F.desc(order)).limit(keep)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__n") <= keep).drop("__n")


def floor_of(rows: DataFrame, keep: int, order: str = "seq") -> DataFrame:
    """The number of the last row that newest() leaves out, 0 if it leaves none out."""
    kept = newest(rows.select(order), keep, order)
    return rows.join(F.broadcast(kept.agg(F.min(order).alias("__first"))), F.col(order) < F.col("__first")).agg(F.coalesce(F.max(order), F.lit(0)).alias("floor"))


def whole_batches(batches: DataFrame, key: str, limit: int) -> DataFrame:
    """Whole batches in order while they hold at most `limit` changes together, the first however many. batches: key, seq, n."""
    summed = running(batches, [key], ["seq"], {"__sum": F.col("n"), "__place": F.lit(1)})
    return summed.where((F.col("__place") == 1) | (F.col("__sum") <= limit)).drop("__sum", "__place")


def within_budget(blocks: DataFrame, key: str, budget: int) -> DataFrame:
    """What a cache keeps: pinned blocks, and the most recently used others while their sum fits. blocks: id, len, last_used, pinned."""
    others = running(blocks.where("not pinned"), [key], ["last_used", "id"], {"__sum": F.col("len")}, descending=("last_used",))
    return others.where(F.col("__sum") <= budget).drop("__sum").unionByName(blocks.where("pinned"))
