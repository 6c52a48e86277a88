"""The client's queue and overlay: status, dependencies, merged listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.order import running
from palimpsest.session import kept

#: A chain of bases of more than 2 to this many entries is taken for a cycle.
LONGEST_BITS = 40


def batch_status(entries: DataFrame) -> DataFrame:
    return entries.groupBy("batch", "state").agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.sum("sent").alias("sent"))


def summary(entries: DataFrame) -> DataFrame:
    """One row for each batch; what is done counts as sent whole."""
    is_ = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0))
    return entries.groupBy("batch").agg(F.count("*").alias("items"), is_("done").alias("done"), is_("failed").alias("failed"), is_("cancelled").alias("cancelled"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("state") == "done", F.col("size")).otherwise(F.col("sent"))).alias("sent"))


def unpublished(entries: DataFrame) -> DataFrame:
    rows = entries.where("state not in ('done', 'cancelled')")
    return rows.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.greatest(F.col("size") - F.col("sent"), F.lit(0))), F.lit(0)).alias("bytes"))


def distinct_keys(entries: DataFrame, state: str) -> DataFrame:
    return entries.where(F.col("state") == state).select("drive", "key").distinct().agg(F.count("*").alias("keys"))


def depends(entries: DataFrame) -> DataFrame:
    """earlier, later: links that say which entries of a drive have to wait for which, directly or by way of others.

    Entries that touch one name wait for each other in order, so each is linked to the one of that name before it. What
    is in a folder is linked to the last entry that touches the folder before it, and to the next after it. So links are
    as many as entries times the depth of their keys, however often a name or folder occurs. Entries are counted by
    ranges and meet by their number, so a name or folder that very many touch is not one task.
    """
    rows = entries.select("id", "drive", "key", F.regexp_replace("key", "/$", "").alias("plain"))
    placed = running(rows.select("id", "drive", "plain"), ["drive", "plain"], ["id"], {"place": F.lit(1)})
    next_ = placed.select("drive", "plain", (F.col("place") - 1).alias("place"), F.col("id").alias("later"))
    same = placed.join(next_, ["drive", "plain", "place"]).select(F.col("id").alias("earlier"), "later")
    parts = F.split("plain", "/")
    folder = lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "/"), F.lit("/"))
    above = rows.where(F.size(parts) > 1).select("id", "drive", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), folder)).alias("folder"), F.lit(0).alias("whole"))
    folders = rows.where(F.col("key").endswith("/")).select("id", "drive", F.col("key").alias("folder"), F.lit(1).alias("whole"))
    both = above.join(folders.select("drive", "folder").distinct(), ["drive", "folder"], "left_semi").unionByName(folders)
    counted = running(both, ["drive", "folder"], ["id"], {"number": F.col("whole")})  # how many touch the folder by then
    wholes = kept(counted.where("whole = 1").select("drive", "folder", "number", F.col("id").alias("whole_id")))
    inside = counted.where("whole = 0").select("drive", "folder", "number", "id")
    before = inside.join(wholes, ["drive", "folder", "number"]).select(F.col("whole_id").alias("earlier"), F.col("id").alias("later"))
    after = inside.withColumn("number", F.col("number") + 1).join(wholes, ["drive", "folder", "number"]).select(F.col("id").alias("earlier"), F.col("whole_id").alias("later"))
    return same.unionByName(before).unionByName(after).distinct()


def merged_names(local: DataFrame, remote: DataFrame) -> DataFrame:
    """parent, name, ino of an overlay: local names over remote ones; a local null hides the name."""
    return local.unionByName(remote.join(local.select("parent", "name"), ["parent", "name"], "left_anti")).where("ino is not null")


def unsaved(local: DataFrame, remote: DataFrame, inodes: DataFrame) -> DataFrame:
    return merged_names(local, remote).join(inodes.where("sync <> 'saved'"), "ino").select("parent", "name", "ino", "sync")


def first_blocked(entries: DataFrame) -> DataFrame:
    """For each entry with a failed or cancelled entry on its chain of bases, itself included, the nearest such.

    Each entry knows the nearest on a stretch of its chain and where that stretch ends; each round takes on the next
    stretch, so a chain of n entries takes log2(n) joins. A base that is nowhere ends a chain.
    """
    own = F.when(F.col("state").isin("failed", "cancelled"), F.col("id"))
    rows = kept(entries.select(F.col("id").alias("node"), F.col("base").alias("after"), own.alias("blocked_by")))
    for _ in range(LONGEST_BITS):
        open_ = rows.where("blocked_by is null and after is not null")
        if open_.isEmpty():
            return rows.where("blocked_by is not null").select("node", "blocked_by")
        further = rows.select(F.col("node").alias("after"), F.col("after").alias("next"), F.col("blocked_by").alias("found"))
        longer = open_.join(further, "after").select("node", F.col("next").alias("after"), F.col("found").alias("blocked_by"))
        rows = kept(rows.where("blocked_by is not null or after is null").unionByName(longer))
    raise ValueError("bases form a cycle")


def unneeded(entries: DataFrame) -> DataFrame:
    """Finished entries that no unfinished entry stands on.

    In round k what is needed reaches 2 to the k bases further, by links that double in length, so a chain of n entries
    takes log2(n) rounds.
    """
    needed = kept(entries.where("state not in ('done', 'cancelled')").select("id").distinct())
    links = kept(entries.where("base is not null").select("id", "base"))
    for _ in range(LONGEST_BITS):
        if links.isEmpty():
            return entries.join(needed, "id", "left_anti").select("id")
        needed = kept(needed.unionByName(links.join(needed, "id", "left_semi").select(F.col("base").alias("id"))).distinct())
        links = kept(links.join(links.select(F.col("id").alias("base"), F.col("base").alias("next")), "base").select("id", F.col("next").alias("base")))
    raise ValueError("bases form a cycle")


def fold(entries: DataFrame) -> DataFrame:
    """Queued changes of one file folded into its creating put: the last attributes given, the last whole content."""
    order = F.struct("id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return entries.groupBy("drive", "key").agg(F.min("id").alias("id"), last("mode"), last("mtime"), last("source"), F.count("*").alias("folded"))
