"""Plans of changes: what a request would do to a state, as rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.operators.order import pass_over
from palimpsest.operators.tree import has_children, missing_parents

BATCH_DELETES = 1000


def put(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """key, outcome: create, replace, or conflict where a name is in the way.

    A file can't be put where a folder of that name is, nor a folder where a file is, nor below a file.
    """
    plain = F.regexp_replace("key", "/$", "")
    there = keyed.select(plain.alias("plain"), F.col("kind").alias("there"))
    folder = F.col("key").endswith("/")
    parts = F.split(plain, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "/"))).otherwise(F.array().cast("array<string>"))
    files = keyed.where("kind = 'file'").select(F.col("key").alias("file"))
    blocked = wanted.select("key", F.explode(above).alias("file")).join(files, "file", "left_semi").select("key").distinct().withColumn("blocked", F.lit(True))
    rows = wanted.withColumn("plain", plain).join(there, "plain", "left").join(blocked, "key", "left")
    outcome = F.when(F.col("blocked"), "conflict").when(F.col("there").isNull(), "create").when(folder == (F.col("there") == "folder"), "replace").otherwise("conflict")
    return rows.select("key", outcome.alias("outcome"))


def make_parents(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    return missing_parents(wanted, keyed)


def delete(asked: DataFrame, keyed: DataFrame, entries: DataFrame) -> DataFrame:
    """key, outcome: removed, or nothing where it is missing, the root, or a folder that is not empty."""
    full = has_children(entries).withColumn("full", F.lit(True))
    rows = asked.join(keyed.select("key", "oid"), "key", "left").join(full, "oid", "left")
    return rows.select("key", F.when((F.col("key") == "") | F.col("oid").isNull() | F.coalesce("full", F.lit(False)), "nothing").otherwise("removed").alias("outcome"))


def rename(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """source, target, outcome: both files or both folders, not into itself, and only a file may be replaced, by a file."""
    kinds = keyed.select("key", "kind")
    rows = asked.join(kinds.withColumnsRenamed({"key": "source", "kind": "is"}), "source", "left").join(kinds.withColumnsRenamed({"key": "target", "kind": "there"}), "target", "left")
    return rows.select("source", "target", F.when(F.col("is").isNull(), "missing").when(F.col("source").endswith("/") != F.col("target").endswith("/"), "kind")
                       .when(F.col("source").endswith("/") & F.col("target").startswith(F.col("source")), "inside itself")
                       .when(F.col("there").isNull(), "moved").when((F.col("there") == "file") & (F.col("is") == "file"), "replaced").otherwise("taken").alias("outcome"))


def restore(asked: DataFrame, history: DataFrame, taken: DataFrame) -> DataFrame:
    """oid with what a rollback to (seq, idx) sets, or why not: no such version, or the key is taken."""
    rows = asked.join(history.select("oid", "seq", "idx", "size", "etag"), ["oid", "seq", "idx"], "left").join(taken.select("oid").distinct().withColumn("taken", F.lit(True)), "oid", "left")
    return rows.select("oid", "seq", "idx", F.when(F.col("etag").isNull(), "no such version").when(F.col("taken"), "key taken").otherwise("restored").alias("outcome"), F.coalesce("size", F.lit(0)).alias("size"))


def restore_subtree(then: DataFrame, now: DataFrame) -> DataFrame:
    """oid, action for a folder's rollback. then, now: oid, parent, name, etag, of the objects in the folder at each time.

    removed: only in it now; brought back: gone since; moved back: elsewhere since; restored: other content; else untouched.
    """
    a, b = then.select("oid", F.struct("parent", "name").alias("was"), F.col("etag").alias("etag_was")), now.select("oid", F.struct("parent", "name").alias("is"), F.col("etag").alias("etag_is"))
    return a.join(b, "oid", "full_outer").select("oid", F.when(F.col("was").isNull(), "removed").when(F.col("is").isNull(), "brought back").when(F.col("was") != F.col("is"), "moved back").when(F.col("etag_was") != F.col("etag_is"), "restored").otherwise("untouched").alias("action"))


def merge_attrs(now: Column, removed: Column, given: Column) -> Column:
    """A map after a patch: keys removed, then keys set."""
    return F.map_concat(F.map_filter(now, lambda k, _: ~F.array_contains(removed, k) & ~F.array_contains(F.map_keys(given), k)), given)


def copy(asked: DataFrame, sources: DataFrame) -> DataFrame:
    """asked (drive, key, target) with the content that the copy refers to; nothing is copied. sources: drive, key, etag, size."""
    return asked.join(sources, ["drive", "key"], "left").select("drive", "key", "target", F.coalesce("etag", F.lit("missing")).alias("etag"), F.coalesce("size", F.lit(0)).alias("size"))


def complete_upload(asked: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """upload, part, verdict: ok, InvalidPart where it is not stored, EntityTooSmall where any but the last is short."""
    last = asked.groupBy("upload").agg(F.max("part").alias("last"))
    return asked.join(parts, ["upload", "part"], "left").join(last, "upload").select("upload", "part", F.when(F.col("size").isNull(), "InvalidPart").when((F.col("size") < least) & (F.col("part") < F.col("last")), "EntityTooSmall").otherwise("ok").alias("verdict"), F.coalesce("size", F.lit(0)).alias("size"))


def upload_plan(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """hash, verdict: held, missing, or length where the stored size differs. known: hash, size."""
    return wanted.join(known, "hash", "left").select("hash", F.when(F.col("size").isNull(), "missing").when(F.col("size") != F.col("n"), "length").otherwise("held").alias("verdict"))


def live_drives(drives: DataFrame) -> DataFrame:
    return drives.where("not deleted").orderBy("drive")


def edit_target(asked: DataFrame, keyed: DataFrame) -> DataFrame:
    """key, outcome of an in-place edit: write on a file, create where nothing is, refused on a folder."""
    return asked.join(keyed.select("key", "kind"), "key", "left").select("key", F.when(F.col("kind").isNull(), F.when(F.col("key").endswith("/"), "refused").otherwise("create")).when(F.col("kind") == "folder", "refused").otherwise("write").alias("outcome"))


def delete_many(asked: DataFrame, limit: int = BATCH_DELETES) -> DataFrame:
    """Whether each request (request, ord, key) is within the limit; its keys are deleted in order."""
    sizes = asked.groupBy("request").agg(F.count("*").alias("n"))
    return asked.join(sizes, "request").select("request", "ord", "key", (F.col("n") <= limit).alias("accepted"))


def commit_upload(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """upload, verdict of a direct upload (upload, hash, n): ok if all its shards are stored with the sizes it says."""
    rows = asked.join(stored.select("hash", "size"), "hash", "left")
    bad = F.sum(F.when(F.col("size").isNull(), 1).otherwise(0))
    wrong = F.sum(F.when(F.col("size") != F.col("n"), 1).otherwise(0))
    return rows.groupBy("upload").agg(F.when(bad > 0, "missing").when(wrong > 0, "length").otherwise("ok").alias("verdict"))


def drive_lifecycle(events: DataFrame) -> DataFrame:
    """drive, state from its events (drive, seq, op: create, soft_delete, undelete, hard_delete): gone for good after a hard delete, else by the last."""
    last = F.max_by("op", "seq")
    return events.groupBy("drive").agg(F.when(F.max(F.when(F.col("op") == "hard_delete", 1)) == 1, "gone").when(last == "soft_delete", "deleted").otherwise("live").alias("state"))


def drive_requests(asked: DataFrame) -> DataFrame:
    """alias, seq, op, outcome of requests (alias, seq, op: create, soft_delete, undelete, hard_delete) made in order.

    An alias is of one live drive at most; a drive deleted softly leaves it free, and the last so deleted can come back
    while it is free. done; exists: a live drive has the alias; missing: there is no such drive. An alias's requests are
    one ordered pass, batch by batch; other ops and nulls are unknown.
    """
    schema = asked.select("alias", "seq", "op", F.lit("").alias("outcome")).schema

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        live = deleted = False

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal live, deleted
            out = []
            for op in rows["op"]:
                outcome = "done"
                if op == "create":
                    outcome, live = ("exists", True) if live else ("done", True)
                elif op == "soft_delete":
                    outcome, live, deleted = ("done", False, True) if live else ("missing", live, deleted)
                elif op == "undelete":
                    outcome, live, deleted = ("missing", live, deleted) if not deleted else ("exists", live, deleted) if live else ("done", True, False)
                elif op == "hard_delete":
                    outcome, live, deleted = ("done", False, deleted) if live else ("done", False, False) if deleted else ("missing", live, deleted)
                else:
                    outcome = "unknown"
                out.append(outcome)
            return rows[["alias", "seq", "op"]].assign(outcome=out)

        return step

    return pass_over(asked.select("alias", "seq", "op"), "alias", ["seq"], schema, start)


def alias_clashes(drives: DataFrame) -> DataFrame:
    """Aliases that more than one live drive has. drives: alias, state."""
    return drives.where("state = 'live'").groupBy("alias").agg(F.count("*").alias("n")).where("n > 1")


def enable_feature(pools: DataFrame, feature: str) -> DataFrame:
    """The pool's features with one more, sorted, each once."""
    return pools.withColumn("features", F.array_sort(F.array_union("features", F.array(F.lit(feature)))))
