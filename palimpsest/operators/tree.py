"""The folder tree: keys from entries, subtrees, ancestors and what rolls up along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.session import RECURSION_LIMIT, kept

#: Names on the way to an entry beyond which the way is taken for a cycle; keys are at most 1,024 bytes.
DEEPEST = 1 << 16


def _recursive(df: DataFrame, sql: str, **frames: DataFrame) -> DataFrame:
    """Recursion to the depth of the longest key, over any number of rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(RECURSION_LIMIT))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(sql, **frames)


def keys(entries: DataFrame, root: str = "root") -> DataFrame:
    """parent, name, oid, kind, key and depth of every entry the root reaches; a folder's key ends in a slash.

    Each entry knows the way from a folder above it; each round joins to it the way of that folder, so ways double and
    a tree of depth d takes log2(d) joins. Entries whose parent is nowhere have no key, nor have those in a cycle, which
    are told by a way of over DEEPEST names.
    """
    own = segment()
    rows = kept(entries.select("parent", "name", "oid", "kind", F.col("parent").alias("top"), own.alias("key"), F.lit(1).alias("depth")))
    while not rows.where(F.col("top") != root).isEmpty():
        above = rows.select(F.col("oid").alias("top"), F.col("top").alias("__next"), F.col("key").alias("__front"), F.col("depth").alias("__more"))
        longer = rows.where(F.col("top") != root).join(above, "top").where(F.col("depth") + F.col("__more") <= DEEPEST)
        longer = longer.select("parent", "name", "oid", "kind", F.col("__next").alias("top"), F.concat("__front", "key").alias("key"), (F.col("depth") + F.col("__more")).alias("depth"))
        rows = kept(rows.where(F.col("top") == root).unionByName(longer))
    return rows.drop("top")


def descendants(entries: DataFrame, start: str) -> DataFrame:
    """oid and depth of all below `start`, which has depth 0. A tree has one way to each, so nothing repeats."""
    return _recursive(entries, """with recursive walk as (select {start} as oid, 0 as depth union all select e.oid, w.depth + 1 from walk w join {entries} e on e.parent = w.oid) select * from walk""", entries=entries, start=start)


def ancestors_of(entries: DataFrame, oid: str) -> DataFrame:
    """oid and distance of each folder above, the root last."""
    return _recursive(entries, """with recursive up as (select parent as oid, 1 as distance from {entries} where oid = {start} union all select e.parent, u.distance + 1 from up u join {entries} e on e.oid = u.oid) select * from up""", entries=entries, start=oid)


def has_children(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("parent").alias("oid")).distinct()


def children(entries: DataFrame, folder: str) -> DataFrame:
    """The entries of a folder with their segment, the name with a slash after a folder's, which gives key order."""
    return entries.where(F.col("parent") == folder).withColumn("segment", segment())


def segment() -> Column:
    return F.concat("name", F.when(F.col("kind") == "folder", "/").otherwise(""))


def child_named(entries: DataFrame, folder: str, name: str) -> DataFrame:
    """The child of that name, a file before a folder."""
    return entries.where((F.col("parent") == folder) & (F.col("name") == name)).orderBy(F.when(F.col("kind") == "file", 0).otherwise(1)).limit(1)


def lookup(keyed: DataFrame, key: str) -> DataFrame:
    """The object at a key; a file's key never names a folder."""
    return keyed.where(F.col("key") == key)


def subtree(keyed: DataFrame, folder: str) -> DataFrame:
    """All under a folder's key, parents before children by depth."""
    return keyed.where(F.col("key").startswith(folder) & (F.col("key") != folder))


def prefixes(key: str = "key") -> Column:
    """All folders a key is in, outermost first, each ending in a slash."""
    parts = F.split(F.regexp_replace(F.col(key), "/$", ""), "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "/"), F.lit("/")))


def ancestor_keys(keyed: DataFrame, key: str = "key", *carried: str) -> DataFrame:
    """key, folder and what is carried along: every folder above each key."""
    deep = keyed.where(F.instr(F.regexp_replace(F.col(key), "/$", ""), "/") > 0)
    return deep.select(key, *carried, F.explode(prefixes(key)).alias("folder"))


def missing_parents(wanted: DataFrame, keyed: DataFrame) -> DataFrame:
    """Folders to make, outermost first, before the wanted keys can be put."""
    return ancestor_keys(wanted).select("folder").distinct().join(keyed.select(F.col("key").alias("folder")), "folder", "left_anti").withColumn("depth", F.size(F.split("folder", "/")) - 1)


def worst_below(keyed: DataFrame, states: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """folder and the worst state of anything in it. states: oid, sync. ranks: a larger rank is worse."""
    rank = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    return ancestor_keys(keyed.join(states, "oid"), "key", "sync").groupBy("folder").agg(F.max_by("sync", rank[F.col("sync")]).alias("worst"))


def orphans(entries: DataFrame, root: str = "root") -> DataFrame:
    """Entries whose parent is neither the root nor a folder."""
    folders = entries.where("kind = 'folder'").select(F.col("oid").alias("parent"))
    return entries.where(F.col("parent") != root).join(folders, "parent", "left_anti")


def clashes(entries: DataFrame) -> DataFrame:
    """Names that two entries of a folder have, whatever their kinds."""
    return entries.groupBy("parent", "name").agg(F.count("*").alias("n")).where("n > 1")


def live_bytes(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Bytes of all files that have a location, in a removed folder or not."""
    return entries.where("kind = 'file'").join(objects.select("oid", "size"), "oid").agg(F.sum("size").alias("bytes"))
