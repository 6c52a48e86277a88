"""Readers of a pool kept in a folder or bucket, through Hadoop's file systems: descriptors, the log, checkpoints, shards."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.operators import transactions
from palimpsest.operators.state import contiguous, explode_log

FORMAT = 1
FEATURES = frozenset({"inline-data", "multi-object-versions"})

POOL = "format int, hash string, features array<string>"
DRIVE = "drive string, alias string, fork_of string, created timestamp"
EXTENT = "struct<s: string, n: bigint, z: bigint, d: string>"
CHANGE = f"struct<create: struct<oid: string, parent: string, name: string, kind: string>, set: struct<oid: string, content: struct<extents: array<{EXTENT}>, root: string, size: bigint>, size: bigint, etag: string>, move: struct<oid: string, parent: string, name: string>, remove: struct<oid: string, recursive: boolean>>"
COMMIT = f"format int, seq bigint, time timestamp, authority string, txns array<struct<target: string, op: string, actor: struct<kind: string, id: string>, changes: array<{CHANGE}>>>"


class UnsupportedPool(ValueError):
    pass


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """The pool's descriptor; an unknown format, hash or feature is refused."""
    row = spark.read.schema(POOL).json(path, multiLine=True).first()
    if row is None or row["format"] != FORMAT or row["hash"] != "sha256":
        raise UnsupportedPool(f"unknown format or hash in {path}")
    if unknown := set(row["features"] or ()) - FEATURES:
        raise UnsupportedPool(f"unknown features {sorted(unknown)} in {path}")
    return spark.createDataFrame([row], spark.read.schema(POOL).json(path, multiLine=True).schema)


def read_drive(spark: SparkSession, path: str) -> DataFrame | None:
    """A drive's descriptor, or None where there is none."""
    try:
        rows = spark.read.schema(DRIVE).json(path, multiLine=True)
        return None if rows.isEmpty() else rows
    except AnalysisException as fault:
        if "PATH_NOT_FOUND" in str(fault):
            return None
        raise


def read_log(spark: SparkSession, path: str, after: int = 0) -> DataFrame:
    """Commits after a number, up to the first gap."""
    return contiguous(spark.read.schema(COMMIT).json(path), after)


def read_checkpoint(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a checkpoint, if its index, which is written last of all, names it."""
    index = spark.read.schema("name string, rows long").json(f"{path}/index")
    if index.where(F.col("name") == table).isEmpty():
        raise ValueError(f"no table {table} in the checkpoint {path}")
    return spark.read.parquet(f"{path}/{table}")


def write_descriptor(row: DataFrame, path: str) -> None:
    """A pool's or drive's descriptor, created once: a descriptor that is there is an error."""
    row.coalesce(1).write.mode("errorifexists").json(path)


def state_at(spark: SparkSession, log_path: str, at: Column | None = None, checkpoint: str | None = None, after: int = 0) -> DataFrame:
    """A drive's objects as its log leaves them, up to a version or instant, from a checkpoint on if one is given.

    A checkpoint holds the table objects as they were after commit `after`; a fork's first checkpoint is its parent's.
    """
    changes = transactions.changes_of(explode_log(read_log(spark, log_path, after)))
    changes = changes if at is None else changes.where(at)
    if checkpoint is None:
        return transactions.state_of(changes)
    return transactions.apply(read_checkpoint(spark, checkpoint, "objects"), changes)


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest of each drive. checkpoints: drive, seq."""
    return checkpoints.groupBy("drive").agg(F.max("seq").alias("seq"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """hash, bytes, n of stored shards; a file whose bytes are not those its name says raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = F.substring_index("path", "/", -1)
    found = F.sha2("content", 256)
    checked = F.when(found == named, named).otherwise(F.raise_error(F.concat(F.lit("shard does not match its name: "), named)))
    return files.select(checked.alias("hash"), F.col("content").alias("bytes"), F.col("length").alias("n"))


def _listing(spark: SparkSession, path: str, recursive: bool) -> list[tuple]:
    """Files, links left out, and empty or unopened folders, as (path under the folder, length, milliseconds, is a folder).

    Folders are listed one by one by their file system, so names that begin with a dot or underscore are as good as any.
    """
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    system = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [(base, "")]
    while todo:
        folder, front = todo.pop()
        found = [x for x in system.listStatus(folder) if not x.isSymlink()]
        if not found and front:
            out.append((front, 0, None, True))
        for status in found:
            name = front + status.getPath().getName()
            if not status.isDirectory():
                out.append((name, status.getLen(), status.getModificationTime(), False))
            elif recursive:
                todo.append((status.getPath(), name + "/"))
            else:
                out.append((name + "/", 0, None, True))
    return out


def _listed(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    rows = spark.createDataFrame(_listing(spark, path, recursive), "path string, length long, ms long, folder boolean")
    return rows.select("path", "length", F.timestamp_millis("ms").alias("modified"), "folder")


def list_files(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """path, length and modification time of the files in a folder, by name, after a name; contents are not read."""
    files = _listed(spark, path, False).where("not folder").drop("folder")
    return (files if after is None else files.where(F.col("path") > after)).orderBy("path")


def list_recursive(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """The same of all files under a folder at any depth, by their path under it."""
    files = _listed(spark, path, True).where("not folder").drop("folder")
    return (files if after is None else files.where(F.col("path") > after)).orderBy("path")


def list_dirs(spark: SparkSession, path: str) -> DataFrame:
    """The folders directly in a folder, empty ones too, by name."""
    return _listed(spark, path, False).where("folder").select(F.regexp_replace("path", "/$", "").alias("name")).orderBy("name")


def walk(spark: SparkSession, path: str) -> DataFrame:
    """What an upload sends: key and length of every file under a folder and of every empty folder, whose key ends in a slash.

    Symbolic links are left out. Two files of one key, which a store of objects can hold, are an error.
    """
    rows = _listed(spark, path, True).select(F.col("path").alias("key"), "length")
    twice = rows.groupBy("key").count().where("count > 1").first()
    if twice:
        raise ValueError(f"two files for the key {twice['key']}")
    return rows.orderBy("key")


def verify(shards: DataFrame, *carried: str) -> DataFrame:
    """hash, whether the bytes are those it names, and the columns carried along."""
    return shards.select("hash", (F.sha2("bytes", 256) == F.col("hash")).alias("good"), *carried)
