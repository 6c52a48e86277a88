"""Writing the log and its checkpoints: grouping, cuts, cadence and what need not be written again."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.operators.order import pass_over, running
from palimpsest.session import kept

BATCH_TXNS, BATCH_BYTES = 256, 1 << 20
CHECKPOINT_COMMITS, CHECKPOINT_BYTES = 1000, 16 << 20
SEGMENT_MIN, SEGMENT_MAX, CUT_BITS, FALLBACK_BITS = 256, 8192, 12, 10
LEAF_MIN, LEAF_MAX, LEAF_BITS = 256, 1024, 9


def group_commits(txns: DataFrame, key: str, limit: int = BATCH_TXNS) -> DataFrame:
    """Transactions of each drive in their order, at most `limit` to a commit."""
    placed = running(txns, [key], ["seq", "idx"], {"place": F.lit(1)})
    place = F.col("place") - 1
    return placed.withColumns({"commit": F.floor(place / limit) + 1, "place": F.pmod(place, F.lit(limit))})


def group_by_bytes(txns: DataFrame, key: str, size: str, limit: int = BATCH_BYTES, most: int = BATCH_TXNS) -> DataFrame:
    """key, seq, idx, commit: a new commit starts where the bytes would pass the limit, unless it is empty.

    The sum starts anew with each commit, which no window can say; one ordered pass over each drive does.
    """
    schema = txns.select(key, "seq", "idx", F.lit(0).cast("long").alias("commit")).schema

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        commit, held, n = 1, 0, 0

        def cut(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal commit, held, n
            out = []
            for nbytes in rows[size]:
                if n and (held + nbytes > limit or n == most):
                    commit, held, n = commit + 1, 0, 0
                held, n = held + nbytes, n + 1
                out.append(commit)
            return rows[[key, "seq", "idx"]].assign(commit=out)

        return cut

    return pass_over(txns.select(key, "seq", "idx", size), key, ["seq", "idx"], schema, start)


def low_zeros(text: Column) -> Column:
    """Low zero bits of the last two bytes of a SHA-256, 16 if all are zero."""
    tail = F.conv(F.substring(F.sha2(text, 256), -4, 4), 16, 10).cast("int")
    return F.when(tail == 0, F.lit(16)).otherwise(F.length(F.bin(tail.bitwiseAND(-tail))) - 1)


def segments(rows: DataFrame, table: str, key: str) -> DataFrame:
    """Content-defined cuts of each table's sorted rows: table, key, segment.

    A segment ends after a row with CUT_BITS low zeros once it is long enough; at its longest it ends after its last
    row with FALLBACK_BITS. Each cut depends on the one before, so a table's cuts come from one ordered pass over its
    rows with zeros enough, one in 1,024, batch by batch. All rows are numbered by ranges and find their segment by the
    block of SEGMENT_MIN places they are in, which no more than two segments share.
    """
    placed = running(rows.select(table, key), [table], [key], {"place": F.lit(1)}).withColumn("zeros", low_zeros(F.col(key)))
    last = placed.groupBy(table).agg(F.max("place").alias("place")).select(table, "place", F.lit(-1).alias("zeros"), F.lit(1).alias("end"))
    marks = placed.where(F.col("zeros") >= FALLBACK_BITS).select(table, "place", "zeros", F.lit(0).alias("end")).unionByName(last)

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        begin, number, fallback = 0, 0, 0

        def step(found: pd.DataFrame) -> pd.DataFrame:
            nonlocal begin, number, fallback
            out: list[tuple[int, int, int]] = []

            def cut(at: int) -> None:
                nonlocal begin, number, fallback
                out.append((begin, at, number))
                begin, number, fallback = at, number + 1, 0

            for place, zeros in zip(found["place"], found["zeros"], strict=True):
                while place > begin + SEGMENT_MAX or (zeros < 0 and place == begin + SEGMENT_MAX):
                    later = [p for p in held if p >= begin + SEGMENT_MIN]
                    cut(later[-1] if later else begin + SEGMENT_MAX)
                    held[:] = [p for p in held if p > begin]
                if zeros < 0:
                    if begin < place:
                        cut(place)
                elif zeros >= CUT_BITS and place >= begin + SEGMENT_MIN:
                    cut(place)
                    held.clear()
                else:
                    held.append(place)
            return pd.DataFrame({table: found[table].iloc[0], "low": [a for a, _, _ in out], "high": [b for _, b, _ in out], "segment": [n for _, _, n in out]})

        held: list[int] = []
        return step

    long = F.lit(0).cast("long")
    cuts = pass_over(marks, table, ["place", "end"], rows.select(table, long.alias("low"), long.alias("high"), long.alias("segment")).schema, start)
    block = lambda place: F.floor((place - 1) / SEGMENT_MIN)
    cuts = cuts.withColumn("block", F.explode(F.sequence(block(F.col("low") + 1), block(F.col("high")))))
    found = placed.withColumn("block", block(F.col("place"))).join(cuts, [table, "block"])
    return found.where((F.col("place") > F.col("low")) & (F.col("place") <= F.col("high"))).select(table, key, "segment")


def leaves(extents: DataFrame, oid: str = "oid", *carried: str) -> DataFrame:
    """Manifest leaves: extents of each object, cut after a hash with LEAF_BITS low zeros or at LEAF_MAX. oid, pos, leaf and what is carried."""
    rows = extents.select(oid, "pos", *carried, F.coalesce(F.conv(F.substring("s", -4, 4), 16, 10).cast("int"), F.lit(1)).alias("tail"))
    schema = rows.select(oid, "pos", *carried, F.lit(0).cast("int").alias("leaf")).schema

    def start() -> Callable[[pd.DataFrame], pd.DataFrame]:
        leaf, n = 0, 0

        def cut(found: pd.DataFrame) -> pd.DataFrame:
            nonlocal leaf, n
            out = []
            for tail in found["tail"]:
                out.append(leaf)
                n += 1
                if n >= LEAF_MAX or (tail % (1 << LEAF_BITS) == 0 and n >= LEAF_MIN):
                    leaf, n = leaf + 1, 0
            return found[[oid, "pos", *carried]].assign(leaf=pd.Series(out, index=found.index, dtype="int32"))

        return cut

    return pass_over(rows, oid, ["pos"], schema, start)


def manifests(extents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots (oid, root, size) and pages (hash, bytes as text) of the manifest trees of objects with over LEAF_MAX extents.

    extents: oid, pos, s, n, z. A page holds up to LEAF_MAX extents or pages, cut by what they are, so an edit makes anew
    one leaf and the pages above it. Each level is one pass; a tree of n extents has log(n) levels, as pages hold 256 at
    least. Objects with fewer extents hold them themselves and have no tree.
    """
    size = F.coalesce("n", "z", F.lit(0))
    item = F.when(F.col("s").isNotNull(), F.to_json(F.struct("s", "n"))).otherwise(F.to_json(F.struct("z")))
    large = extents.groupBy("oid").agg(F.count("*").alias("count")).where(F.col("count") > LEAF_MAX).select("oid")
    level = extents.join(large, "oid", "left_semi").select("oid", F.col("pos").cast("long").alias("pos"), "s", item.alias("item"), size.alias("size"))
    front, roots, pages = '{"kind":"leaf","extents":[', None, None
    while True:
        cut = leaves(level, "oid", "item", "size").groupBy("oid", "leaf").agg(F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("items"), F.sum("size").alias("size"))
        body = F.concat(F.lit(front), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}"))
        made = kept(cut.select("oid", F.col("leaf").cast("long").alias("pos"), body.alias("bytes"), "size").withColumn("hash", F.sha2("bytes", 256)))
        single = made.groupBy("oid").agg(F.count("*").alias("count")).where("count = 1").select("oid")
        done = made.join(single, "oid", "left_semi").select("oid", F.col("hash").alias("root"), "size")
        roots = done if roots is None else roots.unionByName(done)
        pages = made.select("hash", "bytes") if pages is None else pages.unionByName(made.select("hash", "bytes"))
        child = F.to_json(F.struct(F.col("hash").alias("page"), "size"))
        level = kept(made.join(single, "oid", "left_anti").select("oid", "pos", F.col("hash").alias("s"), child.alias("item"), "size"))
        if level.isEmpty():
            return roots, pages.dropDuplicates(["hash"])
        front = '{"kind":"node","children":['


def cadence(commits: DataFrame, key: str, every: int = CHECKPOINT_COMMITS, nbytes: int = CHECKPOINT_BYTES) -> DataFrame:
    """Where a checkpoint is due: each time so many commits or so many bytes have come since the one before."""
    rows = running(commits.select(key, "seq", "bytes"), [key], ["seq"], {"n": F.lit(1), "total": F.col("bytes")})
    before = F.col("total") - F.coalesce("bytes", F.lit(0))
    due = (F.col("n") % every == 0) | (F.floor(F.col("total") / nbytes) > F.floor(before / nbytes))
    return rows.where(due).select(key, "seq")


def not_held(pages: DataFrame, held: DataFrame, key: str = "hash") -> DataFrame:
    """What still has to be written: one row for each hash that is not there yet."""
    return pages.dropDuplicates([key]).join(held.select(key), key, "left_anti")


def write_checkpoint(tables: dict[str, tuple[DataFrame, list[str]]], path: str, partitions: int | None = None) -> None:
    """Writes each table sorted by its key, so row groups carry tight ranges, and an index of rows last of all."""
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (rows, order) in tables.items():
        spread = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
        spread.sortWithinPartitions(*order).write.mode("errorifexists").parquet(f"{path}/{name}")
    counts = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    spark.createDataFrame(counts, "name string, rows long").coalesce(1).write.mode("errorifexists").json(f"{path}/index")


def append_commits(commits: DataFrame, path: str) -> int:
    """Appends commits whose seq the log does not hold yet and returns how many; one writer at a time.

    Of the log only the numbers in the range of those given are read. A log of another schema is an error.
    """
    spark = commits.sparkSession
    if exists(spark, path):
        ends = commits.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
        held = spark.read.parquet(path)
        if set(held.columns) != set(commits.columns):
            raise ValueError(f"the log has the columns {held.columns}, not {commits.columns}")
        commits = commits.join(held.where(F.col("seq").between(ends["a"], ends["b"])).select("seq"), "seq", "left_anti")
    commits = kept(commits)
    n = commits.count()
    if n:
        commits.write.mode("append").parquet(path)
    return n


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def delete_prefix(spark, path: str) -> bool:
    """Deletes a folder of the store through Hadoop's file systems, whatever their scheme."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
