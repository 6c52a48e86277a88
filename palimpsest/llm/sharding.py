"""Shards by jump consistent hashing, with gapless slots inside each shard.

The shard depends on the id and the number of shards alone, so with one more shard rows move only into that shard. A
null id is a key like any other; rows with equal ids go to one shard. Equal texts may go to different shards. A null
text counts as no bytes. Rows that are equal in every column here take neighbouring slots in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from palimpsest.llm.common import documents, ids_and_texts, settled, unused
from palimpsest.operators.order import running

SHARDS = 40
#: Bytes a row takes beside its text.
ROW_BYTES = 16
#: Fixed values of the published algorithm: the multiplier of its generator, and 2 to the 31st.
MULTIPLIER, SPAN = 2862933555777941757, float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, below `shards`, of each 64-bit key."""
    key = keys.astype(np.uint64)
    shard, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while (open_ := ahead < shards).any():
            shard[open_] = ahead[open_]
            key[open_] = key[open_] * np.uint64(MULTIPLIER) + np.uint64(1)
            ahead[open_] = ((shard[open_] + 1) * (SPAN / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
    return shard


@F.pandas_udf(T.IntegerType())
def _jump(key: pd.Series, shards: pd.Series) -> pd.Series:
    return pd.Series(jump(key.to_numpy(), int(shards.iloc[0])) if len(key) else [], dtype="int32")


def assign(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """Adds shard, and grown_shard, where the row is with one more shard."""
    key = F.xxhash64(F.col(id_col))
    return df.withColumns({"shard": _jump(key, F.lit(shards)), "grown_shard": _jump(key, F.lit(shards + 1))})


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, in the order given.

    Shards are summed up by ranges of their rows, so neither a large shard nor one id or row over and over is one task:
    rows that are equal in the order are told apart by where they are kept.
    """
    [tie, place] = unused(df, "tie", "place")
    rows = settled(df).withColumn(tie, F.monotonically_increasing_id())
    return running(rows, ["shard"], [*order, tie], {place: F.lit(1)}).withColumn("slot", F.col(place) - 1).drop(tie, place)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = ids_and_texts(documents(spark, sf_dir)).select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = number(assign(rows), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
