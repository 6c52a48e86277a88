"""Numbers and passes over rows in order, without sorting a table, or gathering a key, in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from palimpsest.session import kept, send_package


def number_all(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds the place of each row in the order of the whole table, from 1; rows equal in that order take places in any."""
    return running(rows, [], order, {name: F.lit(1)})


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], descending: tuple[str, ...] = ()) -> DataFrame:
    """Adds running sums over each key's rows in order, each row's own included; no key is gathered in one task.

    Rows are dealt to ranges of key and order, kept so that no row can change its range, and summed up there. What comes
    before a range is summed up from one row for each key and range: for a key that fills many ranges as many rows as
    there are partitions, else one. Nulls in what is summed count as 0; null keys are a key.
    """
    sort = [*key, *(F.col(c).desc() if c in descending else F.col(c).asc() for c in order)]
    parts = {name: F.coalesce(F.sum(F.col(f"__{name}")), F.lit(0)) for name in sums}
    ranged = kept(rows.withColumns({f"__{name}": value for name, value in sums.items()}).repartitionByRange(*sort).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy(*key, "__range").agg(*[total.alias(f"__{name}_all") for name, total in parts.items()])
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select(*[F.col(k).alias(f"__of_{k}") for k in key], F.col("__range").alias("__of_range"), *[F.coalesce(F.sum(f"__{name}_all").over(before), F.lit(0)).alias(f"__{name}_before") for name in sums])
    same = F.col("__range") == F.col("__of_range")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    inside = Window.partitionBy(*key, "__range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"__{name}": F.coalesce(F.sum(f"__{name}").over(inside), F.lit(0)) for name in sums})
    out = summed.join(first, same)
    return out.select(*rows.columns, *[(F.col(f"__{name}_before") + F.col(f"__{name}")).alias(name) for name in sums])


def quantiles(rows: DataFrame, key: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of each key with linear interpolation, by rank, so that a large group is not held in one task.

    Null values are left out; a key without others has no row.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("__value"))
    ranked = running(rows, key, ["__value"], {"__rank": F.lit(1)})
    sizes = ranked.groupBy(*key).agg(F.max("__rank").alias("__n"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    ranked = ranked.join(sizes.select(*[F.col(k).alias(f"__of_{k}") for k in key], "__n"), same)
    found = []
    for name, share in wanted.items():
        at = (F.col("__n") - 1) * F.lit(share)
        low, high = (F.max(F.when(F.col("__rank") == f(at) + 1, F.col("__value"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        found.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*key).agg(*found)


def pass_over(rows: DataFrame, key: str, order: list[str], schema: StructType, start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Runs a stateful function over each key's rows in order, batch by batch, so that no key has to fit in memory.

    `start()` begins a key; what it returns gets the key's rows in pieces and gives the rows to put out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = object(), None
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].astype(object).where(batch[key].notna(), None)  # a null key is one key, not a new one in each row
            edges = [0, *np.flatnonzero([a != b for a, b in zip(keys[1:], keys[:-1], strict=True)]) + 1, len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if keys.iloc[a] != at:
                    at, step = keys.iloc[a], start()
                if len(out := step(batch.iloc[a:b])):  # columns of frames without rows have no certain type
                    yield out

    send_package(rows.sparkSession)
    # by a hash of its own: a shuffle by the key would give way to that of a join by it, whose partitions Spark splits if skewed
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)
