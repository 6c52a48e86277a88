"""Latencies by scenario, target and round: quantiles, medians, speed-ups and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.operators.order import quantiles, running

#: Upper bounds, in milliseconds, of histogram buckets; a last one has no bound.
BUCKETS = (1.0, 5.0, 25.0, 100.0, 500.0)
MIB = 1048576.0


def round_stats(samples: DataFrame, bytes_per_op: int = 1048576) -> DataFrame:
    """Operations, quantiles with linear interpolation, mean, extremes and throughput of each round."""
    key = ["scenario", "target", "round"]
    ranks = quantiles(samples, key, "latency", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    sums = samples.groupBy(*key).agg(
        F.count("*").alias("ops"), F.round(F.avg("latency"), 6).alias("mean"), F.min("latency").alias("least"), F.max("latency").alias("most"),
        F.round(F.count("*") * bytes_per_op / MIB / (F.sum("latency") / 1000), 6).alias("mib_s"))
    return sums.join(ranks, key).select(*key, "ops", *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p99")], "mean", "least", "most", "mib_s")


def quantile(samples: DataFrame, share: float, name: str) -> DataFrame:
    return quantiles(samples, ["scenario"], "latency", {name: share}).select("scenario", F.round(name, 6).alias(name))


def median_of_rounds(samples: DataFrame) -> DataFrame:
    """The median of the rounds' medians."""
    rounds = quantiles(samples, ["scenario", "target", "round"], "latency", {"p50": 0.5})
    return quantiles(rounds, ["scenario", "target"], "p50", {"median": 0.5}).select("scenario", "target", F.round("median", 6).alias("p50"))


def speedup(samples: DataFrame) -> DataFrame:
    """For each scenario how many times faster target 1 is than target 0."""
    medians = median_of_rounds(samples).groupBy("scenario").pivot("target", [0, 1]).agg(F.first("p50"))
    return medians.select("scenario", F.round(F.col("0") / F.col("1"), 6).alias("speedup"))


def geometric_mean(samples: DataFrame) -> DataFrame:
    """exp(mean(ln x)) of each scenario: 0 where a latency is 0, NaN where one is negative; Spark's ln would leave both out."""
    x = F.col("latency").cast("double")
    ln = F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))
    return samples.groupBy("scenario").agg(F.round(F.exp(F.avg(ln)), 6).alias("geomean"))


def histogram(samples: DataFrame) -> DataFrame:
    """Cumulative counts of each scenario at each bound, 1e300 for the last."""
    counted = samples.groupBy("scenario").agg(*[F.count(F.when(F.col("latency") <= b, 1)).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count("*").alias(f"b{len(BUCKETS)}"))
    pairs = ", ".join(f"{b}D, b{i}" for i, b in enumerate([*BUCKETS, 1e300]))
    return counted.selectExpr("scenario", f"stack({len(BUCKETS) + 1}, {pairs}) as (bound, n)")


def decayed(tally: DataFrame, factor: float = 0.875) -> DataFrame:
    """A tally that takes `factor` of what it holds before each new entry. tally: key, ord, x; folded in order.

    An entry with k after it counts x times factor to the power of k, so the fold is a plain sum once the entries are
    numbered from the last.
    """
    after = running(tally.select("key", "ord", "x"), ["key"], ["ord"], {"n": F.lit(1)}, descending=("ord",))
    return after.groupBy("key").agg(F.round(F.sum(F.col("x").cast("double") * F.pow(F.lit(factor), F.col("n") - 1)), 6).alias("tally"))
