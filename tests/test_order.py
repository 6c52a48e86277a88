from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.operators.order import number_all, pass_over, quantiles, running
from palimpsest.operators import journal, latency, planners, temporal


def test_numbers_of_a_whole_table(spark, table):
    rng = random.Random(1)
    values = [(rng.randrange(50), i) for i in range(2000)]
    found = {(r["a"], r["b"]): r["place"] for r in number_all(table(values, "a int, b int").repartition(7), ["a", "b"]).collect()}
    assert found == {v: n for n, v in enumerate(sorted(values), 1)}
    assert number_all(table([], "a int"), ["a"]).count() == 0


def test_geometric_means_of_zeros_and_negatives(spark, table):
    samples = [("plain", 2.0), ("plain", 8.0), ("plain", None), ("zero", 0.0), ("zero", 5.0), ("minus", -0.0), ("below", -1.0), ("below", 3.0), ("both", 0.0), ("both", -2.0), ("none", None), ("nan", float("nan")), ("far", float("inf"))]
    df = table(samples, "scenario string, latency double")
    found = dict(rows(latency.geometric_mean(df)))
    assert found.pop("none") is None and all(np.isnan(found.pop(k)) for k in ("below", "both", "nan"))
    assert found == {"plain": 4.0, "zero": 0.0, "minus": 0.0, "far": float("inf")}


def test_a_pass_after_a_join_of_skewed_keys(spark):
    """Spark splits the large key's partition for the join; the pass still has to see that key whole."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "20000", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "30000", "adaptive.skewJoin.skewedPartitionFactor": "1.1", "adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(f"spark.sql.{k}") for k in conf}
    for k, v in conf.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        df = spark.range(0, 60_000, 1, 12).selectExpr("if(id % 50 = 0, id % 7, 1) as k", "id as n", "sha2(cast(id as string), 256) as pad")
        joined = df.join(spark.range(7).selectExpr("id as k"), "k", "left_semi")

        def start():
            before = 0

            def step(piece: pd.DataFrame) -> pd.DataFrame:
                nonlocal before
                before += len(piece)
                return pd.DataFrame({"k": piece["k"], "place": range(before - len(piece) + 1, before + 1)})

            return step

        found = pass_over(joined, "k", ["n"], spark.range(0).selectExpr("id as k", "id as place").schema, start)
        assert found.groupBy("k").agg((F.max("place") != F.count("*")).alias("split")).where("split").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(f"spark.sql.{k}", v)


def test_a_pass_sees_each_key_once_in_order(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = table([(k, n) for k in range(5) for n in range(30 * k + 1)], "k int, n int").repartition(9)

    def start():
        total = 0

        def step(piece: pd.DataFrame) -> pd.DataFrame:
            nonlocal total
            out = []
            for n in piece["n"]:
                total += n
                out.append(total)
            return piece[["k", "n"]].assign(total=out)

        return step

    schema = table([(1, 1, 1)], "k int, n int, total int").schema
    found = {(r["k"], r["n"]): r["total"] for r in pass_over(df, "k", ["n"], schema, start).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {(k, n): n * (n + 1) // 2 for k in range(5) for n in range(30 * k + 1)}


def test_as_of_many_is_as_of_for_each(spark, table):
    rng = random.Random(2)
    history = table([(f"o{rng.randrange(4)}", seq, 0, f"2024-01-{rng.randrange(1, 28):02d} 00:00:00", "put", seq) for seq in range(60)], "oid string, seq long, idx int, at string, op string, size long")
    history = history.withColumn("time", history["at"].cast("timestamp_ntz")).drop("at")
    asked = table([(f"o{k}", f"2024-01-{d:02d} 00:00:00") for k in range(5) for d in (1, 9, 27)], "oid string, t string")
    asked = asked.withColumn("at", asked["t"].cast("timestamp_ntz")).drop("t")
    found = {(r["oid"], str(r["at"])): r["seq"] for r in temporal.as_of_many(history, asked).collect()}
    for day in ("2024-01-01 00:00:00", "2024-01-09 00:00:00", "2024-01-27 00:00:00"):
        one = {r["oid"]: r["seq"] for r in temporal.as_of(history, day).collect()}
        assert all(found[f"o{k}", day] == one.get(f"o{k}") for k in range(5))


def test_dependencies_lead_to_all_pairs(spark, table):
    rng = random.Random(3)
    names = ["a", "a/", "a/b", "a/b/", "a/b/c", "ab", "b/", "b/a", "c"]
    entries = [(i, f"d{rng.randrange(2)}", rng.choice(names)) for i in range(60)]
    under = lambda k, p: p.endswith("/") and k.rstrip("/").startswith(p)
    pairs = {(i, j) for i, d, k in entries for j, e, m in entries if i < j and d == e and (k.rstrip("/") == m.rstrip("/") or under(k, m) or under(m, k))}
    links = {tuple(r) for r in journal.depends(table(entries, "id long, drive string, key string")).collect()}

    def closed(found):
        out = set(found)
        for k in range(60):
            out |= {(a, c) for a, b in out if b == k for b2, c in out if b2 == k}
        return out

    assert links <= pairs and closed(links) == closed(pairs)


def test_many_entries_of_one_folder_make_few_links(spark, table):
    entries = [(i, "d", "a/" if i % 3 == 0 else f"a/{i}") for i in range(3000)]
    assert journal.depends(table(entries, "id long, drive string, key string")).count() < 6000


def test_long_chains(spark, table):
    """Ten thousand entries on one another: the nearest blocked one, and what is needed no more."""
    n = 10_000
    rows_ = [(i, i - 1 if i else None, "failed" if i in (2000, 7000) else "queued" if i == 5000 else "done") for i in range(n)]
    entries = table(rows_, "id long, base long, state string").repartition(4)
    found = {r["node"]: r["blocked_by"] for r in journal.first_blocked(entries).collect()}
    assert found == {i: 2000 if i < 7000 else 7000 for i in range(2000, n)}
    assert {r["id"] for r in journal.unneeded(entries).collect()} == set(range(7001, n))


def test_running_sums_and_quantiles(spark, table):
    rng = random.Random(5)
    data = [(rng.choice([None, "hot", "hot", "hot", "a", "b"]), rng.randrange(30), rng.choice([None, *range(9)]), i) for i in range(3000)]
    df = table(data, "k string, at int, x int, i int").repartition(6)
    found = running(df, ["k"], ["at", "i"], {"total": F.col("x"), "n": F.lit(1)}, descending=("at",)).collect()
    want, seen = {}, {}
    for k, at, x, i in sorted(data, key=lambda r: (-r[1], r[3])):
        total, n = seen.get(k, (0, 0))
        seen[k] = want[i] = (total + (x or 0), n + 1)
    assert {r["i"]: (r["total"], r["n"]) for r in found} == want and found[0].asDict().keys() == {"k", "at", "x", "i", "total", "n"}
    got = {r["k"]: (r["low"], r["high"]) for r in quantiles(df, ["k"], "x", {"low": 0.1, "high": 0.77}).collect()}
    for k in (None, "hot", "a", "b"):
        values = [x for kk, _, x, _ in data if kk == k and x is not None]
        assert got[k] == pytest.approx((np.quantile(values, 0.1), np.quantile(values, 0.77)))


def test_restore_classes(spark, table):
    then = table([("kept", "p", "n", "e"), ("gone", "p", "g", "e"), ("moved", "p", "m", "e"), ("edited", "p", "x", "old")], "oid string, parent string, name string, etag string")
    now = table([("kept", "p", "n", "e"), ("moved", "q", "m", "e"), ("edited", "p", "x", "new"), ("added", "p", "a", "e")], "oid string, parent string, name string, etag string")
    assert dict(rows(planners.restore_subtree(then, now))) == {"kept": "untouched", "gone": "brought back", "moved": "moved back", "edited": "restored", "added": "removed"}
