"""Weighted quantiles of groups that span tasks, against plain Python."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.stats import weighted_quantiles
from tapeloom.plans.activity import activity_summary

QS = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "hi": 1.0}


def plain(rows, q):
    """The smallest value whose cumulative weight reaches q of the total, group by group."""
    out = {}
    for k in {r[0] for r in rows}:
        own = sorted((v, w) for g, v, w in rows if g == k and v is not None and w is not None)
        cum, total = 0, sum(w for _, w in own)
        for i, (v, w) in enumerate(own):
            cum += w
            if cum >= total * q and (i + 1 == len(own) or own[i + 1][0] != v):
                out[k] = v
                break
    return out


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_weighted_quantiles(spark, parts):
    """One group holds most values, others a few or one; ties, zero weights, nulls, and more ranges than values of a group."""
    rng = random.Random(parts)
    rows = [(1, rng.choice([rng.uniform(-5, 5), float(rng.randrange(4))]), rng.randrange(0, 30)) for _ in range(900)]
    rows += [(2, float(i % 3), 1) for i in range(7)] + [(3, 2.5, 4), (4, 1.0, 0), (4, 2.0, 0), (5, None, 3), (5, 7.0, 2), (5, 9.0, None), (6, None, 1)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = weighted_quantiles(spark.createDataFrame(rows, "k int, v double, w long"), ["k"], "v", "w", QS).collect()
        none = weighted_quantiles(spark.createDataFrame([], "k int, v double, w long"), ["k"], "v", "w", QS).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert none == 0 and len(got) == len({r.k for r in got}) == 5
    for name, q in QS.items():
        assert {r.k: r[name] for r in got} == plain(rows, q), name


def test_values_of_one_group_are_spread(spark, monkeypatch):
    """All distinct values in one group: the ranges that are added up hold even shares of them."""
    from tapeloom.functions import stats

    seen = []
    monkeypatch.setattr(stats, "stored", lambda df: seen.append(df.persist()) or seen[-1])
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        rows = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 200_003).alias("v"), F.lit(1).alias("w"))
        mid = weighted_quantiles(rows, ["k"], "v", "w", {"mid": 0.5}).first().mid
        sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        for df in seen:
            df.unpersist()
    assert mid == sorted(i * 7919 % 200_003 for i in range(200_000))[99_999]
    assert len(sizes) == 16 and sum(sizes) == 200_000 and max(sizes) <= 2 * median(sizes)


def test_median_trade_size_of_days(spark):
    """Groups of two keys; a group without displayed prints has no median."""
    day = 40_000_000_000_000
    rows = [(0, 1, i, day + i, 0, 100, s) for i, s in enumerate([5, 5, 100, 30])] + [(1, 1, i, day, 1, 100, s) for i, s in enumerate([7, 9])] + [(1, 2, 9, day, 2, 100, 50)]
    prints = spark.createDataFrame(rows, "day int, locate int, seq long, ts_ns long, kind int, price long, shares long")
    got = {(r.day, r.locate): r.vw_median_trade_sz for r in activity_summary(prints, ("day", "locate")).collect()}
    assert got == {(0, 1): 100, (1, 1): 9, (1, 2): None}
