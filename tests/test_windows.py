"""Windows that carry values between stretches, as-of joins and depth at moments, against plain Python."""

import random
from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_book import ops

from tapeloom.functions.windows import asof, carried, stretch_of
from tapeloom.operators import book


@pytest.mark.parametrize("width", [1, 7, 100, 1 << 22])
def test_carried_is_the_plain_window(spark, width):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), 5 * i + rng.randrange(5) - 300, rng.choice([None, None, i])) for i in range(400)] + [(9, 50_000, None)]
    df = spark.createDataFrame(rows, "k int, seq long, v long")
    got = carried(df, ["k"], ["seq"], stretch_of("seq", width), lag={"before": "v", "place": "seq"}, lead={"after": "v"}, last={"known": "v"})
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select("*", F.lag("v").over(w).alias("before"), F.lag("seq").over(w).alias("place"), F.lead("v").over(w).alias("after"), F.last("v", ignorenulls=True).over(w).alias("known"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert carried(df.limit(0), ["k"], ["seq"], stretch_of(), last={"known": "v"}).count() == 0


def test_one_hot_key_is_many_even_tasks(spark):
    """All rows of one key: dealt by stretches, in one shuffle that both passes read."""
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") % 5).alias("v"))
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = carried(df, ["k"], ["seq"], stretch_of("seq", 500), lag={"before": "v"})
        plan = out._jdf.queryExecution().executedPlan().toString()
        sizes = [r["n"] for r in out.where("before is not null or seq = 0").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert "ReusedExchange" in plan and sum(sizes) == 200_000 and len(sizes) >= 15 and max(sizes) <= 3 * median(sizes)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("width", [None, 3, 10_000])
def test_asof(spark, strict, width):
    rng = random.Random(4)
    left = [(rng.choice([1, 1, 1, 2, 4]), rng.randrange(0, 60) - 5, i) for i in range(200)]
    right = [(rng.choice([1, 1, 2, 3]), rng.randrange(0, 50), 1000 + i, rng.choice([None, i])) for i in range(60)]
    got = asof(spark.createDataFrame(left, "k int, t long, id int"), spark.createDataFrame(right, "k int, t long, seq long, v long"), ["k"], "t", "seq", strict, width).collect()
    best = lambda k, t: max(((r[1], r[2], r[3]) for r in right if r[0] == k and (r[1] < t or (not strict and r[1] == t))), default=None, key=lambda x: x[:2])
    assert sorted((r.k, r.t, r.id, r.as_of and (r.as_of.t, r.as_of.seq, r.as_of.v)) for r in got) == sorted((k, t, i, best(k, t)) for k, t, i in left)
    empty = asof(spark.createDataFrame(left, "k int, t long, id int"), spark.createDataFrame([], "k int, t long, seq long"), ["k"], "t", "seq", strict, width)
    assert empty.where("as_of is null").count() == 200


def test_depth_at_moments(spark):
    rng = random.Random(7)
    rows, live = [], {}
    for i in range(300):
        if live and rng.random() < 0.45:
            ref = rng.choice(sorted(live))
            rows.append(("D", ref) if rng.random() < 0.5 else ("X", ref, 10))
        else:
            rows.append(("A", i, rng.choice("BS"), 10 * rng.randrange(1, 5), 1000 + rng.randrange(8), rng.choice([7, 7, 8])))  # operations name locate 7 all the same
            live[i] = 1
    fx = book.effects(ops(spark, *rows))
    changes = [(r.seq, r.ts_ns, r.locate, r.side, r.price, r.shares, r.orders) for r in book.level_changes(fx).collect()]
    want = set()
    for at in range(990, 1311, 13):
        sums = {}
        for _, ts, *level, shares, orders in changes:
            if ts < at:
                s = sums.setdefault(tuple(level), [0, 0])
                s[0] += shares
                s[1] += orders
        for locate in (7, 8):
            bid, ask = (sorted(((p, *v) for (x, y, p), v in sums.items() if (x, y) == (locate, s) and v[1]), reverse=s == "B")[:3] for s in "BS")
            for k in range(max(len(bid), len(ask))):
                want.add((locate, at, k + 1, *(bid[k] if k < len(bid) else (None,) * 3), *(ask[k] if k < len(ask) else (None,) * 3)))
    got = book.depth_at(fx, 990, 1310, 13, 3).select("locate", "at_ns", "rank", "bid_px", "bid_sz", "bid_ct", "ask_px", "ask_sz", "ask_ct").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
