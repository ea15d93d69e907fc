"""Liquidity: time in each state, spread and depth weighted by time, by symbol and by minute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.functions.stats import weighted_quantiles
from tapeloom.functions.storage import stored
from tapeloom.functions.windows import carried, stretch_of

STATES = ("two_sided", "one_sided", "empty", "crossed")


def state_times(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """The states that last within regular hours: keys, the state, t0, t1, w (ns), state. A symbol's last state runs to 20:00."""
    l1 = carried(l1.select(*keys, "seq", "ts_ns", "bid_px", "ask_px", "bid_sz", "ask_sz"), keys, ["seq"], stretch_of(), lead={"n_ts": "ts_ns"})
    end = F.coalesce("n_ts", F.lit(m.FEED_END_NS))
    clip = lambda x: F.greatest(F.lit(m.OPEN_NS), F.least(F.lit(m.CLOSE_NS), x))
    rows = l1.select(*keys, "bid_px", "ask_px", "bid_sz", "ask_sz", clip(F.col("ts_ns")).alias("t0"), clip(end).alias("t1"))
    return rows.select("*", (F.col("t1") - F.col("t0")).alias("w"), m.state_class().alias("state")).where("w > 0")


def _usd() -> Column:
    return F.col("bid_sz") * F.col("bid_px") / 1e4 + F.col("ask_sz") * F.col("ask_px") / 1e4


def _measured(times: DataFrame) -> DataFrame:
    return times.where("state = 'two_sided'").select("*", m.spread_bps().alias("bps"), (F.col("bid_sz") + F.col("ask_sz")).cast("double").alias("depth"), _usd().alias("usd"))


def state_shares(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """Per cent of the time in each class of state, and counts of states."""
    t = state_times(l1, keys)
    share = [(100.0 * F.sum(F.when(F.col("state") == s, F.col("w")).otherwise(0)) / F.sum("w")).alias(f"pct_{s}") for s in STATES]
    return t.groupBy(*keys).agg(*share, F.count("*").alias("n_states_rth"), F.count_if(F.col("state") != "two_sided").alias("n_states_excluded"))


def liquidity_summary(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """One row for each symbol: spread (mean, median, 95th percentile), depth, mid and shares of states, all weighted by time.

    States are timed once. What is left of them for each symbol, state and spread are sums, written once, which all figures follow from.
    """
    keys = list(keys)
    two = F.col("state") == "two_sided"
    t = state_times(l1, keys).withColumn("bps", F.when(two, m.spread_bps()))
    weighed = {"tw_depth_shares": (F.col("bid_sz") + F.col("ask_sz")).cast("double"), "tw_depth_usd": _usd(), "tw_mid": (F.col("bid_px") + F.col("ask_px")) / 2e4}
    by = stored(t.groupBy(*keys, "state", "bps").agg(F.sum("w").alias("w"), F.count("*").alias("n"), *[F.sum(x * F.col("w")).alias(c) for c, x in weighed.items()]))
    share = [(100.0 * F.sum(F.when(F.col("state") == s, F.col("w")).otherwise(0)) / F.sum("w")).alias(f"pct_{s}") for s in STATES]
    of = F.sum(F.when(two, F.col("w")))
    mean = lambda x: F.sum(F.when(two, x)) / of
    sums = by.groupBy(*keys).agg(*share, F.sum("n").alias("n_states_rth"), F.sum(F.when(two, 0).otherwise(F.col("n"))).alias("n_states_excluded"), mean(F.col("bps") * F.col("w")).alias("tw_spread_bps"), *[mean(F.col(c)).alias(c) for c in weighed])
    return sums.join(weighted_quantiles(by.where(two), keys, "bps", "w", {"med_spread_bps": 0.5, "p95_spread_bps": 0.95}), keys, "left")


def liquidity_1min(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """390 rows for each symbol: minute, min_of_day, tw_spread_bps, tw_depth_usd, tw_depth_shares; null without time in two-sided states."""
    keys = list(keys)
    two = _measured(state_times(l1, keys))
    first, last = m.bucket("t0", m.MINUTE_NS), m.bucket(F.col("t1") - 1, m.MINUTE_NS)
    cut = two.select("*", F.explode(F.sequence(first, last)).alias("minute"))
    lo = F.lit(m.OPEN_NS) + F.col("minute").cast("long") * m.MINUTE_NS
    cut = cut.withColumn("w", F.least("t1", lo + m.MINUTE_NS) - F.greatest("t0", lo))
    mean = lambda x: (F.sum(F.col(x) * F.col("w")) / F.sum("w"))
    sums = cut.groupBy(*keys, "minute").agg(mean("bps").alias("tw_spread_bps"), mean("usd").alias("tw_depth_usd"), mean("depth").alias("tw_depth_shares"))
    grid = l1.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(m.MINUTES - 1))).alias("minute"))
    return grid.join(sums, [*keys, "minute"], "left").select(*keys, "minute", (F.col("minute") + 570).alias("min_of_day"), "tw_spread_bps", "tw_depth_usd", "tw_depth_shares")
