"""Order-flow imbalance: events, one-minute table, fits, several horizons, price impact against depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.functions.stats import regressions, t_expansion, t_quantile
from tapeloom.functions.windows import carried, stretch_of

HORIZONS = (10, 30, 60, 300)
#: Degrees of freedom for which quantiles of Student's t are tabled.
TABLE = 100


def _imbalance() -> tuple[Column, Column]:
    """The bid's contribution less the ask's from the state before (p_...) to this one, and whether both are valid."""
    bid = F.when(F.col("bid_px") > F.col("p_bid_px"), F.col("bid_sz")).when(F.col("bid_px") < F.col("p_bid_px"), -F.col("p_bid_sz")).otherwise(F.col("bid_sz") - F.col("p_bid_sz"))
    ask = F.when(F.col("ask_px") < F.col("p_ask_px"), F.col("ask_sz")).when(F.col("ask_px") > F.col("p_ask_px"), -F.col("p_ask_sz")).otherwise(F.col("ask_sz") - F.col("p_ask_sz"))
    return bid - ask, m.valid_state() & m.valid_state("p_bid_px", "p_ask_px")


def _with_before(l1: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States with those before them (p_...), by stretches of the feed."""
    cols = ("bid_px", "ask_px", "bid_sz", "ask_sz")
    return carried(l1.select(*keys, "seq", "ts_ns", *cols), keys, ["seq"], stretch_of(), lag={f"p_{x}": x for x in cols})


def ofi_events(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """One row for each pair of adjacent states of a symbol: keys, seq, ts_ns (of the new state), e, pair_ok.

    e is the bid's contribution less the ask's, 0 unless both states are valid. Over several days, give the
    date as a key too.
    """
    rows = _with_before(l1, keys).where("p_bid_px is not null")
    e, ok = _imbalance()
    return rows.select(*keys, "seq", "ts_ns", F.when(ok, e).otherwise(0).cast("long").alias("e"), ok.alias("pair_ok"))


def event_counts(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """For each symbol: events in regular hours, pairs skipped there, total imbalance, and how many states were one-sided or empty, and crossed."""
    ev = ofi_events(l1, keys).where(m.regular_hours())
    a = ev.groupBy(*keys).agg(F.count_if("pair_ok").alias("events"), F.count_if(~F.col("pair_ok")).alias("skipped"), F.sum("e").alias("total_ofi"))
    kind = m.state_class()
    b = l1.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(kind.isin("empty", "one_sided")).alias("n_empty"), F.count_if(kind == "crossed").alias("n_crossed"))
    return b.join(a, list(keys), "left").na.fill(0, ["events", "skipped", "total_ofi"])


def _grid(l1: DataFrame, keys: Sequence[str], first: int, last: int, name: str) -> DataFrame:
    return l1.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(name))


def _stepped(l1: DataFrame, keys: Sequence[str], width_ns: int) -> DataFrame:
    """keys, b (bucket, -1 before the open), ofi, events, close (struct of seq and mid of the last valid state): one window and one aggregation over the states before the close."""
    rows = _with_before(l1, keys).where(F.col("ts_ns") < m.CLOSE_NS)
    e, ok = _imbalance()
    at = F.when(F.col("ts_ns") < m.OPEN_NS, -1).otherwise(m.bucket("ts_ns", width_ns))
    counted = F.coalesce(ok, F.lit(False)) & (F.col("ts_ns") >= m.OPEN_NS)
    return rows.groupBy(*keys, at.alias("b")).agg(F.sum(F.when(counted, e)).cast("long").alias("ofi"), F.count_if(counted).alias("events"), F.max(F.when(m.valid_state(), F.struct("seq", m.mid().alias("mid")))).alias("close"))


def ofi_1min(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """390 rows for each symbol: minute, ofi, events, mid_close, chg_ticks, chg_bps.

    The mid at a minute's end is that of the last valid state before it, carried on from earlier minutes and from before the open.
    """
    keys = list(keys)
    steps = _stepped(l1, keys, m.MINUTE_NS).select(*keys, F.col("b").alias("minute"), "ofi", "events", F.col("close.mid").alias("mid"))
    rows = _grid(l1, keys, -1, m.MINUTES - 1, "minute").join(steps, [*keys, "minute"], "left")
    w = Window.partitionBy(*keys).orderBy("minute")
    rows = rows.withColumn("mid_close", F.last("mid", ignorenulls=True).over(w))
    rows = rows.withColumn("prev", F.lag("mid_close").over(w)).where("minute >= 0")
    chg = F.col("mid_close") - F.col("prev")
    return rows.select(*keys, "minute", F.coalesce("ofi", F.lit(0)).alias("ofi"), F.coalesce("events", F.lit(0)).alias("events"), "mid_close", (chg / m.TICK).alias("chg_ticks"), (chg / F.col("prev") * 1e4).alias("chg_bps"))


def ofi_fit_1min(l1: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """Contemporaneous fit of the minute's change in bps on its imbalance, for each symbol: n, slope, intercept, r2."""
    return regressions(ofi_1min(l1, keys), keys, "ofi", "chg_bps", "minute").select(*keys, "n", "slope", "intercept", "r2")


def horizon_buckets(l1: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """For each symbol, horizon and bucket: ofi and dmid (ticks).

    A bucket's close needs a valid state in that bucket in regular hours; dmid is null where this or the bucket before has
    none. States are aggregated once, to the horizons' greatest common divisor, and rolled up from there.
    """
    keys = list(keys)
    base = horizons[0]
    for h in horizons:
        while h:
            base, h = h, base % h
    both = _stepped(l1, keys, base * m.SECOND_NS).where("b >= 0").select(*keys, "b", "ofi", "close", F.explode(F.array(*map(F.lit, horizons))).alias("horizon_s"))
    rolled = both.groupBy(*keys, "horizon_s", F.floor(F.col("b") * base / F.col("horizon_s")).cast("int").alias("k")).agg(F.sum("ofi").alias("ofi"), F.max("close")["mid"].alias("mid"))
    grid = l1.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, horizons))).alias("horizon_s")).select("*", F.explode(F.sequence(F.lit(0), (F.lit(m.SESSION_S) / F.col("horizon_s")).cast("int") - 1)).alias("k"))
    rows = grid.join(rolled, [*keys, "horizon_s", "k"], "left")
    w = Window.partitionBy(*keys, "horizon_s").orderBy("k")
    return rows.select(*keys, "horizon_s", "k", F.coalesce("ofi", F.lit(0)).alias("ofi"), ((F.col("mid") - F.lag("mid").over(w)) / m.TICK).alias("dmid"))


def ofi_horizons(l1: DataFrame, horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """Fits of dmid on the same bucket's imbalance (contemporaneous) and on the bucket's before (predictive)."""
    keys = list(keys)
    rows = horizon_buckets(l1, horizons, keys)
    ahead = rows.withColumn("dmid", F.lead("dmid").over(Window.partitionBy(*keys, "horizon_s").orderBy("k")))
    both = rows.withColumn("design", F.lit("contemporaneous")).unionByName(ahead.withColumn("design", F.lit("predictive")))
    fits = regressions(both, [*keys, "horizon_s", "design"], "ofi", "dmid", "k", least=10)
    every = rows.select(*keys, "horizon_s").distinct().select("*", F.explode(F.array(F.lit("contemporaneous"), F.lit("predictive"))).alias("design"))
    fits = every.join(fits, [*keys, "horizon_s", "design"], "left").na.fill(0, ["n", "nw_lag"])
    return fits.select(*keys, "horizon_s", "design", "n", "slope", "r2", "nw_t", "nw_lag", (F.lit(m.SESSION_S) / F.col("horizon_s") - 1 - F.col("n")).cast("long").alias("n_dropped"))


def price_impact(l1: DataFrame, horizons: Sequence[int] = (10, 30, 60), keys: Sequence[str] = ("locate",)) -> DataFrame:
    """Contemporaneous fits for the impact study; dropped counts all buckets without a change, the first included."""
    keys = list(keys)
    fits = regressions(horizon_buckets(l1, horizons, keys), [*keys, "horizon_s"], "ofi", "dmid", "k")
    return fits.select("*", (F.lit(m.SESSION_S) / F.col("horizon_s") - F.col("n")).cast("long").alias("dropped"))


def impact_cross_section(impact: DataFrame, depth: DataFrame, horizon_s: int = 10, keys: Sequence[str] = ("locate",), leave_out=None) -> DataFrame:
    """log10(slope) on log10(average depth), slopes over 0: label, n, slope, intercept, r2, se, ci_lo, ci_hi; for all symbols and without those where `leave_out` holds.

    depth: keys and tw_depth_shares (both sides; half of it is the average depth). The rows are one for each symbol.
    """
    keys = list(keys)
    rows = impact.where((F.col("horizon_s") == horizon_s) & (F.col("slope") > 0)).select(*keys, F.log10("slope").alias("y")).join(depth.select(*keys, F.log10(F.col("tw_depth_shares") / 2).alias("x")), keys)
    sets = rows.withColumn("label", F.lit("all"))
    if leave_out is not None:
        sets = sets.unionByName(rows.where(~leave_out).withColumn("label", F.lit("without")))
    fits = regressions(sets, ["label"], "x", "y", keys[-1])
    # Student's t for every number of symbols; beyond TABLE by its expansion about the normal quantile, off by less than 1e-8 there
    table, df = F.array(*[F.lit(t_quantile(0.975, d)) for d in range(1, TABLE + 1)]), F.col("n") - 2
    t = F.when(df.between(1, TABLE), F.element_at(table, F.greatest(F.lit(1), F.least(F.lit(TABLE), df)).cast("int"))).when(df > TABLE, t_expansion(0.975, df.cast("double")))
    return fits.select("label", "n", "slope", "intercept", "r2", "se", (F.col("slope") - t * F.col("se")).alias("ci_lo"), (F.col("slope") + t * F.col("se")).alias("ci_hi"))


def median_fits(fits: DataFrame, symbols: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """Medians of r2 over symbols for each horizon and design, of all symbols ('ALL') and of each instrument group: grp, horizon_s, design, med_r2, symbols."""
    rows = fits.join(symbols, list(keys)).select("horizon_s", "design", "r2", F.upper(m.group_of("symbol")).alias("grp"))
    rows = rows.select("horizon_s", "design", "r2", F.explode(F.array(F.lit("ALL"), "grp")).alias("grp"))
    return rows.groupBy("grp", "horizon_s", "design").agg(F.median("r2").alias("med_r2"), F.count("*").alias("symbols"))
