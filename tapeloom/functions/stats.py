"""Weighted quantiles and regressions as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.storage import stored


def weighted_quantiles(rows: DataFrame, keys: Sequence[str], value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """For each group the smallest value whose cumulative weight reaches q of the total; one column for each name of `quantiles`.

    Weights are first added up by value, so what is sorted are the distinct values of a group, and those are dealt by ranges of group and value: a group that
    holds most of them spans many tasks. The weights of the ranges, a row for each range and group in it, tell which range a quantile lies in; only the values of
    such ranges are added up one by one, each range on its own. Rows without a value or weight are left out, and so are groups without any other; no key
    is null; weights are not negative. Column names must not start with `_`.
    """
    keys = list(keys)
    by = rows.where(F.col(value).isNotNull() & F.col(weight).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    parts = stored(by.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy(*keys)
    per = parts.groupBy(*keys, "_part").agg(F.sum("_w").alias("_own"))
    # a range is an interval of values, so its place among a group's ranges is its number's
    per = per.select(*keys, "_part", (F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_base"), F.sum("_own").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)).alias("_end"), F.sum("_own").over(group).alias("_all"))
    holds = reduce(lambda a, b: a | b, [(F.col("_end") >= F.col("_all") * q) & (F.col("_base").isNull() | (F.col("_base") < F.col("_all") * q)) for q in quantiles.values()])
    cum = F.coalesce("_base", F.lit(0)) + F.sum("_w").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    near = parts.join(per.where(holds), [*keys, "_part"]).withColumn("_cum", cum)
    # of the ranges that are looked at, the one that q lies in has the smallest value at or above it
    return near.groupBy(*keys).agg(*[F.min(F.when(F.col("_cum") >= F.col("_all") * q, F.col(value))).alias(name) for name, q in quantiles.items()])


def _newey_west(u: Column, lag: Column) -> Column:
    """Long-run variance sum of the scores `u` with Bartlett weights up to `lag`."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    n = F.size(u)
    term = lambda k: (1 - k / (lag + 1)) * dot(F.slice(u, k + 1, F.greatest(n - k, F.lit(0))), F.slice(u, 1, F.greatest(n - k, F.lit(0))))
    return dot(u, u) + 2 * F.aggregate(F.sequence(F.lit(1), lag), F.lit(0.0), lambda s, k: s + term(k))


def regressions(rows: DataFrame, keys: Sequence[str], x: str, y: str, order: str, least: int = 3) -> DataFrame:
    """Least squares of y on x for each group: n, slope, intercept, r2, se, nw_t, nw_lag.

    Rows with a null x or y are left out before. nw_t is the Newey-West t-statistic with
    ceil(1.5 n^(1/3)) lags over the retained rows in `order`. With fewer than `least` rows, or without
    spread in x or y, all but n are null and nw_lag is 0. A group holds the buckets of one session (2,340 at most),
    so its scores fit one array.
    """
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.avg(x).alias("_mean"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_xy"),
    )
    fine = (F.col("n") >= least) & (F.col("_sxx") > 0) & (F.col("_syy") > 0)
    lag = F.ceil(1.5 * F.pow(F.col("n").cast("double"), F.lit(1 / 3))).cast("int")
    g = g.select("*", F.when(fine, lag).otherwise(0).alias("nw_lag"), F.transform("_xy", lambda p: (p["x"] - F.col("_mean")) * (p["y"] - F.col("intercept") - F.col("slope") * p["x"])).alias("_u"), fine.alias("_fine"))
    g = g.withColumn("_s", F.when(F.col("_fine"), _newey_west(F.col("_u"), F.col("nw_lag"))))
    only = lambda v: F.when(F.col("_fine"), v)
    return g.select(
        *keys, "n", only(F.col("slope")).alias("slope"), only(F.col("intercept")).alias("intercept"), only(F.col("r2")).alias("r2"),
        only(F.when(F.col("n") > 2, F.sqrt(F.col("_syy") * (1 - F.col("r2")) / (F.col("n") - 2) / F.col("_sxx")))).alias("se"),
        only(F.when(F.col("_s") > 0, F.col("slope") * F.col("_sxx") / F.sqrt("_s"))).alias("nw_t"), "nw_lag",
    )


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p > 0.5, by bisection on its distribution (Simpson's rule)."""
    if df < 1:
        return math.nan
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def mass(t: float, steps: int = 4000) -> float:
        # substitution t = sqrt(df) tan(a) keeps the range finite
        end = math.atan(t / math.sqrt(df))
        f = lambda a: math.cos(a) ** (df - 1)
        h = end / steps
        total = f(0) + f(end) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, steps))
        return 0.5 + scale * math.sqrt(df) * total * h / 3

    lo, hi = 0.0, 1e6
    for _ in range(200):
        m = (lo + hi) / 2
        lo, hi = (m, hi) if mass(m, 400) < p else (lo, m)
    return (lo + hi) / 2


def t_expansion(p: float, df: Column) -> Column:
    """Quantile of Student's t for many degrees of freedom, by four terms of its expansion about the normal quantile."""
    z = NormalDist().inv_cdf(p)
    terms = (
        (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    return sum((F.lit(x) / F.pow(df, F.lit(float(k))) for k, x in enumerate(terms, 1)), F.lit(z))
