"""Activity and auctions from operation counts and the trade tape; closing prices reconciled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.functions.stats import weighted_quantiles

# Cut-offs of the auctions and the closing window, symbols without a closing cross here.
FIRST30_END = OPEN_CROSS_CUT = 36_000_000_000_000
CLOSE_CROSS_CUT = 56_700_000_000_000
CLOSING_LO, CLOSING_HI = 57_590_000_000_000, 57_900_000_000_000
ARCA = ("SPY", "IWM", "VXX", "UVXY")
RENAMES = {"FB": "META"}


def activity_ratios(ops: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """ops (locate, adds, executes, cancels, deletes, ...) with cancel_ratio and adds_to_exec; null without executions."""
    rows = ops.select("locate", F.try_divide(F.col("cancels") + F.col("deletes"), "executes").alias("cancel_ratio"), F.try_divide("adds", "executes").alias("adds_to_exec"))
    return rows if symbols is None else m.with_symbols(rows, symbols)


def market_medians(ops: DataFrame) -> DataFrame:
    """One row: medians of both ratios over locates with executions, and how many have none."""
    r = activity_ratios(ops)
    return r.agg(F.median("cancel_ratio").alias("med_cancel_ratio"), F.median("adds_to_exec").alias("med_adds_to_exec"), F.count_if(F.col("cancel_ratio").isNull()).alias("n_zero_exec"))


def activity_summary(prints: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """One row for each symbol: volumes, crosses, shares of the close and of the first half hour, volume-weighted median trade size."""
    keys = list(keys)
    k, s = F.col("kind"), F.col("shares")
    shown, hidden, cross, day = k.isin(0, 1), k == 2, (k == 3) & (s > 0), m.regular_hours()
    first = (F.col("ts_ns") >= m.OPEN_NS) & (F.col("ts_ns") < FIRST30_END)
    total = lambda when: F.sum(F.when(when, s).otherwise(0))
    rows = prints.groupBy(*keys).agg(
        total(shown & day).alias("rth_displayed_vol"), total(shown).alias("day_displayed_vol"), total(cross & (F.col("ts_ns") < OPEN_CROSS_CUT)).alias("open_cross_sh"),
        total(hidden & day).alias("rth_hidden_vol"), total(cross & (F.col("ts_ns") >= CLOSE_CROSS_CUT)).alias("close_cross_sh"), total(cross).alias("_cross"), total(shown | hidden | cross).alias("_all"),
        total(shown & first).alias("_f30"), total((shown | hidden) & first).alias("_f30_all"), F.count_if((k == 3) & (s == 0)).alias("admin_crosses"),
    )
    q = weighted_quantiles(prints.where(shown & day), keys, "shares", "shares", {"vw_median_trade_sz": 0.5})
    return rows.join(q, keys, "left").select(
        *keys, "vw_median_trade_sz", "rth_displayed_vol", "day_displayed_vol", "open_cross_sh", "rth_hidden_vol", "close_cross_sh", (F.col("_cross") - F.col("open_cross_sh") - F.col("close_cross_sh")).alias("other_cross_sh"),
        F.try_divide(100.0 * F.col("close_cross_sh"), "_all").alias("close_cross_pct"), F.try_divide("_f30", "rth_displayed_vol").alias("first30_share"), F.try_divide("_f30_all", F.col("rth_displayed_vol") + F.col("rth_hidden_vol")).alias("f30_share_incl_hidden"), "admin_crosses",
    )


def minute_fractions(prints: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """390 rows for each symbol: volume of the minute and its share of the session's; null for symbols without volume."""
    keys = list(keys)
    vol = prints.where(F.col("kind").isin(0, 1) & m.regular_hours()).groupBy(*keys, m.bucket("ts_ns", m.MINUTE_NS).alias("minute")).agg(F.sum("shares").alias("volume"))
    grid = prints.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(m.MINUTES - 1))).alias("minute"))
    rows = grid.join(vol, [*keys, "minute"], "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    return rows.select(*keys, "minute", "volume", F.try_divide("volume", F.sum("volume").over(Window.partitionBy(*keys))).alias("fraction"))


def minute_quartiles(rows: DataFrame, value: str) -> DataFrame:
    """Quartiles over symbols for each minute, interpolated: minute, q25, q50, q75. What the intraday figures plot."""
    q = rows.where(F.col(value).isNotNull()).groupBy("minute").agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select("minute", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))])


def group_means(rows: DataFrame, value: str, symbol: str = "symbol") -> DataFrame:
    """Mean of `value` in each instrument group."""
    return rows.groupBy(m.group_of(symbol).alias("grp")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def top_symbols(tape: DataFrame, n: int = 20) -> DataFrame:
    """The n symbols with most displayed executions; ties by name. (symbol, trades)."""
    return tape.where(F.col("kind").isin(0, 1)).groupBy("symbol").agg(F.count("*").alias("trades")).orderBy(F.desc("trades"), "symbol").limit(n)


def extract_subsets(table: DataFrame, top: DataFrame, path: str) -> None:
    """Writes the rows of the top symbols as Parquet (zstd) by symbol."""
    rows = table.join(F.broadcast(top.select("symbol")), "symbol", "left_semi")  # at most n rows
    rows.repartition("symbol").write.partitionBy("symbol").option("compression", "zstd").parquet(path)


def closing_cross(prints: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """The last real cross of the closing window (both ends included) of each symbol; of equal times the first: price_usd, shares."""
    rows = prints.where((F.col("kind") == 3) & (F.col("shares") > 0) & F.col("ts_ns").between(CLOSING_LO, CLOSING_HI))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("price", "shares"), F.struct("ts_ns", -F.col("seq"))).alias("x"))
    return last.select(*keys, (F.col("x.price") / 1e4).alias("price_usd"), F.col("x.shares").alias("shares"))


def split_factors(splits: DataFrame) -> DataFrame:
    """source, factor: product of numerators over product of denominators of later splits."""
    return splits.groupBy("source").agg((F.product("split_num") / F.product("split_den")).alias("factor"))


def reconcile_close(crosses: DataFrame, official: DataFrame, splits: DataFrame) -> DataFrame:
    """Closing crosses (symbol, price_usd, shares) against official closes (source, close), de-split, retried under a new ticker."""
    official = official.where("close is not null").join(split_factors(splits), "source", "left").select("source", (F.col("close") * F.coalesce("factor", F.lit(1.0))).alias("close"), F.coalesce("factor", F.lit(1.0)).alias("factor"))
    renamed = F.lit(None).cast("string")
    for old, new in RENAMES.items():
        renamed = F.when(F.col("symbol") == old, new).otherwise(renamed)
    own = official.select(F.col("source").alias("s1"), F.col("close").alias("c1"), F.col("factor").alias("f1"))
    new = official.select(F.col("source").alias("s2"), F.col("close").alias("c2"), F.col("factor").alias("f2"))
    rows = crosses.withColumn("renamed", renamed).join(own, F.col("symbol") == F.col("s1"), "left").join(new, F.col("renamed") == F.col("s2"), "left")
    close, eng = F.coalesce("c1", "c2"), F.col("price_usd")
    source, factor = F.coalesce("s1", "s2", F.lit("unavailable")), F.coalesce("f1", "f2", F.lit(1.0))
    verdict = F.when(F.col("symbol").isin(*ARCA), "n/a").when(eng.isNull() | close.isNull(), "unavailable").when(F.abs(eng - close) <= 0.005, "MATCH").otherwise("MISMATCH")
    note = F.concat_ws(", ", F.when(~source.isin("unavailable") & (source != F.col("symbol")), F.concat(F.lit("via "), source)), F.when(F.abs(factor - 1) > 1e-9, F.concat(F.lit("de-split x"), F.format_string("%s", factor))))
    return rows.select("symbol", eng.alias("engine_cross_usd"), F.col("shares").alias("cross_shares"), close.alias("close_usd"), F.round((eng - close) * 100, 4).alias("diff_cents"), verdict.alias("verdict"), note.alias("note"))


def reconcile_counts(rows: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return rows.agg(F.count_if(v == "MATCH").alias("matched"), F.count_if(v.isin("MATCH", "MISMATCH")).alias("available"), F.count_if(v == "unavailable").alias("unavailable"), F.count_if(v == "n/a").alias("not_listed"))
