"""Units of the feed and column expressions over prices, states and times. Prices are integers of 1e-4 dollars, times are nanoseconds since midnight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The trading day.
DAY_NS = 86_400_000_000_000
OPEN_NS = 34_200_000_000_000
CLOSE_NS = 57_600_000_000_000
FEED_END_NS = 72_000_000_000_000
SECOND_NS = 1_000_000_000
MINUTE_NS = 60 * SECOND_NS
MINUTES = 390
SESSION_S = 23_400
TICK = 100

# Kinds of trade records, and instrument groups of the studies.
KIND_NAMES = {0: "exec", 1: "exec_px", 2: "hidden", 3: "cross"}
GROUPS = {"ETF": ["SPY", "QQQ", "IWM", "TQQQ"], "VOL_ETP": ["VXX", "UVXY", "TVIX"], "WIDE_TICK": ["AMZN", "TSLA"]}


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def regular_hours(ts: str | Column = "ts_ns") -> Column:
    """09:30 up to but not including 16:00."""
    return (c(ts) >= OPEN_NS) & (c(ts) < CLOSE_NS)


def valid_state(bid: str | Column = "bid_px", ask: str | Column = "ask_px") -> Column:
    """Both sides are there and do not cross or lock."""
    return (c(bid) > 0) & (c(ask) > 0) & (c(bid) < c(ask))


def state_class(bid: str | Column = "bid_px", ask: str | Column = "ask_px") -> Column:
    both = (c(bid) > 0) & (c(ask) > 0)
    return F.when(both & (c(bid) < c(ask)), "two_sided").when(both, "crossed").when((c(bid) == 0) & (c(ask) == 0), "empty").otherwise("one_sided")


def mid(bid: str | Column = "bid_px", ask: str | Column = "ask_px") -> Column:
    return (c(bid) + c(ask)) / 2


def spread_bps(bid: str | Column = "bid_px", ask: str | Column = "ask_px") -> Column:
    return (c(ask) - c(bid)) / mid(bid, ask) * 1e4


def bucket(ts: str | Column, width_ns: int) -> Column:
    """Number of the half-open bucket since the open, for times from the open on."""
    return F.floor((c(ts) - OPEN_NS) / F.lit(width_ns)).cast("int")


def name_of(code: str | Column, names: dict) -> Column:
    """The name of a code, '' where it has none."""
    out = F.lit("")
    for k, v in names.items():
        out = F.when(c(code) == k, v).otherwise(out)
    return out


def group_of(symbol: str | Column, other: str = "ordinary") -> Column:
    out = F.lit(other)
    for k, v in GROUPS.items():
        out = F.when(c(symbol).isin(v), k).otherwise(out)
    return out


def with_symbols(rows: DataFrame, symbols: DataFrame, keys: Sequence[str] = ("locate",)) -> DataFrame:
    """Adds `symbol` by `keys`, '' where the directory has none. Over several days give the day as a key too, as a locate has another symbol then. A day's directory has at most 65,536 rows (locate has 16 bits), so one day's is broadcast."""
    one = symbols.groupBy(*keys).agg(F.max("symbol").alias("symbol"))
    return rows.join(F.broadcast(one) if list(keys) == ["locate"] else one, list(keys), "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))


def clock(ts: str | Column) -> Column:
    """HH:MM:SS."""
    s = F.floor(c(ts) / SECOND_NS)
    return F.concat_ws(":", *[F.lpad(x.cast("string"), 2, "0") for x in (F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)])
