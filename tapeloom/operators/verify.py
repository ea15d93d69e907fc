"""Integrity checks of exported tables: one row for each check (name, status, bad)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m

CROSSED_FAIL_SHARE = 0.005
#: Rows of a stretch of the stream whose order is checked in one task.
STRETCH = 1 << 20


def _status(bad: Column) -> Column:
    return F.when(bad == 0, "PASS").otherwise("FAIL")


def _as_rows(one: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("name"), status.alias("status"), bad.cast("long").alias("bad")) for name, status, bad in checks])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def backward_steps(rows: DataFrame) -> DataFrame:
    """One row, `backward`: how often ts_ns falls from one row to the next in the order of seq.

    Each stretch of seq is checked by itself, and then the few (stretch, first, last) rows against each other; no
    single task sees the whole stream.
    """
    part = F.floor(F.col("seq") / STRETCH).alias("stretch")
    inside = rows.select("seq", "ts_ns", part).withColumn("prev", F.lag("ts_ns").over(Window.partitionBy("stretch").orderBy("seq")))
    per = inside.groupBy("stretch").agg(F.count_if(F.col("ts_ns") < F.col("prev")).alias("n"), F.min_by("ts_ns", "seq").alias("lo"), F.max_by("ts_ns", "seq").alias("hi"))
    edge = per.withColumn("before", F.lag("hi").over(Window.orderBy("stretch")))  # a row for each stretch
    return edge.agg(F.coalesce(F.sum(F.col("n") + F.when(F.col("lo") < F.col("before"), 1).otherwise(0)), F.lit(0)).alias("backward"))


def _stream_checks(rows: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    unknown = rows.select("locate").distinct().join(symbols.select("locate").distinct(), "locate", "left_anti").agg(F.count("*").alias("unknown"))
    one = rows.agg(F.count_if(F.col("ts_ns") >= m.DAY_NS).alias("late")).crossJoin(backward_steps(rows)).crossJoin(unknown)  # one row each
    return _as_rows(one, [(f"{name}_ts_range", _status(F.col("late")), F.col("late")), (f"{name}_ts_monotonic", _status(F.col("backward")), F.col("backward")), (f"{name}_locates", _status(F.col("unknown")), F.col("unknown"))])


def verify_trades(trades: DataFrame, symbols: DataFrame) -> DataFrame:
    """Checks of a trade tape (seq, ts_ns, locate, kind, price, shares, side)."""
    k = F.col("kind")
    side = F.when(k.isin(0, 1), F.col("side").isin("B", "S")).otherwise(F.col("side").isin("B", "S", ""))
    one = trades.agg(
        F.count_if(~k.isin(0, 1, 2, 3)).alias("kind"), F.count_if(~side).alias("side"), F.count_if((k != 3) & (F.col("price") <= 0)).alias("price"),
        F.count_if((k != 3) & (F.col("shares") <= 0)).alias("shares"), F.count_if((k == 3) & (F.col("shares") == 0)).alias("zero"),
    )
    checks = [(f"trade_{x}", _status(F.col(x)), F.col(x)) for x in ("kind", "side", "price", "shares")]
    return _stream_checks(trades, symbols, "trades").unionByName(_as_rows(one, [*checks, ("trade_zero_share_crosses", F.lit("INFO"), F.col("zero"))]))


def verify_l1(l1: DataFrame, symbols: DataFrame) -> DataFrame:
    """Checks of a top-of-book stream (seq, ts_ns, locate, bid_px, ask_px); crossed rows fail above half a per cent."""
    s = m.state_class()
    one = l1.agg(F.count_if(s == "empty").alias("empty"), F.count_if(s == "crossed").alias("crossed"), F.count("*").alias("n"))
    crossed = F.when(F.col("crossed") > F.col("n") * CROSSED_FAIL_SHARE, "FAIL").otherwise("INFO")
    return _stream_checks(l1, symbols, "l1").unionByName(_as_rows(one, [("l1_empty_book_rows", F.lit("INFO"), F.col("empty")), ("l1_crossed_rows", crossed, F.col("crossed"))]))


def verify_files(trades: DataFrame, l1: DataFrame, meta: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Checks that need the record files: sizes {stream: (file bytes, record bytes)}, counts against meta (key, value), padding."""
    want = meta.agg(*[F.max(F.when(F.col("key") == x, F.col("value"))).alias(f"want_{x}") for x in ("trades", "l1")])
    one = want.crossJoin(trades.agg(F.count("*").alias("trades"), F.count_if(F.col("pad") != 0).alias("trades_pad"))).crossJoin(l1.agg(F.count("*").alias("l1"), F.count_if(F.col("pad") != 0).alias("l1_pad")))  # one row each
    off = lambda x: F.when(F.coalesce(F.col(f"want_{x}"), F.lit("")) == F.col(x).cast("string"), 0).otherwise(1)
    checks = [(f"{x}_size", _status(F.lit(size % width)), F.lit(size % width)) for x, (size, width) in sizes.items()]
    checks += [(f"{x}_count_meta", _status(off(x)), off(x)) for x in ("trades", "l1")]
    return _as_rows(one, [*checks, ("trade_pad", _status(F.col("trades_pad")), F.col("trades_pad")), ("l1_pad", _status(F.col("l1_pad")), F.col("l1_pad"))])
