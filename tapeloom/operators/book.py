"""Order books from order-level operations: effects of each operation, levels, top of book, trades, violations, audit.

Operations: seq, locate, ts_ns, ty (A E C X D U), ref, new_ref, shares, price, side, printable, and optionally day: seq, locate
and ref are numbers of one day (or file) each. Without it, all operations are of day 0. Control rows: [day,] seq, locate, ty (H, Q), state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import sweep
from tapeloom.functions.graph import components
from tapeloom.functions.storage import stored
from tapeloom.functions.windows import carried, stretch_of

#: More than any order holds: what a delete or a replace asks for.
ALL = 1 << 40
#: Messages of the feed in one stretch; a book is replayed stretch by stretch, side by side.
STRETCH = 1 << 22
U32, U16 = 0xFFFFFFFF, 0xFFFF
#: The seq of what a stretch starts with: before any message.
LEAST = -(1 << 63)

EFFECTS = "day int, seq long, locate int, ts_ns long, ty string, ref decimal(20,0), new_ref decimal(20,0), printable string, live boolean, duplicate boolean, side string, rest_price long, msg_shares long, msg_price long, removed long, gone boolean, over boolean, to_zero boolean, home int"


#: A book; an order is known by DAY and its ref.
DAY, BOOK = "day", ["day", "locate"]


def dated(rows: DataFrame) -> DataFrame:
    """`rows` with a day: 0 where they have none."""
    return rows.withColumn(DAY, F.col(DAY).cast("int") if DAY in rows.columns else F.lit(0))


def _home() -> list[Column]:
    """The book that an operation changes."""
    return [F.col(DAY), F.col("home").alias("locate")]


def _typed(ops: DataFrame) -> DataFrame:
    return dated(ops).select(DAY, "seq", F.col("locate").cast("int"), "ts_ns", "ty", F.col("ref").cast("decimal(20,0)"), F.col("new_ref").cast("decimal(20,0)"), F.col("shares").cast("long"), F.col("price").cast("long"), "side", "printable")


def _half() -> Column:
    return F.lit("9223372036854775808").cast("decimal(20,0)")


def _short(rows: DataFrame) -> DataFrame:
    """Refs, which have 64 bits without a sign, as longs less 2^63: joins and sums on decimals of 20 digits take several times as long."""
    return rows.withColumns({c: (F.col(c) - _half()).cast("long") for c in ("ref", "new_ref")})


def _full(rows: DataFrame) -> DataFrame:
    """The refs of `_short` as they were."""
    return rows.withColumns({c: (F.col(c).cast("decimal(20,0)") + _half()).cast("decimal(20,0)") for c in ("ref", "new_ref")})


def _additions(ops: DataFrame) -> DataFrame:
    a = F.col("ty") == "A"
    return ops.where("ty in ('A', 'U')").select(DAY, F.when(a, F.col("ref")).otherwise(F.col("new_ref")).alias("id"), F.when(~a, F.col("ref")).alias("parent"), a.alias("first"), F.col("seq").alias("born"), F.col("shares").alias("size"), F.col("price").alias("rest_price"), F.when(a, F.struct("side", "locate")).alias("own"))


def stray_operations(fx: DataFrame) -> DataFrame:
    """The operations that name another locate than their order's: on a clean feed none."""
    return fx.where("home <> locate")


def cross_locate_refs(ops: DataFrame) -> DataFrame:
    """Refs that operations of several locates name: on a clean feed none."""
    return dated(ops).where("ref is not null").groupBy(DAY, "ref").agg(F.count_distinct("locate").alias("locates")).where("locates > 1")


def fold_effects(ops: DataFrame, by: tuple[str, ...] = ("day", "locate")) -> DataFrame:
    """The effects of operations, one group of `by` at a time and in order: what defines them, for refs that are added twice."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        live: dict = {}  # ref -> [shares, price, side, locate]
        out = []
        for r in pdf.sort_values("seq").itertuples(index=False):
            key = None if r.ref is None or r.ref != r.ref else int(r.ref)
            new = None if r.new_ref is None or r.new_ref != r.new_ref else int(r.new_ref)
            order = None if key is None or r.ty == "A" else live.get(key)
            removed, over, to_zero, gone, duplicate = 0, False, False, False, False
            side, rest = (order[2], order[1]) if order else (None, None)
            if r.ty == "A":
                duplicate = key in live
                side = r.side
                if not duplicate:
                    live[key] = [int(r.shares), int(r.price), r.side, r.locate]
            elif order:
                want = ALL if r.ty in "DU" else int(r.shares)
                removed, over = min(want, order[0]), r.ty in "ECX" and want > order[0]
                to_zero, gone = r.ty == "X" and want >= order[0], removed == order[0]
                order[0] -= removed
                if gone:
                    del live[key]
                if r.ty == "U":
                    duplicate = new in live
                    if not duplicate:
                        live[new] = [int(r.shares), int(r.price), side, order[3]]
            out.append((r.day, r.seq, r.locate, r.ts_ns, r.ty, r.ref, r.new_ref, r.printable, not duplicate if r.ty == "A" else order is not None, duplicate, side, rest, r.shares, r.price, removed, gone, over, to_zero, order[3] if order else r.locate))
        names = [x.split()[0] for x in EFFECTS.split(", ")]
        rows = pd.DataFrame(out, columns=names)
        for n in ("rest_price", "msg_shares", "msg_price"):
            rows[n] = pd.array([None if v is None or v != v else int(v) for v in rows[n]], dtype="Int64")
        return rows

    return (ops if "chain" in ops.columns else _typed(ops)).groupBy(*by).applyInPandas(fold, EFFECTS)


def _orders(ops: DataFrame, uses: DataFrame) -> DataFrame:
    """day, id, side and locate of the root and whether the order ever came to be: replaces are followed to the first add by pointer jumping.

    A replace takes effect if its target then held shares and had come to be itself. Rounds grow with the
    logarithm of the longest chain of replaces.
    """
    took = uses.where("ty = 'U'").select(DAY, F.col("new_ref").alias("id"), F.col("held").alias("took"))
    state = _additions(ops).join(took, [DAY, "id"], "left").select(DAY, "id", F.when(F.coalesce("took", F.lit(False)), F.col("parent")).alias("up"), (F.col("first") | F.coalesce("took", F.lit(False))).alias("ok"), "own")
    state = stored(state)
    while state.where("up is not null").limit(1).count():
        above = state.select(DAY, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("ok").alias("ok2"), F.col("own").alias("own2"))
        state = stored(state.join(above, [DAY, "up"], "left").select(DAY, "id", F.col("up2").alias("up"), (F.col("ok") & F.when(F.col("up").isNull(), True).otherwise(F.coalesce("ok2", F.lit(False)))).alias("ok"), F.coalesce("own", "own2").alias("own")))
    return state.select(DAY, F.col("id").alias("ref"), "ok", F.col("own").alias("root"))


def _joined_effects(ops: DataFrame) -> DataFrame:
    """The effects where every ref is added once: by joins and running sums, however many operations a symbol has."""
    made = _additions(ops).drop("parent", "first", "own").withColumnRenamed("id", "ref")
    uses = ops.where("ty <> 'A'").join(made, [DAY, "ref"], "left").withColumn("known", F.coalesce(F.col("born") < F.col("seq"), F.lit(False)))
    want = F.when(F.col("ty").isin("D", "U"), ALL).otherwise(F.col("shares"))
    # unknown targets are a group of their own kind; they are dealt out by their number
    w = Window.partitionBy(DAY, "_at", "known").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    uses = uses.withColumn("_at", F.when(F.col("known"), F.col("ref")).otherwise(-F.col("seq"))).withColumn("want", want).withColumn("spent", F.sum("want").over(w))
    uses = uses.withColumn("held", F.col("known") & (F.col("spent").isNull() | (F.col("spent") < F.col("size"))))
    uses = stored(uses.drop("_at"))
    rows = uses.join(_orders(ops, uses), [DAY, "ref"], "left").withColumn("live", F.col("held") & F.coalesce("ok", F.lit(False)))
    rest = F.col("size") - F.coalesce("spent", F.lit(0))
    only = lambda x, other: F.when(F.col("live"), x).otherwise(other)
    used = rows.select(
        DAY, "seq", "locate", "ts_ns", "ty", "ref", "new_ref", "printable", "live", F.lit(False).alias("duplicate"), only(F.col("root.side"), None).alias("side"), only(F.col("rest_price"), None).alias("rest_price"), F.col("shares").alias("msg_shares"), F.col("price").alias("msg_price"),
        only(F.least("want", rest), F.lit(0)).alias("removed"), only(F.col("want") >= rest, False).alias("gone"), only(F.col("ty").isin("E", "C", "X") & (F.col("want") > rest), False).alias("over"), only((F.col("ty") == "X") & (F.col("want") >= rest), False).alias("to_zero"), only(F.col("root.locate"), F.col("locate")).alias("home"),
    )
    none = F.lit(None).cast("long")
    added = ops.where("ty = 'A'").select(DAY, "seq", "locate", "ts_ns", "ty", "ref", "new_ref", "printable", F.lit(True).alias("live"), F.lit(False).alias("duplicate"), "side", none.alias("rest_price"), F.col("shares").alias("msg_shares"), F.col("price").alias("msg_price"), F.lit(0).cast("long").alias("removed"), F.lit(False).alias("gone"), F.lit(False).alias("over"), F.lit(False).alias("to_zero"), F.col("locate").alias("home"))
    return used.unionByName(added)


def _chains(ops: DataFrame, twice: DataFrame) -> DataFrame:
    """day, ref, chain: the refs that replaces tie to those of `twice` (day, ref), each with the smallest of its chain. Rounds grow with the logarithm of the longest chain."""
    node = lambda c: F.struct(F.col(DAY), F.col(c).alias("ref"))
    ties = ops.where("ty = 'U' and ref is not null and new_ref is not null").select(node("ref").alias("a"), node("new_ref").alias("b"))
    found, _ = components(ties.unionByName(twice.select(node("ref").alias("a"), node("ref").alias("b"))))
    found = stored(found)
    own = found.join(twice.select(node("ref").alias("node")), "node").select("component").distinct()
    return stored(found.join(own, "component").select(F.col("node")[DAY].alias(DAY), F.col("node.ref").alias("ref"), F.col("component.ref").alias("chain")))


def effects(ops: DataFrame) -> DataFrame:
    """What each operation does to the books, one row for each.

    Orders are known by their ref alone, as in one store of all symbols. home is the locate of the order's book: its add's, whatever locate the operation names
    (`stray_operations`); an operation without a live target has its own.
    live: the operation took hold (its target was there; an add was not a duplicate). side and rest_price are those of
    the resting order, removed the shares that left it, gone whether it left. Refs that are added twice in a day (after their
    removal, or as a duplicate) go through the ordered fold, with the refs that replaces tie to them, one such chain at a time;
    all others go through joins.
    """
    ops = stored(_short(_typed(ops)))
    twice = stored(_additions(ops).groupBy(DAY, F.col("id").alias("ref")).agg(F.count("*").alias("n")).where("n > 1 and ref is not null").select(DAY, "ref"))
    if not twice.limit(1).count():
        return stored(_full(_joined_effects(ops)))
    chains = _chains(ops, twice)
    odd = ops.join(chains, [DAY, "ref"]).select(*ops.columns, "chain")
    return stored(_full(_joined_effects(ops.join(chains, [DAY, "ref"], "left_anti"))).unionByName(fold_effects(_full(odd), (DAY, "chain"))))


def level_changes(fx: DataFrame) -> DataFrame:
    """day, locate, side, price, seq, ts_ns, shares, orders: the change of each level by each operation; both legs of a replace count at once."""
    out = fx.where("live and ty <> 'A'").select(*_home(), "side", F.col("rest_price").alias("price"), "seq", "ts_ns", (-F.col("removed")).alias("shares"), F.when(F.col("gone"), -1).otherwise(0).alias("orders"))
    into = fx.where("live and ty in ('A', 'U') and not duplicate").select(*_home(), "side", F.col("msg_price").alias("price"), "seq", "ts_ns", F.col("msg_shares").alias("shares"), F.lit(1).alias("orders"))
    return out.unionByName(into).groupBy(*BOOK, "side", "price", "seq", "ts_ns").agg(F.sum("shares").alias("shares"), F.sum("orders").cast("long").alias("orders"))


def levels(fx: DataFrame) -> DataFrame:
    """The books at the end: locate, side, price, shares, orders of every level that holds an order."""
    return level_changes(fx).groupBy(*BOOK, "side", "price").agg(F.sum("shares").alias("shares"), F.sum("orders").alias("orders")).where("orders > 0")


def depth(fx: DataFrame, n: int = 5) -> DataFrame:
    """The best `n` levels of each side, side by side: locate, rank, bid_*, ask_*."""
    rank = F.row_number().over(Window.partitionBy(*BOOK, "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))))
    rows = levels(fx).withColumn("rank", rank).where(F.col("rank") <= n)
    side = lambda s, p: rows.where(F.col("side") == s).select(*BOOK, "rank", F.col("price").alias(f"{p}_px"), F.col("shares").alias(f"{p}_sz"), F.col("orders").alias(f"{p}_ct"))
    return side("B", "bid").join(side("S", "ask"), [*BOOK, "rank"], "full")


TOPS = "day int, locate int, seq long, ts_ns long, bid_px long, ask_px long, bid_sz long, ask_sz long, bid_ct long, ask_ct long"


def _best(rows: pa.Table) -> pa.Table:
    """TOPS of whole stretches: rows day, locate, part, side (0 bid, 1 ask), price, seq, ts_ns, shares, orders by stretch and seq; what a stretch starts with has seq LEAST."""
    day, locate, part, side, price, seq, ts, shares, orders = (c.to_numpy() for c in rows.columns)
    group = np.cumsum(np.concatenate(([False], (day[1:] != day[:-1]) | (locate[1:] != locate[:-1]) | (part[1:] != part[:-1]))))
    first, best = sweep.best_levels(group, side, price, seq, shares, orders)
    real = seq[first] != LEAST
    columns = {"day": day[first], "locate": locate[first], "seq": seq[first], "ts_ns": ts[first], **best}
    names = [x.split()[0] for x in TOPS.split(", ")]  # columns are taken by place
    return pa.table({k: pa.array(columns[k][real], pa.int32() if k in BOOK else pa.int64()) for k in names})


def tops(fx: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The best level of both sides after every operation that changes a book: locate, seq, ts_ns, bid_px, ask_px, bid_sz, ask_sz, bid_ct, ask_ct; 0 for an empty side.

    The feed is cut into stretches of seq. Running sums give each level's size at the start of a stretch, so the
    stretches of a symbol are done side by side, and the busiest symbol is as many tasks as it has stretches. In a stretch a level's size holds for an interval of
    changes, and the best level at each is the highest of the intervals over it: no book is replayed, and no row is looked at by itself (`sweep`).
    """
    changes = level_changes(fx).withColumn("part", F.floor(F.col("seq") / stretch).cast("int"))
    per = changes.groupBy(*BOOK, "side", "price", "part").agg(F.sum("shares").alias("shares"), F.sum("orders").alias("orders"))
    w = Window.partitionBy(*BOOK, "side", "price").orderBy("part")
    held = per.select(*BOOK, "side", "price", "part", F.lead("part").over(w).alias("next"), F.sum("shares").over(w).alias("shares"), F.sum("orders").over(w).alias("orders")).where("orders > 0")
    busy = changes.groupBy(*BOOK).agg(F.array_sort(F.collect_set("part")).alias("parts"))  # one number a stretch
    start = held.join(busy, BOOK).select(*BOOK, "side", "price", F.lit(None).cast("long").alias("seq"), F.lit(0).cast("long").alias("ts_ns"), "shares", "orders", F.explode(F.filter("parts", lambda p: (p > F.col("part")) & (F.col("next").isNull() | (p <= F.col("next"))))).alias("part"))
    cols = lambda d: d.select(*BOOK, "part", F.when(F.col("side") == "B", 0).otherwise(1).alias("side"), "price", F.coalesce("seq", F.lit(LEAST)).alias("seq"), "ts_ns", "shares", "orders")
    rows = cols(changes).unionByName(cols(start)).repartition(*BOOK, "part").sortWithinPartitions(*BOOK, "part", "seq")
    return rows.mapInArrow(sweep.by_groups(3, _best), TOPS)


def checked_tops(fx: DataFrame, top: DataFrame) -> DataFrame:
    """The tops at which an export looks: after an add, a cancel, a delete and a replace at the message's locate, after an execution at its order's. Only where operations name other locates than their orders' do these differ from `tops`.

    A change that is not looked at is seen with the next operation that names its book.
    """
    if not stray_operations(fx).limit(1).count():
        return top
    at = fx.select(DAY, F.expr("if(ty in ('E', 'C'), home, locate) as locate"), "seq", "ts_ns", F.lit(True).alias("op"))
    names = ("bid_px", "ask_px", "bid_sz", "ask_sz", "bid_ct", "ask_ct")
    state = F.struct(*names)
    rows = at.withColumn("top", F.lit(None).cast(top.select(state).schema[0].dataType)).unionByName(top.select(*BOOK, "seq", "ts_ns", F.lit(False).alias("op"), state.alias("top")))
    rows = carried(rows, BOOK, ["seq", "op"], stretch_of(), last={"now": "top"}).where("op")
    return rows.select(*BOOK, "seq", "ts_ns", *[F.coalesce(F.col("now")[c], F.lit(0)).alias(c) for c in names])


def l1_stream(top: DataFrame) -> DataFrame:
    """The change-only top of book: rows of `tops` (or `checked_tops`) whose prices or sizes differ from the row before. Sizes and counts saturate first; counts alone are no change."""
    rows = top.select(*BOOK, "seq", "ts_ns", "bid_px", "ask_px", *[F.least(F.col(c), F.lit(U32)).alias(c) for c in ("bid_sz", "ask_sz")], *[F.least(F.col(c), F.lit(U16)).alias(c) for c in ("bid_ct", "ask_ct")])
    now = F.struct("bid_px", "ask_px", "bid_sz", "ask_sz")
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz")])
    rows = carried(rows.withColumn("now", now), BOOK, ["seq"], stretch_of(), lag={"before": "now"})
    return rows.where(F.col("now") != F.coalesce("before", zero)).drop("now", "before")


def level_intervals(fx: DataFrame) -> DataFrame:
    """The life of every level: day, locate, side, price, from_ns, until_ns (null: to the end), shares, orders, a row for each of its changes that leaves orders in it."""
    w = Window.partitionBy(*BOOK, "side", "price").orderBy("seq")
    rows = level_changes(fx).select(*BOOK, "side", "price", F.col("ts_ns").alias("from_ns"), F.lead("ts_ns").over(w).alias("until_ns"), F.sum("shares").over(w).alias("shares"), F.sum("orders").over(w).alias("orders"))
    return rows.where("orders > 0")


def depth_at(fx: DataFrame, first_ns: int, last_ns: int, step_ns: int, n: int = 5) -> DataFrame:
    """The best `n` levels of each side just before each of the moments first_ns, first_ns + step_ns, ... last_ns: day, locate, at_ns, rank, bid_*, ask_*.

    An interval of a level is known by the numbers of the moments it holds, so a level is met only at those, and no book is replayed. Messages of the moment itself
    come after it. A symbol's levels at one moment are ranked together; tasks keep the best `n` before they shuffle.
    """
    number = lambda t: F.floor((t - F.lit(first_ns)) / F.lit(step_ns)).cast("long")
    low, high = F.greatest(F.lit(0), number(F.col("from_ns")) + 1), F.least(F.lit((last_ns - first_ns) // step_ns), number(F.coalesce("until_ns", F.lit(last_ns))))
    rows = level_intervals(fx).withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    rows = rows.select(*BOOK, "side", "price", "shares", "orders", F.explode(F.sequence("_low", "_high")).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*BOOK, "_k", "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= n).withColumn("at_ns", F.lit(first_ns) + F.col("_k") * step_ns)
    cell = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return rows.groupBy(*BOOK, "at_ns", "rank").agg(*[cell(s, c).alias(f"{p}_{x}") for s, p in (("B", "bid"), ("S", "ask")) for c, x in (("price", "px"), ("shares", "sz"), ("orders", "ct"))])


def trade_tape(fx: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """seq, ts_ns, locate, kind, price, shares, side: executions (kind 0 at the display price, with the message's shares; 1 if printable, at the execution price), and P and Q messages.

    messages: seq, ts_ns, locate, ty (P, Q), price, shares, side.
    """
    rows = fx.where("live and (ty = 'E' or (ty = 'C' and printable = 'Y'))").select(DAY, "seq", "ts_ns", F.col("home").alias("locate"), F.when(F.col("ty") == "E", 0).otherwise(1).alias("kind"), F.when(F.col("ty") == "E", F.col("rest_price")).otherwise(F.col("msg_price")).alias("price"), F.col("msg_shares").alias("shares"), "side")
    if messages is None:
        return rows
    q = F.col("ty") == "Q"
    more = dated(messages).where("ty in ('P', 'Q')").select(DAY, "seq", "ts_ns", "locate", F.when(q, 3).otherwise(2).alias("kind"), "price", F.least(F.col("shares").cast("long"), F.lit(U32)).alias("shares"), F.when(q, "").otherwise(F.col("side")).alias("side"))
    return rows.unionByName(more)


def crossings(fx: DataFrame, top: DataFrame, control: DataFrame) -> DataFrame:
    """The operations after which a book in trading state T is crossed or locked: locate, seq, ts_ns, bid_px, ask_px, pending.

    pending: no cross has been since trading began, so the auction is still due. The state is H at first.
    """
    none = lambda kind: F.lit(None).cast(kind)
    checked = fx.where("(ty = 'D') or (live and not duplicate)").select(DAY, F.expr("if(ty = 'D', locate, home) as locate"), "seq", "ts_ns", none("struct<bid_px:bigint,ask_px:bigint>").alias("top"), none("string").alias("state"), none("boolean").alias("pending"), F.lit(True).alias("op"))
    rows = checked.unionByName(top.select(*BOOK, "seq", none("long").alias("ts_ns"), F.struct("bid_px", "ask_px").alias("top"), none("string").alias("state"), none("boolean").alias("pending"), F.lit(False).alias("op")))
    control = dated(control)
    h = control.where("ty = 'H'").select(*BOOK, "seq", "state", F.coalesce(F.lag("state").over(Window.partitionBy(*BOOK).orderBy("seq")), F.lit("H")).alias("was"))
    h = h.select(*BOOK, "seq", "state", F.when((F.col("state") == "T") & (F.col("was") != "T"), True).alias("pending"))
    q = control.where("ty = 'Q'").select(*BOOK, "seq", F.lit(None).cast("string").alias("state"), F.lit(False).alias("pending"))
    ctl = h.unionByName(q).select(*BOOK, "seq", F.lit(None).cast("long").alias("ts_ns"), F.lit(None).cast("struct<bid_px:bigint,ask_px:bigint>").alias("top"), "state", "pending", F.lit(False).alias("op"))
    rows = carried(rows.unionByName(ctl), BOOK, ["seq", "op"], stretch_of(), last={"top_now": "top", "state_now": "state", "pending_now": "pending"})
    rows = rows.select(*BOOK, "seq", "ts_ns", "op", F.col("top_now").alias("top"), F.col("state_now").alias("state"), F.coalesce("pending_now", F.lit(False)).alias("pending"))
    return rows.where("op and state = 'T' and top.bid_px > 0 and top.ask_px > 0 and top.bid_px >= top.ask_px").select(*BOOK, "seq", "ts_ns", F.col("top.bid_px").alias("bid_px"), F.col("top.ask_px").alias("ask_px"), "pending")


def crossed_events(crossed: DataFrame, cap: int = 10_000) -> DataFrame:
    """The first `cap` crossings in trading, in the feed's order: the report's limit."""
    return crossed.where("not pending").orderBy(DAY, "seq").limit(cap).drop("pending")


def crossed_report(events: DataFrame) -> DataFrame:
    """Crossings by symbol: n, first and last time, and the time between."""
    return events.groupBy(*BOOK).agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"))


def violations(fx: DataFrame, crossed: DataFrame) -> DataFrame:
    """One row for each day: the eight counters and their total, which leaves out cancel_to_zero and crossed_auction_pending.

    A level cannot underflow, as what leaves it is bounded by its orders; ladder_underflow counts levels that end below zero all the same.
    """
    miss = ~F.col("live")
    one = fx.groupBy(DAY).agg(F.count_if(miss & F.col("ty").isin("E", "C", "X", "D")).alias("unknown_ref"), F.count_if(miss & (F.col("ty") == "U")).alias("replace_unknown"), F.count_if("duplicate").alias("duplicate_ref"), F.count_if("over").alias("over_reduction"), F.count_if("to_zero").alias("cancel_to_zero"))
    two = crossed.groupBy(DAY).agg(F.count_if(~F.col("pending")).alias("crossed_while_trading"), F.count_if("pending").alias("crossed_auction_pending"))
    ends = level_changes(fx).groupBy(*BOOK, "side", "price").agg(F.sum("shares").alias("s")).groupBy(DAY).agg(F.count_if(F.col("s") < 0).alias("ladder_underflow"))
    total = sum((F.col(x) for x in ("unknown_ref", "replace_unknown", "duplicate_ref", "over_reduction", "crossed_while_trading", "ladder_underflow")), F.lit(0))
    return one.join(two, DAY, "left").join(ends, DAY, "left").na.fill(0).withColumn("total", total.cast("long"))


def operation_counts(fx: DataFrame) -> DataFrame:
    """Adds, executes, cancels, deletes and replaces of each locate: the order's own, for deletes the message's. Deletes count also for unknown refs."""
    n = lambda when, name: F.count_if(when).alias(name)
    t, done = F.col("ty"), F.col("live") & ~F.col("duplicate")
    return fx.groupBy(DAY, F.expr("if(ty = 'D', locate, home) as locate")).agg(n(done & (t == "A"), "adds"), n(F.col("live") & t.isin("E", "C"), "executes"), n(F.col("live") & (t == "X"), "cancels"), n(t == "D", "deletes"), n(done & (t == "U"), "replaces")).where("adds + executes + cancels + deletes + replaces > 0")


def peak_live_orders(fx: DataFrame, stretch: int = 1 << 20) -> DataFrame:
    """day, peak_live_orders: the most orders live at once, over all symbols, counted after an add or a replace.

    Stretches of the feed are summed up first and then each runs its own sum from where the last ended.
    """
    change = F.when((F.col("ty") == "A") & F.col("live"), 1).when(F.col("gone") & ((F.col("ty") != "U") | F.col("duplicate")), -1).otherwise(0)
    rows = fx.select(DAY, "seq", F.floor(F.col("seq") / stretch).alias("part"), change.alias("d"))
    per = rows.groupBy(DAY, "part").agg(F.sum("d").alias("s"))
    base = per.select(DAY, "part", F.coalesce(F.sum("s").over(Window.partitionBy(DAY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each stretch
    run = F.sum("d").over(Window.partitionBy(DAY, "part").orderBy("seq")) + F.col("base")
    return rows.join(base, [DAY, "part"]).select(DAY, run.alias("n"), "d").groupBy(DAY).agg(F.coalesce(F.max(F.when(F.col("d") >= 0, F.col("n"))), F.lit(0)).alias("peak_live_orders"))


def stats(fx: DataFrame) -> DataFrame:
    """One row for each day: adds, executes, cancels, deletes, replaces, executed_shares, peak_live_orders."""
    names = ("adds", "executes", "cancels", "deletes", "replaces")
    counts = operation_counts(fx).groupBy(DAY).agg(*[F.sum(n).alias(n) for n in names])
    shares = fx.groupBy(DAY).agg(F.coalesce(F.sum(F.when(F.col("live") & F.col("ty").isin("E", "C"), F.col("removed"))), F.lit(0)).alias("executed_shares"))
    return shares.join(counts, DAY, "left").join(peak_live_orders(fx), DAY, "left").na.fill(0).select(DAY, *names, "executed_shares", "peak_live_orders")


def live_orders(fx: DataFrame) -> DataFrame:
    """The orders left at the end: day, locate, ref, side, price, shares. A ref that is added again after its removal counts from then on."""
    added = fx.where("live and ty in ('A', 'U') and not duplicate").select(*_home(), F.when(F.col("ty") == "A", F.col("ref")).otherwise(F.col("new_ref")).alias("ref"), "seq", F.struct("side", F.col("msg_price").alias("price")).alias("o"), F.col("msg_shares").alias("shares"), F.lit(1).alias("n"))
    left = fx.where("live and ty <> 'A'").select(*_home(), "ref", "seq", F.lit(None).cast("struct<side:string,price:bigint>").alias("o"), (-F.col("removed")).alias("shares"), F.when(F.col("gone"), -1).otherwise(0).alias("n"))
    rows = added.unionByName(left).groupBy(*BOOK, "ref").agg(F.max_by("o", F.when(F.col("o").isNotNull(), F.col("seq"))).alias("o"), F.sum("shares").alias("shares"), F.sum("n").alias("n"))
    return rows.where("n > 0").select(*BOOK, "ref", "o.side", "o.price", "shares")


def audit(fx: DataFrame) -> DataFrame:
    """For each day and locate with a book: levels, and how many of them differ from those rebuilt from the orders left (mismatches)."""
    again = live_orders(fx).groupBy(*BOOK, "side", "price").agg(F.sum("shares").alias("shares2"), F.count("*").alias("orders2"))
    both = levels(fx).join(again, [*BOOK, "side", "price"], "full")
    same = F.col("shares").eqNullSafe(F.col("shares2")) & F.col("orders").eqNullSafe(F.col("orders2"))
    known = fx.select(*BOOK).union(fx.select(*_home())).distinct()
    return known.join(both.groupBy(*BOOK).agg(F.count("*").alias("levels"), F.count_if(~same).alias("mismatches")), BOOK, "left").na.fill(0)


def audit_counts(audited: DataFrame) -> DataFrame:
    """One row for each day: books audited, and how many of them failed."""
    return audited.groupBy(DAY).agg(F.count("*").alias("audited"), F.count_if(F.col("mismatches") > 0).alias("failed"))
