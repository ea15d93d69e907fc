"""Books from short sequences of operations, and from random ones."""

import random

import pytest

from pyspark.sql import functions as F

from tapeloom.functions.graph import components
from tapeloom.operators import book

SCHEMA = "seq long, locate int, ts_ns long, ty string, ref decimal(20,0), new_ref decimal(20,0), shares long, price long, side string, printable string"


def ops(spark, *rows):
    """(ty, ref, ...) tuples: A ref side shares price; E, X ref shares; C ref shares price printable; D ref; U ref new shares price."""
    out = []
    for i, r in enumerate(rows):
        ty, ref, *x = r
        loc = 7
        d = dict(new_ref=None, shares=None, price=None, side=None, printable=None)
        if ty == "A":
            d |= dict(side=x[0], shares=x[1], price=x[2])
            loc = x[3] if len(x) > 3 else loc
        elif ty in "EX":
            d |= dict(shares=x[0])
        elif ty == "C":
            d |= dict(shares=x[0], price=x[1], printable=x[2])
        elif ty == "U":
            d |= dict(new_ref=x[0], shares=x[1], price=x[2])
        out.append((2 * i, loc, 1000 + i, ty, ref, d["new_ref"], d["shares"], d["price"], d["side"], d["printable"]))
    from decimal import Decimal

    dec = lambda v: None if v is None else Decimal(v)
    return spark.createDataFrame([(a, b, c, d, dec(e), dec(f), g, h, i, j) for a, b, c, d, e, f, g, h, i, j in out], SCHEMA)


def lv(fx):
    return sorted((r.side, r.price, r.shares, r.orders) for r in book.levels(fx).collect())


def none(spark):
    return spark.createDataFrame([], "seq long, locate int, ty string, state string")


def broken(spark, fx, control=None):
    return book.violations(fx, book.crossings(fx, book.tops(fx), control if control is not None else none(spark))).first()


B, S = 999000, 1001000


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("A", 1, "B", 100, B), ("A", 2, "B", 200, B), ("A", 3, "S", 300, S)], [("B", B, 300, 2), ("S", S, 300, 1)]),
        ([("A", 1, "B", 100, B), ("E", 1, 40)], [("B", B, 60, 1)]),
        ([("A", 1, "B", 100, B), ("E", 1, 100)], []),
        ([("A", 1, "S", 100, S), ("C", 1, 100, 1000500, "Y")], []),
        ([("A", 1, "B", 100, B), ("X", 1, 30)], [("B", B, 70, 1)]),
        ([("A", 1, "B", 100, B), ("A", 2, "B", 50, B), ("D", 1)], [("B", B, 50, 1)]),
        ([("A", 1, "B", 100, B), ("U", 1, 2, 150, 998000)], [("B", 998000, 150, 1)]),
        ([("A", 1, "S", 100, S), ("U", 1, 2, 90, S), ("U", 2, 3, 80, 1000000)], [("S", 1000000, 80, 1)]),
        ([("A", 1, "B", 100, B), ("A", 1, "B", 100, B)], [("B", B, 100, 1)]),
        ([("A", 1, "B", 100, B), ("D", 1), ("A", 1, "S", 70, S)], [("S", S, 70, 1)]),
        ([("A", (1 << 64) - 1, "B", 100, B), ("X", (1 << 64) - 1, 30), ("A", 0, "B", 5, B)], [("B", B, 75, 2)]),
    ],
)
def test_levels(spark, rows, want):
    fx = book.effects(ops(spark, *rows))
    assert lv(fx) == want
    assert book.audit(fx).where("mismatches > 0").count() == 0


def test_counters(spark):
    v = broken(spark, book.effects(ops(spark, ("E", 99, 5), ("X", 99, 5), ("D", 99), ("U", 99, 100, 5, B))))
    assert (v.unknown_ref, v.replace_unknown, v.total) == (3, 1, 4)
    fx = book.effects(ops(spark, ("A", 1, "B", 100, B), ("E", 1, 150), ("A", 2, "B", 10, B), ("A", 2, "B", 10, B), ("A", 3, "B", 10, B), ("X", 3, 20)))
    v = broken(spark, fx)
    assert (v.over_reduction, v.duplicate_ref, v.cancel_to_zero) == (2, 1, 1)
    s = book.stats(fx).first()
    assert (s.executed_shares, s.adds, s.cancels, s.peak_live_orders) == (100, 3, 1, 2)


def test_crossed(spark):
    fx = book.effects(ops(spark, ("A", 1, "S", 10, 1000000), ("A", 2, "B", 10, 1000000), ("A", 3, "B", 10, B), ("A", 4, "B", 10, B)))
    ctl = lambda *r: spark.createDataFrame([(s, 7, t, x) for s, t, x in r], "seq long, locate int, ty string, state string")
    assert broken(spark, fx).crossed_while_trading == 0  # halted at first
    v = broken(spark, fx, ctl((-1, "H", "T"), (3, "Q", None)))
    assert (v.crossed_auction_pending, v.crossed_while_trading) == (1, 2)


def test_l1_and_tape(spark):
    fx = book.effects(ops(spark, ("A", 1, "B", 100, B), ("A", 2, "B", 50, 998000), ("E", 1, 150), ("E", 9, 5), ("C", 2, 10, 997000, "N"), ("C", 2, 10, 997000, "Y"), ("U", 2, 3, 5, 998000), ("D", 3)))
    l1 = [(r.seq, r.bid_px, r.bid_sz, r.bid_ct) for r in book.l1_stream(book.tops(fx)).orderBy("seq").collect()]
    assert l1 == [(0, B, 100, 1), (4, 998000, 50, 1), (8, 998000, 40, 1), (10, 998000, 30, 1), (12, 998000, 5, 1), (14, 0, 0, 0)]
    messages = spark.createDataFrame([(20, 1, 7, "P", 5, 6, "B"), (21, 1, 7, "Q", 0, 5_000_000_000, "X")], "seq long, ts_ns long, locate int, ty string, price long, shares long, side string")
    tape = [(r.kind, r.price, r.shares, r.side) for r in book.trade_tape(fx, messages).orderBy("seq").collect()]
    assert tape == [(0, B, 150, "B"), (1, 997000, 10, "B"), (2, 5, 6, "B"), (3, 0, 4294967295, "")]


def test_joins_agree_with_the_fold_on_random_operations(spark):
    rng, rows, refs = random.Random(5), [], [1]
    for i in range(1500):
        ty = rng.choice("AAAAEXDUUC")
        ref = rng.choice(refs[-30:])
        if ty == "A":
            refs.append(i + 10)
            rows.append(("A", i + 10, rng.choice("BS"), 100 * rng.randint(1, 9), 990000 + 100 * rng.randint(-9, 9)))
        elif ty == "U":
            refs.append(i + 10)
            rows.append(("U", ref, i + 10, 100 * rng.randint(1, 9), 990000 + 100 * rng.randint(-9, 9)))
        elif ty == "D":
            rows.append(("D", ref))
        elif ty == "C":
            rows.append(("C", ref, 100 * rng.randint(1, 4), 990000, "Y"))
        else:
            rows.append((ty, ref, 100 * rng.randint(1, 4)))
    o = ops(spark, *rows)
    a, b = book.effects(o), book.fold_effects(o)
    assert a.count() == len(rows) and a.exceptAll(b).count() == 0
    whole, cut = book.tops(a), book.tops(a, stretch=200)  # stretches change nothing
    assert whole.count() and whole.exceptAll(cut).count() == 0 and cut.exceptAll(whole).count() == 0


def test_components_take_few_rounds(spark):
    path = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b"))  # a path in a shuffled order of names
    found, rounds = components(path.union(spark.createDataFrame([(9000, 9001), (9001, 9002), (9500, 9500)], "a long, b long")))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(3001)}, 9000: 9000, 9001: 9000, 9002: 9000, 9500: 9500} and rounds <= 12


def test_chains_of_replaces_with_refs_added_twice(spark):
    """Refs that come back by an add or a replace, in long chains: the split into joins and folds is the fold of all."""
    rng, rows = random.Random(11), []
    for i in range(1200):
        ty, ref = rng.choice("AAAUUUUEXD"), rng.randrange(0, 150) + 40 * (i // 100)
        if ty == "A":
            rows.append(("A", ref, rng.choice("BS"), 100 * rng.randint(1, 9), 990000 + 100 * rng.randint(-9, 9)))
        elif ty == "U":
            rows.append(("U", ref, rng.choice([ref + 1, ref + 150, i + 5000]), 100 * rng.randint(1, 9), 990000 + 100 * rng.randint(-9, 9)))
        else:
            rows.append(("D", ref) if ty == "D" else (ty, ref, 100 * rng.randint(1, 4)))
    o = ops(spark, *rows)
    a, b = book.effects(o), book.fold_effects(o)
    assert a.count() == len(rows) and a.exceptAll(b).count() == 0 and a.where("duplicate and ty = 'U'").count() > 5
    assert book.audit(a).where("mismatches > 0").count() == 0


def test_operations_that_name_another_locate(spark):
    """The order's book changes; deletes count and cancels, deletes and replaces are looked at where the message says."""
    fx = book.effects(ops(spark, ("A", 1, "B", 100, B, 8), ("A", 2, "B", 50, B, 7), ("E", 1, 10), ("X", 1, 20), ("U", 1, 3, 60, B + 100), ("A", 4, "S", 5, S, 8), ("D", 3), ("D", 99)))
    assert [r.seq for r in book.stray_operations(fx).orderBy("seq").collect()] == [4, 6, 8, 12]
    assert sorted((r.locate, r.side, r.price, r.shares) for r in book.levels(fx).collect()) == [(7, "B", B, 50), (8, "S", S, 5)]
    counts = {r.locate: (r.adds, r.executes, r.cancels, r.deletes, r.replaces) for r in book.operation_counts(fx).collect()}
    assert counts == {7: (1, 0, 0, 2, 0), 8: (2, 1, 1, 0, 1)}
    assert [(r.locate, r.shares) for r in book.trade_tape(fx).collect()] == [(8, 10)]
    l1 = [(r.seq, r.locate, r.bid_px, r.bid_sz, r.ask_px) for r in book.l1_stream(book.checked_tops(fx, book.tops(fx))).orderBy("seq").collect()]
    assert l1 == [(0, 8, B, 100, 0), (2, 7, B, 50, 0), (4, 8, B, 90, 0), (10, 8, B + 100, 60, S)]
    assert book.audit(fx).where("mismatches > 0").count() == 0
