"""Frames, messages, records, checks and studies on inputs made by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from tapeloom.functions.stats import t_expansion, t_quantile, weighted_quantiles
from tapeloom.operators import decode, verify
from tapeloom.plans import activity, export
from tapeloom.sources import frames, records

HEAD = struct.pack(">HH", 0x1234, 0x5678) + (34200000000007).to_bytes(6, "big")
LENGTHS = {k: n for k, (_, n, _) in decode.LAYOUTS.items()}


def message(kind, fill=b""):
    body = kind.encode() + HEAD + fill
    return body + b"1" * (LENGTHS[kind] - len(body))


def framed(*payloads):
    return b"".join(len(p).to_bytes(2, "big") + p for p in payloads)


@pytest.mark.parametrize(
    "data, n, clean",
    [
        (b"", 0, True), (framed(message("S"), message("A"), message("A"), message("D")), 4, True), (framed(message("A"), message("A"))[:-10], 1, False),
        (framed(message("E")) + b"\0", 1, False), (b"\0\0A", 0, False), (framed(message("S")) + b"\0\x24", 1, False),
    ],
)
def test_framing(spark, tmp_path, data, n, clean):
    (tmp_path / "feed.bin").write_bytes(data)
    rows = frames.read_frames(spark, str(tmp_path / "feed.bin"))
    assert rows.count() == n
    sizes = spark.createDataFrame([(str(tmp_path / "feed.bin"), len(data))], "file string, size long")
    assert frames.scan_summary(rows, sizes).first().clean_eof is clean


@pytest.mark.parametrize("size", [1, 3, 37, 38, 39, 1000])
def test_framing_across_blocks(tmp_path, monkeypatch, size):
    path = str(tmp_path / "feed.bin")
    (tmp_path / "feed.bin").write_bytes(framed(*[message("A")] * 50))
    monkeypatch.setattr(frames, "BLOCK", size)
    stretch = [path, path, 0, 38 * 50, 0, 0, -1]
    got = [r for b in frames.FramesReader([stretch], False).read(frames._Stretch(0, stretch)) for r in b.to_pylist()]
    assert [r["offset"] for r in got] == list(range(0, len(got) * 38, 38)) and len(got) == 50 and all(r["payload"] == message("A") and r["seq"] == i for i, r in enumerate(got))


@pytest.mark.parametrize("kind", sorted(decode.LAYOUTS))
def test_every_message(spark, kind):
    """Fields cover a message without gaps, and survive a round trip at their largest values."""
    name, length, fields = decode.LAYOUTS[kind]
    at = 1
    for _, offset, width, _ in decode.HEADER + fields:
        assert offset == at
        at += width
    assert at == length
    fill = b"".join(b"\xff" * w if k == "u" else b"AB      "[:w] for _, _, w, k in fields)
    rows = spark.createDataFrame([(0, bytearray(message(kind, fill)))], "seq long, payload binary")
    d = decode.decoded(rows, kind).first()
    assert (d.locate, d.tracking, d.ts_ns) == (0x1234, 0x5678, 34200000000007)
    for n, _, w, k in fields:
        assert (int(d[n]) if k == "u" else d[n]) == ((1 << 8 * w) - 1 if k == "u" else "AB      "[:w])
    assert bytes(decode.encoded(decode.decoded(rows, kind), kind).first().payload) == message(kind, fill)


def test_status_and_failure(spark):
    payloads = [message("S"), message("A"), b"Z" + b"\0" * 9, message("D")]
    rows = spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "seq long, payload binary")
    assert [r.status for r in decode.with_status(rows).orderBy("seq").collect()] == ["Ok", "Ok", "UnknownType", "Ok"]
    assert decode.before_failure(rows).count() == 2
    short = spark.createDataFrame([(0, bytearray(message("A")[:20]))], "seq long, payload binary")
    assert decode.with_status(short).first().status == "BadLength"
    assert decode.lifecycle(rows).first().at == "09:30:00"


def test_stream_checks(spark):
    r, a = message("R", b"AAPL    "), lambda s, side: message("A", b"\0" * 8 + side + b"\0\0\0\1" + s + b"\0\0\0\0")
    k = message("K", b"MSFT    ")
    payloads = [a(b"MSFT    ", b"B"), r, a(b"AAPL    ", b"B"), a(b"MSFT    ", b"Z"), k]
    c = decode.stream_checks(spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "seq long, payload binary")).first()
    assert (c.messages, c.locate_checked, c.locate_mismatch, c.bad_side, c.zero_price_adds, c.ok) == (5, 2, 1, 1, 3, False)


def test_records_and_sidecars(spark, tmp_path):
    trade = struct.Struct("<QIIHBBI")
    (tmp_path / "trades.bin").write_bytes(b"".join(trade.pack(10 + i, 0xF0000000, 5, i, 0x42 * (i == 0), i, 0) for i in range(3)))
    (tmp_path / "symbols.csv").write_text("locate,symbol\n0,OLD\n0,AAPL \n1,MSFT\n")
    (tmp_path / "meta.txt").write_text("source=a=b\ntrades=3\n")
    t = records.read_records(spark, str(tmp_path / "trades.bin"), records.TRADE)
    named = records.named_trades(t, records.read_symbols(spark, str(tmp_path / "symbols.csv"))).orderBy("seq").collect()
    assert [(r.price, r.symbol, r.side, r.kind_name) for r in named] == [(0xF0000000, "AAPL", "B", "exec"), (0xF0000000, "MSFT", "", "exec_px"), (0xF0000000, "", "", "hidden")]
    meta = records.read_meta(spark, str(tmp_path / "meta.txt"))
    assert {r.key: r.value for r in meta.collect()} == {"source": "a=b", "trades": "3"}
    l1 = spark.createDataFrame([(0, 0)], "ts_ns long, pad int")
    got = {r.name: r.status for r in verify.verify_files(t, l1, meta, {"trades": (72, 24), "l1": (33, 32)}).collect()}
    assert got == {"trades_size": "PASS", "l1_size": "FAIL", "trades_count_meta": "PASS", "l1_count_meta": "FAIL", "trade_pad": "PASS", "l1_pad": "PASS"}
    (tmp_path / "trades.bin").write_bytes(b"x" * 25)
    with pytest.raises(ValueError):
        records.read_records(spark, str(tmp_path / "trades.bin"), records.TRADE)


def test_backward_steps_across_stretches(spark):
    n = verify.STRETCH
    rows = spark.createDataFrame([(0, 5), (1, 4), (n - 1, 9), (n, 8), (n + 1, 8)], "seq long, ts_ns long")
    assert verify.backward_steps(rows).first().backward == 2


def test_reconcile(spark):
    crosses = spark.createDataFrame([("AAPL", 323.87, 5), ("FB", 209.53, 6), ("SPY", None, None), ("AMD", 10.0, 1), ("MU", 1.0, 1)], "symbol string, price_usd double, shares long")
    official = spark.createDataFrame([("AAPL", 80.9675), ("META", 209.53), ("AMD", 10.5)], "source string, close double")
    splits = spark.createDataFrame([("AAPL", 4, 1)], "source string, split_num int, split_den int")
    rows = activity.reconcile_close(crosses, official, splits)
    got = {r.symbol: (r.verdict, r.note) for r in rows.collect()}
    assert got["AAPL"][0] == "MATCH" and got["AAPL"][1].startswith("de-split x4") and got["FB"] == ("MATCH", "via META") and got["SPY"][0] == "n/a" and got["AMD"][0] == "MISMATCH" and got["MU"][0] == "unavailable"
    c = activity.reconcile_counts(rows).first()
    assert (c.matched, c.available, c.unavailable, c.not_listed) == (2, 3, 1, 1)


def test_statistics(spark):
    assert abs(t_quantile(0.975, 18) - 2.100922) < 1e-5 and abs(t_quantile(0.975, 14) - 2.144787) < 1e-5
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 3.0, 2)], "k string, v double, w long")
    assert weighted_quantiles(rows, ["k"], "v", "w", {"q": 0.5}).first().q == 2.0


def test_extract_and_csv(spark, tmp_path):
    tape = spark.createDataFrame([("A", 0), ("A", 1), ("B", 0), ("C", 2)], "symbol string, kind int")
    top = activity.top_symbols(tape, 2)
    activity.extract_subsets(tape, top, str(tmp_path / "sub"))
    assert spark.read.parquet(str(tmp_path / "sub")).count() == 3
    records.write_csv(top.withColumn("x", F.lit(None).cast("int")), str(tmp_path / "csv"))
    assert {r.x for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {"-"}
    records.write_lines(top, str(tmp_path / "txt"), "symbol")
    assert spark.read.text(str(tmp_path / "txt")).count() == 2


def packed(kind, locate, ts, **fields):
    out = kind.encode() + struct.pack(">HH", locate, 1) + ts.to_bytes(6, "big")
    for n, _, w, t in decode.LAYOUTS[kind][2]:
        v = fields.get(n, " " if t == "a" else 0)
        out += v.to_bytes(w, "big") if t == "u" else v.encode().ljust(w)
    return out


def day(price, bad=False):
    """Two symbols; the same refs every day."""
    rows = [packed("R", 3, 0, stock="OLD"), packed("R", 3, 1, stock="TGT"), packed("R", 4, 1, stock="OTHER"), packed("H", 3, 2, stock="TGT", state="T")]
    rows += [packed("A", 3, 5, ref=1, side="B", shares=100, stock="TGT", price=price), packed("A", 4, 6, ref=2, side="B", shares=50, stock="OTHER", price=price)]
    rows += [packed("E", 3, 7, ref=1, shares=40, match=9), packed("P", 4, 8, side="S", shares=7, stock="OTHER", price=5), packed("Q", 3, 9, shares=5_000_000_000, stock="TGT", price=6)]
    rows += [b"Z123"] * bad + [packed("X", 4, 10, ref=2, shares=10)]
    return framed(*rows)


def test_export_of_several_days(spark, tmp_path):
    """Refs and sequence numbers of one day do not meet those of another; a bad message ends its own day only."""
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.bin").write_bytes(day(1000, bad=True))
    (tmp_path / "feed" / "b.bin").write_bytes(day(2000))
    f = frames.read_frames(spark, str(tmp_path / "feed"))
    x = export.replay(f)
    assert sorted((r.day, r.kind, r.price, r.shares, r.locate, r.side) for r in x.trades.collect()) == [(d, k, p, n, loc, s) for d, px in ((0, 1000), (1, 2000)) for k, p, n, loc, s in ((0, px, 40, 3, "B"), (2, 5, 7, 4, "S"), (3, 6, 4294967295, 3, ""))]
    assert sorted((r.day, r.locate, r.bid_px, r.bid_sz) for r in x.l1.collect()) == [(0, 3, 1000, 60), (0, 3, 1000, 100), (0, 4, 1000, 50), (1, 3, 2000, 60), (1, 3, 2000, 100), (1, 4, 2000, 40), (1, 4, 2000, 50)]
    assert {(r.day, r.key, r.value) for r in export.totals(x).collect() if r.key != "source"} == {(0, "messages", "9"), (0, "trades", "3"), (0, "l1", "3"), (1, "messages", "10"), (1, "trades", "3"), (1, "l1", "4")}
    assert {(r.day, r.total) for r in x.violations().collect()} == {(0, 0), (1, 0)}
    export.write_export(x, str(tmp_path / "out"))
    assert sorted(p.read_text() for p in (tmp_path / "out" / "symbols.csv" / "day=1").glob("*.csv")) == ["locate,symbol\n3,TGT\n4,OTHER\n"]
    assert [p.read_text() for p in (tmp_path / "out" / "ops.csv" / "day=0").glob("*.csv")] == ["locate,adds,executes,cancels,deletes,replaces\n3,1,1,0,0,0\n4,1,0,0,0,0\n"]
    assert [p.read_text().split("\n")[1:4] for p in (tmp_path / "out" / "meta.txt" / "day=1").glob("*.txt")] == [["messages=10", "trades=3", "l1=4"]]
    assert {r.symbol for r in spark.read.parquet(str(tmp_path / "out" / "trades.parquet")).collect()} == {"TGT", "OTHER"}
    one = export.replay(f, symbol="TGT")
    assert {r.locate for r in one.trades.collect()} == {r.locate for r in one.l1.collect()} == {3} and one.symbols.count() == 4
    sizes = spark.createDataFrame([(r.file, len(day(1, i == 0))) for i, r in enumerate(f.select("file").distinct().orderBy("file").collect())], "file string, size long")
    assert [(r.failed, r.clean_eof, r.ok) for r in decode.verdict(decode.stream_checks(f), frames.scan_summary(f, sizes)).orderBy("file").collect()] == [("UnknownType", True, False), (None, True, True)]
    assert {r.symbol for r in decode.directory(f, stripped=False).collect()} == {"TGT     ", "OTHER   "}


def test_records_are_read_by_ranges(spark, tmp_path):
    item = struct.Struct("<QIIIIHHHH")
    (tmp_path / "l1.bin").write_bytes(b"".join(item.pack(1 << 60, i, 2, 3, 0xFFFFFFFF, i % 65536, 5, 6, 0) for i in range(3500)))
    rows = records.read_records(spark, str(tmp_path / "l1.bin"), records.L1, split=1000)
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 3500
    assert rows.where("seq <> bid_px or ts_ns <> 1152921504606846976 or ask_sz <> 4294967295 or locate <> seq or ask_ct <> 6").count() == 0


def test_ops_scope_and_expansion(spark, tmp_path):
    (tmp_path / "ops.csv").write_text("locate,adds,executes,cancels,deletes,replaces\n3,1,2,3,4,5\n")
    assert tuple(records.read_ops(spark, str(tmp_path / "ops.csv")).first()) == (3, 1, 2, 3, 4, 5)
    (tmp_path / "symbols.csv").write_text("locate,symbol\n1,AB  \n")
    assert records.read_symbols(spark, str(tmp_path / "symbols.csv"), stripped=False).first().symbol == "AB  "
    records.write_table(spark.range(3), str(tmp_path / "study"), scope="one day")
    assert spark.read.parquet(str(tmp_path / "study")).schema["id"].metadata == {"scope": "one day"}
    got = spark.createDataFrame([(float(d),) for d in (101, 400)], "df double").select(t_expansion(0.975, F.col("df")).alias("t")).collect()
    assert all(abs(r.t - t_quantile(0.975, d)) < 1e-6 for r, d in zip(got, (101, 400), strict=True))


def test_symbols_by_day_and_lazy_replay(spark):
    from tapeloom.functions import market

    symbols = spark.createDataFrame([(0, 3, "OLD"), (1, 3, "TGT")], "day int, locate int, symbol string")
    rows = spark.createDataFrame([(0, 3), (1, 3), (1, 4)], "day int, locate int")
    assert sorted(tuple(r) for r in market.with_symbols(rows, symbols, ("day", "locate")).collect()) == [(0, 3, "OLD"), (1, 3, "TGT"), (1, 4, "")]
    payloads = [packed("R", 3, 0, stock="TGT"), packed("A", 3, 5, ref=1, side="B", shares=100, stock="TGT", price=7)]
    x = export.replay(spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(payloads)], "seq long, payload binary"))
    assert [r.symbol for r in x.symbols.collect()] == ["TGT"] and not {"effects", "tops"} & set(vars(x))
    assert [(r.bid_px, r.bid_sz) for r in x.l1.collect()] == [(7, 100)] and {"effects", "tops"} <= set(vars(x))
