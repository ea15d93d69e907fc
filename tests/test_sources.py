"""Framed and fixed-length files: ranges of one file, push-down, and folders of parts."""

import random

import pytest
from pyspark.sql import functions as F

from tapeloom.sources import frames, records
from tapeloom.sources.files import list_files


def framed(payloads):
    return b"".join(len(p).to_bytes(2, "big") + p for p in payloads)


def plain(data):
    """(seq, offset, payload) of each whole frame, followed from the start."""
    at, out = 0, []
    while at + 2 <= len(data):
        n = int.from_bytes(data[at : at + 2], "big")
        if not n or at + 2 + n > len(data):
            break
        out.append((len(out), at, data[at + 2 : at + 2 + n]))
        at += 2 + n
    return out


def feeds():
    rng = random.Random(6)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    short = framed([noise(rng.randrange(1, 60)) for _ in range(9000)])
    yield "noise", short
    yield "long frames", framed([noise(3) + bytes([1]) * rng.choice([1, 10, 65530]) for _ in range(40)])
    yield "frames inside frames", framed([framed([b"\1" * rng.randrange(1, 9) for _ in range(40)]) for _ in range(300)])
    yield "equal", framed([b"\0\1" * 20] * 4000)
    yield "all ones", b"\1" * 100_000
    yield "cut", short[:-7]
    yield "half a length", short + b"\0"
    yield "zero in the middle", short[: len(plain(short)[:4000][-1][2]) + plain(short)[3999][1] + 2] + b"\0\0" + short
    yield "empty", b""


@pytest.mark.parametrize("name, data", list(feeds()), ids=[n for n, _ in feeds()])
def test_one_file_by_many_tasks(spark, tmp_path, monkeypatch, name, data):
    path = str(tmp_path / "feed.bin")
    (tmp_path / "feed.bin").write_bytes(data)
    for split in (max(5_000, len(data) // 20), 1 << 20):
        rows = frames.read_frames(spark, path, split=split)
        got = sorted((r.seq, r.offset, bytes(r.payload)) for r in rows.collect())
        assert got == plain(data), (name, split)
    if len(plain(data)) > 8000:
        assert frames.read_frames(spark, path, split=40_000).rdd.getNumPartitions() >= 5


@pytest.mark.parametrize("run_up", [0, 100, 70_000])
def test_maps_hold_the_true_entry_after_any_run_up(tmp_path, monkeypatch, run_up):
    """The run-up only makes maps small; without it every offset of a range is an entry."""
    import pandas as pd

    monkeypatch.setattr(frames, "RUN_UP", run_up)
    for name, data in feeds():
        (tmp_path / "x.bin").write_bytes(data)
        places = {at for _, at, _ in plain(data)}
        for begin in range(70_000, min(len(data), 200_000), 60_000):
            end = min(len(data), begin + 60_000)
            (got,) = frames.range_map(iter([pd.DataFrame([(str(tmp_path / "x.bin"), len(data), begin, end)], columns=["path", "size", "begin", "end"])]))
            own = sorted(p for p in places if begin <= p < end)
            if own:
                row = got[got["entry"] == own[0]].iloc[0]
                later = sorted(p for p in places if p >= end)
                assert row["frames"] == len(own) and (not later or (row["exit"] == later[0] and not row["stopped"]))


def test_filters_are_pushed_down(spark, tmp_path):
    head = lambda k, locate, ts: k + locate.to_bytes(2, "big") + b"\0\1" + ts.to_bytes(6, "big")
    payloads = [head(b"AED"[i % 3 : i % 3 + 1], i % 50, 1000 + i) + b"x" * (i % 7) for i in range(6000)] + [b"S", b"\xe9\1"]
    (tmp_path / "a.bin").write_bytes(framed(payloads))
    (tmp_path / "b.bin").write_bytes(framed(payloads[:10]))
    rows = frames.read_frames(spark, str(tmp_path), split=10_000, header=True)
    a = str(tmp_path / "a.bin")
    some = rows.where((F.col("file") == a) & (F.col("locate") == 7) & F.col("kind").isin("A", "E") & (F.col("ts_ns") >= 3000) & (F.col("seq") < 5000))
    want = [i for i in range(2000, 5000) if i % 50 == 7 and i % 3 != 2]
    assert sorted(r.seq for r in some.collect()) == want
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert " = " not in plan and ">=" not in plan and " IN " not in plan  # only null checks are left to Spark
    reader = frames.FramesReader([[a, a, 0, 10, 0, 0, 100], [a, a, 10, 20, 100, 0, 50], ["b", "b", 0, 5, 0, 0, -1]], True)
    eq = frames.EqualTo(("locate",), 7)
    text = frames.EqualTo(("payload",), b"")
    assert list(reader.pushFilters([eq, text, frames.EqualTo(("file",), a), frames.GreaterThan(("seq",), 120), frames.IsNotNull(("locate",)), frames.IsNotNull(("seq",))])) == [text, frames.IsNotNull(("locate",))]
    assert [p.stretch[:3] for p in reader.partitions()] == [[a, a, 10]]
    (batch,) = frames.FramesReader([[a, a, 0, 300, 0, 0, -1]], True).read(frames._Stretch(0, [a, a, 0, 300, 0, 0, -1]))
    reader = frames.FramesReader([], True)
    list(reader.pushFilters([eq]))
    (kept,) = reader.read(frames._Stretch(0, [a, a, 0, 300, 0, 0, -1]))
    assert batch.num_rows > 15 and kept.num_rows == 1 and kept.column("payload")[0].as_py() == payloads[7]  # others are never made into rows
    short = {r.kind: (r.locate, r.ts_ns) for r in rows.where("kind in ('S', 'é')").collect()}
    assert short == {"S": (None, None), "é": (None, None)}
    assert rows.where("locate is null").count() == 2 and rows.where("locate <> 7").count() == 6010 - 120 - 1


def test_frames_are_written_in_order_and_read_as_one_stream(spark, tmp_path):
    rng = random.Random(2)
    payloads = [bytes(rng.randrange(1, 256) for _ in range(rng.randrange(1, 50))) for _ in range(3000)]
    rows = [(10 * i - 500, bytearray(p)) for i, p in enumerate(payloads)]
    rng.shuffle(rows)
    path = str(tmp_path / "feed")
    frames.write_frames(spark.createDataFrame(rows, "seq long, payload binary"), path, 4)
    assert len(list_files(path)) > 1
    for split in (4000, 1 << 20):
        got = frames.read_frames(spark, path, split=split, joined=True).orderBy("seq").collect()
        assert [(r.seq, bytes(r.payload)) for r in got] == list(enumerate(payloads)) and {r.file for r in got} == {path}
        assert [r.offset for r in got] == [o for _, o, _ in plain(framed(payloads))]


def test_records_are_written_in_order(spark, tmp_path):
    path = str(tmp_path / "trades.bin")
    rows = spark.range(5000).select((7 * F.col("id") % 5000).alias("seq"), (F.col("id") * 0 + 9).alias("ts_ns"), F.lit(4294967295).alias("price"), (7 * F.col("id") % 5000).alias("shares"), F.lit(65535).alias("locate"), F.lit("S").alias("side"), F.lit(3).alias("kind")).repartition(7)
    records.write_records(rows, path, records.TRADE, 4)
    back = records.read_records(spark, path, records.TRADE, split=700)
    assert back.count() == 5000 and back.where("seq <> shares or price <> 4294967295 or locate <> 65535 or side <> 83 or kind <> 3 or pad <> 0 or ts_ns <> 9").count() == 0
    assert sum(s for _, s in list_files(path)) == 24 * 5000 and len(list_files(path)) > 1
    records.write_records(rows, path, records.TRADE)
    assert records.read_records(spark, path, records.TRADE).agg(F.max("seq")).first()[0] == 9999


@pytest.mark.parametrize("bad", ["price = 4294967296", "price = -1", "price = null"])
def test_a_failed_write_leaves_no_file(spark, tmp_path, bad):
    path = tmp_path / "l1.bin"
    rows = spark.range(1000).select(F.col("id").alias("seq"), F.when(F.col("id") == 900, F.expr(bad.split(" = ")[1]).cast("long")).otherwise(F.col("id")).alias("bid_px"))
    with pytest.raises(Exception):
        records.write_records(rows, str(path), records.L1, 4)
    assert not path.exists() or not list(path.iterdir())
    records.write_records(rows.where("seq <> 900"), str(path), records.L1)
    assert records.read_records(spark, str(path), records.L1).count() == 999
