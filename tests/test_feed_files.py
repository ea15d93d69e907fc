"""A feed in files: few ranges for each core, one look for days and failures, payloads written whole batches at a time."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import decode
from tapeloom.plans import export
from tapeloom.sources import frames

DELETE = b"D" + b"\0" * 18


def framed(payloads):
    return b"".join(len(p).to_bytes(2, "big") + p for p in payloads)


def test_short_ranges_get_longer_as_a_file_grows(spark, tmp_path):
    payloads = [DELETE] * 20_000
    (tmp_path / "feed.bin").write_bytes(framed(payloads))
    rows = frames.read_frames(spark, str(tmp_path / "feed.bin"), split=1000)
    assert rows.rdd.getNumPartitions() <= frames.PER_CORE * spark.sparkContext.defaultParallelism + 1  # 420 ranges of 1,000 bytes
    assert rows.agg(F.count("*"), F.count_distinct("seq"), F.max("seq"), F.max("offset")).first()[:] == (20_000, 20_000, 19_999, 21 * 19_999)


@pytest.mark.parametrize("total, split, cores, want", [
    (10_000, 4000, 8, 4000), (1 << 22, 1 << 17, 8, 1 << 17), (32_000_000, 1 << 17, 8, 1_000_000), (10**10, 1 << 17, 12, frames.SPLIT), (10**9, 1 << 26, 1, 1 << 26), (10**12, 1 << 17, 12, 50_000_000), (0, 1, 0, 1),
])
def test_bytes_of_a_range(total, split, cores, want):
    assert frames.range_bytes(total, split, cores) == want


def test_a_replay_reads_a_file_once_for_each_table(spark, tmp_path):
    (tmp_path / "feed.bin").write_bytes(framed([DELETE] * 3000))
    x = export.replay(frames.read_frames(spark, str(tmp_path / "feed.bin"), split=10_000))
    for rows in (x.messages, x.trades):
        assert rows._jdf.queryExecution().executedPlan().toString().count("BatchScan frames") == 1
    assert x.messages.first().messages == 3000


@pytest.mark.parametrize("named", [False, True])
def test_days_and_failures_at_once(spark, named):
    """Files that begin with a bad message have no day, as before; so have those that `days` leaves out."""
    files = {"a": [b"Z"] + [DELETE] * 3, "b": [DELETE] * 5, "c": [DELETE] * 2 + [DELETE[:-1], DELETE, b"Z"], "d": [DELETE]}
    rows = spark.createDataFrame([(f, s, bytearray(p)) for f, ps in files.items() for s, p in enumerate(ps)], "file string, seq long, payload binary")
    days = spark.createDataFrame([("a", 4), ("b", 9), ("c", 7)], "file string, day int") if named else None
    got, want = decode.days_before_failure(rows, days), decode.with_day(decode.before_failure(rows), days)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.file, r.day, r.seq) for r in got.collect()} == {(f, d, s) for f, d, n in ([("b", 9, 5), ("c", 7, 2)] if named else [("b", 0, 5), ("c", 1, 2), ("d", 2, 1)]) for s in range(n)}


def test_payloads_of_a_batch_and_of_a_part_of_it():
    payloads = [b"a", b"bc" * 200, b"\0" * 65_535, b"\xff" * 3, b"e"]
    batch = pa.RecordBatch.from_pydict({"seq": list(range(5)), "payload": pa.array(payloads, pa.binary())})
    encode = frames._FramesWriter("/nowhere", False).encode
    assert encode(batch) == framed(payloads) and encode(batch.slice(1, 3)) == framed(payloads[1:4])
    for bad in (None, b"", b"x" * 65_536):
        with pytest.raises(ValueError):
            encode(pa.RecordBatch.from_pydict({"seq": [0, 1], "payload": pa.array([b"a", bad], pa.binary())}))


def test_whole_numbers_are_written_as_decimals_are(spark):
    rows = spark.sql("select bigint(seq) as seq, int(locate) as locate, int(1) as tracking, bigint(ts) as ts_ns, bigint(ref) as ref from values (0, 0, 0, 0), (1, 65535, 281474976710655, 9223372036854775807), (2, 70000, -1, -5), (3, null, 1, 1) as t(seq, locate, ts, ref)")
    wide = rows.select("seq", *[F.col(c).cast("decimal(20,0)").alias(c) for c in rows.columns if c != "seq"])
    got, want = ({r.seq: r.payload for r in decode.encoded(x, "D").collect()} for x in (rows, wide))
    assert got == want and bytes(got[1]) == b"D\xff\xff\0\1" + b"\xff" * 6 + b"\x7f" + b"\xff" * 7 and got[3] is None
