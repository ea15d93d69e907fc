"""Every message type from bytes written out here, so that the table of layouts is not checked against itself."""

import pytest

from tapeloom.operators import decode

# A header (locate 0x1234, tracking 0x5678, 34,200,000,000,007 ns), and for each type the bytes after it and what they mean.
HEADER = b"\x12\x34\x56\x78\x1f\x1a\xce\xd9\xf0\x07"
N4 = lambda v: v.to_bytes(4, "big")
N8 = lambda v: v.to_bytes(8, "big")
WIRE = {
    "S": (b"Q", ["Q"]),
    "R": (b"AAPL    QN\x00\x00\x00\x64NCZ PNN1N\x00\x00\x00\x03N", ["AAPL    ", "Q", "N", 100, "N", "C", "Z ", "P", "N", "N", "1", "N", 3, "N"]),
    "H": (b"MSFT    T LUDP", ["MSFT    ", "T", " ", "LUDP"]),
    "Y": (b"TSLA    1", ["TSLA    ", "1"]),
    "L": (b"NSDQAMD     YNA", ["NSDQ", "AMD     ", "Y", "N", "A"]),
    "V": (N8(322910000000) + N8(305930000000) + N8(271940000000), [322910000000, 305930000000, 271940000000]),
    "W": (b"2", ["2"]),
    "K": (b"NEWCO   \x00\x00\x93\xa8A\x00\x02\xbf\x20", ["NEWCO   ", 37800, "A", 180000]),
    "J": (b"GME     " + N4(1500000) + N4(1650000) + N4(1350000) + N4(2), ["GME     ", 1500000, 1650000, 1350000, 2]),
    "h": (b"INTC    QH", ["INTC    ", "Q", "H"]),
    "A": (b"\x11\x22\x33\x44\x55\x66\x77\x88B\x00\x00\x01\x2cNVDA    \x00\x26\x37\x34", [0x1122334455667788, "B", 300, "NVDA    ", 2504500]),
    "F": (N8(42) + b"S" + N4(100) + b"QQQ     " + N4(3300000) + b"JPMS", [42, "S", 100, "QQQ     ", 3300000, "JPMS"]),
    "E": (N8(42) + b"\x00\x00\x00\x32\xaa\xbb\xcc\xdd\xee\xff\x00\x11", [42, 50, 0xAABBCCDDEEFF0011]),
    "C": (N8(42) + N4(50) + N8(77) + b"Y" + N4(1999900), [42, 50, 77, "Y", 1999900]),
    "X": (N8(42) + N4(25), [42, 25]),
    "D": (b"\xff" * 8, [0xFFFFFFFFFFFFFFFF]),
    "U": (N8(42) + N8(43) + N4(200) + N4(1000000), [42, 43, 200, 1000000]),
    "P": (N8(0) + b"B" + N4(100) + b"SPY     " + N4(3250000) + N8(99), [0, "B", 100, "SPY     ", 3250000, 99]),
    "Q": (b"\x00\x00\x00\x01\x2a\x05\xf2\x00AAPL    " + N4(3180000) + N8(7) + b"C", [5000000000, "AAPL    ", 3180000, 7, "C"]),
    "B": (N8(99), [99]),
    "I": (N8(1000) + N8(500) + b"BAAPL    " + N4(3180000) + N4(3181000) + N4(3180500) + b"OL", [1000, 500, "B", "AAPL    ", 3180000, 3181000, 3180500, "O", "L"]),
    "N": (b"IBM     A", ["IBM     ", "A"]),
    "O": (b"DLCR    Y" + N4(160000) + N4(1440000) + N4(800000) + N8(34200000000008) + N4(720000) + N4(880000), ["DLCR    ", "Y", 160000, 1440000, 800000, 34200000000008, 720000, 880000]),
}
# The fields of each type in the order of the wire.
NAMES = {
    "S": "event_code", "R": "stock market_category financial_status round_lot_size round_lots_only issue_classification issue_subtype authenticity short_sale_threshold ipo_flag luld_tier etp_flag etp_leverage inverse",
    "H": "stock state reserved reason", "Y": "stock action", "L": "mpid stock primary_mm mm_mode state", "V": "level1 level2 level3", "W": "breached_level", "K": "stock release_time_s qualifier price",
    "J": "stock reference upper lower extensions", "h": "stock market_code action", "A": "ref side shares stock price", "F": "ref side shares stock price mpid", "E": "ref shares match", "C": "ref shares match printable price",
    "X": "ref shares", "D": "ref", "U": "ref new_ref shares price", "P": "ref side shares stock price match", "Q": "shares stock price match cross_type", "B": "match",
    "I": "paired imbalance direction stock far near reference cross_type price_variation", "N": "stock interest_flag", "O": "stock eligibility min max near near_time lower_collar upper_collar",
}


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(i, bytearray(k.encode() + HEADER + body)) for i, (k, (body, _)) in enumerate(WIRE.items())], "seq long, payload binary").cache()


def test_all_types_are_whole(messages):
    assert set(WIRE) == set(decode.LAYOUTS) and {r.status for r in decode.with_status(messages).collect()} == {"Ok"}
    assert {r.type: r.bytes for r in decode.type_counts(messages).collect()} == {k: 13 + len(body) for k, (body, _) in WIRE.items()}


@pytest.mark.parametrize("kind", list(WIRE))
def test_fields(messages, kind):
    (d,) = decode.decoded(messages, kind).collect()
    assert (d.locate, d.tracking, d.ts_ns) == (0x1234, 0x5678, 34200000000007)
    plain = lambda v: v if isinstance(v, str) else int(v)
    assert {n: plain(d[n]) for n in NAMES[kind].split()} == dict(zip(NAMES[kind].split(), WIRE[kind][1], strict=True)) and len(d) == 4 + len(WIRE[kind][1])


def test_book_fields_in_one_pass(messages):
    got = {r.ty: r for r in decode.operations(messages).orderBy("seq").collect() if r.side != "B"}
    assert (int(got["A"].ref), got["A"].side, got["A"].shares, got["A"].price) == (42, "S", 100, 3300000)  # F counts as A
    assert (got["E"].shares, got["C"].shares, got["C"].price, got["C"].printable, got["X"].shares, int(got["D"].ref)) == (50, 50, 1999900, "Y", 25, (1 << 64) - 1)
    assert (int(got["U"].ref), int(got["U"].new_ref), got["U"].shares, got["U"].price, got["U"].locate, got["U"].ts_ns) == (42, 43, 200, 1000000, 0x1234, 34200000000007)
