"""Binary messages to typed columns, and checks of a decoded stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as m
from tapeloom.functions.storage import stored
from tapeloom.functions.windows import carried, stretch_of

# The wire format. Type -> (name, length, fields); a field is (name, offset, width, kind): u unsigned, a text.
HEADER = (("locate", 1, 2, "u"), ("tracking", 3, 2, "u"), ("ts_ns", 5, 6, "u"))
_ORDER = (("ref", 11, 8, "u"), ("side", 19, 1, "a"), ("shares", 20, 4, "u"), ("stock", 24, 8, "a"), ("price", 32, 4, "u"))
_STOCK = ("stock", 11, 8, "a")
LAYOUTS: dict[str, tuple[str, int, tuple[tuple[str, int, int, str], ...]]] = {
    "S": ("system_event", 12, (("event_code", 11, 1, "a"),)),
    "R": ("stock_directory", 39, (
        _STOCK, ("market_category", 19, 1, "a"), ("financial_status", 20, 1, "a"), ("round_lot_size", 21, 4, "u"), ("round_lots_only", 25, 1, "a"),
        ("issue_classification", 26, 1, "a"), ("issue_subtype", 27, 2, "a"), ("authenticity", 29, 1, "a"), ("short_sale_threshold", 30, 1, "a"),
        ("ipo_flag", 31, 1, "a"), ("luld_tier", 32, 1, "a"), ("etp_flag", 33, 1, "a"), ("etp_leverage", 34, 4, "u"), ("inverse", 38, 1, "a"))),
    "H": ("trading_action", 25, (_STOCK, ("state", 19, 1, "a"), ("reserved", 20, 1, "a"), ("reason", 21, 4, "a"))),
    "Y": ("reg_sho", 20, (_STOCK, ("action", 19, 1, "a"))),
    "L": ("participant_position", 26, (("mpid", 11, 4, "a"), ("stock", 15, 8, "a"), ("primary_mm", 23, 1, "a"), ("mm_mode", 24, 1, "a"), ("state", 25, 1, "a"))),
    "V": ("mwcb_decline", 35, (("level1", 11, 8, "u"), ("level2", 19, 8, "u"), ("level3", 27, 8, "u"))),
    "W": ("mwcb_status", 12, (("breached_level", 11, 1, "a"),)),
    "K": ("ipo_quoting", 28, (_STOCK, ("release_time_s", 19, 4, "u"), ("qualifier", 23, 1, "a"), ("price", 24, 4, "u"))),
    "J": ("luld_collar", 35, (_STOCK, ("reference", 19, 4, "u"), ("upper", 23, 4, "u"), ("lower", 27, 4, "u"), ("extensions", 31, 4, "u"))),
    "h": ("operational_halt", 21, (_STOCK, ("market_code", 19, 1, "a"), ("action", 20, 1, "a"))),
    "A": ("add_order", 36, _ORDER),
    "F": ("add_order_mpid", 40, (*_ORDER, ("mpid", 36, 4, "a"))),
    "E": ("order_executed", 31, (("ref", 11, 8, "u"), ("shares", 19, 4, "u"), ("match", 23, 8, "u"))),
    "C": ("order_executed_price", 36, (("ref", 11, 8, "u"), ("shares", 19, 4, "u"), ("match", 23, 8, "u"), ("printable", 31, 1, "a"), ("price", 32, 4, "u"))),
    "X": ("order_cancel", 23, (("ref", 11, 8, "u"), ("shares", 19, 4, "u"))),
    "D": ("order_delete", 19, (("ref", 11, 8, "u"),)),
    "U": ("order_replace", 35, (("ref", 11, 8, "u"), ("new_ref", 19, 8, "u"), ("shares", 27, 4, "u"), ("price", 31, 4, "u"))),
    "P": ("trade", 44, (*_ORDER, ("match", 36, 8, "u"))),
    "Q": ("cross_trade", 40, (("shares", 11, 8, "u"), ("stock", 19, 8, "a"), ("price", 27, 4, "u"), ("match", 31, 8, "u"), ("cross_type", 39, 1, "a"))),
    "B": ("broken_trade", 19, (("match", 11, 8, "u"),)),
    "I": ("noii", 50, (
        ("paired", 11, 8, "u"), ("imbalance", 19, 8, "u"), ("direction", 27, 1, "a"), ("stock", 28, 8, "a"), ("far", 36, 4, "u"),
        ("near", 40, 4, "u"), ("reference", 44, 4, "u"), ("cross_type", 48, 1, "a"), ("price_variation", 49, 1, "a"))),
    "N": ("rpii", 20, (_STOCK, ("interest_flag", 19, 1, "a"))),
    "O": ("direct_listing", 48, (
        _STOCK, ("eligibility", 19, 1, "a"), ("min", 20, 4, "u"), ("max", 24, 4, "u"), ("near", 28, 4, "u"),
        ("near_time", 32, 8, "u"), ("lower_collar", 40, 4, "u"), ("upper_collar", 44, 4, "u"))),
}
#: Types whose symbol must agree with the directory; K carries one but is not checked.
CHECKED = ("H", "Y", "L", "J", "h", "A", "F", "P", "Q", "I", "N", "O")


def _field(payload: Column, offset: int, width: int, kind: str) -> Column:
    raw = F.substring(payload, offset + 1, width)
    if kind == "a":
        return raw.cast("string")
    number = F.conv(F.hex(raw), 16, 10)
    return number.cast("decimal(20,0)" if width == 8 else "bigint" if width >= 4 else "int")


def with_status(frames: DataFrame) -> DataFrame:
    """Adds `status` to frames (seq, payload): Ok, UnknownType or BadLength, and `type`."""
    kind = F.substring("payload", 1, 1).cast("string")
    want = F.lit(-1)
    for k, (_, length, _) in LAYOUTS.items():
        want = F.when(kind == k, length).otherwise(want)
    return frames.select("*", kind.alias("type"), want.alias("_want")).select("*", F.when(F.col("_want") < 0, "UnknownType").when(F.octet_length("payload") != F.col("_want"), "BadLength").otherwise("Ok").alias("status")).drop("_want")


def _file(frames: DataFrame) -> DataFrame:
    """Frames with the file they are from; without one, all are of one file."""
    return frames if "file" in frames.columns else frames.withColumn("file", F.lit(""))


def before_failure(frames: DataFrame) -> DataFrame:
    """The frames of each file before its first that does not decode; the file's stream ends there."""
    rows = _file(frames if "status" in frames.columns else with_status(frames))
    first = rows.where("status <> 'Ok'").groupBy("file").agg(F.min("seq").alias("_bad"))  # at most a row for each file
    rows = rows.join(F.broadcast(first), "file", "left").where("_bad is null or seq < _bad").drop("_bad")
    return rows if "file" in frames.columns else rows.drop("file")


def days_before_failure(frames: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """`with_day` of `before_failure`, from one look at the frames for both: a row for each file is written down, with its first frame and its first that does not decode."""
    rows = _file(frames if "status" in frames.columns else with_status(frames))
    ends = stored(rows.groupBy("file").agg(F.min("seq").alias("_first"), F.min(F.when(F.col("status") != "Ok", F.col("seq"))).alias("_bad")))
    ends = ends.where("_bad is null or _first < _bad").drop("_first")
    return with_day(rows, with_day(ends) if days is None else ends.join(days, "file")).where("_bad is null or seq < _bad").drop("_bad")


def with_day(frames: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Frames with `day`, a number for each file: by `days` (file, day), or else by the files' order."""
    if days is None:
        days = frames.select("file").distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("day"))  # a row for each file
    return frames.join(F.broadcast(days), "file")


def decoded(frames: DataFrame, kind: str) -> DataFrame:
    """The messages of one type, typed: seq, locate, tracking, ts_ns and the type's fields. Unsigned 64-bit values are decimal(20,0); texts keep their padding."""
    fields = HEADER + LAYOUTS[kind][2]
    ts = [F.conv(F.hex(F.substring("payload", 6, 6)), 16, 10).cast("bigint").alias("ts_ns")]
    cols = [_field(F.col("payload"), o, w, k).alias(n) for n, o, w, k in fields if n != "ts_ns"]
    return frames.where(F.substring("payload", 1, 1).cast("string") == kind).select("seq", *cols[:2], *ts, *cols[2:])


def _bytes_of(kind: str, have: dict[str, str]) -> Column:
    """A message's bytes; `have`: name -> type of the columns there are. Whole numbers need no `conv`, which takes several times as long."""
    parts = [F.encode(F.lit(kind), "UTF-8")]
    for n, _, w, k in HEADER + LAYOUTS[kind][2]:
        value = F.col(n) if n in have else F.lit("" if k == "a" else 0)
        digits = F.hex(value) if have.get(n, "int") in ("int", "bigint") else F.conv(value.cast("string"), 10, 16)
        parts.append(F.encode(F.rpad(F.coalesce(value, F.lit("")), w, " "), "UTF-8") if k == "a" else F.unhex(F.lpad(digits, 2 * w, "0")))
    return F.concat(*parts)


def encoded(rows: DataFrame, kind: str) -> DataFrame:
    """The inverse of `decoded`: seq and payload, from columns named as the fields (numbers, or texts that get padded; 0 or blanks where there is no such column)."""
    return rows.select("seq", _bytes_of(kind, dict(rows.dtypes)).alias("payload"))


def encoded_all(rows: DataFrame, kinds: str, kind: str = "ty", keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Messages of several kinds in one pass: `keep` and payload, for the rows whose `kind` is one of `kinds`."""
    out = F.lit(None).cast("binary")
    for k in kinds:
        out = F.when(F.col(kind) == k, _bytes_of(k, dict(rows.dtypes))).otherwise(out)
    return rows.where(F.col(kind).isin(*kinds)).select(*keep, out.alias("payload"))


def _columns(kinds: str, names: dict[str, str]) -> list[Column]:
    """Each named field, cast, for frames of several kinds in one pass: null where a kind has no such field."""
    payload, kind = F.col("payload"), F.substring("payload", 1, 1).cast("string")
    out = []
    for name, cast in names.items():
        value, places = F.lit(None).cast(cast), {}
        for k in kinds:
            for n, o, w, t in LAYOUTS[k][2]:
                if n == name:
                    places.setdefault((o, w, t), []).append(k)
        for place, own in places.items():
            value = F.when(kind.isin(*own), _field(payload, *place).cast(cast)).otherwise(value)
        out.append(value.alias(name))
    return out


def _header() -> list[Column]:
    return [_field(F.col("payload"), 1, 2, "u").alias("locate"), F.conv(F.hex(F.substring("payload", 6, 6)), 16, 10).cast("bigint").alias("ts_ns")]


def _of_kinds(frames: DataFrame, kinds: str, names: dict[str, str]) -> DataFrame:
    keys = [c for c in ("file", "day") if c in frames.columns]
    kind = F.substring("payload", 1, 1).cast("string")
    return frames.where(kind.isin(*kinds)).select(*keys, "seq", *_header(), kind.alias("ty"), *_columns(kinds, names))


def operations(frames: DataFrame) -> DataFrame:
    """The book operations of all types in one table, in one pass: [file, day,] seq, locate, ts_ns, ty, ref, new_ref, shares, price, side, printable. F counts as A."""
    types = {"ref": "decimal(20,0)", "new_ref": "decimal(20,0)", "shares": "bigint", "price": "bigint", "side": "string", "printable": "string"}
    return _of_kinds(frames, "AFECXDU", types).withColumn("ty", F.when(F.col("ty") == "F", "A").otherwise(F.col("ty")))


def control(frames: DataFrame) -> DataFrame:
    """Trading actions and crosses, which drive a book's state: [file, day,] seq, locate, ts_ns, ty (H, Q), state."""
    return _of_kinds(frames, "HQ", {"state": "string"})


def prints(frames: DataFrame) -> DataFrame:
    """Trades against hidden orders and crosses: [file, day,] seq, locate, ts_ns, ty (P, Q), price, shares (not saturated), side."""
    return _of_kinds(frames, "PQ", {"price": "bigint", "shares": "decimal(20,0)", "side": "string"})


def directory(frames: DataFrame, stripped: bool = True) -> DataFrame:
    """[file, day,] locate, symbol: the last directory entry of each locate, without trailing blanks (with them if not `stripped`)."""
    keys = [c for c in ("file", "day") if c in frames.columns]
    rows = _of_kinds(frames, "R", {"stock": "string"})
    last = rows.groupBy(*keys, "locate").agg(F.max_by("stock", "seq").alias("symbol"))
    return last.withColumn("symbol", F.rtrim("symbol")) if stripped else last


def tracked(frames: DataFrame, symbol: str) -> DataFrame:
    """The frames of one symbol's locate: directory entries and trading actions of all symbols stay, as do messages without a symbol.

    Books, prints and counts of other symbols go. The locate is the one that the directory last gives the symbol.
    """
    keys = [c for c in ("file", "day") if c in frames.columns]
    rows = _of_kinds(frames, "R", {"stock": "string"}).where(F.rtrim("stock") == symbol)
    own = rows.groupBy(*keys).agg(F.max_by("locate", "seq").alias("_own"))  # a row for each day
    kind = F.substring("payload", 1, 1).cast("string")
    joined = frames.join(F.broadcast(own), keys, "left") if keys else frames.crossJoin(F.broadcast(own))
    return joined.where(~kind.isin(*"AFECXDUPQ") | (_field(F.col("payload"), 1, 2, "u") == F.col("_own"))).drop("_own")


def type_counts(frames: DataFrame) -> DataFrame:
    """Messages and bytes (length prefixes included) of each type."""
    return frames.groupBy(F.substring("payload", 1, 1).cast("string").alias("type")).agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload") + 2).alias("bytes"))


def stream_checks(frames: DataFrame) -> DataFrame:
    """One row for each file: file, messages, ts_min, ts_max, ts_out_of_range, bad_side, zero_price_adds, locate_checked, locate_mismatch, failed, ok.

    A symbol is compared with the last directory entry of its locate in its file so far; locates without one are skipped. Frames from the first
    on that does not decode are left out; `failed` is that frame's status, null if all decode. Whether a file ends with its last frame
    is for `verdict` to add.
    """
    given = "file" in frames.columns
    checked = _file(with_status(frames))
    failed = checked.where("status <> 'Ok'").groupBy("file").agg(F.min_by("status", "seq").alias("failed"))
    frames = before_failure(checked)
    kind = F.substring("payload", 1, 1).cast("string")
    stock = F.lit(None).cast("string")
    for k in ("R", *CHECKED):
        at = next(o for n, o, _, _ in LAYOUTS[k][2] if n == "stock")
        stock = F.when(kind == k, F.substring("payload", at + 1, 8).cast("string")).otherwise(stock)
    rows = frames.select("file", "seq", kind.alias("t"), _field(F.col("payload"), 1, 2, "u").alias("locate"), F.conv(F.hex(F.substring("payload", 6, 6)), 16, 10).cast("bigint").alias("ts_ns"), stock.alias("stock"),
                         F.when(kind.isin("A", "F", "P"), F.substring("payload", 20, 1).cast("string")).alias("side"), F.when(kind.isin("A", "F"), _field(F.col("payload"), 32, 4, "u")).alias("price"))
    rows = carried(rows.withColumn("named", F.when(F.col("t") == "R", F.col("stock"))), ["file", "locate"], ["seq"], stretch_of(), last={"known": "named"})
    rows = rows.withColumn("known", F.when(F.col("t").isin(*CHECKED), F.col("known")))
    one = rows.groupBy("file").agg(
        F.count("*").alias("messages"), F.min("ts_ns").alias("ts_min"), F.max("ts_ns").alias("ts_max"), F.count_if(F.col("ts_ns") >= m.DAY_NS).alias("ts_out_of_range"), F.count_if(~F.col("side").isin("B", "S")).alias("bad_side"),
        F.count_if(F.col("price") == 0).alias("zero_price_adds"), F.count("known").alias("locate_checked"), F.count_if(F.col("known") != F.col("stock")).alias("locate_mismatch"),
    )
    one = one.join(failed, "file", "full").na.fill(0)
    one = one.withColumn("ok", F.col("failed").isNull() & (F.col("ts_out_of_range") == 0) & (F.col("bad_side") == 0) & (F.col("locate_mismatch") == 0))
    return one if given else one.drop("file")


def verdict(checks: DataFrame, scan: DataFrame) -> DataFrame:
    """The checks of `stream_checks` with clean_eof of `scan_summary`; ok also needs that each file ends just after its last frame."""
    rows = scan.select("file", "clean_eof").join(checks, "file", "left")
    return rows.withColumn("ok", F.coalesce("ok", F.lit(True)) & F.col("clean_eof"))




def lifecycle(frames: DataFrame) -> DataFrame:
    """The system events in order: seq, at (HH:MM:SS), event_code."""
    return decoded(frames, "S").select("seq", m.clock("ts_ns").alias("at"), "event_code").orderBy("seq")
