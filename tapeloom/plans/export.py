"""From frames to exports in one call: tape, top of book, directory, operation counts and totals, and the checks of a replay."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.storage import stored
from tapeloom.operators import book, decode
from tapeloom.sources import records


class Replay:
    """What a feed makes: every table has `day`, a number for each file. A table is made when it is first asked for, so the directory alone replays no book."""

    def __init__(self, rows: DataFrame, messages: DataFrame):
        self._rows, self.messages = rows, messages

    @cached_property
    def effects(self) -> DataFrame:
        return book.effects(decode.operations(self._rows))

    @cached_property
    def tops(self) -> DataFrame:
        return stored(book.tops(self.effects))

    @cached_property
    def trades(self) -> DataFrame:
        return book.trade_tape(self.effects, decode.prints(self._rows))

    @cached_property
    def l1(self) -> DataFrame:
        return book.l1_stream(book.checked_tops(self.effects, self.tops))

    @cached_property
    def symbols(self) -> DataFrame:
        return stored(decode.directory(self._rows).drop("file").where("symbol <> ''"))

    @cached_property
    def ops(self) -> DataFrame:
        """Counts of the locates that the directory names."""
        ops = book.operation_counts(self.effects)
        return self.symbols.select("day", "locate").join(ops, book.BOOK, "left").na.fill({c: 0 for c in ops.columns if c not in book.BOOK})

    @cached_property
    def control(self) -> DataFrame:
        return decode.control(self._rows)

    def crossings(self) -> DataFrame:
        return book.crossings(self.effects, self.tops, self.control)

    def violations(self) -> DataFrame:
        return book.violations(self.effects, stored(self.crossings()))


def replay(frames: DataFrame, days: DataFrame | None = None, symbol: str | None = None) -> Replay:
    """Replays `frames` (file, seq, payload), each file to its first bad message; with `symbol`, only that symbol's books and prints.

    Files are days of their own (`days`: file, day), so seq, locate and ref need not differ between them. ops has
    only locates that the directory names.
    """
    rows = decode.days_before_failure(frames, days)
    counted = rows.groupBy("day", "file").agg(F.count("*").alias("messages"))
    return Replay(rows if symbol is None else decode.tracked(rows, symbol), counted)


def totals(x: Replay) -> DataFrame:
    """day, key, value: source, messages, trades and l1 of each day, as meta.txt has them."""
    counts = x.messages.withColumnRenamed("file", "source")
    for name, rows in (("trades", x.trades), ("l1", x.l1)):
        counts = counts.join(rows.groupBy("day").agg(F.count("*").alias(name)), "day", "left")
    counts = counts.na.fill(0, ["trades", "l1"])
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(("source", "messages", "trades", "l1"))])
    return counts.select("day", F.explode(pairs).alias("p")).select("day", "p.*")


def write_export(x: Replay, path: str) -> None:
    """Writes trades and l1 as Parquet with symbols, and symbols.csv, ops.csv and meta.txt as folders of text, split by day where that is a column.

    symbols.csv and ops.csv hold only locates with a symbol, in order.
    """
    trades = book_symbols(x.trades, x.symbols).withColumn("kind_name", records.kind_name())
    for name, rows in (("trades", trades), ("l1", book_symbols(x.l1, x.symbols))):
        records.write_table(rows.repartitionByRange("day", "seq").sortWithinPartitions("day", "seq"), f"{path}/{name}.parquet", "day")
    # a day's directory has at most 65,536 rows
    x.symbols.repartition("day").sortWithinPartitions("day", "locate").select("day", "locate", "symbol").write.partitionBy("day").csv(f"{path}/symbols.csv", header=True)
    x.ops.repartition("day").sortWithinPartitions("day", "locate").select("day", "locate", "adds", "executes", "cancels", "deletes", "replaces").write.partitionBy("day").csv(f"{path}/ops.csv", header=True)
    lines = totals(x).repartition("day").sortWithinPartitions("day", "at")
    lines.select("day", F.concat_ws("=", "key", "value").alias("value")).write.partitionBy("day").text(f"{path}/meta.txt")


def book_symbols(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds `symbol` by day and locate, '' where the directory has none; a day has at most 65,536 locates, so the join shuffles only over many days."""
    return rows.join(symbols, book.BOOK, "left").withColumn("symbol", F.coalesce("symbol", F.lit("")))
