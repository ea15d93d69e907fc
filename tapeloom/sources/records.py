"""Record files, their sidecars, and Parquet tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tapeloom.functions import market as m
from tapeloom.sources.files import PartsWriter, list_files, open_path

# The records, little-endian: (name, offset, width).
TRADE = (24, (("ts_ns", 0, 8), ("price", 8, 4), ("shares", 12, 4), ("locate", 16, 2), ("side", 18, 1), ("kind", 19, 1), ("pad", 20, 4)))
L1 = (32, (("ts_ns", 0, 8), ("bid_px", 8, 4), ("ask_px", 12, 4), ("bid_sz", 16, 4), ("ask_sz", 20, 4), ("locate", 24, 2), ("bid_ct", 26, 2), ("ask_ct", 28, 2), ("pad", 30, 2)))


#: Records of one partition, and of one batch.
SPLIT, BATCH = 1 << 22, 1 << 18


class _Range(InputPartition):
    def __init__(self, number: int, path: str, first: int, end: int, base: int):
        super().__init__(number)
        self.path, self.first, self.end, self.base = path, first, end, base


def record_counts(path: str, width: int) -> list[tuple[str, int]]:
    """Records of a file, or of each part of a folder in order."""
    out = []
    for part, size in list_files(path):
        if size % width:
            raise ValueError(f"{part}: {size} bytes are no multiple of {width}")
        out.append((part, size // width))
    return out


class RecordsReader(DataSourceReader):
    def __init__(self, path: str, layout: tuple, split: int):
        self.path, (self.width, self.fields), self.split = path, layout, split

    def partitions(self) -> list[InputPartition]:
        out, base = [], 0
        for path, n in record_counts(self.path, self.width):
            out += [_Range(len(out) + i, path, at, min(n, at + self.split), base) for i, at in enumerate(range(0, n, self.split))]
            base += n
        return out or [_Range(0, self.path, 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        record = np.dtype({"names": [n for n, _, _ in self.fields], "formats": [f"<u{w}" for _, _, w in self.fields], "offsets": [o for _, o, _ in self.fields], "itemsize": self.width})
        if partition.first >= partition.end:
            return
        system, name = open_path(partition.path)
        with system.open_input_file(name) as f:
            f.seek(partition.first * self.width)
            for at in range(partition.first, partition.end, BATCH):
                rows = np.frombuffer(f.read(min(BATCH, partition.end - at) * self.width), record)
                columns = [pa.array(rows[n].astype("i8" if w >= 4 else "i4")) for n, _, w in self.fields]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows)) + partition.base), *columns], ["seq", *[n for n, _, _ in self.fields]])


class RecordsWriter(PartsWriter):
    """Records of one layout, from columns of its fields' names; a field without a column is 0. A value that does not fit its field is an error, so nothing is written then."""

    def __init__(self, path: str, overwrite: bool, layout: tuple):
        super().__init__(path, overwrite)
        self.layout = layout

    def encode(self, batch: pa.RecordBatch) -> bytes:
        width, fields = self.layout
        record = np.dtype({"names": [n for n, _, _ in fields], "formats": [f"<u{w}" for _, _, w in fields], "offsets": [o for _, o, _ in fields], "itemsize": width})
        rows = np.zeros(batch.num_rows, record)
        for n, _, w in fields:
            if (at := batch.schema.get_field_index(n)) < 0:
                continue
            column = batch.column(at)
            if column.null_count:
                raise ValueError(f"{n} is null")
            values = column.to_numpy(zero_copy_only=False)
            if len(values) and (values.min() < 0 or int(values.max()) >> 8 * w):
                raise ValueError(f"{n} does not fit {w} bytes")
            rows[n] = values
        return rows.tobytes()


class RecordsDataSource(DataSource):
    """format("records"): options path, kind (trades, l1) and split (records of a partition). A partition is a range of records, read in batches; seq is the record's place in the file.

    A folder of parts is read as one file, and written a part a task.
    """

    LAYOUTS = {"trades": TRADE, "l1": L1}

    @classmethod
    def name(cls) -> str:
        return "records"

    def _layout(self) -> tuple:
        return self.LAYOUTS[self.options["kind"]]

    def schema(self) -> str:
        return ", ".join(["seq long", *[f"{n} {'long' if w >= 4 else 'int'}" for n, _, w in self._layout()[1]]])

    def reader(self, schema) -> RecordsReader:
        return RecordsReader(self.options["path"], self._layout(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> RecordsWriter:
        return RecordsWriter(self.options["path"], overwrite, self._layout())


def _kind(layout: tuple) -> str:
    return next(k for k, x in RecordsDataSource.LAYOUTS.items() if x == layout)


def read_records(spark: SparkSession, path: str, layout: tuple, split: int = SPLIT) -> DataFrame:
    """A file (or a folder of parts) of fixed-length records, `split` of them in a partition: seq and the record's fields. A size that is no multiple of the record is an error."""
    spark.dataSource.register(RecordsDataSource)
    record_counts(path, layout[0])
    return spark.read.format("records").option("path", path).option("kind", _kind(layout)).option("split", split).load()


def write_records(rows: DataFrame, path: str, layout: tuple, parts: int | None = None) -> None:
    """Writes trades.bin or l1.bin: records in the order of `seq`, a range of it in each of the `parts` (or as many as Spark sees fit) of a folder that `read_records` takes for one file. A side may be a letter.

    If a task fails for good no file is left. Rows of several days need a folder for each.
    """
    rows.sparkSession.dataSource.register(RecordsDataSource)
    if dict(rows.dtypes).get("side") == "string":
        rows = rows.withColumn("side", F.when(F.col("side") == "B", 0x42).when(F.col("side") == "S", 0x53).otherwise(0))
    names = [F.col(n).cast("long").alias(n) for n, _, _ in layout[1] if n in rows.columns]
    ordered = rows.repartitionByRange(*([parts] if parts else []), "seq").sortWithinPartitions("seq").select(*names)
    ordered.write.format("records").option("kind", _kind(layout)).mode("append").save(path)


def read_symbols(spark: SparkSession, path: str, stripped: bool = True) -> DataFrame:
    """symbols.csv: locate, symbol (trimmed, or as it stands if not `stripped`); of repeated locates the last row."""
    rows = spark.read.csv(path, schema="locate int, symbol string", header=True, enforceSchema=False, ignoreLeadingWhiteSpace=stripped, ignoreTrailingWhiteSpace=stripped)
    rows = rows.where("locate is not null").select("locate", (F.trim("symbol") if stripped else F.col("symbol")).alias("symbol"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("locate").agg(F.max_by("symbol", "at").alias("symbol"))


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    names = ("locate", "adds", "executes", "cancels", "deletes", "replaces")
    return spark.read.csv(path, schema=", ".join(f"{n} long" for n in names), header=True, enforceSchema=False)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """meta.txt: key, value, cut at the first '='."""
    rows = spark.read.text(path).where(F.contains("value", F.lit("=")))
    return rows.select(F.substring_index("value", "=", 1).alias("key"), F.expr("substring(value, locate('=', value) + 1)").alias("value"))


def kind_name() -> Column:
    return m.name_of("kind", m.KIND_NAMES)


def named_trades(trades: DataFrame, symbols: DataFrame) -> DataFrame:
    """Trade records with symbol, side as a letter and kind_name; unknown codes are ''."""
    rows = m.with_symbols(trades, symbols)
    return rows.withColumn("side", m.name_of("side", {0x42: "B", 0x53: "S"})).withColumn("kind_name", kind_name()).drop("pad")


def write_table(rows: DataFrame, path: str, by: str | None = None, scope: str | None = None) -> None:
    """Parquet with zstd, split by a column if named. `scope` is kept as a comment on every column, which Spark reads back."""
    if scope is not None:
        rows = rows.select([F.col(c).alias(c, metadata={"scope": scope}) for c in rows.columns])
    w = rows.write.option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def write_csv(rows: DataFrame, path: str, missing: str = "-") -> None:
    """CSV with a header; null becomes `missing`."""
    rows.select([F.coalesce(F.col(x).cast("string"), F.lit(missing)).alias(x) for x in rows.columns]).write.csv(path, header=True)


def write_lines(rows: DataFrame, path: str, key: str, value: str | None = None) -> None:
    """key=value lines (meta.txt), or one value a line (symbols.txt)."""
    text = F.concat_ws("=", F.col(key).cast("string"), F.col(value).cast("string")) if value else F.col(key).cast("string")
    rows.select(text.alias("value")).write.text(path)
