"""Source and sink of framed byte streams: a two-byte big-endian length before each payload.

Each length tells where the next frame is, so a stream can only be followed from its start. To read one file by many tasks it is cut into byte ranges.
Whatever frame the true chain starts a range with, it is among the places that chains from all offsets shortly before the range lead to. These chains merge
soon, so a range has few such entries; `range_map` follows each of them to the range's end, for all ranges at once. Putting the maps one behind the other
from the file's first byte (`index_of`) gives the true entry of every range and the number of its first frame, and then all ranges are read side by side.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tapeloom.sources.files import PartsWriter, list_files, open_path

#: Bytes read from a file at a time, bytes of one range, and the most ranges of one read: beyond it ranges get longer, so what the driver puts together stays small.
BLOCK, SPLIT, RANGES = 1 << 22, 1 << 25, 20_000
#: Ranges for each core from which shorter ones than SPLIT get longer: each costs a task in every read, and a run-up once.
PER_CORE = 4
#: Bytes of the longest frame, and from how far before a range chains are followed up to it.
LONGEST, RUN_UP = (1 << 16) + 1, 1 << 20
SCHEMA = "file string, seq long, offset long, payload binary"
HEADER = ", kind string, locate int, ts_ns long"


def follow(data: bytes, at: int, limit: int) -> tuple[list[int], int, bool]:
    """The places of whole frames that start from `at` on and before `limit`, where the next one is, and whether its length is zero. Stops before a frame that `data` cuts off."""
    out, end = [], len(data)
    limit = min(limit, end - 1)
    add = out.append
    while at < limit:
        n = data[at] << 8 | data[at + 1]
        if not n:
            return out, at, True
        if at + 2 + n > end:
            break
        add(at)
        at += 2 + n
    return out, at, False


def entries(data: bytes, begin: int) -> list[int]:
    """All places from `begin` on that a chain can come to first if it passes one of the first LONGEST offsets, as every chain from before them does.

    Every offset points at the next; pointing twice as far in each round, all of them come to `begin` in a logarithm of rounds.
    """
    raw, lost = np.frombuffer(data, np.uint8), begin + LONGEST + 1
    to = np.arange(lost + 1, dtype=np.int32)
    to[:begin] = lost
    here = np.arange(max(0, min(begin, len(raw) - 1)), dtype=np.int32)
    n = raw[here].astype(np.int32) << 8 | raw[here + 1]
    to[here] = np.where(n > 0, here + 2 + n, lost)
    while not np.array_equal(further := to[to], to):
        to = further
    found = np.unique(to[:LONGEST])
    return found[(found >= begin) & (found < lost)].tolist()


def exits(data: bytes, starts: Iterable[int], limit: int) -> dict[int, tuple[int, int, bool]]:
    """For each start: where its chain is at or beyond `limit`, its frames before that, and whether it ends for good before `limit`. Chains that meet go on as one.

    `data` has the whole of every frame that starts before `limit`, but for one that the file cuts off.
    """
    done: dict[int, tuple[int, int, bool]] = {}
    members = {s: [(s, 0)] for s in starts}  # place of a chain -> its starts, and their frames less the chain's
    heap = sorted(members)
    count = dict.fromkeys(heap, 0)
    while heap:
        at = heapq.heappop(heap)
        own, n = members.pop(at), count.pop(at)
        # on to the next place of another chain, or to the end
        places, to, stopped = follow(data, at, min(limit, heap[0] if heap else limit))
        n += len(places)
        if to >= limit or stopped or to + 1 >= len(data) or to + 2 + (data[to] << 8 | data[to + 1]) > len(data):
            for s, less in own:
                done[s] = (to, n + less, to < limit)
        elif to in members:
            members[to] += [(s, less + n - count[to]) for s, less in own]
        else:
            members[to], count[to] = own, n
            heapq.heappush(heap, to)
    return done


def range_map(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For ranges (path, size, begin, end) of files: entry, exit, frames and stopped for every place where a chain may enter the range."""
    for batch in batches:
        for path, size, begin, end in batch[["path", "size", "begin", "end"]].itertuples(index=False):
            first = max(0, begin - RUN_UP)
            system, name = open_path(path)
            with system.open_input_file(name) as f:
                f.seek(first)
                data = f.read(min(size, end + LONGEST + 1) - first)
            starts = [0] if not begin else [follow(data, 0, begin)[1]] if not first else entries(data, begin - first)
            rows = [(path, begin, s + first, to + first, n, over) for s, (to, n, over) in exits(data, [s for s in starts if s + first < end], end - first).items()]
            yield pd.DataFrame(rows, columns=["path", "begin", "entry", "exit", "frames", "stopped"])


def range_bytes(total: int, split: int, cores: int) -> int:
    """Bytes of a range for streams of `total` bytes: `split`, but up to SPLIT where that still leaves PER_CORE ranges for each core, and beyond it from RANGES ranges on."""
    return max(split, min(SPLIT, total // (PER_CORE * max(1, cores))), total // RANGES)


def index_of(spark: SparkSession, streams: list[tuple[str, list[tuple[str, int]]]], split: int) -> list[tuple]:
    """The ranges of all streams (name, parts): name, path, begin (a frame's place), end, number of its first frame, bytes of the stream before the part, frames (-1: not counted).

    A part of one range is not looked at, unless another part of its stream follows. Few rows a range reach the driver, and ranges are at most about RANGES.
    """
    split = range_bytes(sum(s for _, parts in streams for _, s in parts), split, spark.sparkContext.defaultParallelism)
    ranges = [(path, size, at, min(size, at + split)) for _, parts in streams for path, size in parts if size > split or len(parts) > 1 for at in range(0, size, split)]
    maps: dict[tuple, dict] = {}
    if ranges:
        table = spark.createDataFrame(ranges, "path string, size long, begin long, end long").coalesce(1).repartition(min(len(ranges), 4096))  # in turn, as hashes would give some tasks several
        for r in table.mapInPandas(range_map, "path string, begin long, entry long, exit long, frames long, stopped boolean").collect():
            maps.setdefault((r.path, r.begin), {})[r.entry] = (r.exit, r.frames, r.stopped)
    out = []
    for name, parts in streams:
        seq, base, stopped = 0, 0, False
        for path, size in parts:
            at = 0
            if len(parts) == 1 and size <= split:
                out.append((name, path, 0, size, 0, 0, -1))
            else:
                for begin in range(0, size, split):
                    end = min(size, begin + split)
                    if stopped or at >= end:
                        continue
                    to, frames, stopped = maps[path, begin][at]
                    out.append((name, path, at, end, seq, base, frames))
                    at, seq = to, seq + frames
            base += size
    return out


class _Stretch(InputPartition):
    def __init__(self, number: int, stretch: list):
        super().__init__(number)
        self.stretch = stretch


#: A byte as a letter: those of this wire format are ASCII, others come as Latin-1.
LETTERS = np.array([chr(x) for x in range(256)])
#: Filter -> comparison of a column with its value.
OPS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: np.isin(x, list(v)),
}


class FramesReader(DataSourceReader):
    def __init__(self, stretches: list, header: bool):
        self.stretches, self.header = stretches, header
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of every column but payload with plain values are decided here, on the raw bytes."""
        for f in filters:
            plain = type(f) in OPS and f.attribute[0] != "payload" and None not in (f.value if isinstance(f, In) else (f.value,))
            there = isinstance(f, IsNotNull) and f.attribute[0] in ("file", "seq", "offset", "kind")
            if plain or there:
                self.kept += [f] * plain
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The ranges that may hold a row: others are pruned by file and by numbers of frames."""
        out = []
        for s in self.stretches:
            name, _, _, _, seq, _, frames = s
            may = True
            for f in self.kept:
                op, (column,) = OPS[type(f)], f.attribute
                if column == "file":
                    may &= bool(op(np.array([name]), f.value)[0])
                elif column == "seq" and frames >= 0:
                    low, high = seq, seq + frames - 1
                    values = list(f.value) if isinstance(f, In) else [f.value]
                    may &= any(low <= v <= high for v in values) if isinstance(f, (EqualTo, In)) else bool(op(high if isinstance(f, (GreaterThan, GreaterThanOrEqual)) else low, f.value))
            if may:
                out.append(_Stretch(len(out), s))
        return out or [_Stretch(0, ["", "", 0, 0, 0, 0, 0])]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        name, path, at, end, seq, base, _ = partition.stretch
        if at >= end:
            return
        system, file = open_path(path)
        with system.open_input_file(file) as f:
            f.seek(at)
            rest, stopped = b"", False
            while not stopped and at < end and (chunk := f.read(BLOCK)):
                data = rest + chunk
                places, to, stopped = follow(data, 0, end - at)
                if places:
                    yield self._batch(name, np.frombuffer(data, np.uint8), np.array(places), seq, base + at)
                seq += len(places)
                rest, at = data[to:], at + to

    def _batch(self, name: str, raw: np.ndarray, at: np.ndarray, seq: int, offset: int) -> pa.RecordBatch:
        size = (raw[at].astype(np.int32) << 8) | raw[at + 1]
        columns = {"seq": np.arange(seq, seq + len(at)), "offset": offset + at}
        missing = {}
        if self.header:
            byte = lambda k: raw[np.minimum(at + 2 + k, len(raw) - 1)]
            columns["kind"] = byte(0)
            columns["locate"] = (byte(1).astype(np.int32) << 8) | byte(2)
            ts = np.zeros(len(at), np.int64)
            for k in range(5, 11):
                ts = ts << 8 | byte(k)
            columns["ts_ns"] = ts
            missing = {"locate": size < 3, "ts_ns": size < 11}
        keep = np.ones(len(at), bool)
        for f in self.kept:
            (column,), value = f.attribute, f.value
            if column == "file":
                x = np.full(len(at), name)
            elif column == "kind":
                x = LETTERS[columns["kind"]]
            else:
                x = columns[column]
            keep &= OPS[type(f)](x, value)
            if column in missing:
                keep &= ~missing[column]
        at, size = at[keep], size[keep]
        # payloads stand close together but for the lengths between them
        mark = np.zeros(len(raw) + 1, np.int8)
        mark[at + 2] = 1
        mark[at + 2 + size] -= 1
        values = raw[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
        ends = np.zeros(len(at) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        payload = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(values)])
        out = [pa.repeat(name, len(at)), pa.array(columns["seq"][keep]), pa.array(columns["offset"][keep]), payload]
        names = ["file", "seq", "offset", "payload"]
        if self.header:
            kind = pa.DictionaryArray.from_arrays(pa.array(columns["kind"][keep].astype(np.int16)), pa.array(LETTERS.tolist())).cast(pa.string())
            out += [kind, *[pa.array(columns[c][keep], mask=missing[c][keep]) for c in ("locate", "ts_ns")]]
            names += ["kind", "locate", "ts_ns"]
        return pa.RecordBatch.from_arrays(out, names)


class _FramesWriter(PartsWriter):
    def encode(self, batch: pa.RecordBatch) -> bytes:
        payload = batch.column(batch.schema.get_field_index("payload")).cast(pa.binary())
        _, ends, values = payload.buffers()
        ends = np.frombuffer(ends, np.int32)[payload.offset : payload.offset + len(payload) + 1]
        size = np.diff(ends)
        if payload.null_count or not ((size > 0) & (size < 1 << 16)).all():
            raise ValueError("a payload has 1 to 65,535 bytes")
        # a length stands before each payload
        at = ends[:-1].astype(np.int64) - ends[0] + 2 * np.arange(len(size))
        out = np.empty(ends[-1] - ends[0] + 2 * len(size), np.uint8)
        plain = np.ones(len(out), bool)
        plain[at] = plain[at + 1] = False
        out[at], out[at + 1], out[plain] = size >> 8, size & 255, np.frombuffer(values, np.uint8)[ends[0] : ends[-1]]
        return out.tobytes()


class FramesDataSource(DataSource):
    """format("frames"): option path or paths (comma-joined; a folder's files are streams of their own, or one stream by their names with joined=true), and header=true for the columns kind, locate and ts_ns.

    Columns: file, seq (from 0 in each stream), offset, payload. Without an `index` (see `read_frames`) each file is one task.
    Filters on all columns but payload are pushed down: frames that they leave out are never copied. Written folders hold a part a task.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def _on(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def schema(self) -> str:
        return SCHEMA + HEADER * self._on("header")

    def reader(self, schema) -> FramesReader:
        index = self.options.get("index")
        stretches = json.loads(index) if index else [[p, p, 0, size, 0, 0, -1] for path in _paths(self.options) for p, size in list_files(path)]
        return FramesReader(stretches, self._on("header"))

    def writer(self, schema, overwrite: bool) -> _FramesWriter:
        return _FramesWriter(self.options["path"], overwrite)


def _paths(options) -> list[str]:
    return [p for p in (options.get("paths") or options.get("path", "")).split(",") if p]


def read_frames(spark: SparkSession, path: str, split: int = SPLIT, joined: bool = False, header: bool = False) -> DataFrame:
    """The frames of a file or of all files of a folder, read by ranges of about `split` bytes, or longer ones (`range_bytes`) where there would be many for each core.

    A stream ends at a zero length or a frame that is cut off. `joined`: a folder's files are one stream, each from a frame's start on, as `write_frames` makes them.
    Finding where ranges start reads files longer than `split` once more. Turns on Spark's push-down into Python sources for the session.
    """
    spark.dataSource.register(FramesDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = list_files(path)
    index = index_of(spark, [(path, files)] if joined else [(p, [(p, size)]) for p, size in files], split)
    return spark.read.format("frames").option("path", path).option("header", str(header).lower()).option("index", json.dumps(index)).load()


def write_frames(frames: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes payloads in the order of seq, a range of it in each part (`parts` of them, or as Spark sees fit). No part is left if a task fails."""
    frames.sparkSession.dataSource.register(FramesDataSource)
    frames.select("seq", "payload").repartitionByRange(*([parts] if parts else []), "seq").sortWithinPartitions("seq").write.format("frames").mode("append").save(path)


def scan_summary(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each file of `sizes` (file, size): messages, bytes framed, and whether the frames end just where the file does."""
    per = frames.groupBy("file").agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload") + 2).alias("bytes"))
    rows = sizes.join(per, "file", "left").na.fill(0, ["messages", "bytes"])
    return rows.select("file", "size", "messages", "bytes", (F.col("bytes") == F.col("size")).alias("clean_eof"))
