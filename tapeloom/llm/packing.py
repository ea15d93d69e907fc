"""Packing: minimum bin slack over the counts of piece lengths."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import running_totals, written

TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, as the `tokenizers` file at `path` gives them.

    Beside byte_bpe_50k.json lies the same vocabulary as ranks, for tiktoken, which is several times faster
    and gives the same ids. The two split texts by the same pattern, but by Unicode tables of their own, so a text
    with characters beyond Latin letters and plain white space goes to `tokenizers` itself; so does
    every text where there is no file of ranks.
    """

    LATIN = re.compile("[^\t\n\r -~\u00a1-\u024f]")

    def __init__(self, path: str):
        self.path, self.ranks, self.model = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.basename(path) == TOKENIZER and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding(TOKENIZER, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.ranks is not None and not self.LATIN.search(text):
            return self.ranks.encode_to_numpy(text).astype("<u4").tobytes()
        if self.model is None:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path)
            self.model.encode_special_tokens = True  # their strings are ordinary text here
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Cuts the token ids of every row of `docs` (doc_id, text), each document ended by id 0, into pieces of
    at most `capacity`: doc_id, start, length, ids_crc32, doc_tokens and, with keep_ids, ids.

    All pieces but a document's last are full. Null and empty texts have the one id 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = Encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        step = 4 * capacity
        for batch in batches:
            row: list[int] = []
            new: dict[str, list] = {c: [] for c in ("start", "length", "ids_crc32", "doc_tokens")}
            pieces: list[np.ndarray] = []
            for i, text in enumerate(batch.column(1)):
                ids = (encoder(t) if (t := text.as_py()) else b"") + b"\0\0\0\0"
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    row.append(i)
                    new["start"].append(at // 4)
                    new["length"].append(len(piece) // 4)
                    new["ids_crc32"].append(zlib.crc32(piece))
                    new["doc_tokens"].append(len(ids) // 4)
                    if keep_ids:
                        pieces.append(np.frombuffer(piece, "<u4").astype("i8"))
            columns = {"doc_id": batch.column(0).take(pa.array(row, pa.int64()))} | {c: pa.array(v, pa.int64()) for c, v in new.items()}
            if keep_ids:
                columns["ids"] = pa.array(pieces, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def fill_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Minimum bin slack: how often to use which multiset of lengths, [(times, {length: number})].

    Each window starts with the longest length left. A bitset holds which sums the remaining lengths can
    reach (length by length, each as often as it is left); the largest sum that fits is traced back
    through the bitsets to the numbers of each length. The multiset is used as often as the counts allow
    before the next one is sought, so the work depends on `capacity`, not on how many pieces there are.
    """
    left, plan = dict(counts), []
    while left:
        top = max(left)
        room, bits, mask = capacity - top, 1, (1 << (capacity - top + 1)) - 1
        steps: list[tuple[int, int, int]] = []  # length, how many at most, the sums reached before it
        if room and room in left and (room != top or left[top] > 1):
            pattern = {top: 1}
            pattern[room] = pattern.get(room, 0) + 1
        else:
            for length in sorted(left, reverse=True):
                most = min(left[length] - (length == top), room // length)
                if most <= 0:
                    continue
                steps.append((length, most, bits))
                n = 1
                while most:  # n at a time: 1, 2, 4, ... and the rest
                    n = min(n, most)
                    bits |= (bits << n * length) & mask
                    most -= n
                    n *= 2
                if bits >> room & 1:
                    break
            pattern, total = {top: 1}, bits.bit_length() - 1
            for length, most, before in reversed(steps):
                n = next(k for k in range(most + 1) if total >= k * length and before >> (total - k * length) & 1)
                if n:
                    pattern[length] = pattern.get(length, 0) + n
                    total -= n * length
        times = min(left[x] // n for x, n in pattern.items())
        plan.append((times, pattern))
        for x, n in pattern.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
    return plan


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (doc_id, start, length <= capacity, ...).

    Only the count of each length (at most `capacity` rows) goes to the driver, which plans there; pieces
    then find their place from their number among the pieces of the same length, which comes from
    distributed prefix sums. A length that most pieces share is spread over many partitions.
    """
    pieces = running_totals(pieces.withColumn("_one", F.lit(1).cast("long")), ["length"], ["doc_id", "start"], {"_one": "_nth"}).drop("_one", "_nth_all")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first piece, first sequence, pieces a sequence, offset
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in fill_patterns(counts, capacity):
        offset = 0
        for length, n in pattern.items():
            slots.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    tables = {k: np.array(v, dtype="i8").T for k, v in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = (np.asarray(batch.column(c)) for c in ("length", "_nth"))
            where, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, seq, n, off = tables[int(x)]
                k = np.searchsorted(first, nth[at], side="right") - 1
                i = nth[at] - first[k]
                where[at], offset[at] = seq[k] + i // n[k], off[k] + i % n[k] * x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(where), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c != "_nth"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_nth") + ", sequence_id long, offset long"
    return pieces.select(*kept, "_nth").mapInArrow(place, schema)


def packed(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Packs all `docs` (doc_id, text) into sequences of at most `capacity` tokens; one row for each piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset. Full pieces fill
    sequences of their own; what remains of each document is packed by minimum bin slack. Null and
    empty texts count as the one end id; null doc_ids stay null; repeated rows are packed each; an
    empty table gives no rows; other columns are not read.
    """
    # written, as the range partitioning reads its input twice
    return place_pieces(written(tokenized_pieces(docs, capacity, tokenizer, keep_ids)), capacity)


def sequences(pieces: DataFrame, capacity: int = 1024, pad: int = 0) -> DataFrame:
    """The padded sequences: sequence_id, ids array<long> of `capacity`, from pieces with ids."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    return rows.select("sequence_id", F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), capacity)), 1, capacity).alias("ids"))


def op1_query(spark, sf_dir: str) -> DataFrame:
    rows = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), 1024, keep_ids=False)
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
