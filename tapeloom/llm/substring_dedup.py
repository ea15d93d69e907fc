"""Substring dedup: long passages that an earlier document has too are cut out, found with a compacted De Bruijn graph of words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import joined_counted, written
from tapeloom.llm.shingles import BASE, INVERSE, U64, mixed_bits

#: Words of a window (an edge of the graph), and of an anchor, of which every window has one.
WIDTH, ANCHOR = 50, 12
#: Bytes of text worked on at a time; a longer text is hashed in such blocks, but its words' hashes are held at once.
CHUNK = 1 << 20
#: Bits of the filter that tells which texts have to be shuffled (8 MB, whatever the input).
FILTER_BITS = 1 << 26
LOW32 = U64(0xFFFFFFFF)

INSIDE = np.ones(256, bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False
COEF = mixed_bits(np.arange(101, 101 + ANCHOR, dtype=U64)) | U64(1)

PIECES = "doc_id long, key long, start int, windows int, a long, c long, prev long, next long"
WINDOWS = "doc_id long, c long, j int, w long"
FOUND = "doc_id long, key long, n_words long, sha string, text string"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, digests array<struct<unit:bigint,digest:bigint>>"


class Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                p = np.full(max(n, 2 * CHUNK), base, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


def word_hashes(raw: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and where it starts."""
    data, at, hashes, starts = np.frombuffer(raw, np.uint8), 0, [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data) and INSIDE[data[end - 1]]:  # a block ends behind white space
            gaps = np.flatnonzero(~INSIDE[data[end : end + CHUNK]])
            end += int(gaps[0]) + 1 if len(gaps) else min(CHUNK, len(data) - end)
        block = data[at:end]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], INSIDE[block], [False]))))
        first, last = edges[0::2], edges[1::2]
        up, down = powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, U64)
        np.cumsum((block.astype(U64) + U64(1)) * up[: len(block)], out=sums[1:])
        hashes.append(mixed_bits((sums[last] - sums[first]) * down[first] + (last - first).astype(U64)))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


class Hashed:
    """The words of a run of texts as hashes; `doc` tells a word's text, `begin` each text's first word."""

    def __init__(self, texts: list[bytes], powers: Powers):
        self.h, at = word_hashes(b" ".join(texts), powers)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.begin = np.searchsorted(at, bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.append(self.begin, len(at))))
        up, self.down = powers(len(self.h) + 1)
        self.sums = np.zeros(len(self.h) + 1, U64)
        np.cumsum(self.h * up[: len(self.h)], out=self.sums[1:])

    def spans(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from `first` up to `end`, wherever they stand."""
        return mixed_bits((self.sums[end] - self.sums[first]) * self.down[first] + (end - first).astype(U64)).view(np.int64)

    def pieces(self) -> tuple[np.ndarray, ...]:
        """Runs of windows with the same anchor: first word, windows, anchor's hash, hash of all their words.

        The anchor of a window is its least sequence of ANCHOR words by hash, the last one of equals. It depends on the window's words alone,
        so equal windows have equal anchors at the same place.
        """
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        n = len(self.h)
        if n < WIDTH:
            return none
        m = n - ANCHOR + 1
        g = np.zeros(m, U64)
        for k in range(ANCHOR):
            g += self.h[k : k + m] * COEF[k]
        g = mixed_bits(g)
        least = (g & ~LOW32) | (LOW32 - np.arange(m, dtype=U64))
        covered, need = 1, WIDTH - ANCHOR + 1
        while 2 * covered <= need:
            least = np.minimum(least[:-covered], least[covered:])
            covered *= 2
        if covered < need:
            least = np.minimum(least[: len(least) - (need - covered)], least[need - covered :])
        s = np.flatnonzero(self.doc[: n - WIDTH + 1] == self.doc[WIDTH - 1 :])
        if not len(s):
            return none
        at = (LOW32 - (least[s] & LOW32)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1))))
        windows = np.diff(np.append(new, len(s)))
        first = s[new]
        return first, windows, g[at[new]].view(np.int64), self.spans(first, first + windows + WIDTH - 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows (without text, which is the last column) and texts in runs of about CHUNK bytes."""
    rows, texts, size = [], [], 0
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns - 1)), strict=True)):
            raw = text[i].as_py().encode()
            if texts and size + len(raw) > CHUNK:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(row)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield rows, texts


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[t]) for v, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for rows, texts in _runs(batches):
        x = Hashed(texts, powers)
        first, windows, a, c = x.pieces()
        if not len(first):
            continue
        doc = x.doc[first]
        ids, keys = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        same = doc[1:] == doc[:-1]
        prev, next_ = np.zeros_like(a), np.zeros_like(a)
        prev[1:][same], next_[:-1][same] = a[:-1][same], a[1:][same]
        yield _batch(PIECES, [ids[doc], keys[doc], first - x.begin[doc], windows, a, c, prev, next_])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the pieces asked for: doc_id, the piece's hash, the window's number in the piece and its hash."""
    powers = Powers()
    for rows, texts in _runs(batches):
        x = Hashed(texts, powers)
        asked = [(i, r[0], p) for i, r in enumerate(rows) for p in r[1]]
        at = np.array([x.begin[i] + p["start"] for i, _, p in asked], np.int64)
        many = np.array([p["windows"] for _, _, p in asked], np.int64)
        j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        s = np.repeat(at, many) + j
        yield _batch(WINDOWS, [np.repeat(np.array([d for _, d, _ in asked], np.int64), many), np.repeat(np.array([p["c"] for _, _, p in asked], np.int64), many), j, x.spans(s, s + WIDTH)])


def _filter_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = key.view(U64)
    return k % U64(FILTER_BITS), (k >> U64(32)) % U64(FILTER_BITS)


def _whole(bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words and hash of each whole text; the text itself only if its key may be one that the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint8)
        has = lambda p: (known[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8)) & 1
        for batch in batches:
            one, two = _filter_places(np.array(batch.column(1)))
            may = (has(one) & has(two)).astype(bool)
            words, shas, texts = [], [], []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                own = [] if may[i] else text.encode().split()  # of bytes, split() takes exactly the six kinds of white space
                words.append(len(own))
                shas.append(None if may[i] else hashlib.sha256(b" ".join(own)).hexdigest())
                texts.append(text if may[i] else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "key", "n_words", "sha", "text"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of each document, and a digest of the words of every span asked for."""
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for i in range(batch.num_rows):
            doc_id, n, sha, text, spans = (batch.column(c)[i].as_py() for c in range(5))
            removed, digests = 0, []
            if text is not None:
                words = text.encode().split()
                n, gone = len(words), np.zeros(len(words) + 1, np.int32)
                for p in spans or ():
                    end = p["start"] + p["windows"] + WIDTH - 1
                    if p["unit"] is not None:
                        digests.append({"unit": p["unit"], "digest": int.from_bytes(hashlib.md5(b" ".join(words[p["start"] : end])).digest()[:8], "big", signed=True)})
                    if p["removed"]:
                        gone[p["start"]] += 1
                        gone[end] -= 1
                keep = np.cumsum(gone[:-1]) == 0
                removed = n - int(keep.sum())
                sha = hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest()
            for column, v in zip(out, (doc_id, n, removed, sha, digests), strict=True):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("unit", pa.int64()), ("digest", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "digests"])


def _holding(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """FOUND for every document: its text only where `keys` may have its key, so that the join that follows ships no other text.

    The filter has FILTER_BITS bits at any size. Where it takes in too much, texts are shuffled for nothing, but the result is the same.
    """
    k = F.col("key")
    places = F.array(F.pmod(k, F.lit(FILTER_BITS)), F.pmod(F.shiftrightunsigned(k, 32), F.lit(FILTER_BITS)))
    words = keys.select(F.explode(places).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("w")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["at"].to_numpy()] = words["w"].to_numpy()
    spark = docs.sparkSession
    return docs.mapInArrow(_whole(spark.sparkContext.broadcast(bits.tobytes())), FOUND)


def _heads(nodes: DataFrame) -> DataFrame:
    """a, head, back: the first piece of each piece's nonbranching path and how many windows lie between their starts.

    Two pieces are linked if every occurrence of the one is followed by the other and every occurrence of the other preceded by it. Links are followed by
    jumping twice as far in each round; paths that have reached their head drop out. A path can't be a circle, as a document's last piece has no next.
    """
    before = nodes.select(F.col("a").alias("prev0"), F.col("windows").alias("back")).where("prev0 <> 0")
    ends = nodes.where("next0 = next1 and next0 <> 0").select(F.col("a").alias("prev0"), F.col("next0").alias("a"))
    linked = nodes.where("prev0 = prev1 and prev0 <> 0").select("a", "prev0").join(ends, ["a", "prev0"]).join(before, "prev0").select("a", F.col("prev0").alias("head"), F.col("back").cast("long").alias("back"))
    open_ = written(linked)
    done = nodes.select("a").join(open_.select("a"), "a", "left_anti").select("a", F.col("a").alias("head"), F.lit(0).cast("long").alias("back"))
    done = written(done)
    while open_.limit(1).count():
        far = done.select(F.col("a").alias("head"), F.col("head").alias("head2"), F.col("back").alias("back2"), F.lit(True).alias("end")).unionByName(open_.select(F.col("a").alias("head"), F.col("head").alias("head2"), F.col("back").alias("back2"), F.lit(False).alias("end")))
        moved = written(open_.join(far, "head").select("a", F.col("head2").alias("head"), (F.col("back") + F.col("back2")).alias("back"), "end"))
        done, open_ = done.unionByName(moved.where("end").drop("end")), moved.where("not end").drop("end")
    return done


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: each document without the words of windows of WIDTH words that a document with a smaller doc_id has too. Windows are judged on the input.

    Edges of the graph are windows; those with one anchor form a piece, which is what is counted, about a row for twenty words. Pieces whose anchor is in one document only
    are unique and go. An anchor with one context is a piece that does not branch: such pieces compact into paths (`_heads`), and every occurrence of a path is a span
    of source coordinates. Where contexts differ, equal contexts are counted first and one of each is spread into its windows. The words of all paths
    and contexts are compared at their coordinates by digest; a unit whose words differ (a collision of hashes) is dropped.

    Only doc_id and text are read. Null texts have no words. A row without a doc_id is whole and removes nothing; rows that share a doc_id remove nothing from each other, but each is
    judged against smaller ones. An empty table gives no rows.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    pieces = docs.where("doc_id is not null").mapInArrow(_pieces, PIECES)

    seen = Observation()
    anchors = pieces.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).observe(seen, F.sum("n").alias("rows"))
    anchors = written(anchors.where("lo < hi").drop("hi"))
    again = written(joined_counted(pieces, anchors, ["a"], seen.get["rows"] or 0).drop("n"))
    rows = again.count()

    both = [f(c).alias(f"{c}{i}") for c in ("c", "prev", "next") for i, f in enumerate((F.min, F.max))]
    nodes = written(again.groupBy("a").agg(*both, F.first("windows").alias("windows"), F.count("*").alias("n")))
    paths = _heads(nodes.where("c0 = c1"))
    marked = joined_counted(again, nodes.select("a", "n").join(paths, "a", "left"), ["a"], rows)
    marked = written(marked.drop("prev", "next"))
    plain = marked.where("head is not null").groupBy("doc_id", "key", "head", (F.col("start") - F.col("back")).cast("int").alias("start")).agg(F.sum("windows").cast("int").alias("windows"), F.first("lo").alias("lo"))
    plain = plain.select("doc_id", "key", "start", "windows", F.col("head").alias("unit"), (F.col("doc_id") > F.col("lo")).alias("removed"))

    branching = marked.where("head is null").drop("n", "lo", "head", "back")
    contexts = written(branching.groupBy("c", "a").agg(F.min(F.struct("doc_id", "key", "start", "windows")).alias("first"), F.count("*").alias("n")))
    owned = joined_counted(branching, contexts.select("c", "a", F.col("first.doc_id").alias("owner"), "n"), ["c", "a"], rows)
    owned = written(owned.select("doc_id", "key", "start", "windows", F.col("c").alias("unit"), (F.col("doc_id") > F.col("owner")).alias("removed")))

    asked = contexts.groupBy("first.doc_id", "first.key").agg(F.collect_list(F.struct("first.start", "first.windows", "c")).alias("spans"))
    asked = written(asked)
    texts = _holding(docs.where("doc_id is not null"), asked).where("text is not null").select("doc_id", "key", "text").join(asked, ["doc_id", "key"]).select("doc_id", "spans", "text")
    windows = written(texts.mapInArrow(_windows, WINDOWS))
    firsts = windows.groupBy("w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    late = joined_counted(windows, written(firsts), ["w"], windows.count()).where("doc_id > lo").select("doc_id", "c", "j").distinct()
    late = late.withColumn("run", F.col("j") - F.row_number().over(Window.partitionBy("doc_id", "c").orderBy("j"))).groupBy("doc_id", "c", "run").agg(F.min("j").alias("j"), F.count("*").cast("int").alias("many"))
    part = owned.where("not removed").select("doc_id", "key", "start", F.col("unit").alias("c")).join(late, ["doc_id", "c"]).select("doc_id", "key", (F.col("start") + F.col("j")).alias("start"), F.col("many").alias("windows"), F.lit(None).cast("long").alias("unit"), F.lit(True).alias("removed"))

    spans = written(plain.unionByName(owned).unionByName(part))
    while True:
        result = _cut_out(docs, spans)
        # a unit stands for the same words wherever it is
        false = written(result.select(F.explode("digests").alias("d")).groupBy("d.unit").agg(F.min("d.digest").alias("x"), F.max("d.digest").alias("y")).where("x <> y").select("unit"))
        if not false.limit(1).count():
            return result.drop("digests")
        spans = written(spans.join(false, "unit", "left_anti"))


def _cut_out(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """RESULT for every document, without the spans to be removed. A document's spans are at most a few for every twenty of its words."""
    asked = written(spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "windows", "unit", "removed")).alias("spans")))
    found = _holding(docs, asked).join(asked, ["doc_id", "key"], "left").select("doc_id", "n_words", "sha", "text", "spans")
    return written(found.mapInArrow(_cut, RESULT))


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 over all documents."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
