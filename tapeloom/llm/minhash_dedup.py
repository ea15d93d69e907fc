"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import connected_components, joined_counted, joined_small, joined_wide, least_reached, written
from tapeloom.llm.shingles import U64, Shingler, mixed_bits

#: Cells in each row of the sketch of document frequencies, rows, and cells that are added up together.
CELLS, ROWS, PART = 1 << 18, 2, 1 << 13


@dataclass(frozen=True)
class Settings:
    """similarity: weighted Jaccard from which texts are near-duplicates. bands x band_rows: samples of a signature.

    idf_share: how much rarer shingles weigh more, from 1 to 1 + idf_share. Kept small, as in a large group of
    near copies the shared shingles are frequent and what an edit changed is rare: with plain IDF the
    copies would drift below the limit just because there are many of them.
    """

    similarity: float = 0.8
    bands: int = 14
    band_rows: int = 4
    idf_share: float = 0.2
    block: int = 256


def _cells(ids: np.ndarray, row: int) -> np.ndarray:
    return (mixed_bits(ids + U64(row * 7919)) >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """A Count-Min sketch (ROWS x CELLS) of how many texts hold each shingle, and the number of texts.

    Each task counts its whole partition into one sketch; parts of the sketches are added up on the cluster. What
    reaches the driver has a fixed size (4 MB), whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, table, n = Shingler(), np.zeros((ROWS, CELLS), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, ids, _ in shingler.chunks(batch.column(0)):
                for row in range(ROWS):
                    table[row] += np.bincount(_cells(ids, row), minlength=CELLS)
        if n:
            parts = table.reshape(-1, PART)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts)), pa.int32()), pa.array([n] + [0] * len(parts), pa.int64()), pa.array([b""] + [p.astype("<i8").tobytes() for p in parts], pa.binary())], ["part", "n", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, total = None, 0, np.zeros(PART, np.int64)
        for batch in batches:
            part, n = int(batch["part"].iloc[0]), n + int(batch["n"].sum())
            for x in batch["counts"]:
                if x:
                    total += np.frombuffer(x, "<i8")
        yield pd.DataFrame({"part": [part], "n": [n], "counts": [total.tobytes()]})

    add.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}  # Spark tells by them that it streams
    rows = docs.select("text").mapInArrow(count, "part int, n long, counts binary").groupBy("part").applyInPandas(add, "part int, n long, counts binary").collect()
    table, n = np.zeros((ROWS * CELLS // PART, PART), np.int64), 0
    for r in rows:
        if r["part"] < 0:
            n = r["n"]
        else:
            table[r["part"]] = np.frombuffer(r["counts"], "<i8")
    return table.reshape(ROWS, CELLS), n


def idf_weights(table: np.ndarray, n: int, share: float) -> np.ndarray:
    """For each cell the weight of a shingle in it; a shingle has the larger weight of its cells.

    What other shingles have put into a cell on average is taken off its count.
    """
    total = table.sum(axis=1, keepdims=True)
    frequency = np.clip(table - (total - table) / (CELLS - 1), 1, max(n, 1))
    return (1 + share * np.log((1 + max(n, 1)) / (1 + frequency)) / np.log(1 + max(n, 1))).astype(np.float32)


def weigh(ids: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return times * np.maximum.reduce([idf[row][_cells(ids, row)] for row in range(ROWS)])


def _gamma_table(bits: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, 1 - (1 + x) exp(-x), at the middles of 2**bits steps."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x)), x / 4)
    return x


class Sampler:
    """Improved consistent weighted sampling: `size` samples of each weighted set.

    For shingle and sample, r and c are Gamma(2, 1) and b is uniform, all from one hash. With
    t = floor(ln w / r + b), the set's sample is the shingle, with its t, of the least ln c - r (t - b + 1).
    Two sets have the same sample with the probability of their weighted Jaccard similarity.
    """

    def __init__(self, size: int):
        gamma = _gamma_table(16)
        self.r, self.ln_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.seeds = mixed_bits(np.arange(1, size + 1, dtype=U64) * U64(0xD1342543DE82EF95))

    def __call__(self, doc: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(sets, size) of sample hashes, for the sets in `doc` (ascending) in order."""
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        spread = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(doc))))
        ln_w = np.log(weights).astype(np.float32)
        out = np.empty((len(begin), len(self.seeds)), U64)
        low = U64(0xFFFF)
        for k, seed in enumerate(self.seeds):
            h = ids ^ seed
            h *= U64(0xBF58476D1CE4E5B9)
            h ^= h >> U64(32)
            h *= U64(0x94D049BB133111EB)
            h ^= h >> U64(29)
            r = self.r[h & low]
            b = ((h >> U64(16)) & low).astype(np.float32)
            b += np.float32(0.5)
            b *= np.float32(1 / 65536)
            t = np.floor(ln_w / r + b)
            a = self.ln_c[(h >> U64(32)) & low]
            a -= r * (t - b + np.float32(1))
            hit = np.flatnonzero(a == np.minimum.reduceat(a, begin)[spread])
            own = spread[hit]
            sel = hit[np.concatenate(([True], own[1:] != own[:-1]))]
            out[:, k] = mixed_bits(ids[sel] + seed + t[sel].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
        return out


def _signatures(docs: DataFrame, idf, s: Settings) -> DataFrame:
    """doc_id, h1, h2 (of the text), bands (hash of each band's samples); bands is null without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sampler = Shingler(), Sampler(s.bands * s.band_rows)
        mix = mixed_bits(np.arange(1, s.band_rows + 1, dtype=U64)) | U64(1)
        for batch in batches:
            bands = [None] * batch.num_rows
            for at, _, doc, ids, times in shingler.chunks(batch.column(3)):
                if len(doc):
                    samples = sampler(doc, ids, weigh(ids, times, idf.value))
                    keys = mixed_bits((samples.reshape(len(samples), s.bands, s.band_rows) * mix).sum(axis=2, dtype=U64)).view(np.int64)
                    for i, d in enumerate(doc[np.concatenate(([True], doc[1:] != doc[:-1]))]):
                        bands[at + d] = keys[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "h1", "h2", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text").mapInArrow(sign, "doc_id long, h1 long, h2 long, bands array<long>")


def pack_set(ids: np.ndarray, times: np.ndarray) -> bytes:
    """Distinct shingles (48 bits), ascending, with their counts (16 bits) as bytes; with a byte more before ids and counts of 64 bits each if a count is larger."""
    if len(times) and times.max() > 0xFFFF:
        return b"\1" + ids.astype("<u8").tobytes() + times.astype("<u8").tobytes()
    return ((ids << U64(16)) | times.astype(U64)).tobytes()


def unpack_set(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) % 8:
        both = np.frombuffer(data, U64, offset=1)
        return both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)
    both = np.frombuffer(data, U64)
    return both >> U64(16), (both & U64(0xFFFF)).astype(np.int64)


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """node, set: the shingles of each text of `texts` (node, text)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [b""] * batch.num_rows
            for at, end, doc, ids, times in shingler.chunks(batch.column(1)):
                cut = np.searchsorted(doc, np.arange(end - at + 1))
                for d in range(end - at):
                    sets[at + d] = pack_set(ids[cut[d] : cut[d + 1]], times[cut[d] : cut[d + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    return texts.select("node", "text").mapInArrow(collect, "node long, set binary")


def weighted_jaccard(a: bytes, b: bytes, idf: np.ndarray) -> float:
    """Sum of the smaller over sum of the larger weights of two shingle sets; 0 if both are empty."""
    parts = unpack_set(a), unpack_set(b)
    ids, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = ids.argsort(kind="stable")
    ids, times = ids[order], times[order]
    same = ids[1:] == ids[:-1]
    weight = weigh(ids, np.ones(len(ids)), idf)
    total = float((weight * times).sum())
    common = float((weight[1:] * np.minimum(times[1:], times[:-1]))[same].sum())
    return common / (total - common) if total > 0 else 0.0


def _elements(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, key and shingle of every element of `sets`; a shingle that a text has n times is n elements, so that common weights are sums over equal keys."""
    owners, keys, shingles = [], [], []
    for i, data in enumerate(sets):
        ids, times = unpack_set(data)
        which = np.repeat(np.arange(len(ids)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        owners.append(np.full(len(which), i))
        keys.append(mixed_bits(ids[which] + nth.astype(U64) * U64(0x9E3779B97F4A7C15)))
        shingles.append(ids[which])
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(shingles)


def all_similarities(left: list[bytes], right: list[bytes], idf: np.ndarray, width: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of every set of `left` with every set of `right`, as products of matrices of `width` shingles at a time."""
    (own_l, key_l, id_l), (own_r, key_r, id_r) = _elements(left), _elements(right)
    ones = lambda ids: weigh(ids, np.ones(len(ids)), idf).astype(np.float64)
    w_l = ones(id_l)
    total_l, total_r = np.bincount(own_l, w_l, len(left)), np.bincount(own_r, ones(id_r), len(right))
    both, at = np.intersect1d(key_l, key_r), 0
    common = np.zeros((len(left), len(right)))
    place_l, place_r = np.searchsorted(both, key_l), np.searchsorted(both, key_r)
    in_l, in_r = (np.flatnonzero(np.append(both, 0)[p] == k) if len(both) else np.zeros(0, int) for p, k in ((place_l, key_l), (place_r, key_r)))
    in_l, in_r = in_l[place_l[in_l] < len(both)], in_r[place_r[in_r] < len(both)]
    in_l, in_r = in_l[np.argsort(place_l[in_l])], in_r[np.argsort(place_r[in_r])]
    for at in range(0, len(both), width):
        a, b = in_l[slice(*np.searchsorted(place_l[in_l], (at, at + width)))], in_r[slice(*np.searchsorted(place_r[in_r], (at, at + width)))]
        x, y = np.zeros((len(left), width)), np.zeros((len(right), width))
        x[own_l[a], place_l[a] - at] = w_l[a]
        y[own_r[b], place_r[b] - at] = 1
        common += x @ y.T
    total = total_l[:, None] + total_r[None, :] - common
    return np.divide(common, total, out=np.zeros_like(common), where=total > 0)


def rare_part(data: bytes, idf: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set's rarest elements, which leave less than `similarity` of its weight to the others.

    Elements stand in one order for all sets: by weight, heaviest first, then key. Sets of that similarity share at least that part of the weight
    of either, so the first element that they share is in the rare part of both.
    """
    _, keys, shingles = _elements([data])
    weights = weigh(shingles, np.ones(len(shingles)), idf).astype(np.float64)
    order = np.lexsort((keys, -weights))
    after = weights.sum() - np.cumsum(weights[order])
    # a billionth of slack for rounding
    return keys[order][: np.count_nonzero(after >= similarity * weights.sum() * (1 - 1e-9)) + 1]


def blocks_to_compare(open_: DataFrame, sets: DataFrame, idf, s: Settings) -> DataFrame:
    """Which nodes of open buckets to compare: `open_` (key, node, component, rest, n: rows of the key) -> key, node, component, rest, rests, mains.

    `rests` and `mains` tell how many blocks the nodes with and without `rest` make in their group. A bucket of more than a block is cut
    into groups of nodes that share an element of their rare parts, unless its sets would be copied to fewer blocks uncut.
    Groups of one component need no comparison; of groups with the same nodes one is left.
    """
    count = [F.count("*").alias("n"), F.count_if("rest").alias("r"), F.min("component").alias("lo"), F.max("component").alias("hi")]
    up = lambda n: F.ceil(n / s.block)
    copies = (F.col("r") * (up(F.col("r")) + up(F.col("n") - F.col("r"))) + (F.col("n") - F.col("r")) * up(F.col("r"))).cast("double")

    @F.pandas_udf("array<long>")
    def rare(data: pd.Series) -> pd.Series:
        return pd.Series([rare_part(x, idf.value, s.similarity).view(np.int64) for x in data])

    large = open_.where(F.col("n") > s.block).drop("n")
    parts = sets.join(large.select("node").distinct(), "node").select("node", rare("set").alias("rare"))
    cut = large.join(parts, "node").select("key", "node", "component", "rest", F.explode("rare").alias("rare"))
    cut = written(cut.select(F.xxhash64("key", "rare").alias("part"), "key", "node", "component", "rest"))
    groups = cut.groupBy("part").agg(F.min("key").alias("key"), *count, F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all")).where("lo <> hi")
    groups = written(groups.groupBy("key", "n", "r", "all").agg(F.min("part").alias("part")))

    whole = open_.groupBy("key").agg(*count).withColumn("copies", copies)
    cost = groups.groupBy("key").agg(F.sum(copies).alias("cost"))
    whole = written(whole.join(cost, "key", "left").withColumn("cut", (F.col("n") > s.block) & (F.coalesce("cost", F.lit(0.0)) < F.col("copies"))))
    chosen = groups.join(whole.where("cut").select("key"), "key").select(F.col("part").alias("key"), "n", "r").union(whole.where("not cut").select("key", "n", "r"))
    chosen = written(chosen.select("key", up(F.col("r")).cast("int").alias("rests"), up(F.col("n") - F.col("r")).cast("int").alias("mains"), "n"))
    rows = open_.drop("n").union(cut.select(F.col("part").alias("key"), "node", "component", "rest"))
    return joined_counted(rows, chosen, ["key"], rows.count()).drop("n")


def near_duplicate_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The class of every row of `docs` (doc_id long, text): doc_id, class_id, kept.

    Texts of weighted Jaccard similarity of `similarity` or more over their word shingles are linked, equal texts
    too; class_id is the smallest doc_id that links lead to, and kept marks that document. Words are
    runs of ASCII letters, digits and characters beyond ASCII, case aside.

    1. Document frequencies of all shingles go into a sketch of fixed size; each text gets a signature.
    2. Equal texts are one node; nodes that share a band form a bucket.
    3. Each node of a bucket is compared with the bucket's first, on whole shingle sets.
    4. In buckets that are not in one class yet, each node outside the first's class is compared with all others, a block of nodes
       against a block, as products of matrices. Buckets of more than a block are cut by rare shingles first (`blocks_to_compare`), which
       loses no pair: so thousands of dissimilar texts with one passage in common are not all compared. No pair that shares a band is left
       out, and a bucket of thousands of copies costs one comparison each.

    Copies, buckets and classes of many rows are joined by `joined_counted` and `joined_wide`, which spread them. Null and empty texts
    are in a class of their own, as are texts without words unless equal; rows of one doc_id are one document with the links of all
    its texts; rows with a null doc_id get a null class and are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    s = settings
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    idf = spark.sparkContext.broadcast(idf_weights(*document_frequencies(docs), s.idf_share))  # 2 MB
    rows = written(_signatures(docs, idf, s))
    filled = F.col("doc_id").isNotNull() & ~F.col("h1").isin(*spark.range(1).select(F.xxhash64(F.lit("")), F.xxhash64(F.lit(None).cast("string"))).first())
    known = rows.where(filled)

    # equal texts are one node
    texts = known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()))
    size = texts.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()

    # buckets of two nodes or more
    keys = texts.select("node", "rep", F.posexplode("bands").alias("band", "value")).select("node", "rep", F.xxhash64("band", "value").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min_by("node", "rep").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    members = written(joined_counted(keys.select("key", "node"), shared, ["key"], s.bands * size["texts"]))
    many = members.count()
    wanted = texts.select("node", F.col("rep").alias("doc_id"), "h1", "h2").join(members.select("node").distinct(), "node")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    sets = written(_shingle_sets(joined_small(hashed, wanted, ["doc_id", "h1", "h2"]).dropDuplicates(["node"])))

    # each node with the first of its buckets
    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([weighted_jaccard(x, y, idf.value) for x, y in zip(a, b, strict=True)], dtype="float64")

    stars = written(members.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    pairs = joined_wide(stars, sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), ["b"], many).join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    links = written(pairs.where(similarity("set_a", "set_b") >= s.similarity).select("a", "b"))

    # buckets that are still in several classes; of buckets with the same nodes, one
    classes = written(connected_components(links))
    placed = members.select("key", "node", (F.col("node") == F.col("lead")).alias("first")).join(classes, "node", "left").select("key", "node", "first", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("first"), F.col("component"))).alias("main"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
    mixed = written(mixed.where("lo <> hi").groupBy("n", "all").agg(F.min_by(F.struct("key", "main"), "key").alias("k")).select("k.key", "k.main", "n"))
    # blocks of the nodes outside the first's class, then those of that class, which need not meet each other
    open_ = joined_counted(placed.drop("first"), mixed, ["key"], many).select("key", "node", "component", (F.col("component") != F.col("main")).alias("rest"), "n")
    open_ = blocks_to_compare(written(open_), sets, idf, s)
    dealt = lambda blocks: F.pmod(F.xxhash64("node", F.lit(3)), F.col(blocks)).cast("int")
    open_ = open_.withColumn("own", F.when(F.col("rest"), dealt("rests")).otherwise(F.col("rests") + dealt("mains")))
    open_ = open_.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("rests") + F.col("mains") - 1).otherwise(F.col("rests") - 1))).alias("other"))
    open_ = open_.join(sets, "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "own", "set")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        i, j = block["i"].iloc[0], block["j"].iloc[0]
        block = block.drop_duplicates("node")
        left, right = block[block["own"] == i], block[block["own"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        nodes_l, nodes_r = left["node"].to_numpy(), right["node"].to_numpy()
        near = all_similarities(left["set"].tolist(), right["set"].tolist(), idf.value) >= s.similarity
        near &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        roots = least_reached(near, nodes_l, nodes_r)
        out = pd.DataFrame({"a": np.concatenate((nodes_l, nodes_r)), "b": np.concatenate(roots)}, dtype="int64")
        return out[out["a"] != out["b"]]

    more = written(open_.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))

    # the texts of a doc_id that has several
    several = written(known.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("doc_id", "n"))
    own = joined_counted(known.select("doc_id", "h1", "h2"), several, ["doc_id"], size["rows"]).join(texts.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node").distinct()
    least = own.groupBy("doc_id").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    bound = joined_counted(own, least, ["doc_id"], size["rows"]).select(F.col("node").alias("a"), F.col("least").alias("b"))

    final = written(connected_components(links.union(more).union(bound)).join(texts.select("node", "rep"), "node"))
    firsts = final.groupBy("component").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    final = joined_counted(final.select("component", "node"), firsts, ["component"], final.count()).select("node", "first")
    facts = texts.select("h1", "h2", "n", "rep", "node").join(final, "node", "left").select("h1", "h2", "n", F.coalesce("first", "rep").alias("class_id"))
    out = joined_counted(known.select("doc_id", "h1", "h2"), facts, ["h1", "h2"], size["rows"]).select("doc_id", "class_id")
    out = out.union(rows.where(~filled).select("doc_id", F.col("doc_id").alias("class_id")))
    return out.select("doc_id", "class_id", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` whose document is kept, with all their columns; rows that repeat a doc_id are all kept or all dropped."""
    gone = near_duplicate_classes(docs, settings).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
