"""Large buckets of dissimilar texts: no pair is lost, and comparisons do not grow with the square."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import minhash_dedup
from tapeloom.llm.shingles import Shingler


def crowd(n: int, near: int, template: int, own: int, seed: int = 5) -> list[tuple[int, str]]:
    """`n` texts of a common passage and words of their own; the last `near` are texts from the front with one word changed."""
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(template))
    rows = [(i, passage + " " + " ".join(f"own{i}x{k}" for k in range(own))) for i in range(n)]
    for i in range(near):
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = f"changed{i}"
        rows[n - 1 - i] = (n - 1 - i, " ".join(words))
    return rows


def sets_of(rows: list[tuple[int, str]]) -> list[bytes]:
    out = [b""] * len(rows)
    for at, _, doc, ids, times in Shingler().chunks(pa.array([t for _, t in rows], pa.string())):
        for d in np.unique(doc):
            out[at + d] = minhash_dedup.pack_set(ids[doc == d], times[doc == d])
    return out


def roots_of(near: np.ndarray) -> list[int]:
    root = list(range(len(near)))
    for x, y in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = root[x], root[y]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_a_rare_part_is_shared_by_all_similar_sets():
    rng = random.Random(1)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 80))]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(len(words))] = "other"
        rows.append((2 * i + 1, " ".join(words + words[: rng.randrange(3)])))
    sets = sets_of(rows)
    idf = np.random.default_rng(2).uniform(1, 1.2, (minhash_dedup.ROWS, minhash_dedup.CELLS)).astype(np.float32)
    for limit in (0.3, 0.5, 0.8):
        near = minhash_dedup.all_similarities(sets, sets, idf) >= limit
        parts = [set(minhash_dedup.rare_part(s, idf, limit).tolist()) for s in sets]
        assert near.sum() > len(sets)
        for x, y in zip(*np.nonzero(near), strict=True):
            assert parts[x] & parts[y]
    assert len(minhash_dedup.rare_part(b"", idf, 0.8)) == 0


@pytest.mark.parametrize("template, own", [(60, 40), (88, 16)])
def test_no_link_is_lost_in_a_crowd(spark, template, own):
    """A passage that is most of each text leaves it in all rare parts, so such buckets stay uncut."""
    rows = crowd(700, 60, template, own)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    settings = minhash_dedup.Settings(block=16)
    got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicate_classes(docs, settings).collect()}
    idf = minhash_dedup.idf_weights(*minhash_dedup.document_frequencies(docs), settings.idf_share)
    sets = sets_of(rows)
    want = roots_of(minhash_dedup.all_similarities(sets, sets, idf) >= settings.similarity)
    assert len(set(want)) < len(rows) - 50
    assert got == dict(enumerate(want))


def test_comparisons_of_a_crowd_grow_with_its_texts(spark):
    copies = {}
    settings = minhash_dedup.Settings(block=16)
    for n in (400, 1600):
        rows = crowd(n, n // 10, 60, 40)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        idf = spark.sparkContext.broadcast(minhash_dedup.idf_weights(*minhash_dedup.document_frequencies(docs), settings.idf_share))
        sets = spark.createDataFrame(list(zip(range(n), map(bytearray, sets_of(rows)), strict=True)), "node long, set binary")
        open_ = sets.select(F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("component"), (F.col("node") > 0).alias("rest"), F.lit(n).cast("long").alias("n"))
        blocks = minhash_dedup.blocks_to_compare(open_, sets, idf, settings)
        copies[n] = blocks.agg(F.sum(F.when(F.col("rest"), F.col("rests") + F.col("mains")).otherwise(F.col("rests")))).first()[0]
    assert copies[1600] <= 6 * copies[400]
    assert copies[1600] * 4 < 1600 * 1600 / 16
