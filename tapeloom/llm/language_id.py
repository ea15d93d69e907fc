"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import written
from tapeloom.llm.quality_classifier import held_out
from tapeloom.llm.shingles import U64, mixed_bits

ORDER = 4
#: Characters a model reckons with that it has not seen.
ALPHABET = 500
BLANK, EDGE = 32, 1


def _fold_table() -> np.ndarray:
    """Code point (below 2**16) to its lower-case letter, or BLANK if it is no letter; EDGE stays."""
    fold = np.full(1 << 16, BLANK, np.uint16)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    fold[EDGE] = EDGE
    return fold


FOLD = _fold_table()


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    return np.isin(codes, [c for c in np.unique(codes) if chr(c).isalpha()])


def character_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER-grams of letters of all `texts`, packed 16 bits a character, and the text each belongs to.

    Letters are lower-cased; whatever stands between them is one blank. Each text begins with blanks. Letters beyond
    2**16 share the codes of CJK letters, whatever else lies there is no letter.
    """
    edge = chr(EDGE) * (ORDER - 1)
    raw = np.frombuffer((edge + edge.join(x.replace(chr(EDGE), " ") for x in texts)).encode("utf-32-le", "replace"), np.uint32)
    far = np.flatnonzero(raw >= 1 << 16)
    if len(far):
        raw = raw.copy()
        raw[far] = np.where(_letters(raw[far]), (raw[far] & 0x3FFF) | 0x4E00, BLANK)
    low = FOLD[raw]
    keep = (low != BLANK) | np.concatenate(([True], low[:-1] != BLANK))
    owner = np.repeat(np.arange(len(texts)), [len(x) + ORDER - 1 for x in texts])[keep]
    low = low[keep]
    code = np.where(low == EDGE, BLANK, low).astype(U64)
    grams = code[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        grams |= code[ORDER - 1 - k : len(code) - k] << U64(16 * k)
    real = low[ORDER - 1 :] != EDGE
    return grams[real], owner[ORDER - 1 :][real]


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stands in the ascending keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


class KneserNey:
    """Interpolated Kneser-Ney model of one language, from counts of ORDER-grams. Lower orders count distinct continuations."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order].astype(np.float64)
        self.levels = []  # by order from ORDER down: grams, discounted counts, contexts, totals, discounted mass
        for n in range(ORDER, 0, -1):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            context, own = np.unique(grams >> U64(16) if n > 1 else np.zeros(len(grams), U64), return_inverse=True)
            total, kinds = np.bincount(own, counts, len(context)), np.bincount(own, minlength=len(context))
            self.levels.append((grams, np.maximum(counts - d, 0), context, total, d * kinds))
            grams, counts = np.unique(grams & U64((1 << 16 * (n - 1)) - 1), return_counts=True)
        self.levels = self.levels[::-1]

    def share_left(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """The mass that order n leaves to the order below, 1 for contexts not seen."""
        _, _, context, total, left = self.levels[n - 1]
        at, found = _find(context, contexts)
        return np.where(found, left[at] / total[at], 1.0) if len(context) else np.ones(len(contexts))

    def probability(self, n: int, grams: np.ndarray) -> np.ndarray:
        if not n:
            return np.full(len(grams), 1 / ALPHABET)
        known, discounted, context, total, _ = self.levels[n - 1]
        contexts = grams >> U64(16) if n > 1 else np.zeros(len(grams), U64)
        below = self.share_left(n, contexts) * self.probability(n - 1, grams & U64((1 << 16 * (n - 1)) - 1))
        at, found = _find(known, grams)
        where, seen = _find(context, contexts)
        return below + np.where(found & seen, discounted[at] / total[where], 0.0) if len(known) else below


@dataclass
class LanguageModels:
    """Log probabilities of all languages side by side, for sorted hashes of all grams that any of them has seen."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    log_left: list[np.ndarray] = field(default_factory=list)
    reject_above: np.ndarray | None = None

    @classmethod
    def of(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
        out = cls(sorted(counts))
        models = [KneserNey(*counts[x]) for x in out.languages]
        for n in range(1, ORDER + 1) if models else ():
            grams = np.unique(np.concatenate([m.levels[n - 1][0] for m in models]))
            contexts = np.unique(np.concatenate([m.levels[n - 1][2] for m in models]))
            for names, values, keys, worth in (("keys", "log_p", grams, lambda m, k, n=n: m.probability(n, k)), ("contexts", "log_left", contexts, lambda m, k, n=n: m.share_left(n, k))):
                order = np.argsort(mixed_bits(keys))
                getattr(out, names).append(mixed_bits(keys)[order])
                getattr(out, values).append(np.log(np.stack([worth(m, keys[order]) for m in models], axis=1)).astype(np.float32))
        return out

    def log_probability(self, n: int, grams: np.ndarray) -> np.ndarray:
        """(grams, languages)."""
        if not n:
            return np.full((len(grams), len(self.languages)), -np.log(ALPHABET), np.float32)
        at, found = _find(self.keys[n - 1], mixed_bits(grams))
        out = self.log_p[n - 1][at]
        if not found.all():
            miss = grams[~found]
            where, seen = _find(self.contexts[n - 1], mixed_bits(miss >> U64(16) if n > 1 else np.zeros(len(miss), U64)))
            out[~found] = np.where(seen[:, None], self.log_left[n - 1][where], 0) + self.log_probability(n - 1, miss & U64((1 << 16 * (n - 1)) - 1))
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) of nats a character, and the number of characters scored; whole texts, a run of them at a time."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 500_000):
                size += len(texts[end])
                end += 1
            grams, owner = character_grams(texts[at:end])
            if len(grams):
                log_p = self.log_probability(ORDER, grams)
                count[at:end] = np.bincount(owner, minlength=end - at)
                for k in range(len(self.languages)):
                    total[at:end, k] = np.bincount(owner, log_p[:, k], end - at)
            at = end
        return -total / np.maximum(count, 1)[:, None], count


def drawn_rows(rows: DataFrame, per_language: int) -> DataFrame:
    """lang and text of at most `per_language` different rows (doc_id, text) of each language, all of them where it has no more rows than that.

    Rows fall into `per_language` classes by a hash of doc_id and text, and the least hash of a class is drawn: no sort, no class without a row of it,
    and repeated rows count once. So the bound holds at any size, and no language is left out, whatever its doc_ids.
    """
    rows = rows.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    rows = rows.withColumn("_class", F.pmod("_h", F.lit(per_language)))
    least = rows.groupBy("lang", "_class").agg(F.min("_h").alias("_least"), F.count("*").alias("_n"))
    least = least.select("lang", "_class", "_least", (F.sum("_n").over(Window.partitionBy("lang")) <= per_language).alias("_all"))
    own = rows.join(F.broadcast(least), ["lang", "_class"]).where("_all or _h = _least")  # at most per_language rows for each language
    return own.dropDuplicates(["lang", "_h"]).select("lang", "text")


def train(rows: DataFrame, per_language: int = 1000) -> LanguageModels:
    """Learns from at most `per_language` of the rows of `rows` (doc_id, text, lang not null) of each language, see `drawn_rows`.

    Grams are counted on the cluster; their counts, bounded by that sample, reach the driver. A language whose rows have no text is not
    learned; without any language the models know none. Rejection: a language's limit is the cross-entropy of its worst
    training text of 50 characters or more, plus half the distance from the mean to it.
    """
    drawn = written(drawn_rows(rows, per_language))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                grams, n = np.unique(character_grams(own["text"].tolist())[0], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "n": n})

    table = drawn.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    models = LanguageModels.of({lang: (own["gram"].to_numpy().view(U64), own["n"].to_numpy()) for lang, own in table.groupby("lang")})

    def worth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["lang"].isin(models.languages)]
            nats, n = models.cross_entropies(batch["text"].tolist())
            own = nats[np.arange(len(batch)), [models.languages.index(x) for x in batch["lang"]]]
            yield pd.DataFrame({"lang": batch["lang"], "nats": own})[n >= 50]

    limits = {r["lang"]: r["worst"] + 0.5 * (r["worst"] - r["mean"]) for r in drawn.mapInPandas(worth, "lang string, nats double").groupBy("lang").agg(F.max("nats").alias("worst"), F.avg("nats").alias("mean")).collect()}
    models.reject_above = np.array([limits.get(x, np.inf) for x in models.languages])
    return models


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The language of every row of `docs` (doc_id, text): doc_id, lang_pred, score, rejected.

    lang_pred has the lowest cross-entropy a character over the whole text, `und` where the text is null or has
    no letter (score 0); ties go to the first language by name. The score is the posterior of the
    language as if the text had at most 50 characters. rejected tells that the text is unlike what
    the language was learned from. Repeated rows are scored each, rows without a doc_id too; other columns are not read. Models that know no language
    predict `und` with score 0. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, "und"], dtype=object)
        for batch in batches:
            if not own.languages:
                m = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * m), pa.array([0.0] * m), pa.array([False] * m)], ["doc_id", "lang_pred", "score", "rejected"])
                continue
            nats, n = own.cross_entropies([x or "" for x in batch.column(1).to_pylist()])
            none = ~np.array(batch.column(2).to_pylist(), bool)
            best = nats.argmin(axis=1)
            lead = nats[np.arange(len(nats)), best]
            score = 1 / np.exp(-(nats - lead[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
            label = names[np.where(none, len(names) - 1, best)]
            columns = [batch.column(0), pa.array(label, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(~none & (lead > own.reject_above[best]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    rows = identify(docs, models)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
