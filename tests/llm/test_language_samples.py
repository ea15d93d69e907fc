"""Language ID: what is learned from where ids are null, repeated or useless, and whole predictions against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import language_id
from tapeloom.llm.shingles import U64

FR, EN = "le chat dort sur la chaise et les enfants jouent dans le jardin".split(), "the cat sleeps on the chair while those children play with things".split()


def text(rng, words, n=12):
    return " ".join(rng.choice(words) for _ in range(n))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words here", None), (None, None, "fr"), (2, "", None)], "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.train(docs)).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score, r.rejected) for r in got) == [(0, "und", 0.0, False), (1, "und", 0.0, False), (2, "und", 0.0, False)]
    blank = docs.withColumn("lang", F.lit("xx")).withColumn("text", F.lit(""))
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(blank)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), language_id.train(docs.limit(0))).count() == 0


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7, lambda i: i])
def test_every_language_is_learned(spark, ids):
    rng = random.Random(4)
    rows = [(ids(i), text(rng, FR), "fr") for i in range(3000)] + [(ids(i), text(rng, EN), "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = Counter(r.lang for r in language_id.drawn_rows(docs, 200).collect())
    assert drawn["en"] == 5 and 150 < drawn["fr"] <= 200
    got = language_id.identify(docs, language_id.train(docs, 200)).select("lang_pred").join(spark.range(1).select(F.lit(1)), how="cross").collect()
    assert Counter(r.lang_pred for r in got) == {"fr": 3000, "en": 5}


def test_a_hot_row_is_drawn_once(spark):
    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("toujours la même phrase").alias("text"), F.lit("fr").alias("lang"))
    assert language_id.drawn_rows(docs, 100).count() == 1


def test_predictions_are_plain_kneser_ney(spark):
    """lang_pred, score and rejected of whole texts from the models' own probabilities, summed up one character at a time."""
    rng = random.Random(8)
    rows = [(i, text(rng, FR if i % 2 else EN, rng.randrange(1, 30)), "fr" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(docs)
    grams = {lang: Counter() for lang in ("en", "fr")}

    def of(t):  # runs of what is no letter are one blank
        low = "   " + "".join(c.lower() if c.isalpha() else " " for c in t)
        low = "   " + " ".join(low.split()) + (" " if low.endswith(" ") and low.strip() else "") if not low[3:].startswith(" ") else "    " + " ".join(low.split())
        return [tuple(map(ord, low[k : k + 4])) for k in range(len(low) - 3)]

    for _, t, lang in rows:
        grams[lang].update(of(t))
    plain = {}
    for lang, counts in grams.items():
        keys = sorted(counts)
        pack = np.array([sum(c << 16 * (3 - k) for k, c in enumerate(g)) for g in keys], U64)
        plain[lang] = language_id.KneserNey(pack, np.array([counts[g] for g in keys]))
    mine = {r.doc_id: r for r in language_id.identify(docs, models).collect()}
    for i, t, _ in rows:
        g = np.array([sum(c << 16 * (3 - k) for k, c in enumerate(x)) for x in of(t)], U64)
        nats = {lang: -sum(math.log(p) for p in m.probability(4, g)) / len(g) for lang, m in plain.items()}
        best = min(sorted(nats), key=nats.get)
        score = 1 / sum(math.exp(-(v - nats[best]) * min(len(g), 50)) for v in nats.values())
        assert mine[i].lang_pred == best and math.isclose(mine[i].score, score, rel_tol=2e-4)
        assert mine[i].rejected == (nats[best] > models.reject_above[models.languages.index(best)])
