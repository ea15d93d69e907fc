"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from oracle import SF, check
from pyspark.sql import functions as F

import __spark_entry__ as e
from tapeloom.llm import common, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, mixing, packing, quality_classifier, quality_rules, sharding

SPACES = " \t\n\x0b\x0c\r"
TEXTS = [None, "", " \n\t", "one", "MIT License\nApache License", "a b c d e f g h " * 6, "x" * 50_000, "Grüße, 世界! " * 30, "a b c d e f g h " * 6, "<|endoftext|> is text"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd rows: nulls everywhere, repeats, clashing extra columns."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 4}", 7, "x") for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", "s1", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, _n string")


def words(t):
    return [w for w in "".join(" " if c in SPACES else c for c in t or "").split(" ") if w]


@pytest.mark.parametrize("name", ["op2_mixing", "op7_quality_rules", "op9_line_dedup"])
def test_sql(spark, name):
    check(spark, name)


BIG, BIGGER = (1 << 60) + 1, (1 << 60) + 3
#: Columns named like those that operators make for themselves.
CLASHES = ("_id", "_gone", "gone", "_text", "_position", "_pass", "_row", "_doc", "shard", "slot", "_slot", "n", "node", "key", "h1", "_n")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, ids over 2**53 beside nulls, repeated ids and rows, clashing columns."""
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(BIG, f"first {long}", "en", "s1"), (BIGGER, f"second {long[:60]} {long[100:]}", "en", "s1"), (None, f"third {long}", None, "s2"), (None, None, None, None), (7, f"one\n{long}", "en", "s2"), (7, f"other\n{long}\nmore words here", "en", None), (7, f"one\n{long}", "en", "s2"), (8, "", "en", "s1"), (9, "MIT License", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def test_empty_and_odd_tables_pass_through_all(spark, docs, odd):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, None)], "doc_id long, quality int")
    for d in (docs, docs.limit(0), odd):
        n, ids = d.count(), Counter(r.doc_id for r in d.select("doc_id").collect())
        same = lambda x: Counter(r.doc_id for r in x.select("doc_id").collect()) == ids
        assert same(sharding.assign_shards(d))
        assert same(mixing.mixing_plan(d))
        assert same(quality_rules.rule_report(d))
        assert same(license_scan.license_report(d))
        assert line_dedup.without_boilerplate(d).columns == d.columns and same(line_dedup.without_boilerplate(d, min_sites=2))
        assert same(minhash_dedup.near_duplicate_classes(d))
        assert same(quality_classifier.classify_quality(d, labels, lambda i: F.lit(True)))
        got = language_id.identify(d, language_id.train(d))
        assert same(got) and all(r.lang_pred == "und" for r in got.collect() if r.doc_id in (0, 1, 2))
        pieces = packing.packed(d)
        assert same(pieces.where("start = 0")) and n <= pieces.count()


def test_odd_table_through_the_stages_and_shards(spark, odd, tmp_path):
    import corpus_pipeline

    d = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        if name != "quality rules":  # few of these rows pass
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in d.collect()}
    assert {BIG, BIGGER, None} <= {r.doc_id for r in corpus_pipeline.packing(spark, odd, SF).collect()}
    sharding.write_shards(odd, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in odd.collect())


def test_lines_go_by_row_and_not_by_doc_id(spark):
    rows = [(i, f"shared\nown {i}", f"s{i}") for i in range(12)] + [(11, "precious line\nshared", "s11"), (None, "shared", "s1")]
    got = Counter(r.text for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got["precious line"] == 1 and got["own 11"] == 1 and got["shared\nown 0"] == 1 and got["shared"] == 1


def test_token_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    mine = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    alphabet = "abz ABZ 019 .,!?'\"-_\t\n\r  é ü ß Ā ı 's 'll <|endoftext|>     世 🙂"
    texts = [t for t in TEXTS if t] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    for t in texts:
        assert list(np.frombuffer(mine(t), "<u4")) == model.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_fills_windows_exactly(spark):
    rows = e.queries()["op1_packing"](spark, SF).toPandas()
    for _, own in rows.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == own["doc_tokens"].iloc[0]
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024
    assert sorted(rows["sequence_id"].unique()) == list(range(rows["sequence_id"].nunique()))
    assert rows["sequence_id"].nunique() * 1024 <= 1.02 * rows["length"].sum() + 1024  # little padding


def test_minimum_bin_slack_finds_the_fullest_window():
    rng = random.Random(2)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        plan = packing.fill_patterns(dict(Counter(lengths)), 20)
        used = Counter()
        for times, pattern in plan:
            used.update({k: times * n for k, n in pattern.items()})
            assert sum(k * n for k, n in pattern.items()) <= 20
        assert used == Counter(lengths)
        top, rest = max(lengths), sorted(lengths)[:-1]
        best = max(s for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if (s := top + sum(c)) <= 20)
        assert sum(k * n for k, n in plan[0][1].items()) == best


def test_mixing_against_brute_force(spark):
    rows = mixing.mixing_plan(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    raw = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert rows.set_index("doc_id")["size"].to_dict() == {i: len(words(t)) for i, t in zip(raw["doc_id"], raw["text"])}
    assert (rows["taken"] <= 2 * rows["size"]).all()
    src = rows.merge(raw[["doc_id", "source"]]).groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(src["taken"] - src["target"]) <= 1).all()
    assert abs(src["target"].sum() - 1.5 * rows["size"].sum()) < 1


@pytest.mark.parametrize("options", [{}, {"share": 40.0, "cap": 30.0}])
def test_mix_has_every_row_as_often_as_planned(spark, docs, options):
    """Null and repeated doc_ids, equal rows, columns with names of the plan, more than ten passes."""
    rows = [(None, f"null id {i} " * (i + 1), "s1", i, "a") for i in range(5)] + [(7, "twice " * k, "s2", k, "b") for k in (1, 1, 4)] + [(i, "w " * 9, "s1", i, "c") for i in range(20, 30)]
    for d in (docs, spark.createDataFrame(rows, "doc_id long, text string, source string, _position int, _pass string"), docs.limit(0)):
        got, plan = mixing.mixed(d, **options), mixing.mixing_plan(d, **options).collect()
        assert got.columns == d.columns
        takes = lambda p: p.whole + (p.part > 0 and p.part * 2 >= p.size)
        key = lambda r, n: (r.doc_id is None, r.doc_id, n)
        left = got.collect()
        if d.columns[-1] != "_pass":  # doc_ids are unique here
            want = Counter({key(p, p.size): takes(p) for p in plan})
            assert Counter(key(r, len(words(r.text))) for r in left) == +want
        else:  # which rows of a repeated doc_id the last, partial pass takes is open
            n, given = Counter(left), d.collect()
            whole = {key(p, p.size): p.whole for p in plan}
            many = Counter(given)
            for r in given:
                w = whole[key(r, len(words(r.text)))]
                assert w * many[r] <= n[r] <= (w + 1) * many[r]
            size = Counter()
            for r in left:
                size[r.source] += len(words(r.text))
            target = {key(p, 0)[:2]: p.target for p in plan}
            for r in given:
                assert abs(size[r.source] - target[key(r, 0)[:2]]) <= 15 and target[key(r, 0)[:2]] > 0
        assert not options or not plan or max(p.whole for p in plan) > 10


def test_shards_are_contiguous_and_near_equal(spark):
    rows = e.queries()["op3_sharding"](spark, SF).toPandas()
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().set_index("doc_id")["text"].to_dict()
    for r in rows.itertuples():
        data = (raw[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    sums = rows.groupby("shard")["size"].sum()
    assert abs(sums - rows["size"].sum() / 40).max() <= rows["size"].max()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_equal_texts_stay_in_one_shard_up_to_a_share_of_it(spark):
    rows = [(i, f"text {i % 300} " + "x" * (i % 300)) for i in range(900)] + [(i, "very frequent text") for i in range(1000, 4000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).toPandas()
    sums = got.groupby("shard")["size"].sum()
    target = got["size"].sum() / 10
    assert abs(sums - target).max() <= 0.05 * target + 400
    often = got[got["text_crc32"] == zlib.crc32(b"very frequent text")]
    assert often["shard"].nunique() > 1  # two thirds of all bytes
    rest = got[got["text_crc32"] != zlib.crc32(b"very frequent text")]
    assert rest.groupby("text_crc32")["shard"].nunique().max() == 1


def test_quality_scores_hold_on_unseen_rows(spark):
    rows = e.queries()["op4_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    rank = rows["score"].rank()
    one = rows["quality"] == 1
    auc = (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())
    assert auc > 0.8


def test_languages_hold_on_unseen_rows(spark):
    rows = e.queries()["op6_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.95


def _linked(raw):
    """vec_id, links and smallest vec_id reached of each (vec_id, vector, label), by all pairs."""

    def unit(v):
        if v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(v, float)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units, links = [unit(v) for _, v, _ in raw], defaultdict(set)
    for i, j in itertools.combinations(range(len(raw)), 2):
        if raw[i][0] is not None and raw[j][0] is not None and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and raw[i][2] is not None and raw[i][2] == raw[j][2] and units[i] @ units[j] >= 0.98:
            links[i].add(j)
            links[j].add(i)
    out = []
    for k, (i, _, _) in enumerate(raw):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(links[k]), min((raw[x][0] for x in seen if raw[x][0] is not None), default=None)))
    return Counter(out)


def _vectors(spark):
    """Clusters, near ones at 0.98, extremes of size, and everything that links with nothing."""
    rng, rows = np.random.default_rng(3), []
    for c in range(6):
        centre = rng.normal(size=8)
        rows += [(100 * c + k, (centre + rng.normal(size=8) * 0.05 * (k % 5)).tolist(), "ab"[c % 2]) for k in range(30)]
    s = math.sqrt(1 - 0.98**2)
    rows += [(1000, [1.0, 0.0] + [0.0] * 6, "a"), (1001, [0.98, s] + [0.0] * 6, "a"), (1002, [0.9799, math.sqrt(1 - 0.9799**2)] + [0.0] * 6, "a")]
    rows += [(1100 + k, [x * m for x in (0.0, 0.0, 3.0, 4.0, 0.0, 0.0, 1.0, 0.0)], "b") for k, m in enumerate((1e200, 1e-200, 1e307, 1.0, 1e-320))]
    rows += [(1200, None, "a"), (1201, [], "a"), (1202, [0.0] * 8, "a"), (1203, [1.0, None] + [0.0] * 6, "a"), (1204, [float("nan")] * 8, "a"), (1205, [float("inf")] + [0.0] * 7, "a"), (1206, [1.0] + [0.0] * 7, None), (None, [1.0] + [0.0] * 7, "a")]
    return rows + [(1300, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0], "a"), (1300, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.01, 1.0], "a"), (1300, [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0], "a"), (1301, [2.0, 0.0, 0.0], "a")]


@pytest.mark.parametrize("hot, block", [((100_000, 256), 512), ((20, 4), 8)])
def test_vector_links_against_all_pairs(spark, monkeypatch, hot, block):
    """Also with blocks and broadcasts so small that intervals are split several times and hot keys are spread."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", hot[0])
    monkeypatch.setattr(common, "HOT_ROWS", hot[1])
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    read = lambda d: [(r.vec_id, r.embedding, r.label) for r in d.collect()]
    own = spark.createDataFrame(_vectors(spark), "vec_id long, embedding array<double>, label string")
    for d in (own, own.limit(0), spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")):
        got = Counter((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.embedding_classes(d).collect())
        assert got == _linked(read(d))


def test_near_blocks_do_not_grow_with_their_square(spark):
    """Blocks along a line: each is near its neighbours only, whatever their number."""
    n = {}
    for size in (50, 800):
        blocks = spark.range(size).select(F.lit(1).cast("long").alias("grp"), F.col("id").alias("block"), *[F.array(F.col("id") * 1.0 + add, *[F.lit(0.0)] * (embedding_dedup.DIMS - 1)).alias(c) for c, add in (("lo", 0.0), ("hi", 0.9))])
        n[size] = embedding_dedup._near_blocks(blocks, 0.2).count()
    assert n == {50: 50 + 49, 800: 800 + 799}


@pytest.mark.parametrize("window", [3, 6, 7, 8])
def test_repeated_windows_against_brute_force(spark, window):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))) for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", quality_rules.repeated_words(common.words_of(F.col("text")), window).alias("n")).collect()
    for r in rows:
        w = words(texts[r.doc_id])
        grams = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        many = Counter(grams)
        assert r.n == len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(window)})


def test_license_base_counts_and_containment(spark):
    texts = ["The MIT license. Apache-License, GNU General Public License and mit   LICENSE", "Licensed under the Apache License, Version 2.0", "nothing", None, "SPDX-License-Identifier: GPL-3.0-only"]
    rows = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (12, 4, 1, 10, "apache,gpl,mit")
    assert "apache-2.0" in rows[1].labels.split(",") and rows[1].score > 0.8 and rows[2].score == 0 and rows[3].n_words == 0
    assert rows[4].labels == "gpl-3.0" and rows[4].score == 1.0
    assert all(not (a.start <= b.start and b.end <= a.end and a.priority >= b.priority) for r in rows.values() for a, b in itertools.permutations(r.detections, 2))


def _sample(parsed, rng):
    """A text that the parsed pattern takes, but for what it looks ahead or behind for."""
    out = ""
    for op, v in parsed:
        op = str(op)
        if op == "LITERAL":
            out += chr(v)
        elif op == "IN":
            kind, x = rng.choice(v)
            out += {"CATEGORY_SPACE": "\n", "CATEGORY_WORD": "x", "CATEGORY_DIGIT": "1"}[str(x)] if str(kind) == "CATEGORY" else chr(x if str(kind) == "LITERAL" else rng.randint(*x))
        elif op == "SUBPATTERN":
            out += _sample(v[3], rng)
        elif op == "BRANCH":
            out += _sample(rng.choice(v[1]), rng)
        elif "REPEAT" in op:
            out += "".join(_sample(v[2], rng) for _ in range(rng.randint(v[0], min(v[1], v[0] + 2))))
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
    return out


def test_license_keywords_stand_in_every_match(spark):
    rng, rows = random.Random(5), []
    for label, _, keys, pattern in license_scan.signature_rules():
        parsed = re._parser.parse(pattern)
        texts = {t for t in (_sample(parsed, rng) for _ in range(60)) if re.search(pattern, t)}
        assert texts, pattern
        for t in texts:
            assert all(k in t for k in keys), (label, keys, t)
        rows += [(t,) for t in texts]
    assert not spark.createDataFrame(rows, "text string").where(~license_scan._gate(F.col("text"))).head(5)
    want = {"Do What The Fun You Want To Public License": ("wtfpl", 0.64), "The Expat License": ("mit", 0.64), "released under the 2-clause BSD": ("bsd-2-clause", 0.88), "distributed under CC0 1.0": ("cc0-1.0", 0.88), "see the ISC License": ("isc", 0.76)}
    got = license_scan.license_report(spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")).collect()
    assert {r.doc_id: (r.labels, round(r.score, 2)) for r in got} == want


def test_license_text_may_be_wrapped_and_names_short(spark):
    want = {
        "/*\n * under the GNU General Public\n * License, version 3.\n */": "gpl-3.0",
        "Permission is hereby granted, free of charge, to any\nperson obtaining  a copy": "mit",
        "# Licensed under the\n# Apache  License,\n#\tVersion 2.0": "apache-2.0",
        "dnl Creative Commons\ndnl Attribution-ShareAlike 4.0": "cc-by-sa-4.0",
        "// Redistribution and use in\r\n// source and binary   forms": "bsd",
        "All rights\n    reserved": "proprietary",
        "licensed under GPLv3": "gpl-3.0",
        "LGPL\n * 2.1": "lgpl-2.1",
        "released under the Apache\n# 2.0": "apache-2.0",
        "distributed under MIT.": "mit",
        "available under the GPL": "gpl",
        "GPL-2.0-or-later": "gpl-2.0",
        "the GPL.\n2. Next": "gpl",
        "a course available under MIT OpenCourseWare": "",
        "Apache 2.0 answers on port 80; EPL 2 was won": "",
        "general, public": "",
    }
    rows = license_scan.license_report(spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")).collect()
    assert {r.doc_id: ",".join(sorted({d.label for d in r.detections})) for r in rows} == want
    first = next(r for r in rows if r.doc_id.startswith("/*")).detections[0]
    assert rows[0].doc_id[first.start : first.end].lower() == "gnu general public\n * license, version 3"
    long = license_scan.license_report(spark.createDataFrame([("gnu general public " + "*/ \n" * 50_000 + "x",)], "text string").selectExpr("1 as doc_id", "text")).head()
    assert long.labels == ""


def test_line_spread_is_exact_near_the_limit(spark):
    rows = [(100 * k + s, f"line {k}\nown {k} {s}", f"s{s}") for k, sites in enumerate((9, 10, 11, 30)) for s in range(sites)]
    got = line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    left = Counter(r.text.split("\n")[0] for r in got if r.text.startswith("line"))
    assert left == {"line 0": 9, "line 1": 1, "line 2": 1, "line 3": 1}


def _near_texts():
    """Texts with none to many words changed, so that similarities lie all around the limit; copies; two texts of one doc_id."""
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 200))] for _ in range(25)]
    texts = [list(b) for b in base]
    for b in base:
        for edits in (1, 1, 2, 3, 4, 6):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = f"edit{rng.randint(0, 99)}"
            texts.append(c)
    texts = [" ".join(t) for t in texts] + [" ".join(base[0])] * 40 + ["a b c", "A  b, c!", "...", "...", "", None]
    return [(i, t) for i, t in enumerate(texts)] + [(5, "an entirely different text of the same document with some words"), (900, "an entirely different text of the same document with some words")]


@pytest.mark.parametrize("hot", [(100_000, 256), (20, 4)])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, hot):
    """Classes are those that all pairs of weighted Jaccard similarity 0.8 make: no link is missed, none is made up."""
    import pyarrow as pa

    monkeypatch.setattr(common, "BROADCAST_ROWS", hot[0])
    monkeypatch.setattr(common, "HOT_ROWS", hot[1])
    rows = _near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in minhash_dedup.near_duplicate_classes(docs).collect():
        assert got.setdefault(r.doc_id, r.class_id) == r.class_id and r.kept == (r.doc_id == r.class_id)
    idf = minhash_dedup.idf_weights(*minhash_dedup.document_frequencies(docs), minhash_dedup.Settings().idf_share)
    sets = [b""] * len(rows)
    for at, end, doc, ids, times in minhash_dedup.Shingler().chunks(pa.array([t for _, t in rows], pa.string())):
        for d in range(end - at):
            sets[at + d] = minhash_dedup.pack_set(ids[doc == d], times[doc == d])
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    near = 0
    for x, y in itertools.combinations(range(len(rows)), 2):
        (i, s), (j, t) = rows[x], rows[y]
        alike = minhash_dedup.weighted_jaccard(sets[x], sets[y], idf)
        near += 0.8 <= alike < 0.87
        if s and t and (s == t or alike >= 0.8):
            u, v = find(i), find(j)
            up[max(u, v)] = min(u, v)
    assert near > 20 and got == {i: find(i) for i in got}


def test_sets_keep_counts_of_any_size():
    for times in ([1, 70_000, 3], [1, 65_535], []):
        ids = np.arange(5, 5 + len(times), dtype=np.uint64)
        back = minhash_dedup.unpack_set(minhash_dedup.pack_set(ids, np.array(times, np.int64)))
        assert back[0].tolist() == ids.tolist() and back[1].tolist() == times


def test_hot_keys_are_spread_over_tasks(spark):
    """One class of 100,000 copies and a hub of as many neighbours: no task of a join sees more than three times the median."""
    rows = spark.range(130_000).select((F.when(F.col("id") < 100_000, 7).otherwise(F.col("id"))).cast("long").alias("k"), F.col("id").alias("v")).repartition(40)
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = common.joined_counted(rows, table, ["k"], 130_000)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 130_000 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joined.where("(k = 7 and (n <> 100000 or least <> 0)) or (k <> 7 and n <> 1)").count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 100)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(1000, k) for k in range(1001, 1400)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for a, b in edges if a != b for x in (a, b)}}


def _passes(t):
    """The quality rules, plainly."""
    w, t = words(t), t or ""
    n = len(w)
    grams = [tuple(w[i : i + 8]) for i in range(n - 7)]
    many = Counter(grams)
    repeated = len({i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(8)})
    letters = [c for c in t if c.isascii() and c.isalpha()]
    lines = [x for x in t.split("\n") if words(x)]
    return n >= 20 and 100 * repeated <= 30 * n and 4 * sum(c in "#*$%&|<>" for c in t) <= n and sum(c.isupper() for c in letters) <= 0.6 * len(letters) and 3 * t.count("!") <= n and 1.5 <= sum(map(len, w)) / n <= 25 and not (len(lines) > 3 and 2 * (len(lines) - len(set(lines))) > len(lines))


def _without_lines(rows):
    """doc_id, text, source: lines on ten sources or more go, but for their first document."""
    key = lambda x: x.strip(SPACES).lower()
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            sites[key(x)].add(s)
            first[key(x)] = min(i, first.get(key(x), i))
    out = []
    for i, t, s in rows:
        keep = [x for x in t.split("\n") if not (key(x) and len(sites[key(x)]) >= 10 and i > first[key(x)])]
        if len(keep) == len(t.split("\n")) or words("\n".join(keep)):
            out.append((i, "\n".join(keep), s))
    return out


def _takes(rows):
    """How often the mix takes each document: target by weight up to twice the source's size, documents in order of md5."""
    import hashlib

    size, own = Counter(), defaultdict(list)
    for i, t, s in rows:
        size[s] += len(words(t))
        own[s].append((hashlib.md5(str(i).encode()).hexdigest(), i, len(words(t))))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        open_ -= full
    out = Counter()
    for s, docs in own.items():
        whole, rest = divmod(round(target[s]), size[s])
        for _, i, n in sorted(docs):
            part = min(n, max(0, rest))
            rest -= n
            out[i] = whole + (part > 0 and 2 * part >= n)
    return +out


def test_pipeline_against_plain_python(spark):
    """Each stage's rows, from what the stage before kept, against a plain version."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    import corpus_pipeline as pipe

    rows = lambda d: sorted((r.doc_id, r.text, r.source) for r in d.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r for r in rows(docs) if _passes(r[1])]
    docs = common.written(pipe.quality_rules(spark, docs, SF))
    assert rows(docs) == sorted(want) and 0 < len(want)
    want = _without_lines(want)
    docs = common.written(pipe.line_dedup(spark, docs, SF))
    assert rows(docs) == sorted(want)

    idf = minhash_dedup.idf_weights(*minhash_dedup.document_frequencies(docs), minhash_dedup.Settings().idf_share)
    sets = [b""] * len(want)
    for at, end, doc, ids, times in minhash_dedup.Shingler().chunks(pa.array([t for _, t, _ in want], pa.string())):
        for d in range(end - at):
            sets[at + d] = minhash_dedup.pack_set(ids[doc == d], times[doc == d])
    ids = np.array([i for i, _, _ in want])
    near = minhash_dedup.all_similarities(sets, sets, idf) >= 0.8
    least = common.least_reached(near, ids, ids)[0]
    docs = common.written(pipe.near_dedup(spark, docs, SF))
    kept = rows(docs)
    assert kept == sorted(r for r, k in zip(want, least, strict=True) if r[0] == k) and len(kept) < len(want)

    takes = _takes(kept)
    docs = common.written(pipe.mixing(spark, docs, SF))
    assert Counter(r.doc_id for r in docs.collect()) == takes

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    want = Counter()
    for i, t, _ in kept:
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes())] += takes[i]
    packed = pipe.packing(spark, docs, SF).toPandas()
    assert Counter(zip(packed["doc_id"], packed["start"], packed["length"], packed["ids_crc32"])) == +want
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024
    whole = pipe.run(spark, SF).toPandas()
    cols = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(map(tuple, whole[cols].values.tolist())) == sorted(map(tuple, packed[cols].values.tolist()))


def test_discriminant_against_densities(spark):
    """Scores follow the log densities of two normal distributions, worked out plainly."""
    rng = np.random.default_rng(1)
    d = len(quality_classifier.FEATURES)
    x = np.vstack([rng.normal(size=(200, d)) * rng.uniform(0.5, 2, d) + 1, rng.normal(size=(150, d)) @ rng.normal(size=(d, d)) * 0.3])
    y = np.array([0] * 200 + [1] * 150)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    model = quality_classifier.fit(features, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, label int"), 0.1)
    share = [200 / 350, 150 / 350]
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = share[0] * cov[0] + share[1] * cov[1]
    scale = np.sqrt(np.diag(pooled))
    z = (x - x.mean(axis=0)) / scale
    target = 0.5 * pooled / np.outer(scale, scale) + 0.5 * np.eye(d) + 1e-3 * np.eye(d)
    log = []
    for c in (0, 1):
        s = 0.9 * cov[c] / np.outer(scale, scale) + 0.1 * target
        off = z - z[y == c].mean(axis=0)
        log.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(s), off))
    assert np.allclose(model.log_odds(x), log[1] - log[0], atol=1e-5)


def _kneser_ney(counts, order):
    """Probability of a gram (a tuple) by the textbook recursion over the counts of grams of `order`."""
    levels = [counts]
    for _ in range(order - 1):
        lower = Counter()
        for g in levels[-1]:
            lower[g[1:]] += 1
        levels.append(lower)
    levels = levels[::-1]
    off = []
    for c in levels:
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        off.append(once / (once + 2 * twice) if once and twice else 0.5)

    def p(g):
        if not g:
            return 1 / language_id.ALPHABET
        c, d = levels[len(g) - 1], off[len(g) - 1]
        same = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        return p(g[1:]) if not total else max(c.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[1:])

    return p


def test_character_models_against_the_textbook():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcde  é世", k=300)) for _ in range(3)]
    grams, n = np.unique(language_id.character_grams(texts)[0], return_counts=True)
    model = language_id.KneserNey(grams, n)
    split = lambda g: tuple(int(g) >> 16 * k & 0xFFFF for k in reversed(range(language_id.ORDER)))
    plain = _kneser_ney(Counter({split(g): int(v) for g, v in zip(grams, n, strict=True)}), language_id.ORDER)
    seen = rng.sample(list(grams), 60)
    other = [np.uint64(sum(ord(c) << 16 * k for k, c in enumerate(rng.choices("abcdeé世z ", k=4)))) for _ in range(60)]
    for g in (*seen, *other):
        assert math.isclose(model.probability(language_id.ORDER, np.array([g]))[0], plain(split(g)), rel_tol=1e-9)
    context = split(grams[5])[:-1]
    letters = {c for g in grams for c in split(g)}
    rest = (language_id.ALPHABET - len(letters)) * plain((*context, 0xFFFF))
    assert math.isclose(sum(plain((*context, c)) for c in letters) + rest, 1, rel_tol=1e-9)
    models = language_id.LanguageModels.of({"x": (grams, n)})
    nats, count = models.cross_entropies(texts[:1])
    own = language_id.character_grams(texts[:1])[0]
    assert count[0] == len(own) and math.isclose(nats[0, 0], -sum(math.log(plain(split(g))) for g in own) / len(own), rel_tol=1e-5)
    assert len(language_id.character_grams(["\U0001F600"])[0]) <= 1


def test_license_report_against_brute_force(spark):
    """All rules tried on all texts, without keywords or gate, and containment by pairs; base columns by a plain loop."""
    rules, rng = license_scan.signature_rules(), random.Random(8)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where(F.lower("text").rlike("licen|permission|copyright|warrant")).limit(40).collect()]
    for _ in range(40):
        texts.append(" and ".join(_sample(re._parser.parse(rng.choice(rules)[3]), rng) for _ in range(3)))
    texts += ["The MIT license. general public license MIT  LICENSE", None, ""]
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    base = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda x: x[0].lower(), t))
        at = [(k, label) for k in range(len(w)) for label, phrase in base.items() if w[k : k + len(phrase)] == phrase]
        low = t.lower()
        if len(low) != len(t):
            continue
        spans = sorted({(m.start(), -m.end(), -priority, label) for label, priority, _, pattern in rules for m in re.finditer(pattern, low) if m.end() > m.start()})
        left = [s for k, s in enumerate(spans) if not any(o[0] <= s[0] and -o[1] >= -s[1] and -o[2] >= -s[2] for o in spans[:k])]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert {(d.start, d.end, d.priority, d.label) for d in r.detections} == {(a, -b, -p, x) for a, b, p, x in left}, t
        assert r.labels == ",".join(sorted({x for _, x in at} | {s[3] for s in left}))


def test_rules_are_ordered_by_what_they_cost_and_reject(spark):
    docs = spark.createDataFrame([("SHOUT " * 30 if i % 2 else "plain words " * 30,) for i in range(400)], "text string")
    slow = quality_rules.Rule("slow", lambda t, w: F.length(F.regexp_replace(F.repeat(t, 200), "[aeiou]+", "")) < 0)
    dear = quality_rules.Rule("dear", lambda t, w: (F.length(F.regexp_replace(F.repeat(t, 200), "[aeiou]+", "")) >= 0) & t.startswith("SHOUT"))
    cheap = quality_rules.Rule("cheap", lambda t, w: t.startswith("SHOUT"))
    assert [r.name for r in quality_rules.order_rules(docs, (slow, dear, cheap))] == ["cheap", "dear", "slow"]
    assert [r.name for r in quality_rules.order_rules(docs.limit(0), (slow, dear, cheap))] == ["slow", "dear", "cheap"]


def test_scratch_tables_go(spark):
    with common.scratch(spark) as made:
        kept, gone = common.written(spark.range(3)), common.written(spark.range(4))
        made.pop(0)
    assert kept.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        gone.count()
