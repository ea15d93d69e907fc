"""Substring dedup, Merkle manifest and divergence audit against plain Python, on odd tables too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import check
from pyspark.sql import functions as F

from tapeloom.llm.divergence import divergence
from tapeloom.llm.merkle import audited
from tapeloom.llm.substring_dedup import Powers, Hashed, WIDTH, without_repeats, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_source_divergence"])
def test_against_sql(spark, name):
    check(spark, name)


# substring dedup


def plain_repeats(rows):
    """(doc_id, words, removed, hash) of each row; windows are compared as tuples of words."""
    least = {}
    words = [[] if t is None else re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for _, t in rows]
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - WIDTH + 1) if i is not None else ():
            k = tuple(w[p : p + WIDTH])
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - WIDTH + 1) if i is not None else ():
            if least[tuple(w[p : p + WIDTH])] < i:
                gone[p : p + WIDTH] = [True] * WIDTH
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def repeats(spark, rows):
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_repeats_of_copies_and_passages(spark):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randrange(5000))
    text = lambda n: [word() for _ in range(n)]
    passage, base = text(130), text(400)
    rows = []
    for i in range(60):
        kind = i % 6
        w = text(rng.randrange(0, 300))
        if kind == 0:  # a passage at any place
            w[len(w) // 2 : len(w) // 2] = passage[rng.randrange(30) : 130 - rng.randrange(30)]
        elif kind == 1:  # near copies
            w = list(base)
            for _ in range(3):
                w[rng.randrange(400)] = word()
        elif kind == 2:
            w = list(base)
        elif kind == 3:  # the end of one next to the middle of another
            w = base[350:] + passage[40:100] + base[:49]
        rows.append((1000 - i if i % 2 else i, rng.choice([" ", "\n", "\t \r"]).join(w)))
    rng.shuffle(rows)
    assert repeats(spark, rows) == plain_repeats(rows)


def test_repeats_of_repetitive_texts(spark):
    """Texts of few words: windows repeat within a text, anchors tie, pieces follow themselves."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab" if i % 2 else "aaaab") for _ in range(rng.randrange(40, 400)))) for i in range(25)]
    rows += [(100 + i, " ".join("xyz"[k % 3] for k in range(60 + 7 * i))) for i in range(12)]
    rows += [(200 + i, " ".join(["same"] * (49 + i))) for i in range(6)]
    assert repeats(spark, rows) == plain_repeats(rows)


def test_repeats_of_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, long), (None, long), (4, long), (4, long), (4, long + " more"), (5, "x" + long), (-7, long.replace(" ", " ")), (6, long.replace("t3 ", "T3 ")), (7, "é " + long + " \x00")]
    assert repeats(spark, rows) == plain_repeats(rows)
    assert repeats(spark, [(1, "one")]) == plain_repeats([(1, "one")])
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string, KEY int, unit int")).count() == 0


def test_long_texts_are_hashed_in_blocks():
    rng = random.Random(1)
    text = " ".join("v" * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(400_000)).encode() + b"  " + b"z" * 3_000_000 + b" end"
    h, at = word_hashes(text, Powers())
    words = text.split()
    assert len(h) == len(words) and [text[i : i + 2] for i in at[::9999].tolist()] == [w[:2] for w in words[::9999]]
    assert len(set(h.tolist())) == len(set(words)) and dict(zip(words, h.tolist())) == {w: x for w, x in zip(reversed(words), reversed(h.tolist()))}


def test_equal_windows_have_equal_pieces():
    rng = random.Random(2)
    words = [f"q{rng.randrange(6)}".encode() for _ in range(500)]
    a, b = Hashed([b" ".join(words)], Powers()), Hashed([b"other words before", b" ".join(words[60:300])], Powers())
    full = {p.tobytes(): None for p in [a.spans(a.begin[0] + 60, a.begin[0] + 300).reshape(1)]}
    assert b.spans(b.begin[1], b.begin[1] + 240).reshape(1).tobytes() in full


# Merkle manifest


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(part, (r[0], r[3], r[2], r[4], text))))
    low = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):  # the root, and for each node its steps (left, right)
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k in range(len(steps)):
                run = nodes[at[k] // 8 * 8 : at[k] // 8 * 8 + 8]
                steps[k].append(("".join(run[: at[k] % 8]), "".join(run[at[k] % 8 + 1 :])))
                at[k] //= 8
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        return nodes[0], steps

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[g] = tree([leaf(r, r[1]) for r in members])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, upper = tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for r, own in zip(groups[g], trees[g][1]):
            steps = own + above
            h = leaf(r, low(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1])
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[0], leaf(r, r[1]), trees[g][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("count", [1, 2, 9, 70])
def test_manifest(spark, count):
    rows = [(i * 7 - 30, f"Text {i} É", "ab"[i % 2] if i % 5 else None, None if i % 11 == 3 else f"s{i % 3}", i) for i in range(count)]
    rows += [(10_000 + i, None if i % 2 else "", f"l{i}", "x", None) for i in range(count // 7)]
    got = sorted((tuple(r) for r in audited(spark.createDataFrame(rows, DOCS)).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert count < 9 or {r[-1] for r in got} == {True, False}


def test_manifest_of_odd_rows(spark):
    rows = [(None, "A", "x", "s", 1)] * 12 + [(5, "B", "x", "s", 1)] * 3 + [(5, "C", "x", "s", 1), (None, None, None, None, None), (1, "A" * 100_000, "", "s", 2), (2, "1:a-", "", "-", 3)]
    assert sorted((tuple(r) for r in audited(spark.createDataFrame(rows, DOCS)).collect()), key=repr) == plain_manifest(rows)
    assert audited(spark.createDataFrame([], DOCS + ", hash string, steps int")).count() == 0
    more = spark.createDataFrame(rows[-3:], DOCS).withColumn("leaf", F.lit(1)).withColumn("_g", F.lit(1)).withColumn("up", F.lit(2))
    assert sorted((tuple(r) for r in audited(more).collect()), key=repr) == plain_manifest(rows[-3:])


# divergence audit


def plain_divergence(rows, least=30, top=50):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(r[1] or ""))) for r in rows]
    have, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, ts in docs:
        sources[lang].add(source)
        have[lang].update(set(ts))
        counts[lang, source].update(ts)
    out = []
    for lang in sources:
        kept = [t for t, n in have[lang].items() if n >= least]
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: price(counts[lang, s]) for s in sources[lang]}
        q = price(sum((counts[lang, s] for s in sources[lang]), Counter()))
        for s in sources[lang]:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources[lang] if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["Ab", "ab", "é", "É", "zz-top", "x1y", "_", "straße", f"r{i % 7}q"]) for _ in range(rng.randrange(0, 30))), rng.choice(["a", "b", None]), rng.choice(["s", "t", "ü", "", None]), 0) for i in range(400)]
    rows += [(1000, None, "lonely", "s", 0), (1001, "few words", "two", "s", 0), (1001, "few words", "two", "t", 0), (None, "ab " * 50_000, "a", "hot", 0)]
    got = sorted(tuple(r) for r in divergence(spark.createDataFrame(rows, DOCS)).collect())
    assert got == plain_divergence(rows)
    few = sorted(tuple(r) for r in divergence(spark.createDataFrame(rows, DOCS), 5, 2).collect())
    assert few == plain_divergence(rows, 5, 2)


def test_divergence_of_odd_tables(spark):
    assert divergence(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, "x", None)]
    more = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit(1)).withColumn("n", F.lit(1)).withColumn("_g", F.lit(1))
    assert sorted(tuple(r) for r in divergence(more).collect()) == plain_divergence(rows) == [("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)]
