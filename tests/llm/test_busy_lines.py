"""Line dedup where lines hold many rows, or are too many to broadcast."""

import random
from collections import defaultdict

import pytest

from tapeloom.llm import common, line_dedup


def plain(rows, sites):
    """(doc_id, text) -> what is left of it."""
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    on, first = defaultdict(set), {}
    for i, t, s in rows:
        for x in map(norm, (t or "").split("\n")):
            if x and t is not None:
                on[x].add(s)
                if i is not None:
                    first[x] = min(i, first.get(x, i))
    gone = lambda i, x: i is not None and norm(x) != "" and len(on[norm(x)]) >= sites and i > first[norm(x)]
    return sorted(((i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x)), s) for i, t, s in rows), key=repr)


@pytest.mark.parametrize("few", [100_000, 3])
def test_hot_lines_also_beyond_a_broadcast(spark, monkeypatch, few):
    """A spread line on every row, a busy line of one site, lines near the limit, nulls, blank lines, case: the same rows by either join."""
    for module in (common, line_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", few)
        monkeypatch.setattr(module, "HOT_ROWS", 8)
    rng = random.Random(9)
    rows = []
    for i in range(400):
        site = rng.choice(["a", "b", "c", "d", "e", "f", None])
        own = [f"line {rng.randrange(60)}", rng.choice(["Cookies", " cookies\t", "COOKIES"]), "", f"only {i}", rng.choice([f"near {i % 9}", "x"])]
        rng.shuffle(own)
        rows.append((i if i % 50 else None, "\n".join([*own, "of one site"] if site == "a" else own), site))
    rows += [(900, None, "a"), (901, "", "b"), (902, "\n\n", "c"), (903, "cookies\ncookies\nCookies", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_dedup.without_boilerplate(docs, min_sites=5).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 5)


def test_one_text_of_many_removed_lines(spark):
    """50,000 lines of one document, every other one spread: the kept lines in order."""
    n = 50_000
    shared = "\n".join(f"s {i}" for i in range(0, n, 2))
    rows = [(i, shared, f"site {i}") for i in range(5)] + [(9, "\n".join(f"s {i}" if i % 2 == 0 else f"own {i}" for i in range(n)), "z")]
    got = {r.doc_id: r.text for r in line_dedup.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=5).collect()}
    assert got[9] == "\n".join(f"own {i}" for i in range(1, n, 2)) and got[0] == shared and got[1] == ""
