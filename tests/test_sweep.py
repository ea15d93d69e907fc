"""Best levels by intervals against a book kept one change at a time."""

import random

import numpy as np
import pyarrow as pa

from tapeloom.functions import sweep


def test_covered():
    rng = random.Random(1)
    for n in (1, 2, 7, 64, 300):
        spans = [sorted(rng.sample(range(n + 1), 2)) for _ in range(rng.randrange(0, 80))]
        key = [rng.randrange(1000) for _ in spans]
        want = [max((k for (a, b), k in zip(spans, key) if a <= t < b), default=-1) for t in range(n)]
        got = sweep.covered(np.array([a for a, _ in spans], int), np.array([b for _, b in spans], int), np.array(key, int), n)
        assert got.tolist() == want


def test_best_levels():
    rng = random.Random(2)
    rows, want = [], []
    for group in range(30):
        book, seq = {}, -5
        for _ in range(rng.randrange(1, 120)):
            seq += rng.randrange(1, 3)
            for side, price in {(rng.randrange(2), rng.choice([0, 1, 5, 9, 2**32 - 1])) for _ in range(rng.randrange(1, 3))}:
                size, count = book.get((side, price), (0, 0))
                d = rng.choice([1, 1, -1]) if count else 1
                s = -size if count + d == 0 else rng.randrange(1, 9) * (1 << 40)
                rows.append((group, side, price, seq, s, d))
                book[side, price] = (size + s, count + d)
            best = [max(((p, *v) for (x, p), v in book.items() if x == 0 and v[1]), default=(0, 0, 0)), min(((p, *v) for (x, p), v in book.items() if x == 1 and v[1]), default=(0, 0, 0))]
            want.append([best[0][0], best[1][0], best[0][1], best[1][1], best[0][2], best[1][2]])
    first, got = sweep.best_levels(*(np.array(c) for c in zip(*rows)))
    assert len(first) == len(want)
    assert [list(x) for x in zip(*(got[c].tolist() for c in ("bid_px", "ask_px", "bid_sz", "ask_sz", "bid_ct", "ask_ct")))] == want


def test_groups_stay_whole(monkeypatch):
    monkeypatch.setattr(sweep, "ROWS", 10)
    sizes = [1, 3, 40, 2, 9, 1, 1, 25]
    values = [g for g, n in enumerate(sizes) for _ in range(n)]
    batches = [pa.record_batch({"g": values[i : i + 4], "h": [0] * len(values[i : i + 4])}) for i in range(0, len(values), 4)]
    seen = []
    out = sweep.by_groups(2, lambda t: seen.append(t.column("g").to_pylist()) or t)(iter(batches))
    assert [x for b in out for x in b.column("g").to_pylist()] == values
    assert all(set(a).isdisjoint(b) for a, b in zip(seen, seen[1:])) and len(seen) >= 3
