"""Texts of very many matches or lines, and keys that hold a third of all rows."""

import random
import time
from collections import Counter


from tapeloom.llm import license_scan


def test_license_matches_of_one_long_text(spark):
    """Places over several runs of gathered matches, with matches contained in others between."""
    rng = random.Random(2)
    parts = [rng.choice(["mit license", "licensed under the mit license", "gpl-3.0", "words", "é\U0001f600"]) for _ in range(3000)]
    text = " , ".join(parts)
    row = license_scan.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    at = [(d.start, d.end) for d in row.detections]
    assert at == sorted(at) and len(at) > 3 * license_scan.RUN
    found = Counter(text[d.start : d.end].lower() for d in row.detections)
    assert found["licensed under the mit license"] + found["under the mit license"] == parts.count("licensed under the mit license")
    assert found["mit license"] == parts.count("mit license")


def test_license_time_follows_matches(spark):
    """100,000 matches in one text cost seconds, where a square would take hours."""
    def took(n):
        text = "the mit license , " * n
        t = time.monotonic()
        row = license_scan.license_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
        assert len(row.detections) == n and row.n_base == n
        assert (row.detections[-1].start, row.detections[-1].end) == (18 * (n - 1) + 4, 18 * (n - 1) + 15)
        return time.monotonic() - t

    took(1)
    few, many = took(1000), took(100_000)
    print(few, many)
    assert many < few + 60
