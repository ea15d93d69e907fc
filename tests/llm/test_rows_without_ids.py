"""Mixing of rows that have no doc_id: they are spread, and reruns agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.llm import mixing


def test_rows_without_ids_are_spread_and_reruns_agree(spark):
    rows = [(None, f"word{i} " * (1 + i % 7), "aabbbc"[i % 6]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # partitions as they are dealt
    try:
        plans = [mixing.mixing_plan(docs.repartition(n, *by)) for n, by in ((3, ["text"]), (7, ["source", "text"]))]
        spread = plans[0].groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    facts = [sorted(map(tuple, p.select("size", "source_size", "target", "taken", "position").collect())) for p in plans]
    assert facts[0] == facts[1]
    per = {}
    for _, size, target, taken, _ in facts[0]:
        per[size, target] = per.get((size, target), 0) + taken
    assert all(total == round(target) for (_, target), total in per.items())
    assert len(spread) > 1 and max(r["count"] for r in spread) <= 3 * 6000 / len(spread)
