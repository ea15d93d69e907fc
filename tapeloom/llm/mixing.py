"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import joined_small, running_totals, word_count, written

WEIGHTS = (5, 2, 1)
#: Weight of a source at the start and at the end of training, relative to its mean; one for each of WEIGHTS.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def source_targets(sized: DataFrame, weights: Sequence[int], schedules: Sequence[tuple[float, float]], share: float, cap: float) -> DataFrame:
    """One row for each source: _rank, source_size, target, and the ends of its schedule.

    Targets share `share` of all words by weight; where that is over `cap` times the source's size the
    target stops there and the excess is shared again. The level that settles is the largest of the
    levels got by capping the first j sources in order of size over weight.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row for each source from here on
    src = src.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    nth = (F.col("_rank") - 1) % len(weights)
    pick = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), (nth + 1).cast("int"))
    src = src.select("*", pick(weights).alias("_w"), pick([s[0] for s in schedules]).alias("_from"), pick([s[1] for s in schedules]).alias("_to"), (F.col("source_size") * cap).alias("_cap"))
    every, before = Window.partitionBy(), Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    capped = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    src = src.withColumn("_level", (F.sum("source_size").over(every) * share - capped("_cap")) / (F.sum("_w").over(every) - capped("_w")))
    return src.select("source", "_rank", "source_size", "_from", "_to", F.least("_cap", F.col("_w") * F.max("_level").over(every)).alias("target"))


def _when(demand):
    """Training time (0 to 1) at which a source's cumulative demand, as a share of its target, is reached.

    The source's weight goes linearly from _from to _to; its integral is a quadratic, inverted here.
    """
    a, d = F.col("_from"), F.col("_to") - F.col("_from")
    return F.when(d == 0, demand).otherwise((F.sqrt(a * a + d * (a + F.col("_to")) * demand) - a) / d)


def mixing_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """What the mix takes of each row of `docs` (doc_id, text, source).

    Returns doc_id, size, source_size, target, taken, whole, part and position. A source's documents stand in
    a fixed pseudo-random order (md5 of doc_id, then hash of the text); the mix goes through them again and again until the
    source's target is met, so a document is taken `whole` times in full and once for its first `part`
    words. The time-varying schedule of the source places that demand in training time: `position` (0 to 1)
    is when the first word of the document is due, null if none is taken.

    Null texts have size 0 and take no part; null is a source of its own, after all others; repeated
    rows count as documents of their own; an empty table gives no rows; other columns are not read.
    """
    return _plan(docs, [], weights, schedules, share, cap)


def _plan(docs: DataFrame, keep: list[str], weights: Sequence[int] = WEIGHTS, schedules: Sequence[tuple[float, float]] = SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The plan, with the columns `keep` of `docs`; they also order rows of equal doc_id, without them a hash of the text does."""
    tie = keep or ["_tie"]
    sized = docs.select(*(keep or [F.xxhash64("text").alias("_tie")]), "doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"))
    src = source_targets(sized, weights, schedules, share, cap)
    src = src.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    rows = joined_small(sized.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"), src, ["_key"]).drop("_key")
    rows = running_totals(rows, ["_rank"], ["_order", "doc_id", *tie], {"size": "_before"})
    want, size = F.round("target").cast("long"), F.col("source_size")
    # in two steps, so that each value is computed once
    rows = rows.select("*", F.when(size > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("int").alias("whole"), want.alias("_want"))
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("_want") - F.col("whole") * F.col("source_size") - F.col("_before"))).cast("long"))
    taken = F.col("whole") * F.col("size") + F.col("part")
    due = F.when((taken > 0) & (F.col("_want") > 0), F.round(_when(F.col("_before") / F.col("_want")), 9))
    return rows.select(*keep, "doc_id", "size", "source_size", "target", taken.alias("taken"), "whole", "part", due.alias("position"), "_before", "_want", "_from", "_to")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """`docs` as the mix trains on them: a row for each time a document is taken, in order of position.

    Training takes documents whole, so a document taken in part counts if at least half of it is taken.
    All columns of `docs` stay. Rows are range-partitioned and sorted by position.

    Each row is a document of its own, also without a doc_id or with one that repeats; such rows stand
    next to each other, by their place in `docs`. A text without a word comes in each full pass of its source. Rows
    are numbered and written once, so that the plan finds them by number.
    """
    docs = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct("*").alias("_doc")))
    plan = _plan(docs.select("_row", "_doc.doc_id", "_doc.text", "_doc.source"), ["_row"], **options)
    plan = plan.select(F.explode(F.sequence(F.lit(0), "whole")).alias("_pass"), "*").where((F.col("_pass") < F.col("whole")) | ((F.col("_pass") == F.col("whole")) & (F.col("part") > 0) & (F.col("part") * 2 >= F.col("size"))))
    at = F.when(F.col("_want") > 0, _when(F.least(F.lit(1.0), (F.col("_before") + F.col("_pass") * F.col("source_size")) / F.col("_want"))))
    rows = docs.join(plan.select("_row", at.alias("_position")), "_row")
    order = ["_position", "_doc.doc_id", "_row"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_doc.*")


def op2_query(spark, sf_dir: str) -> DataFrame:
    plan = mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


OP2_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    md5(coalesce(cast(doc_id as varchar), '')) as o
  from documents),
src as (
  select source, sum(size)::double as source_size, row_number() over (order by source nulls last) as rk
  from sized group by source),
w as (
  select *, [5.0::double, 2.0, 1.0][(rk - 1) % 3 + 1] as w, [1.5::double, 1.0, 0.5][(rk - 1) % 3 + 1] as a,
    [0.5::double, 1.0, 1.5][(rk - 1) % 3 + 1] as b, source_size * 2 as cap from src),
lev as (
  select *, ((sum(source_size) over ()) * 1.5 - coalesce(sum(cap) over p, 0)) / ((sum(w) over ()) - coalesce(sum(w) over p, 0)) as level
  from w window p as (order by cap / w, rk rows between unbounded preceding and 1 preceding)),
tgt as (select source, source_size, a, b, least(cap, w * max(level) over ()) as target from lev),
d as (
  select doc_id, size, source_size, target, a, b, round(target) as want,
    coalesce(sum(size) over (partition by s.source order by o, doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join tgt on s.source is not distinct from tgt.source),
e as (select *, case when source_size > 0 then floor(want / source_size) else 0 end as whole from d),
f as (select *, whole * size + greatest(0, least(size, want - whole * source_size - before)) as taken from e)
select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target, cast(taken as bigint) as taken,
  case when taken > 0 and want > 0 then
    round(case when b - a = 0 then before / want else (sqrt(a * a + (b - a) * (a + b) * (before / want)) - a) / (b - a) end, 9) end as position
from f
"""
