"""Ordered windows over keys that hold many rows, and as-of joins, by stretches of the order with what is carried into them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Messages of the feed in one stretch.
STRETCH = 1 << 22


def stretch_of(seq: str | Column = "seq", width: int | None = None) -> Column:
    """The stretch that a place in the feed, or a time, lies in."""
    return F.floor((F.col(seq) if isinstance(seq, str) else seq) / (width or STRETCH)).cast("long")


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], stretch: Column, lag: Mapping[str, str] | None = None, lead: Mapping[str, str] | None = None, last: Mapping[str, str] | None = None) -> DataFrame:
    """`rows` with columns from their neighbours in `order` among rows of equal `keys`: name -> column of the row before (lag), of the row after (lead), or the last value that is not null up to the row (last).

    `stretch` grows with the order; a key's rows of one stretch are one window, so a key that holds most rows is as many tasks as it has stretches. What leaves
    each stretch (its first and last row, the last values) is a row for each key and stretch; a window over those tells what is carried into the next, which may
    be several stretches on. Both passes read the same shuffle. Rows with a null key or stretch are in no window and left out; orders differ within a key; columns of `rows` must not start with `_w`.
    """
    lag, lead, last = lag or {}, lead or {}, last or {}
    keys = list(keys)
    base = rows.withColumn("_w", stretch).where(" and ".join(f"`{k}` is not null" for k in [*keys, "_w"])).repartition(*keys, "_w")
    at = F.struct(*order)
    whole = F.struct(*rows.columns)  # all columns, so that both passes need the same shuffle
    edges = base.groupBy(*keys, "_w").agg(F.max_by(whole, at).alias("_w_end"), F.min_by(whole, at).alias("_w_begin"), *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_w_last_{n}") for n, c in last.items()])
    by = Window.partitionBy(*keys).orderBy("_w")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, "_w", F.lag("_w_end").over(by).alias("_w_before"), F.lead("_w_begin").over(by).alias("_w_after"), *[F.last(f"_w_last_{n}", ignorenulls=True).over(before).alias(f"_w_last_{n}") for n in last])
    own = Window.partitionBy(*keys, "_w").orderBy(*order)
    first, final = F.lag(F.lit(True)).over(own).isNull(), F.lead(F.lit(True)).over(own).isNull()
    new = [F.when(first, F.col("_w_before")[c]).otherwise(F.lag(c).over(own)).alias(n) for n, c in lag.items()]
    new += [F.when(final, F.col("_w_after")[c]).otherwise(F.lead(c).over(own)).alias(n) for n, c in lead.items()]
    new += [F.coalesce(F.last(c, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col(f"_w_last_{n}")).alias(n) for n, c in last.items()]
    return base.join(edges, [*keys, "_w"]).select(*rows.columns, *new)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, order: str, strict: bool = True, width: int | None = None) -> DataFrame:
    """Every row of `left` with `as_of`: the columns of the last row of `right` of equal keys whose `at` is before it (or, not `strict`, at the same time too); null where there is none.

    Of right rows of one time the one with the largest `order` counts. Both sides may have any times, repeated ones too. They are merged into one order and
    cut into stretches of `width` in `at` (a 64th of what `right` spans if not given), so a key with most rows is spread.
    """
    if width is None:
        lo, hi = right.agg(F.min(at), F.max(at)).first()
        width = max(1, ((hi or 0) - (lo or 0)) // 64 + 1)
    keys = list(keys)
    state = F.struct(*[F.col(c) for c in right.columns])
    none = F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType)
    asked = left.select(*keys, F.col(at).alias("at"), F.lit(0 if strict else 2).alias("kind"), F.monotonically_increasing_id().alias("tie"), F.struct(*left.columns).alias("own"), F.lit(None).cast(right.select(state).schema[0].dataType).alias("state"))
    known = right.select(*keys, F.col(at).alias("at"), F.lit(1).alias("kind"), F.col(order).cast("long").alias("tie"), none.alias("own"), state.alias("state"))
    merged = carried(asked.unionByName(known), keys, ["at", "kind", "tie"], stretch_of("at", width), last={"as_of": "state"})
    return merged.where("kind <> 1").select("own.*", "as_of")
