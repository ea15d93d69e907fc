"""What several operators share: shared checkpoints, word classes, distributed prefix sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that ends a word: space and TAB to CR. Anything else belongs to a word.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A small table is broadcast only up to this many rows (a few MB); beyond it the join shuffles.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
#: Rows of one key from which its rows no longer meet in one task of a join.
HOT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else the one given to setCheckpointDir; a local one only where Spark runs in one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")
        named = os.path.join(tempfile.gettempdir(), "tapeloom-checkpoints")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders of the tables that `written` has made since `scratch` was entered.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that `written` makes inside, but for those taken out of the list that it gives."""
    made: list[str] = []
    before = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(before)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared checkpoint folder; partitions and their order stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: columnar, so later reads prune columns.

    The folder stays for whoever reads the result; inside `scratch` it goes at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it a name that no column of `df` has, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, also where a lambda in `body` uses it per element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of `text` in order (array<string>; empty for null or blank text)."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def word_count(text: Column) -> Column:
    """Number of words (long); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def joined_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a table that is nearly always small: broadcast after its rows and bytes are checked, else shuffled."""
    small = checkpointed(small)
    wide = [F.octet_length(f.name) for f in small.schema if f.dataType.typeName() in ("string", "binary")]
    size = small.agg(F.count("*").alias("n"), F.sum(sum(map(F.coalesce, wide, [F.lit(0)] * len(wide)), F.lit(0)).cast("long")).alias("bytes")).first()
    fits = size["n"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    return df.join(F.broadcast(small) if fits else small, on, how)


def hot_limit(rows: int) -> int:
    """How many rows of one key may meet in a task, of `rows` in all. So few keys are over it that a table of them can be broadcast."""
    return max(HOT_ROWS, -(-rows // BROADCAST_ROWS))


def joined_counted(df: DataFrame, table: DataFrame, on: list[str], rows: int, n: str = "n", how: str = "inner") -> DataFrame:
    """Join (inner or left) with a table of unique keys and a few numbers that tells in `n` how many rows of `df` each key has.

    `rows` is the number of rows of `df`, or more; the first key is a long. Keys over hot_limit(rows) are broadcast, at most BROADCAST_ROWS by
    their definition, and their rows are dealt by a hash of the whole row; all others shuffle by key.
    """
    if rows <= BROADCAST_ROWS:  # so are the keys
        return df.join(F.broadcast(table), on, how)
    limit = hot_limit(rows)
    more = [c for c in table.columns if c not in on]
    hot = table.where(F.col(n) > limit).select(*on, F.struct(*more).alias("_hot"))
    cold = table.where(F.col(n) <= limit).select(F.col(on[0]).alias("_key"), *on[1:], F.struct(*more).alias("_cold"))
    both = df.join(F.broadcast(hot), on, "left").withColumn("_key", F.when(F.col("_hot").isNotNull(), F.xxhash64(*df.columns)).otherwise(F.col(on[0])))
    both = both.join(cold, ["_key", *on[1:]], "left")
    if how == "inner":
        both = both.where("_hot is not null or _cold is not null")
    return both.select(*df.columns, *[F.when(F.col("_hot").isNotNull(), F.col("_hot")[c]).otherwise(F.col("_cold")[c]).alias(c) for c in more])


def joined_wide(df: DataFrame, wide: DataFrame, on: list[str], rows: int, per: int = 64) -> DataFrame:
    """Inner join of narrow rows with a table of unique keys and wide values, which are never broadcast.

    A value that more than `per` rows ask for is copied, so that about `per` rows meet one copy in a task. `rows` is the
    number of rows of `df`, which is read twice; the first key is a long.
    """
    asked = df.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > per).withColumn("_copies", F.ceil(F.col("n") / per).cast("int"))
    left = joined_counted(df, asked, on, rows, how="left").withColumn("_copy", F.coalesce(F.pmod(F.xxhash64(*df.columns), F.col("_copies")), F.lit(0)).cast("int"))
    right = wide.join(asked.drop("n"), on, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)))
    return left.drop("n", "_copies").join(right.drop("_copies"), [*on, "_copy"]).drop("_copy")


def running_totals(df: DataFrame, group_by: Sequence[str], order_by: Sequence[str], totals: dict[str, str]) -> DataFrame:
    """Adds, for each `value: name` of `totals`, the sum of `value` over the rows before this one in its group.

    Rows are range-partitioned by group and order, the totals of each partition (one row for each
    partition and group in it) are summed up first, and each partition then adds its own running sum.
    So a group that holds most of the rows is spread over many partitions. `<name>_all` holds the
    group's total. Group columns must not be null; values are long and not null. The partitioned rows
    are checkpointed: both passes see the same partitions also if an executor is lost.
    """
    parts = checkpointed(df.repartitionByRange(*group_by, *order_by).withColumn("_part", F.spark_partition_id()))
    per = parts.groupBy("_part", *group_by).agg(*[F.sum(v).alias(f"_sum_{n}") for v, n in totals.items()])
    group = Window.partitionBy(*group_by) if group_by else Window.partitionBy()
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "_part", *group_by,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in totals.values()],
        *[F.sum(f"_sum_{n}").over(group).alias(f"{n}_all") for n in totals.values()],
    )
    inside = Window.partitionBy("_part", *group_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    out = joined_small(parts, per, ["_part", *group_by])
    out = out.select("*", *[(F.col(f"_base_{n}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for v, n in totals.items()])
    return out.drop("_part", *[f"_base_{n}" for n in totals.values()])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: `edges` (a long, b long) -> (node long, component long: its smallest node).

    Alternates the large-star and the small-star step: each step links the neighbours of a node to the
    smallest of them, until every node points at the smallest of its component. Both steps are one
    aggregation, which combines before it shuffles, and one join over the edges, in which nodes of many
    neighbours are broadcast (`joined_counted`), so a hub's edges stay spread. An edge
    between equal nodes is ignored; `edges` without rows gives no rows. Stops at the fixed point, which
    takes about as many rounds as the logarithm of the longest path.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = lambda: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = mark()
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined_counted(both, least, ["a"], 2 * last[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = checkpointed(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_counted(large, down, ["a"], 2 * last[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = checkpointed(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        if (now := mark()) == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def least_reached(near: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a block pair reaches through its links."""
    x, y = ids_x.copy(), ids_y.copy()
    top = np.iinfo(np.int64).max
    while True:
        new_x = np.minimum(x, np.where(near, y[None, :], top).min(axis=1, initial=top))
        new_y = np.minimum(y, np.where(near, new_x[:, None], top).min(axis=0, initial=top))
        if (new_x == x).all() and (new_y == y).all():
            return x, y
        x, y = new_x, new_y


def any_of(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))
