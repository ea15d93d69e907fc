"""Merkle manifest of a dataset: a tree of hashes over each group's rows and over the groups, with a proof for every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import running_totals, written

FANOUT = 8
#: Characters of a hash.
HEX = 64
EMPTY = "array<struct<pos:int,siblings:string>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the values in turn: '-' for null, else the number of UTF-8 bytes, ':' and the value. No two different rows give the same input."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def with_runs(nodes: DataFrame, by: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """Adds to nodes (by, at, n, hash) the index `up` and hash `parent` of their parent, and `step`: place in the run and siblings, or no step where the tree has one node.

    One full-frame window over the run of a parent gives both; a run has at most `fanout` nodes, so no group is ever in one task.
    """
    run = F.collect_list("hash").over(Window.partitionBy(*by, "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = nodes.withColumn("up", F.floor(F.col("at") / fanout).cast("long")).withColumn("_run", run).withColumn("_pos", (F.col("at") % fanout).cast("int"))
    others = F.array_join(F.concat(F.slice("_run", F.lit(1), F.col("_pos")), F.slice("_run", F.col("_pos") + 2, F.lit(fanout))), "")
    several = F.col("n") > 1
    rows = rows.withColumn("parent", F.when(several, F.sha2(F.array_join("_run", ""), 256)).otherwise(F.col("hash")))
    return rows.withColumn("step", F.when(several, F.array(F.struct(F.col("_pos").alias("pos"), others.alias("siblings")))).otherwise(F.array()).cast(EMPTY)).drop("_run", "_pos")


def levels(nodes: DataFrame, by: Sequence[str], fanout: int = FANOUT) -> list[DataFrame]:
    """Node tables (by, at, n, hash) from the second level to the one where every tree of `by` has one node. Each is written: the next is built from it, and so are the proofs."""
    out, most = [], nodes.agg(F.max("n")).first()[0] or 1
    while not out or most > 1:
        nodes = with_runs(nodes.select(*by, "at", "n", "hash"), by, fanout).where(F.col("at") % fanout == 0)  # one node of each run stands for its parent
        nodes = written(nodes.select(*by, F.col("up").alias("at"), F.ceil(F.col("n") / fanout).cast("long").alias("n"), F.col("parent").alias("hash")))
        most = -(-most // fanout)
        out.append(nodes)
    return out


def with_paths(nodes: DataFrame, above: Sequence[DataFrame], top: DataFrame, by: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """Adds `steps`, the steps from each node to the top, and what else `top` (by, steps, ...) has: from the top down, each level joined to its parents."""
    upper = top.withColumn("up", F.lit(0).cast("long"))
    for level in [*reversed(above[:-1]), nodes]:
        rows = with_runs(level, by, fanout).drop("parent").join(upper.withColumnRenamed("steps", "_steps"), [*by, "up"])
        rows = rows.withColumn("steps", F.concat("step", "_steps")).drop("step", "_steps", "up")
        upper = rows.drop("n", "hash").withColumnRenamed("at", "up")
    return rows.drop("at", "n")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.substring(s["siblings"], F.lit(1), s["pos"] * HEX), h, F.substring(s["siblings"], s["pos"] * HEX + 1, F.length(s["siblings"]))), 256))


def proof(steps: Column) -> Column:
    """The siblings of all steps as one text, from the leaf to the root and from left to right."""
    return F.array_join(F.transform(steps, lambda s: s["siblings"]), "")


def manifest(rows: DataFrame, group: str, order: Sequence[str], fanout: int = FANOUT) -> DataFrame:
    """`rows` (with `leaf`) and their steps, subroot and root, in trees of `fanout`: one tree over the rows of each value of `group` by `order`, one over the values' roots by their bytes.

    Nulls in `group` are a group of their own, the first; nulls in `order` come first. Rows equal in `order` are ordered by leaf, so which of them is first
    changes no result; rows equal in both are interchangeable. Rows are numbered by a range partitioning with prefix sums, so a group that holds most rows is many tasks.
    No row gives no row. The names _has, _g, _tie, _one, at, n, hash, step, steps, up, subroot and root are taken.
    """
    by = ["_has", "_g"]
    keyed = rows.withColumn("_has", F.col(group).isNotNull().cast("int")).withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    keyed = written(keyed)  # hashing whole texts is done once
    keyed = keyed.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("long"))
    leaves = running_totals(keyed, by, [*order, "leaf", "_tie"], {"_one": "at"}).withColumnRenamed("at_all", "n").withColumn("hash", F.col("leaf")).drop("_tie", "_one")
    leaves = written(leaves)
    trees = levels(leaves, by, fanout)
    tops = running_totals(trees[-1].select(*by, "hash").withColumn("_one", F.lit(1).cast("long")), [], by, {"_one": "at"}).withColumnRenamed("at_all", "n").drop("_one")
    tops = written(tops.withColumn("subroot", F.col("hash")))
    crown = levels(tops, [], fanout)
    root = crown[-1].select(F.array().cast(EMPTY).alias("steps"), F.col("hash").alias("root"))
    top = with_paths(tops, crown, root, [], fanout).drop("hash")
    return with_paths(leaves, trees, top, by, fanout).drop("hash", *by)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified over all documents; every third doc_id by its crc32 has a tampered text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audited(docs)


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang, checked against a copy in which some texts (where 3 divides the crc32 of doc_id) have their A-Z lower-cased.

    A null doc_id is never tampered with, and a null text stays null.
    """
    fields = lambda text: leaf_hash([docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text])
    low = F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.when(F.crc32(docs["doc_id"].cast("string")) % 3 == 0, fields(low))
    rows = docs.select(docs["doc_id"], docs["lang"].alias("lang"), fields(docs["text"]).alias("leaf"), found.alias("found")).withColumn("found", F.coalesce("found", "leaf"))
    rows = manifest(rows, "lang", ["doc_id"])
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), folded(F.col("found"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, source: str, by: str, depth: int = 12) -> str:
    """Relations {name}0.. of nodes and {name}p0.. of runs, by groups; 8^12 rows of a group are enough."""
    out = [f"{name}0 as ({source})"]
    for k in range(depth):
        out.append(f"{name}p{k} as (select {by}, ix // 8 as ix, any_value(n) as n, list(h order by ix) as a from {name}{k} group by {by}, ix // 8)")
        out.append(f"{name}{k + 1} as (select {by}, ix, (n + 7) // 8 as n, case when n > 1 then sha256(array_to_string(a, '')) else a[1] end as h from {name}p{k})")
    return ",\n".join(out)


def _fold_sql(name: str, tree: str, source: str, by: str, depth: int = 12) -> str:
    """Relations {name}0..: `source` (ix, path, fold, ...) carried up the tree's levels."""
    out = [f"{name}0 as ({source})"]
    for k in range(depth):
        left, right = "array_to_string(p.a[1:x.ix % 8], '')", "array_to_string(p.a[x.ix % 8 + 2:], '')"
        out.append(
            f"{name}{k + 1} as (select x.* replace (x.ix // 8 as ix, x.path || case when p.n > 1 then {left} || {right} else '' end as path, case when p.n > 1 then sha256({left} || x.fold || {right}) else x.fold end as fold)"
            f" from {name}{k} x join {tree}p{k} p on p.{by} = x.{by} and p.ix = x.ix // 8)"
        )
    return ",\n".join(out)


_PART = lambda v: f"coalesce(octet_length(encode({v}))::varchar || ':' || {v}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_PART(v) for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


def op12_sql() -> str:
    """DuckDB has no crc32: `tab` is its table of bytes, and `crcs` folds the digits of doc_id with it."""
    return f"""
with recursive bits as (select b, 0 as k, b::ubigint as c from range(256) t(b) union all select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end from bits where k < 8),
tab as (select list(c order by b) as t from bits where k = 8),
crcs as (
  select distinct doc_id, doc_id::varchar as s, 0 as k, 4294967295::ubigint as c from documents where doc_id is not null
  union all select doc_id, s, k + 1, xor(c >> 8, t[(xor(c, ascii(s[k + 1])::ubigint) & 255)::bigint + 1]) from crcs, tab where k < length(s)),
crc as (select doc_id as own, xor(c, 4294967295::ubigint) as crc from crcs where k = length(s)),
d as (
  select d.doc_id, lang is not null as has, coalesce(lang, '') as g, {_LEAF('text')} as leaf,
    case when crc % 3 = 0 then {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as found
  from documents d left join crc on own = doc_id),
e as (select *, (has::int)::varchar || g as k, row_number() over (partition by has, g order by doc_id nulls first, leaf) - 1 as ix, count(*) over (partition by has, g) as n from d),
{_tree_sql('l', 'select k, ix, n, leaf as h from e', 'k')},
{_tree_sql('r', "select 1 as z, row_number() over (order by encode(k)) - 1 as ix, count(*) over () as n, h, k from l12", 'z')},
{_fold_sql('x', 'l', "select k, ix, doc_id, leaf, coalesce(found, leaf) as fold, '' as path from e", 'k')},
{_fold_sql('y', 'r', "select 1 as z, x12.k, r0.ix, doc_id, leaf, fold, path, r0.h as subroot from x12 join r0 on r0.k = x12.k", 'z')}
select doc_id, leaf, subroot, r12.h as root, sha256(path) as proof_sha256, fold as folded_root, fold = r12.h as verified from y12, r12
"""


OP12_SQL = op12_sql()
