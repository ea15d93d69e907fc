"""Source divergence audit: how far the term probabilities of a language's sources are from each other, and from the language's own."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import joined_counted, written

#: A lower-cased term: ASCII letters and anything beyond ASCII (in UTF-8, every byte from 0x80 on).
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Different (language, source, term) that a task gathers before it hands them on; bytes of text from which terms are not listed but counted one by one.
HELD, LONG = 200_000, 4 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
#: Tasks that the pairs of one language are dealt to.
DEALT = 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task: for each lang, source and term its occurrences and documents; a row with a null term counts a group's documents."""
    held: dict[tuple[str, str], dict] = defaultdict(dict)
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            names = [None if t is None else t.decode() for t in terms]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.string()), pa.array([x[0] for x in terms.values()], pa.int64()), pa.array([x[1] for x in terms.values()], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            lang, source, text = (batch.column(c)[i].as_py() for c in range(3))
            raw = text.encode().lower()  # of bytes, lower() changes A to Z only
            own = Counter(TERM.findall(raw) if len(raw) < LONG else (x.group() for x in TERM.finditer(raw)))
            terms = held[lang, source]
            size -= len(terms)
            for t, n in own.items():
                x = terms.get(t)
                if x is None:
                    terms[t] = [n, 1]
                else:
                    x[0] += n
                    x[1] += 1
            terms.setdefault(None, [0, 0])[1] += 1
            size += len(terms)
            if size > HELD:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group and the documents that have it. The row with a null term holds the group's documents.

    Null columns are read as ''. Tasks sum up before they shuffle, so what a hot group or a frequent term ships are a few rows a task.
    """
    part = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(_counted, COUNTS)
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 terms)) in whole numbers, which may pass 64 bits on the way; null without terms."""
    return F.expr(f"1 + (cast({n} + 5 as decimal(20,0)) * cast(1000000000 as decimal(10,0))) div cast(nullif({total} + 5 * {terms}, 0) as decimal(20,0))")


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the L1 distance of a source to each other source of its language, part `term` the `top` terms it has more often than its language.

    Terms are those in at least `least_docs` documents (rows) of a language; probabilities are smoothed and scaled to whole numbers, so sums are exact
    and do not depend on an order. The distance of two sources is put together from what most terms have in common:
    terms that one of them has are priced by its histogram of counts (how many terms have a count) as if the other had none, terms that both have are
    corrected where their postings meet, and terms that neither has cost a constant each. So work grows with the postings, not with sources times terms.

    Null lang, source and text are '', and groups of that name are one. A group without terms has all distances; a language with one source has no pair.
    Without documents there are no rows. Only doc columns text, lang and source are read.
    """
    counts = written(term_counts(docs))
    terms = counts.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    posts = written(terms.drop("docs").join(kept, ["lang", "term"]))
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("lang_total"))
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(groups.withColumn("zero", _price("0L", "total", "v")).withColumn("_g", F.xxhash64("lang", "source")))

    priced = joined_counted(posts.withColumn("_g", F.xxhash64("lang", "source")), groups.select("_g", "lang", "source", "total", "size", "v", "lang_total"), ["_g", "lang", "source"], posts.count(), "size")
    priced = written(priced.select("lang", "source", "term", "n", _price("n", "total", "v").alias("p"), _price("all", "lang_total", "v").alias("q")))

    # both sources of a pair, the smaller name first; sources of a language are dealt to several tasks
    deal = F.pmod(F.xxhash64("source"), F.lit(DEALT)).cast("int")
    others = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.col("size").alias("other_size"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_deal"))
    one, two = F.least("source", "other").alias("one"), F.greatest("source", "other").alias("two")
    neither = groups.withColumn("_deal", deal).join(others, ["lang", "_deal"]).where("source < other")
    neither = neither.select("lang", one, two, F.coalesce((F.col("v") - F.col("size") - F.col("other_size")) * F.abs(F.col("zero") - F.col("other_zero")), F.lit(0)).alias("x"))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    single = histogram.withColumn("_deal", deal).join(others, ["lang", "_deal"]).where("source <> other").select("lang", one, two, (F.col("k") * F.abs(F.col("p") - F.col("other_zero"))).alias("x"))
    posted = joined_counted(priced.withColumn("_g", F.xxhash64("lang", "source")), groups.select("_g", "lang", "source", "zero", "size"), ["_g", "lang", "source"], posts.count(), "size").select("lang", "term", "source", "p", "zero")
    again = posted.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    far = lambda a, b: F.abs(F.col(a) - F.col(b))
    both = posted.join(again, ["lang", "term"]).where("source < other").select("lang", one, two, (far("p", "other_p") - far("p", "other_zero") - far("zero", "other_p") + far("zero", "other_zero")).alias("x"))
    pairs = neither.unionByName(single).unionByName(both).groupBy("lang", "one", "two").agg(F.sum("x").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("s"), "value").select("lang", "s.source", "s.item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank)
    over = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("part", F.lit("pair")).unionByName(over.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank over all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with d as (
  select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as (select i, lang, source, unnest(ts) as term from d),
kept as (select lang, term, count(*) as al from t group by lang, term having count(distinct i) >= 30),
ls as (select l.lang, count(k.term) as v, coalesce(sum(k.al), 0) as tot from (select distinct lang from d) l left join kept k on k.lang = l.lang group by l.lang),
g as (select distinct lang, source from d),
c as (select t.lang, t.source, t.term, count(*) as n from t join kept k on k.lang = t.lang and k.term = t.term group by all),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.al, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as tot
  from g join kept k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (
  select x.lang, x.source, x.term, x.n, 1 + (1000000000::hugeint * (x.n + 5)) // (x.tot + 5 * ls.v) as p, 1 + (1000000000::hugeint * (x.al + 5)) // (ls.tot + 5 * ls.v) as q
  from dense x join ls on ls.lang = x.lang),
pr as (
  select a.lang, a.source, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y on x.term = y.term where x.lang = a.lang and y.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source),
tm as (select lang, source, term as item, p - q as value from p where n > 0 and p > q),
u as (select 'pair' as part, * from pr union all select 'term', * from tm),
r as (select *, row_number() over (partition by part, lang, source order by value desc, encode(item)) as rank from u)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50
"""
