"""Quality rules: a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACE, let, words_of

SYMBOLS = r"[#*$%&|<>]"


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def _chars(text: Column, runs: str) -> Column:
    """Characters of `text` in runs that match; where most characters do, cheaper than a match for each."""
    return (F.length(text) - F.length(F.regexp_replace(text, runs, ""))).cast("long")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def full_lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(full_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _windows(hashes: Column, width: int) -> Column:
    """A hash of every window of `width` of `hashes`, in order; a window's hash is that of its halves'."""
    if width == 1:
        return hashes
    pairs = lambda a, b, by: F.zip_with(F.slice(a, F.lit(1), F.size(a) - by), F.slice(b, F.lit(by + 1), F.size(b) - by), lambda x, y: F.xxhash64(x, y))
    even = let(_windows(hashes, width // 2), lambda h: pairs(h, h, width // 2))
    return even if width % 2 == 0 else let(even, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - 1), F.slice(hashes, F.lit(width), F.size(h) - 1), lambda x, y: F.xxhash64(x, y)))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Of an array of words, those in a window of `window` words found twice or more in it, the first included.

    Windows are compared by a 64-bit hash, built by doubling from their words' hashes. Only texts that
    hold a repeated window are looked at further: sorting puts equal windows side by side, and a sweep over
    their starts adds up the words they cover. All of it is linear in the text but for that sort.
    """

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))
        starts = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["i"])))
        step = lambda a, p: F.struct((p + window).alias("end"), (a["n"] + window - F.greatest(F.lit(0), a["end"] - p)).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"])

    def count(hashes: Column) -> Column:
        return let(_windows(hashes, window), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) <= window, F.lit(0)).otherwise(count(h))).cast("long")


@dataclass(frozen=True)
class Rule:
    """A rule that rejects a text: an expression over the text and the array of its words, split once for all rules."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base rules come from the contract; the others take texts far outside what prose looks like.
BASE_RULES = (
    Rule("few_words", lambda t, w: F.size(w) < 20),
    Rule("repeated_windows", lambda t, w: repeated_words(w) * 100 > F.size(w) * 30),
)
EXTRA_RULES = (
    Rule("symbols", lambda t, w: _count(t, SYMBOLS) * 4 > F.size(w)),
    Rule("shouting", lambda t, w: F.coalesce(F.try_divide(_chars(t, "[A-Z]+"), _chars(t, "[A-Za-z]+")) > 0.6, F.lit(False))),
    Rule("exclamations", lambda t, w: _count(t, "!") * 3 > F.size(w)),
    Rule("word_length", lambda t, w: ~F.coalesce(F.try_divide(word_chars(w), F.size(w)), F.lit(0.0)).between(1.5, 25)),
    Rule("dup_lines", lambda t, w: let(full_lines(t), lambda x: (F.size(x) > 3) & ((F.size(x) - F.size(F.array_distinct(x))) * 2 > F.size(x)))),
)


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 500, runs: int = 3) -> list[Rule]:
    """`rules` by rejected share over seconds, most first, both measured on a random sample of about `sample_rows` rows of all `docs`.

    A rule's seconds are the least of `runs` runs over the sample, less those of a rule that does nothing, so that what a job takes to
    start or to compile counts for none. The sample decides only the order in which a cascade looks at the rules, never its
    verdicts. Ties (also an empty table) keep the given order.
    """
    sample = docs.select("text").sample(min(1.0, sample_rows / max(1, docs.count())), seed=7).repartition(1).withColumn("words", words_of(F.col("text"))).persist()
    idle = Rule("idle", lambda t, w: F.size(w) < 0)
    hits, seconds = {}, {}
    try:
        for _ in range(runs):
            for rule in (idle, *rules):
                began = time.perf_counter()
                hits[rule.name] = sample.agg(F.count_if(rule.rejects(F.col("text"), F.col("words"))).alias("n")).first()["n"]
                seconds[rule.name] = min(seconds.get(rule.name, float("inf")), time.perf_counter() - began)
    finally:
        sample.unpersist()
    merit = [hits[r.name] / max(seconds[r.name] - seconds["idle"], 1e-4) for r in rules]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-merit[i], i))]


def cascade(text: Column, words: Column, rules: Sequence[Rule]) -> Column:
    """Whether any rule rejects the text; later rules are not evaluated once one does."""
    verdict = F.lit(False)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text, words), F.lit(True)).otherwise(verdict)
    return verdict


def passing(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + EXTRA_RULES) -> DataFrame:
    """The rows of `docs` (text) that no rule rejects, with all their columns.

    Null and empty texts have no words and are rejected; repeated rows get the same verdict; other
    columns are passed on and may have any name; an empty table stays empty.
    """
    text, ordered = docs["text"], order_rules(docs, rules)
    return docs.where(let(words_of(text), lambda w: ~cascade(text, w, ordered)))


def rule_report(docs: DataFrame) -> DataFrame:
    """The base counts of every row of `docs` (doc_id, text) and the cascade's verdict; no row is left out.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. Null texts count
    as empty ones: no words, so base_failed.
    """
    t = F.col("text")
    extra = order_rules(docs, EXTRA_RULES)

    def counts(w: Column) -> Column:
        base = F.struct(F.size(w).cast("long").alias("n_words"), word_chars(w).alias("word_chars"), _count(t, SYMBOLS).alias("n_symbols"), dup_lines(t).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words"))
        failed = lambda b: (b["n_words"] < 20) | (b["n_repeat_words"] * 100 > b["n_words"] * 30)
        return let(base, lambda b: F.struct(b.alias("base"), failed(b).alias("base_failed"), F.when(failed(b), F.lit(False)).otherwise(~cascade(t, w, extra)).alias("kept")))

    return docs.select("doc_id", let(words_of(t), counts).alias("_counts")).select("doc_id", "_counts.base.*", "_counts.base_failed", "_counts.kept")


def op7_query(spark, sf_dir: str) -> DataFrame:
    return rule_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (
  select rid, i, array_to_string(words[i:i + 7], ' ') as gram
  from (select rid, words, unnest(range(1, len(words) - 6)) as i from d where len(words) >= 8)),
r as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g) where c > 1),
p as (select rid, i, lag(i) over (partition by rid order by i) as prev from r),
rep as (select rid, sum(least(8, i - coalesce(prev, i - 8))) as n from p group by rid),
s as (
  select doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(ls) as n_lines,
    length(text) - length(regexp_replace(text, '!', '', 'g')) as bangs,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as upper_n,
    length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as alpha_n
  from d left join rep using (rid)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from s)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and not (
    n_symbols * 4 > n_words or (alpha_n > 0 and upper_n > 0.6 * alpha_n) or bangs * 3 > n_words
    or not (word_chars / n_words between 1.5 and 25) or (n_lines > 3 and n_dup_lines * 2 > n_lines)) as kept
from b
"""
