"""Line dedup: lines that spread over many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import BROADCAST_ROWS, HOT_ROWS, SPACE, joined_counted, let, unused, written

MIN_SITES = 10


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, _text (hash of the text), _site, _pos, _line (hash) of every line that holds a word; case and outer white space don't count."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("_site"), F.posexplode(F.split("text", "\n")).alias("_pos", "_raw"))
    rows = rows.withColumn("_raw", F.lower(F.btrim("_raw", F.lit(SPACE)))).where("_raw <> ''")
    return rows.select("doc_id", "_text", "_site", "_pos", F.xxhash64("_raw").alias("_line"))


def _of_lines(lines: DataFrame, table: DataFrame, busy: DataFrame) -> DataFrame:
    """The rows of `lines` whose _line is in `table` (_line, _n and more; unique), with its columns but _n.

    A table of few rows is broadcast. Beyond that lines of many rows stay spread: `busy` (_line, _n) has every line that is in `table` or
    on more than HOT_ROWS rows, so no other line's rows fill a task.
    """
    if table.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(table.drop("_n")), "_line")
    more = [c for c in table.columns if c not in ("_line", "_n")]
    known = busy.join(table.withColumn("_in", F.lit(True)).drop("_n"), "_line", "left")
    rows = busy.agg(F.sum("_n")).first()[0]
    return joined_counted(lines, known, ["_line"], rows, "_n").where("_in").select(*lines.columns, *more)


def _candidates(lines: DataFrame, min_sites: int, rsd: float) -> tuple[DataFrame, DataFrame]:
    """The lines that may be on `min_sites` sites or more (_line, _sites as estimated, _first, _n), and the `busy` ones of `_of_lines`."""
    may = F.col("_sites") * 2 >= min_sites
    seen = lines.groupBy("_line").agg(F.approx_count_distinct("_site", rsd).alias("_sites"), F.min("doc_id").alias("_first"), F.count("*").alias("_n"))
    seen = written(seen.where(may | (F.col("_n") > HOT_ROWS)))
    return seen.where(may), seen.select("_line", "_n")


def _spread(rows: DataFrame, seen: DataFrame, min_sites: int) -> DataFrame:
    """Those of the candidates `seen` that are on `min_sites` sites or more; `rows` are the rows of the candidates, with _sites."""
    exact = rows.where(F.col("_sites") < 2 * min_sites).select("_line", "_site").distinct().groupBy("_line").agg(F.count("*").alias("_exact")).where(F.col("_exact") >= min_sites)
    return seen.join(exact, "_line", "left").where((F.col("_sites") >= 2 * min_sites) | F.col("_exact").isNotNull()).select("_line", "_first", "_n")


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, rsd: float = 0.05) -> DataFrame:
    """The lines on `min_sites` sites or more: _line, _first (the smallest doc_id that has it).

    A HyperLogLog sketch of the sites of each line is merged in the aggregation. Lines estimated within a
    factor of two of the limit (ten standard errors at least) get an exact count; the others are decided
    by the sketch. Both aggregations combine before they shuffle, so a line on a third of all rows
    is one row of each map task; the rows of each line are counted too, so that joins keep such a line's rows spread.
    """
    lines = _lines(docs, site)
    seen, busy = _candidates(lines, min_sites, rsd)
    return _spread(_of_lines(lines, seen.select("_line", "_n", "_sites"), busy), seen, min_sites).drop("_n")


def removed_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """_id, _text, _gone: for each document (doc_id and hash of its text) with such lines, their places in it. The first document that has a line keeps it.

    Texts are cut into lines twice: for the sketches, and for the rows of lines that may spread, which are written once.
    """
    lines = _lines(docs, site)
    seen, busy = _candidates(lines, min_sites, 0.05)
    rows = written(_of_lines(lines, seen.select("_line", "_n", "_sites"), busy))
    spread = written(_spread(rows, seen, min_sites))
    hits = _of_lines(rows, spread, busy)
    if keep_first:
        hits = hits.where(F.col("doc_id") > F.col("_first"))
    return hits.groupBy(F.col("doc_id").alias("_id"), "_text").agg(F.collect_set("_pos").alias("_gone"))


def _with_removed(docs: DataFrame, site: str, min_sites: int, keep_first: bool) -> tuple[DataFrame, str]:
    """`docs` with a column of the places to remove, null where there are none, and that column's name."""
    name = unused(docs, "gone")
    gone = removed_lines(docs.select("doc_id", "text", site), site, min_sites, keep_first).select(F.col("_id").alias(f"{name}_id"), F.col("_text").alias(f"{name}_text"), F.col("_gone").alias(name))
    keys = unused(docs, f"{name}_id"), unused(docs, f"{name}_text")
    gone = gone.toDF(*keys, name)
    rows = docs.join(gone, (docs["doc_id"] == gone[keys[0]]) & (F.xxhash64(docs["text"]) == gone[keys[1]]), "left")
    return rows.drop(*keys), name


def _cleaned(text: Column, gone: Column) -> Column:
    """`text` without the lines at the places `gone`; places are told apart by a hash set, so the work grows with the lines."""
    kept = lambda raw: F.transform(F.array_except(F.sequence(F.lit(0), F.size(raw) - 1), gone), lambda i: F.get(raw, i))
    return F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n"), lambda raw: F.array_join(kept(raw), "\n")))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, keep_first: bool = True, keep_empty: bool = True) -> DataFrame:
    """`docs` (doc_id, text and the site column) with the lines removed that spread over `min_sites` sites.

    All columns stay, whatever their names; n_chars, where there is one, follows the text. A line stays in the document with
    the smallest doc_id that has it (keep_first). With keep_empty=False, documents that lose their last
    word go. Null texts have no lines and stay null; a null site is a site of its own; rows with a null doc_id
    are left as they are; rows with the same doc_id but other texts are each cleaned by their own lines; an empty table stays empty.
    """
    rows, gone = _with_removed(docs, site, min_sites, keep_first)
    text = _cleaned(F.col("text"), F.col(gone))
    if not keep_empty:
        rows = rows.where(F.col(gone).isNull() | F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op9_query(spark, sf_dir: str) -> DataFrame:
    rows, gone = _with_removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"), "source", MIN_SITES, True)
    clean = _cleaned(F.col("text"), F.col(gone))
    counts = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("long").alias("n_removed")
    return rows.select("doc_id", *counts, clean.alias("_clean")).select("doc_id", "n_lines", "n_removed", F.length("_clean").cast("long").alias("kept_chars"), F.md5("_clean").alias("text_md5"))


OP9_SQL = r"""
with l as (
  select doc_id, coalesce('s' || source, 'n') as site, i, s[i] as raw, lower(trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as line
  from (select doc_id, source, string_split(text, chr(10)) as s, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
b as (select line, min(doc_id) as first_id from l where line <> '' group by line having count(distinct site) >= 10),
m as (select l.*, b.line is not null and doc_id > first_id as gone from l left join b using (line)),
a as (
  select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed, coalesce(string_agg(raw, chr(10) order by i) filter (not gone), '') as clean
  from m group by doc_id)
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_removed as bigint) as n_removed, cast(length(clean) as bigint) as kept_chars, md5(clean) as text_md5
from a
"""
