"""Operator 7: line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import Renamed, checked_broadcast, written

RATIO = 0.02
LEAST_PAGES = 3  # a line of two pages may be that of one page and its near copy


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r")) == ""


def boilerplate(host: Column, text: Column, docs: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """host and the hashes of its boilerplate lines, one row per host that has any.

    Texts stay where they are: what is shuffled is a page's hash, and 64 bits per distinct line of it.
    """
    hashes = F.array_distinct(F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~_blank(x)), _key))
    pages = docs.select(host.alias("host"), F.xxhash64(text).alias("page"), hashes.alias("lines")).groupBy("host", "page").agg(F.first("lines").alias("lines"))
    # the host's total goes along as a line of its own, a null
    counts = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "lines")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages"))
    counts = written(counts.filter(F.col("line").isNull() | (F.col("pages") >= least_pages)), "line-counts")
    totals = counts.filter("line is null").select(F.col("host").alias("site"), F.col("pages").alias("total"))
    over = counts.filter("line is not null").join(totals, F.col("host").eqNullSafe(F.col("site"))).filter(F.col("pages") > F.lit(ratio) * F.col("total"))
    return over.groupBy("host").agg(F.collect_set("line").alias("lines"))


def _cut(docs: DataFrame, host: str, ratio: float, least_pages: int) -> tuple[Renamed, DataFrame, dict[str, Column]]:
    """The renamed table, with lines and left, and the columns that replace its own."""
    table = Renamed(docs)
    own, text = table[host], table["text"]
    # ratio bounds the lines of a host: fewer than (lines a page) / ratio can exceed it
    found = written(boilerplate(own, text, table.df, ratio, least_pages), "boilerplate")
    width = found.select(F.coalesce(F.max(F.size("lines")), F.lit(1))).first()[0] * 8 + 64
    joined = table.df.join(checked_broadcast(found.select(F.col("host").alias("site"), F.col("lines").alias("cut")), width), own.eqNullSafe(F.col("site")), "left")
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col("cut"), _key(x)))
    joined = joined.withColumn("left", F.when(F.col("cut").isNull(), lines).otherwise(left)).withColumn("gone", F.size(lines) - F.size("left"))
    put = {n: F.array_join("left", "\n") for n in docs.columns if table.name_of("text") == table.name_of(n)}
    put |= {n: F.length(F.array_join("left", "\n")).cast("bigint") for n in docs.columns if n.lower() == "n_chars"}
    return table, joined, put


def deduped(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """docs with the boilerplate lines cut from text, n_chars renewed, and n_dropped added, the lines cut.

    A line is boilerplate on a host if at least least_pages of the host's pages hold it and the pages that hold
    it, divided by all the host's pages, exceed ratio. Pages of equal text count as one page: repeated rows and
    copies are no evidence. Lines are compared without blanks, tabs and carriage returns at their ends; blank
    lines are never counted or cut. A line counts once a page, however often it is there. A null host is one
    host; a null text has no lines, loses none and stays null, but counts as a page. An empty table gives an empty
    one. Other columns pass through untouched, whatever their names; one named n_dropped is replaced.
    """
    table, joined, put = _cut(docs, host, ratio, least_pages)
    return table.back(joined, put | {"n_dropped": F.coalesce("gone", F.lit(0)).cast("bigint")})


def stage(docs: DataFrame, host: str = "source") -> DataFrame:
    """deduped() as a filter, without n_dropped: a document goes only if it had a non-blank line and all such lines
    were cut."""
    table, joined, put = _cut(docs, host, RATIO, LEAST_PAGES)
    nothing = (F.coalesce("gone", F.lit(0)) > 0) & ~F.exists("left", lambda x: ~_blank(x))
    return table.back(joined.filter(~F.coalesce(nothing, F.lit(False))), put)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "text", "n_dropped")


def sql(source: str = "documents") -> str:
    """DuckDB SELECT of source's columns with the cut text and n_dropped."""
    clean = lambda x: f"trim({x}, ' ' || chr(9) || chr(13))"
    return f"""
WITH b_pages AS (SELECT row_number() OVER () AS row_no, source, text FROM (SELECT DISTINCT source, text FROM {source})),
b_lines AS (
  SELECT DISTINCT row_no, source, {clean('line')} AS line
  FROM (SELECT row_no, source, unnest(string_split(text, chr(10))) AS line FROM b_pages)
  WHERE {clean('line')} <> ''),
b_totals AS (SELECT source, count(*) AS total FROM b_pages GROUP BY source),
b_over AS (
  SELECT l.source, list(l.line) AS lines FROM (
    SELECT source, line, count(*) AS pages FROM b_lines GROUP BY source, line HAVING count(*) >= {LEAST_PAGES}) l
  JOIN b_totals t ON l.source IS NOT DISTINCT FROM t.source WHERE l.pages > {RATIO!r} * t.total GROUP BY l.source),
b_cut AS (
  SELECT d.*, list_filter(string_split(d.text, chr(10)), lambda x: {clean('x')} = '' OR NOT coalesce(list_contains(o.lines, {clean('x')}), false)) AS b_left
  FROM {source} d LEFT JOIN b_over o ON d.source IS NOT DISTINCT FROM o.source)
SELECT * EXCLUDE (text, n_chars, b_left), array_to_string(b_left, chr(10)) AS text, length(array_to_string(b_left, chr(10))) AS n_chars,
  coalesce(len(string_split(text, chr(10))) - len(b_left), 0) AS n_dropped FROM b_cut"""


ORACLE = f"SELECT doc_id, source, text, n_dropped FROM ({sql()})"
