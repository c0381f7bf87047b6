"""Operator 1: mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaptide.llm.common import Renamed, checked_broadcast, written

SEED = "mix-1"
CELLS = 4096
MOST_COPIES = 4  # of a document, unless its source is due more copies a document than that
_SPAN = float(1 << 52)
_WEIGHT = 1 << 40  # what the largest of given weights counts as


def _uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5, the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(_SPAN)


def scaled(weights: dict[str | None, float]) -> list[tuple[str | None, int]]:
    """Weights as integers; the least positive one stays above 0."""
    if any(not v >= 0 or math.isinf(v) for v in weights.values()):
        raise ValueError("weights are finite and not negative")
    top = max(weights.values(), default=0) or 1
    return [(k, max(1, round(v / top * _WEIGHT))) for k, v in weights.items() if v > 0]


def allocation(sizes: DataFrame, weights: dict[str, float] | None, total: int | None, most_copies: int) -> DataFrame:
    """Per source: rows, summed size, the copies it is due (largest remainders make them add up) and the most that a
    document may have. sizes has src, size and cnt, the documents of a size."""
    stats = written(sizes.groupBy("src").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.col("size")).alias("sized")), "mix-stats")
    if weights is None:
        weight = F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast("bigint")
    else:
        table = sizes.sparkSession.createDataFrame(scaled(weights) or [(None, 0)], "name string, w bigint")
        stats = stats.join(table, F.col("src").eqNullSafe(F.col("name")), "left")
        weight = F.coalesce("w", F.lit(0).cast("bigint"))
    stats = stats.withColumn("weight", weight)
    sums = stats.agg(F.sum("weight").alias("all_weight"), (F.sum("n") if total is None else F.lit(total).cast("bigint")).alias("all_rows"))
    due = F.col("all_rows").cast("double") * F.col("weight").cast("double") / F.col("all_weight").cast("double")
    shares = stats.crossJoin(F.broadcast(sums)).filter("weight > 0").withColumn("due", due).withColumn("base", F.floor("due").cast("bigint"))
    # one row a source, so one partition will do for the remainders
    order = Window.orderBy(F.desc(F.col("due") - F.col("base")), F.asc_nulls_first("src"))
    over = Window.partitionBy(F.lit(1))
    rest = F.col("all_rows") - F.sum("base").over(over)
    out = shares.withColumn("copies", F.col("base") + F.when(F.row_number().over(order) <= rest, 1).otherwise(0))
    return out.select("src", "n", "sized", "copies", F.greatest(F.lit(most_copies).cast("bigint"), F.ceil(F.col("copies").cast("double") / F.col("n"))).alias("most"))


def expectation(sizes: DataFrame, alloc: DataFrame) -> DataFrame:
    """Per source: src, copies, most, and bound, num and den: a document of at most bound in size expects
    num x size / den copies, a larger one most. So the expectations add up to the copies due."""
    above = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0).cast("bigint"))
    own = alloc.select(F.col("src").alias("of"), "copies", "sized", "most")
    steps = sizes.join(checked_broadcast(own, 64), F.col("src").eqNullSafe(F.col("of")))
    steps = steps.withColumn("num", F.col("copies") - F.col("most") * before(F.col("cnt"))).withColumn("den", F.col("sized") - before(F.col("cnt") * F.col("size")))
    fits = steps.filter(F.col("num").cast("double") * F.col("size").cast("double") / F.col("den").cast("double") <= F.col("most"))
    bound = fits.groupBy("src").agg(F.max("size").alias("bound"), F.max_by("num", "size").alias("num"), F.max_by("den", "size").alias("den"))
    return own.join(bound, F.col("of").eqNullSafe(F.col("src")), "left").select("of", "copies", "most", "bound", "num", "den")


def _odds(df: DataFrame, doc_id: Column, size: Column, seed: str) -> DataFrame:
    """Add whole, the copies that are certain, and q, the ranking odds (null: nothing left to draw)."""
    expected = F.when(F.col("bound").isNull() | (size > F.col("bound")), F.col("most").cast("double")).otherwise(F.col("num").cast("double") * size.cast("double") / F.col("den").cast("double"))
    df = df.withColumn("e", expected).withColumn("whole", F.floor("e").cast("bigint"))
    part, u = F.col("e") - F.col("whole"), F.col("u")
    return df.withColumn("u", _uniform(doc_id, seed)).withColumn("q", F.when(part > 0, (u / (1 - u)) / (part / (1 - part))))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: str = SEED, most_copies: int = MOST_COPIES) -> DataFrame:
    """Documents drawn so that each source has its target share of the copies; one row a copy, numbered in copy.

    A source is due total x weight / sum of weights copies (default: as many as there are rows, and weights that
    grow with the square root of a source's rows), and gets exactly as many. A document expects its source's
    copies in proportion to n_chars + 1, but most_copies at most, or what its source is due a document if that is
    more; what the largest may not have goes to the others. The whole part of that is certain; the rest is drawn
    by Pareto order sampling: the documents with the smallest u/(1-u) / (p/(1-p)) stay, ties by doc_id, and of
    rows that repeat a doc_id and size any, exactly as many as the source still lacks. u comes from the MD5 of
    seed and doc_id. A null or negative n_chars counts as 0, a null source is a source of its own, a null doc_id
    draws as the word null and sorts first. Sources without weight give nothing; an empty table gives none;
    negative and infinite weights are an error. A column named copy in docs is replaced; others pass through,
    whatever their names.

    No source is sorted as a whole: counts in CELLS cells of the odds find the cell in which the draw ends, and
    only that cell is ranked.
    """
    table = Renamed(docs)
    source, doc_id = table["source"], table["doc_id"]
    size = F.greatest(F.coalesce(table["n_chars"].cast("bigint"), F.lit(0)), F.lit(0).cast("bigint")) + 1
    sizes = written(table.df.groupBy(source.alias("src"), size.alias("size")).agg(F.count("*").alias("cnt")), "mix-sizes")
    alloc = written(allocation(sizes, weights, total, most_copies), "mix-alloc")
    due = written(expectation(sizes, alloc), "mix-due")
    thin = table.df.select(doc_id.alias("id"), source.alias("src"), size.alias("size"))
    drawn = _odds(thin.join(checked_broadcast(due, 96), F.col("src").eqNullSafe(F.col("of"))), F.col("id"), F.col("size"), seed)
    drawn = drawn.withColumn("cell", F.floor(F.col("q") / (F.col("q") + 1) * CELLS).cast("int"))
    cells = drawn.groupBy("src", "cell").agg(F.count("q").alias("here"), F.sum("whole").alias("whole"), F.first("copies").alias("due"))
    cells = written(cells, "mix-cells")
    by = Window.partitionBy("src")
    run = by.orderBy(F.asc_nulls_first("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lacking = cells.withColumn("lack", F.col("due") - F.sum("whole").over(by)).withColumn("up_to", F.sum("here").over(run))
    last = lacking.filter("lack > 0 and here > 0 and up_to >= lack and up_to - here < lack")
    last = written(last.select(F.col("src").alias("c_src"), F.col("cell").alias("c_cell"), (F.col("lack") - F.col("up_to") + F.col("here")).alias("need")), "mix-last")
    edge = drawn.join(checked_broadcast(last, 64), F.col("src").eqNullSafe(F.col("c_src")) & (F.col("cell") == F.col("c_cell")))
    tied = edge.groupBy("src", "q", "id").agg(F.count("*").alias("ties"), F.first("need").alias("need"))
    ranked = tied.withColumn("up_to", F.sum("ties").over(by.orderBy("q", F.asc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ranked.filter("up_to >= need and up_to - ties < need").select(F.col("src").alias("e_src"), F.col("q").alias("end_q"), F.col("id").alias("end_id"), "ties", (F.col("need") - F.col("up_to") + F.col("ties")).alias("take"))
    # a source of which all odds lie below the draw's end has no edge: it takes all it can
    lacks = lacking.groupBy(F.col("src").alias("l_src")).agg(F.max("lack").alias("lack"))
    plan = due.join(ends, F.col("of").eqNullSafe(F.col("e_src")), "left").join(lacks, F.col("of").eqNullSafe(F.col("l_src")), "left")
    plan = written(plan.drop("e_src", "l_src", "copies"), "mix-plan")
    full = _odds(table.df.join(checked_broadcast(plan, 128), source.eqNullSafe(F.col("of"))), doc_id, size, seed)
    at_end = (F.col("q") == F.col("end_q")) & doc_id.eqNullSafe(F.col("end_id"))
    before = (F.col("q") < F.col("end_q")) | ((F.col("q") == F.col("end_q")) & (at_end | doc_id.isNull() | (doc_id < F.col("end_id"))))
    chosen = F.coalesce(before, F.lit(False)) | (F.col("end_q").isNull() & (F.col("lack") > 0) & F.col("q").isNotNull())
    if plan.filter("take < ties").isEmpty():
        full = full.withColumn("times", F.col("whole") + chosen.cast("bigint"))
    else:  # of rows that tie at a source's end only some are taken
        cut = F.coalesce(at_end & (F.col("take") < F.col("ties")), F.lit(False))
        some = full.filter(cut).withColumn("times", F.col("whole") + (F.row_number().over(Window.partitionBy("of").orderBy("q")) <= F.col("take")).cast("bigint"))
        full = full.filter(~cut).withColumn("times", F.col("whole") + chosen.cast("bigint")).unionByName(some)
    made = full.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times")))
    return made.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(table.names) if n.lower() != "copy"), "copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(source: str = "documents") -> str:
    """DuckDB SELECT of source's columns and copy."""
    return f"""
WITH m_sizes AS (SELECT source, greatest(coalesce(n_chars, 0), 0) + 1 AS size, count(*) AS cnt FROM {source} GROUP BY ALL),
m_stats AS (SELECT source, sum(cnt)::BIGINT AS n, sum(cnt * size)::BIGINT AS sized, floor(sqrt(sum(cnt)::DOUBLE) * 1000)::BIGINT AS weight FROM m_sizes GROUP BY source),
m_due AS (SELECT *, (SELECT sum(n)::BIGINT FROM m_stats) AS all_rows, (SELECT sum(n)::BIGINT FROM m_stats)::DOUBLE * weight::DOUBLE / (SELECT sum(weight)::BIGINT FROM m_stats)::DOUBLE AS due FROM m_stats),
m_copies AS (
  SELECT source, n, sized, floor(due)::BIGINT + CASE WHEN row_number() OVER (ORDER BY due - floor(due)::BIGINT DESC, source ASC NULLS FIRST) <= all_rows - sum(floor(due)::BIGINT) OVER () THEN 1 ELSE 0 END AS copies FROM m_due),
m_alloc AS (SELECT *, greatest({MOST_COPIES}, ceil(copies::DOUBLE / n)::BIGINT) AS most FROM m_copies),
m_steps AS (
  SELECT s.source, s.size, a.most, (a.copies - a.most * coalesce(sum(s.cnt) OVER above, 0))::BIGINT AS num, (a.sized - coalesce(sum(s.cnt * s.size) OVER above, 0))::BIGINT AS den
  FROM m_sizes s JOIN m_alloc a ON s.source IS NOT DISTINCT FROM a.source
  WINDOW above AS (PARTITION BY s.source ORDER BY s.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m_bound AS (SELECT source, max(size) AS bound, max_by(num, size) AS num, max_by(den, size) AS den FROM m_steps WHERE num::DOUBLE * size::DOUBLE / den::DOUBLE <= most GROUP BY source),
m_expect AS (
  SELECT d.*, a.copies, CASE WHEN b.bound IS NULL OR greatest(coalesce(d.n_chars, 0), 0) + 1 > b.bound THEN a.most::DOUBLE
    ELSE b.num::DOUBLE * (greatest(coalesce(d.n_chars, 0), 0) + 1)::DOUBLE / b.den::DOUBLE END AS e,
    (('0x' || substr(md5('{SEED}|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {_SPAN!r} AS u
  FROM {source} d JOIN m_alloc a ON d.source IS NOT DISTINCT FROM a.source LEFT JOIN m_bound b ON d.source IS NOT DISTINCT FROM b.source),
m_odds AS (
  SELECT *, floor(e)::BIGINT AS whole, CASE WHEN e - floor(e)::BIGINT > 0 THEN (u / (1 - u)) / ((e - floor(e)::BIGINT) / (1 - (e - floor(e)::BIGINT))) END AS q FROM m_expect),
m_ranked AS (
  SELECT *, copies - sum(whole) OVER (PARTITION BY source) AS lack, row_number() OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id ASC NULLS FIRST) AS r FROM m_odds),
m_times AS (SELECT *, whole + CASE WHEN q IS NOT NULL AND r <= lack THEN 1 ELSE 0 END AS times FROM m_ranked)
SELECT * EXCLUDE (copies, e, u, whole, q, lack, r, times), unnest(range(1, times::BIGINT + 1)) AS copy FROM m_times"""


ORACLE = sql()
