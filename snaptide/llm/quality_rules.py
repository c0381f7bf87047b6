"""Operator 9: quality rules, one threshold table compiled into one projection."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import Renamed

SYMBOLS = "|&%$#*!<>{}[]\\^~=+@"
BULLETS = "-*•‣▪–"
STOP_WORDS = {
    "en": "the of and to in is that for with on as be".split(),
    "de": "der die und das den von zu mit in im ist ein".split(),
    "fr": "de la le les des et un une du en que qui".split(),
    "es": "de la que el los las en un por con se del".split(),
}


class Rule(NamedTuple):
    """name of the ratio; its bounds, both inclusive; the words a text must have before the rule speaks."""

    measure: str
    low: float
    high: float
    least_words: int


#: The production threshold table.
RULES = (
    Rule("n_chars", 1, 5_000_000, 0),
    Rule("n_words", 1, float("inf"), 0),
    Rule("symbol_ratio", 0.0, 0.05, 0),
    Rule("capital_ratio", 0.0, 0.4, 0),
    Rule("mean_word_chars", 1.0, 40.0, 20),
    Rule("distinct_word_ratio", 0.3, 1.0, 20),
    Rule("stop_word_ratio", 0.02, 1.0, 50),
    Rule("distinct_line_ratio", 0.3, 1.0, 20),
    Rule("bullet_line_ratio", 0.0, 0.9, 20),
    Rule("ellipsis_line_ratio", 0.0, 0.5, 20),
)


def _listed(tokens: Column, words: list[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: w.isin(words)))


def _only(text: Column, signs: str) -> Column:
    """The text's signs of a class, counted: a run of others is one match, so that text is passed over quickly."""
    return F.length(F.regexp_replace(text, f"[^{signs}]++", ""))


def _measures(text: Column, lang: Column, tokens: Column, lines: Column) -> dict[str, Column]:
    """The measures over text, and its tokens and lines as arrays()."""
    chars, n_tokens, n_lines = F.length(text), F.size(tokens), F.size(lines)
    share = lambda part, whole: F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))
    stop = F.lit(None).cast("double")
    for code, listed in STOP_WORDS.items():
        stop = F.when(lang == code, share(_listed(tokens, listed), n_tokens)).otherwise(stop)
    return {
        "n_chars": chars.cast("bigint"),
        "n_words": n_tokens.cast("bigint"),
        "symbol_ratio": share(_only(text, re.escape(SYMBOLS)), chars),
        "capital_ratio": share(_only(text, r"\p{Lu}"), chars),
        "mean_word_chars": share(F.length(F.array_join(tokens, "")), n_tokens),
        "distinct_word_ratio": share(F.size(F.array_distinct(tokens)), n_tokens),
        "distinct_line_ratio": share(F.size(F.array_distinct(lines)), n_lines),
        "bullet_line_ratio": share(F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin(*BULLETS))), n_lines),
        "ellipsis_line_ratio": share(F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))), n_lines),
        "stop_word_ratio": stop,
    }


def _arrays(text: Column) -> tuple[Column, Column]:
    """A text's lower-case words, without the commonest punctuation, and its lines that aren't blank."""
    tokens = F.filter(F.split(F.regexp_replace(F.lower(text), "[.,;:!?]+", ""), "[ \n\t\r]+"), lambda w: w != "")
    return tokens, F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


MEASURES = ("n_chars", "n_words", "symbol_ratio", "capital_ratio", "mean_word_chars", "distinct_word_ratio", "distinct_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio", "stop_word_ratio")


def _broken(rule: Rule, measure, n_words: Column) -> Column:
    value = measure(rule.measure)
    out = value < F.lit(float(rule.low))
    if rule.high != float("inf"):
        out = out | (value > F.lit(float(rule.high)))
    return F.coalesce(out & (n_words >= rule.least_words), F.lit(False))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, the names of the broken rules ('|'-joined) and keep, one row per row of docs.

    A null text counts as empty; an empty one breaks n_chars and n_words, a blank one n_words. A ratio over nothing is 0. The
    stop-word ratio is null, and never breaks, where lang is null or has no word list. Rows that repeat are
    judged each for itself; columns of docs besides doc_id, text and lang are ignored, whatever their names.
    """
    table = Renamed(docs)
    base = table.df.select(table["doc_id"].alias("doc_id"), F.coalesce(table["text"], F.lit("")).alias("text"), table["lang"].alias("lang"))
    tokens, lines = _arrays(F.col("text"))
    m = _measures(F.col("text"), F.col("lang"), F.col("tokens"), F.col("lines"))
    rows = base.select("*", tokens.alias("tokens"), lines.alias("lines")).select("doc_id", *(m[k].alias(k) for k in MEASURES))
    broken = F.concat_ws("|", *(F.when(_broken(r, F.col, F.col("n_words")), F.lit(r.measure)) for r in rules))
    return rows.withColumn("broken", broken).withColumn("keep", F.col("broken") == "")


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that break no rule, with all their columns, whatever their names. See measured()."""
    table = Renamed(docs)
    base = table.df.withColumn("text", F.coalesce(table["text"], F.lit("")))
    tokens, lines = _arrays(F.col("text"))
    # a generator holds the arrays, else the optimiser moves their making into every rule of the filter
    made = base.withColumn("made", F.explode(F.array(F.struct(tokens.alias("tokens"), lines.alias("lines")))))
    m = _measures(F.col("text"), table["lang"], F.col("made.tokens"), F.col("made.lines"))
    broken = F.lit(False)
    for r in rules:
        broken = broken | _broken(r, m.__getitem__, m["n_words"])
    return table.back(made.filter(~broken))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def measures_sql(source: str = "documents") -> str:
    """DuckDB SELECT of every column of source with the measures and broken."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    stop = " ".join(f"WHEN lang = '{k}' THEN CASE WHEN len(tok) > 0 THEN len(list_filter(tok, lambda w: w IN ({quoted(v)})))::DOUBLE / len(tok) ELSE 0.0 END" for k, v in STOP_WORDS.items())
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0 END"
    sym = re.escape(SYMBOLS)
    tests = []
    for r in RULES:
        name = {"n_chars": "q_chars"}.get(r.measure, r.measure)
        bad = f"{name} < {r.low!r}" + ("" if r.high == float("inf") else f" OR {name} > {r.high!r}")
        tests.append(f"CASE WHEN ({bad}) AND n_words >= {r.least_words} THEN '{r.measure}' END")
    return f"""
WITH q_base AS (
  SELECT *, coalesce(text, '') AS q_text,
    list_filter(string_split(translate(lower(coalesce(text, '')), chr(10) || chr(9) || chr(13) || '.,;:!?', '   '), ' '), lambda w: w <> '') AS tok,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS q_lines
  FROM {source}),
q_measured AS (
  SELECT * EXCLUDE (n_chars), length(q_text) AS q_chars, len(tok) AS n_words,
    {share(f"length(regexp_replace(q_text, '[^{sym}]+', '', 'g'))", "length(q_text)")} AS symbol_ratio,
    {share("length(regexp_replace(q_text, '[^\\p{Lu}]+', '', 'g'))", "length(q_text)")} AS capital_ratio,
    {share("length(array_to_string(tok, ''))", "len(tok)")} AS mean_word_chars,
    {share("len(list_distinct(tok))", "len(tok)")} AS distinct_word_ratio,
    {share("len(list_distinct(q_lines))", "len(q_lines)")} AS distinct_line_ratio,
    {share(f"len(list_filter(q_lines, lambda x: substr(ltrim(x), 1, 1) IN ({quoted(BULLETS)})))", "len(q_lines)")} AS bullet_line_ratio,
    {share("len(list_filter(q_lines, lambda x: rtrim(x).ends_with('...') OR rtrim(x).ends_with('…')))", "len(q_lines)")} AS ellipsis_line_ratio,
    CASE {stop} END AS stop_word_ratio
  FROM q_base)
SELECT *, concat_ws('|', {", ".join(tests)}) AS broken FROM q_measured"""


ORACLE = f"""
SELECT doc_id, q_chars AS n_chars, n_words, symbol_ratio, capital_ratio, mean_word_chars, distinct_word_ratio,
  distinct_line_ratio, bullet_line_ratio, ellipsis_line_ratio, stop_word_ratio, broken, broken = '' AS keep
FROM ({measures_sql()})"""
