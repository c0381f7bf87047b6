"""Operator 2: secret scans that link the parts of a credential."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 400  # characters between the intervals of two parts that belong together
HEX_SIGNS, KEY_SIGNS = 9, 18  # different characters that a bare run has at least; of random keys one in a million has fewer

_ASSIGN = r"""["']?[ \t]{0,4}(?:=|:)[ \t]{0,4}["']?"""
#: Each is looked for by itself, so a part may lie within another, as a secret does in a URL's query. Runs are taken
#: whole, so a piece of a longer one, as of an inline picture, is none.
KINDS = {
    "secret": rf"(?:api[_-]?key|secret(?:[_-]?(?:access[_-]?)?key)?|access[_-]?token|auth[_-]?token|token|passw(?:or)?d|pwd){_ASSIGN}[A-Za-z0-9/+_=.-]{{12,200}}",
    "identifier": rf"A[KS]IA[0-9A-Z]{{16}}|(?:access[_-]?key[_-]?id|client[_-]?id|account|user(?:name)?|login){_ASSIGN}[A-Za-z0-9._@+-]{{3,64}}",
    "address": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,5}",
    "endpoint": r"https?://[^ \t\n\r\"'<>]{4,300}|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?",
    "weak hex": r"[A-Za-z0-9]{32,}",
    "weak key": r"[A-Za-z0-9/+]{40,}={0,2}",
}
#: How kinds are named in the result.
NAMES = {"address": "identifier", "weak hex": "weak secret", "weak key": "weak secret"}
ANY_SECRET = f"(?i)(?:{KINDS['secret']}|{KINDS['weak hex']}|{KINDS['weak key']})"
_HEX, _KEY = re.compile("[0-9a-fA-F]{32,128}"), re.compile("(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9/+]{40}")


def likely(kind: str, value: str) -> bool:
    """Whether a run could be a key: hexadecimal, or 40 base64 digits of either case; and of many different ones."""
    body = value.rstrip("=")
    if kind == "weak hex":
        return bool(_HEX.fullmatch(body)) and len(set(body.lower())) >= HEX_SIGNS
    return bool(_KEY.fullmatch(body)) and not _HEX.fullmatch(body) and len(set(body)) >= KEY_SIGNS


def pairs_of(gaps, sizes, kinds, window: int) -> list[dict]:
    """The interval join within one scope: secrets with the identifiers, addresses and endpoints in their window.

    Parts come in the order of their starts; a gap is below 0 where a part begins within the one before it. A weak
    secret is linked only to parts beside it, not to one that it lies in or that lies in it, and only if an
    identifier is among them, or an address and an endpoint.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    stops = np.cumsum(np.asarray(gaps[: len(sizes)], dtype=np.int64) + sizes)
    starts = stops - sizes
    partner = np.flatnonzero(np.isin(kinds, ("identifier", "address", "endpoint")))
    longest = sizes[partner].max(initial=0)
    out = []
    for i, kind in enumerate(kinds):
        if kind in ("secret", "weak hex", "weak key"):
            low, high = np.searchsorted(starts[partner], starts[i] - window - longest), np.searchsorted(starts[partner], stops[i] + window, side="right")
            near = partner[low:high]
            near = near[stops[near] >= starts[i] - window]
            if kind != "secret":
                first, last = starts[near] - starts[i], stops[near] - stops[i]
                near = near[~(((first <= 0) & (last >= 0)) | ((first >= 0) & (last <= 0)))]
                there = {kinds[p] for p in near.tolist()}
                if "identifier" not in there and not {"address", "endpoint"} <= there:
                    continue
            for p in near.tolist() or [None]:
                gap = None if p is None else int(max(0, starts[p] - stops[i], starts[i] - stops[p]))
                out.append({"s": i, "s_at": int(starts[i]), "p": p, "p_at": None if p is None else int(starts[p]), "gap": gap})
    return out


def _bare(starts: np.ndarray, stops: np.ndarray, kinds: np.ndarray, values) -> np.ndarray:
    """Which parts stay: all but weak secrets that can't be keys, are (part of) a strong one or lie in an identifier."""
    stay = np.ones(len(kinds), dtype=bool)
    weak = np.flatnonzero(np.isin(kinds, ("weak hex", "weak key")))
    stay[weak] = [likely(kinds[i], values[i]) for i in weak.tolist()]
    for kind in ("secret", "identifier", "address"):
        other = np.flatnonzero(kinds == kind)  # of one kind, so in order and apart
        if len(other) and len(weak):
            if kind == "secret":
                k = np.searchsorted(stops[other], starts[weak], side="right")
                hit = (k < len(other)) & (starts[other[np.minimum(k, len(other) - 1)]] < stops[weak])
            else:
                k = np.searchsorted(starts[other], starts[weak], side="right") - 1
                hit = (k >= 0) & (stops[other[np.maximum(k, 0)]] >= stops[weak])
            stay[weak[hit]] = False
    return stay


def _in_scope(gaps, values, kinds, window: int) -> list[dict]:
    """pairs_of() over parts that come kind by kind, each kind's gaps from the text's begin."""
    kinds, steps = np.asarray(kinds, dtype=object), np.asarray(gaps, dtype=np.int64)
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    stops = np.zeros(len(sizes), dtype=np.int64)
    for kind in KINDS:
        own = kinds == kind
        stops[own] = np.cumsum(steps[own] + sizes[own])
    starts = stops - sizes
    order = np.flatnonzero(_bare(starts, stops, kinds, values))
    order = order[np.lexsort((stops[order], starts[order]))]
    before = np.concatenate([[0], stops[order][:-1]])
    found = pairs_of(starts[order] - before, sizes[order], kinds[order], window)
    return [x | {"s": int(order[x["s"]]), "p": None if x["p"] is None else int(order[x["p"]])} for x in found]


def _joiner(window: int):
    @F.pandas_udf("array<struct<s:int,s_at:bigint,p:int,p_at:bigint,gap:bigint>>")
    def join(gaps: pd.Series, values: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([_in_scope(g, v, k, window) for g, v, k in zip(gaps, values, kinds)])

    return join


def linked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per secret and linked part: doc_id, secret_at, secret_kind, secret_md5, part_kind, part_at, part, gap.

    A document is a scope. Parts may overlap; their gap is then 0. A secret and an identifier (or e-mail address) or
    endpoint are linked if the one's interval, widened by window characters, meets the other's. A strong secret,
    one that a name is assigned to, is reported even without partner (part columns null). A weak one, a whole run of
    32 to 128 hexadecimal or of 40 base64 digits (see likely()), is reported only if complementary parts stand
    beside it: an identifier, or an address and an endpoint; and not if it belongs to a strong secret or lies
    within an identifier. Identifiers and endpoints alone are never reported. Secrets show only as MD5s of what
    matched. Null and empty texts give nothing; repeated rows report each; a null doc_id is reported as null; other
    columns are ignored. Ties need no order: all partners in the window are reported.

    All parts of a scope lie in its row, so the interval join needs no shuffle; texts without a secret end at
    the first filter.
    """
    base = docs.select("doc_id", F.col("text").alias("body")).filter(F.col("body").rlike(ANY_SECRET))
    # generators keep the optimiser from copying the expressions into each use
    each = []
    for k, pattern in enumerate(KINDS.values()):
        whole = f"(?i)(?:{pattern})"
        each += [F.regexp_extract_all("body", F.lit(whole), F.lit(0)).alias(f"v{k}"), F.transform(F.split("body", whole, -1), F.length).alias(f"gaps{k}")]
    apart = base.select("doc_id", F.explode(F.array(F.struct(*each))).alias("m"))
    values = [F.col(f"m.v{k}") for k in range(len(KINDS))]
    gaps = F.concat(*(F.slice(F.col(f"m.gaps{k}"), F.lit(1), F.size(v)) for k, v in enumerate(values)))
    kinds = F.concat(*(F.array_repeat(F.lit(kind), F.size(v)) for kind, v in zip(KINDS, values)))
    parts = apart.select("doc_id", F.explode(F.array(F.struct(F.concat(*values).alias("v"), gaps.alias("gaps"), kinds.alias("kinds")))).alias("m"))
    v, kinds = F.col("m.v"), F.col("m.kinds")
    pairs = _joiner(window)(F.col("m.gaps"), v, kinds)
    rows = parts.select("doc_id", v.alias("v"), kinds.alias("kinds"), F.explode(pairs).alias("x"))
    secret, part = F.get("v", F.col("x.s")), F.get("v", F.col("x.p"))
    named = F.create_map(*(F.lit(x) for kind in KINDS for x in (kind, NAMES.get(kind, kind))))
    return rows.select(
        "doc_id",
        F.col("x.s_at").alias("secret_at"),
        named[F.get("kinds", F.col("x.s"))].alias("secret_kind"),
        F.md5(secret).alias("secret_md5"),
        named[F.get("kinds", F.col("x.p"))].alias("part_kind"),
        F.col("x.p_at").alias("part_at"),
        part.alias("part"),
        F.col("x.gap").alias("gap"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _located(kind: str) -> str:
    """DuckDB SELECT of a kind's parts: what stands before a part ends where the gaps and parts so far end."""
    pattern = _quoted(f"(?i)(?:{KINDS[kind]})")
    return f"""
  SELECT row_no, doc_id, '{kind}' AS kind, value, stop - length(value) AS start, stop FROM (
    SELECT *, (sum(gap + length(value)) OVER (PARTITION BY row_no ORDER BY i))::BIGINT AS stop FROM (
      SELECT row_no, doc_id, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS value, unnest(list_transform(gaps[1:len(found)], lambda g: length(g))) AS gap
      FROM (SELECT row_no, doc_id, regexp_extract_all(text, {pattern}) AS found, regexp_split_to_array(text, {pattern}) AS gaps FROM cand)))"""


_SIGNS = "len(list_distinct(string_split(rtrim({}, '='), '')))"
ORACLE = f"""
WITH cand AS (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents WHERE regexp_matches(text, {_quoted(ANY_SECRET)})),
parts AS ({" UNION ALL".join(_located(kind) for kind in KINDS)}),
weak AS (
  SELECT * FROM parts w WHERE (
    kind = 'weak hex' AND regexp_full_match(value, '[0-9a-fA-F]{{32,128}}') AND {_SIGNS.format("lower(w.value)")} >= {HEX_SIGNS}
    OR kind = 'weak key' AND regexp_full_match(value, '[A-Za-z0-9/+]{{40}}={{0,2}}') AND NOT regexp_full_match(value, '[0-9a-fA-F]{{40}}={{0,2}}')
      AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND {_SIGNS.format("w.value")} >= {KEY_SIGNS})
  AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.row_no = w.row_no AND (o.kind = 'secret' AND o.stop > w.start AND o.start < w.stop OR o.kind IN ('identifier', 'address') AND o.start <= w.start AND o.stop >= w.stop))),
secrets AS (SELECT * FROM parts WHERE kind = 'secret' UNION ALL SELECT * FROM weak),
linked AS (
  SELECT s.row_no, s.doc_id, s.kind, s.value, s.start, s.stop, p.kind AS p_kind, p.value AS p_value, p.start AS p_start, p.stop AS p_stop,
    coalesce(bool_or(p.kind = 'identifier') OVER own OR (bool_or(p.kind = 'address') OVER own AND bool_or(p.kind = 'endpoint') OVER own), false) AS whole
  FROM secrets s LEFT JOIN parts p ON p.row_no = s.row_no AND p.kind IN ('identifier', 'address', 'endpoint') AND p.start <= s.stop + {WINDOW} AND p.stop >= s.start - {WINDOW}
    AND (s.kind = 'secret' OR NOT (p.start <= s.start AND p.stop >= s.stop OR p.start >= s.start AND p.stop <= s.stop))
  WINDOW own AS (PARTITION BY s.row_no, s.kind, s.start))
SELECT doc_id, start AS secret_at, CASE WHEN kind = 'secret' THEN kind ELSE 'weak secret' END AS secret_kind, md5(value) AS secret_md5,
  CASE WHEN p_kind = 'address' THEN 'identifier' ELSE p_kind END AS part_kind, p_start AS part_at, p_value AS part,
  CASE WHEN p_start IS NOT NULL THEN greatest(0, p_start - stop, start - p_stop) END AS gap
FROM linked WHERE kind = 'secret' OR whole"""
