"""Operator 6: HTML extraction by differencing pages with the nearest URL of their host."""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import checked_broadcast, written

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|article|section|nav|header|footer|title|body|html|head|blockquote|pre|main|aside|form|option)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^?#]*)")


def _tags_out(tag: re.Pattern, by: str, html: str) -> str:
    """tag.sub(), but only up to the last >: before it each search for a tag's end finds one, so all is read once."""
    end = html.rfind(">") + 1
    return tag.sub(by, html[:end]) + html[end:]


def lines_of(html: str | None) -> list[str]:
    """The text lines of a page: comments, scripts and styles dropped, block tags as breaks, blanks collapsed."""
    if not html:
        return []
    text = entities.unescape(_tags_out(_TAG, "", _tags_out(_BREAK, "\n", _DROP.sub("\n", html))))
    return [x for x in (" ".join(line.split()) for line in text.splitlines()) if x]


def address(url: str | None) -> tuple[str, str] | None:
    """(lower-case host without www., path without a closing slash), or None where there is no host."""
    m = _URL.match(url.strip()) if url else None
    if not m or not m[1]:
        return None
    host = m[1].lower()
    return host.removeprefix("www."), m[2].rstrip("/") or "/"


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def line_hashes(lines: list[str]) -> list[int]:
    return [_hash(x.encode("utf-8", "surrogatepass")) for x in lines]


def digest_of(hashes: list[int]) -> int:
    return _hash(np.array(hashes, dtype=np.int64).tobytes())


def shared(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of one longest common subsequence of a and b.

    A row of the table is the bits of one integer; every isqrt(n)-th row is held and those between are made anew
    on the way back, so memory stays small for long pages.
    """
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    b = [x for x in b if x in both]
    if not at:
        return []
    places: dict[int, int] = {}
    for k, i in enumerate(at):
        places[a[i]] = places.get(a[i], 0) | (1 << k)
    full = (1 << len(at)) - 1

    def row_after(v: int, x: int) -> int:
        u = v & places[x]
        return ((v + u) | (v - u)) & full

    step = max(16, isqrt(len(b)))
    held, v = [], full
    for j, x in enumerate(b):
        if j % step == 0:
            held.append(v)  # the row before b[j]
        v = row_after(v, x)
    out: list[int] = []
    j, k = len(b), len(at)
    rows: list[int] = []
    base = len(b)
    while j and k:
        if j <= base:  # rows[i] is the row after b[base + i]; also the one before b[base]
            base = (j - 1) // step * step
            v, rows = held[base // step], []
            for x in b[base:j]:
                v = row_after(v, x)
                rows.append(v)
        if rows[j - 1 - base] >> (k - 1) & 1:
            k -= 1
            continue
        j -= 1
        above = held[base // step] if j == base else rows[j - 1 - base]
        if j and not above >> (k - 1) & 1:
            continue
        k -= 1
        out.append(at[k])
    return out[::-1]


def _narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for url, html in zip(b["url"].tolist(), b["html"].tolist()):
            where = address(url)
            hashes = line_hashes(lines_of(html)) if where else []
            if hashes:
                rows.append((*where, digest_of(hashes), hashes))
        yield pd.DataFrame(rows, columns=["host", "path", "digest", "lines"])


_NARROW = "host string, path string, digest bigint, lines array<bigint>"
_PAIRED = "kind string, seat int, " + _NARROW + ", partner string, cut array<int>"


def likeness(a: str, b: str) -> tuple[int, int]:
    """How near two paths are: leading segments in common, then leading characters."""
    x, y = a.split("/"), b.split("/")
    return len(os.path.commonprefix([x, y])), len(os.path.commonprefix([a, b]))


def _pick(before: tuple | None, row: tuple, after: tuple | None) -> tuple | None:
    """The nearer neighbour of the same host; of equals the one before."""
    near = [x for x in (before, after) if x and x[0] == row[0]]
    return max(near, key=lambda x: likeness(x[1], row[1])) if near else None


def _resolved(before: tuple | None, row: tuple, after: tuple | None) -> tuple:
    other = _pick(before, row, after)
    cut = shared(list(row[3]), list(other[3])) if other else []
    return ("mask", 0, row[0], row[1], row[2], [], other[1] if other else None, cut)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Masks of the rows inside a sorted partition; of its two ends two rows each, to be settled with the next."""
    columns = ["kind", "seat", "host", "path", "digest", "lines", "partner", "cut"]
    held: list[tuple] = []  # the last two rows
    n = 0
    for b in batches:
        out = []
        for row in zip(b["host"], b["path"], b["digest"], b["lines"]):
            n += 1
            if n <= 2:
                out.append(("end", n, *row, None, []))
            if len(held) == 2:
                if n > 3:
                    out.append(_resolved(held[0], held[1], row))
                else:  # the second row, which has both neighbours here
                    out.append(_resolved(held[0], held[1], row))
                held.pop(0)
            held.append(row)
        yield pd.DataFrame(out, columns=columns)
    tail = held if n > 2 else []
    out = [("end", k - len(tail), *row, None, []) for k, row in enumerate(tail) if n - len(tail) + k + 1 > 2]
    yield pd.DataFrame(out, columns=columns)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Masks of the first and the last row of every partition, from all the partitions' ends in order."""
    rows = [tuple(r) for b in batches for r in zip(b["seat"], b["host"], b["path"], b["digest"], b["lines"], b["size"])]
    out = []
    for i, r in enumerate(rows):
        first, last = r[0] == 1, r[0] == -1 or r[0] == r[5]
        if first or last:
            before = rows[i - 1][1:5] if i else None
            after = rows[i + 1][1:5] if i + 1 < len(rows) else None
            out.append(_resolved(before, r[1:5], after))
    yield pd.DataFrame(out, columns=["kind", "seat", "host", "path", "digest", "lines", "partner", "cut"])


def masks(pages: DataFrame) -> DataFrame:
    """host, digest, partner (path), cut (line positions): what is deleted from a page with such lines.

    Only hashes of lines move. The distinct contents of a host are sorted by path over all partitions, so a
    host of any size is spread; neighbours across the bounds of partitions are settled from the rows at the
    bounds, four a partition.
    """
    rows = pages.select("url", "html").mapInPandas(_narrow, _NARROW)
    once = written(rows.groupBy("host", "digest").agg(F.min(F.struct("path", "lines")).alias("x")).select("host", "x.path", "digest", "x.lines"), "contents")
    order = ["host", "path", "digest"]
    runs = once.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_runs, _PAIRED)
    runs = written(runs.withColumn("task", F.spark_partition_id()), "runs")
    ends = runs.filter("kind = 'end'")
    # a partition of one or two rows has no tail rows: its last row is the one with the highest seat
    sizes = ends.groupBy("task").agg(F.when(F.min("seat") > 0, F.max("seat")).otherwise(F.lit(0)).alias("size"))
    ordered = ends.join(sizes, "task").select(*order, "lines", "seat", "size").coalesce(1).sortWithinPartitions(*order)
    settled = ordered.mapInPandas(_ends, _PAIRED)
    return runs.filter("kind = 'mask'").select("host", "digest", "partner", "cut").union(settled.select("host", "digest", "partner", "cut"))


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for page, url, html in zip(b["page_id"].tolist(), b["url"].tolist(), b["html"].tolist()):
            lines, where = lines_of(html), address(url)
            digest = digest_of(line_hashes(lines)) if where and lines else None
            rows.append((page, url, where[0] if where else None, digest, lines))
        frame = pd.DataFrame(rows, columns=["page_id", "url", "host", "digest", "lines"])
        frame["digest"] = pd.array([r[3] for r in rows], dtype="Int64")
        frame["page_id"] = pd.array([None if x is None or x != x else int(x) for x in frame["page_id"]], dtype="Int64")
        yield frame


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, host, partner, n_lines, n_shared and text: each page's lines but those its partner shares.

    A host's pages with the same lines count as one, at the first of their paths. The partner is the page next
    before or after it in order of path (ties by content) with more leading path segments in common, then more
    characters, of equals the one before. Lines on a longest common subsequence of the two pages are deleted.
    A page that is alone on its host, or has no host or no text, loses nothing; a null html gives an empty
    text. Every row of pages gives a row, repeated ones the same. Other columns are ignored.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    cuts = written(masks(pages), "masks").select(F.col("host").alias("m_host"), F.col("digest").alias("m_digest"), "partner", "cut")
    width = cuts.select(F.coalesce(F.avg(F.size("cut")), F.lit(0.0))).first()[0] * 4 + 120
    rows = base.mapInPandas(_extracted, "page_id bigint, url string, host string, digest bigint, lines array<string>")
    out = rows.join(checked_broadcast(cuts, int(width)), (F.col("host") == F.col("m_host")) & (F.col("digest") == F.col("m_digest")), "left")
    left = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("cut", i), F.lit(False)))
    return out.select("page_id", "url", "host", "partner", F.size("lines").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_shared"), F.array_join(left, "\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
