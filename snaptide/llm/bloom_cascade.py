"""Operator 4: URL filters by a cascade of Bloom filters, exact over the corpus's keys."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import BROADCAST_BYTES, scratch, written

KEYS_A_SHARD = 250_000
SALTS = 16  # tasks, at most, that rows of one shard go to
#: Hosts that are listed as a whole, and the digests' first digits that stand for a feed of single URLs.
LISTED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
LISTED_DIGEST = "0f"


#: Scheme and user information, which may be missing; then the host.
_BEFORE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?"
_HOST = _BEFORE + r"(\[[^\]/?#]*\]|[^/?#:@]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def _host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _HOST, 1)), r"\.+$", ""), r"^www\.", "")


def host_key(url: Column) -> Column:
    """'h:' and the lower-cased host without www., user, port and closing dots; null where the URL has none."""
    host = _host(url)
    return F.when(host != "", F.concat(F.lit("h:"), host))


def url_key(url: Column) -> Column:
    """'u:' and the URL without scheme, user, port, www., query, fragment, index file suffix and closing slash."""
    host = _host(url)
    return F.when(host != "", F.concat(F.lit("u:"), host, F.regexp_replace(F.regexp_extract(F.trim(url), _PATH, 1), r"(\.html?|/+)$", "")))


def _hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key).alias("x"), F.xxhash64(F.lit("cascade"), key).alias("y")


def _probes(x: np.ndarray, y: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    """k x n bit positions of a level; the levels hash independently."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    a, b = x ^ salt, y + salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        a = (a ^ (a >> np.uint64(shift))) * np.uint64(factor)
        b = (b ^ (b >> np.uint64(shift))) * np.uint64(factor)
    a, b = a ^ (a >> np.uint64(31)), (b ^ (b >> np.uint64(31))) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(m) for i in range(k)]).astype(np.int64)


def _inside(bits: np.ndarray, x: np.ndarray, y: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    at = _probes(x, y, level, k, m)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)


def levels_of(x: np.ndarray, y: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(hashes, bits, filter) of each level: the listed keys, then by turns the other side's false positives.

    The first level's rate follows the two sides' sizes, the later ones' is a half, so each level is about half
    as large as the one two before; the last has no false positives. Keys must differ in (x, y).
    """
    out: list[tuple[int, int, bytes]] = []
    sides = [(x[listed], y[listed]), (x[~listed], y[~listed])]
    mine, other = sides
    while len(mine[0]):
        n, level = len(mine[0]), len(out)
        rate = min(0.5, math.sqrt(0.5) * n / max(1, len(other[0]))) if level == 0 else 0.5
        k = max(1, round(-math.log2(rate)))
        m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        bits = np.zeros((m + 7) // 8, dtype=np.uint8)
        at = _probes(*mine, level, k, m).ravel()
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        out.append((k, m, bits.tobytes()))
        hit = _inside(bits, *other, level, k, m)
        mine, other = (other[0][hit], other[1][hit]), mine
    return out


def member(levels: list[tuple[int, int, bytes]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: they are if the first level that rejects them is an even one."""
    out, left = np.zeros(len(x), dtype=bool), np.arange(len(x))
    for level, (k, m, raw) in enumerate(levels):
        out[left] = level % 2 == 0  # it holds unless this level rejects
        hit = _inside(np.frombuffer(raw, dtype=np.uint8), x[left], y[left], level, k, m)
        out[left[~hit]] = level % 2 == 1
        left = left[hit]
    return out


def _built(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    x, y = frame["x"].to_numpy(np.int64).view(np.uint64), frame["y"].to_numpy(np.int64).view(np.uint64)
    made = levels_of(x, y, frame["listed"].to_numpy(bool))
    rows = [(int(key[0]), i, k, m, raw) for i, (k, m, raw) in enumerate(made)]
    return pd.DataFrame(rows, columns=["shard", "level", "k", "m", "bits"])


def cascade(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """The filters (shard, level, k, m, bits) over the keys of universe, and the number of shards.

    universe and listed have a column key; nulls are left out, repeats count once, listed keys join the universe.
    A shard holds the keys whose hash falls to it, about KEYS_A_SHARD of them, and has a cascade of its own.
    """
    everything = universe.select("key", F.lit(0).alias("here")).union(listed.select("key", F.lit(1).alias("here")))
    x, y = _hashed(F.col("key"))
    keys = everything.filter("key is not null").select(x, y, "here").groupBy("x", "y").agg(F.max("here").alias("listed"))
    keys = written(keys, "keys")
    shards = max(1, math.ceil(keys.count() / KEYS_A_SHARD))
    made = keys.withColumn("shard", F.pmod(F.col("y"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_built, "shard int, level int, k int, m bigint, bits binary")
    return written(made, "cascade"), shards


def _by_shard(filters: pd.DataFrame) -> dict[int, list[tuple[int, int, bytes]]]:
    out: dict[int, list] = {}
    for r in filters.sort_values(["shard", "level"]).itertuples():
        out.setdefault(int(r.shard), []).append((int(r.k), int(r.m), bytes(r.bits)))
    return out


def _probe(x: pd.Series, y: pd.Series, tables: dict, shards: int) -> pd.Series:
    xs, ys = x.to_numpy(np.int64).view(np.uint64), y.to_numpy(np.int64).view(np.uint64)
    out, shard = np.zeros(len(xs), dtype=bool), y.to_numpy(np.int64) % shards
    for s in np.unique(shard):
        i = np.flatnonzero(shard == s)
        out[i] = member(tables.get(int(s), []), xs[i], ys[i])
    return pd.Series(out)


def flagged(df: DataFrame, keys: dict[str, Column], filters: DataFrame, shards: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a boolean column for each of keys, telling if that key, one of the universe, is listed.

    The filters go to the executors whole while they take limit bytes or less, and are probed in the scan. Beyond
    that they lie in the shared folder, a part for each shard; the rows are shuffled by shard and, so that a key
    that many rows have is no task of its own, by SALTS values of the row; a task reads the parts of its own shards
    only. A null key is not listed.
    """
    spark = df.sparkSession
    size = filters.agg(F.coalesce(F.sum(F.octet_length("bits") + 64), F.lit(0))).first()[0]
    out = df.drop(*keys)
    if size <= limit:
        probe = _prober(spark.sparkContext.broadcast(_by_shard(filters.toPandas())), shards)
        return out.withColumns({name: probe(*_hashed(key)) & key.isNotNull() for name, key in keys.items()})
    path = scratch(spark, "shards")
    filters.write.partitionBy("shard").parquet(path)
    probe = _file_prober(path, shards)
    for name, key in keys.items():
        x, y = _hashed(key)
        salt = F.pmod(F.xxhash64(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns)), F.lit(SALTS))
        out = out.repartition(F.pmod(y, F.lit(shards)), salt).withColumn(name, probe(x, y) & key.isNotNull())
    return out


def _prober(shared, shards: int):
    @F.pandas_udf("boolean")
    def probe(x: pd.Series, y: pd.Series) -> pd.Series:
        return _probe(x, y, shared.value, shards)

    return probe


def _file_prober(path: str, shards: int):
    held: dict[int, list] = {}

    @F.pandas_udf("boolean")
    def probe(x: pd.Series, y: pd.Series) -> pd.Series:
        from pyarrow import dataset, fs

        system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for s in np.unique(y.to_numpy(np.int64) % shards).tolist():
            if s not in held:
                if len(held) > 64:
                    held.clear()
                at = f"{root}/shard={s}"
                there = system.get_file_info(at).type != fs.FileType.NotFound
                rows = dataset.dataset(at, filesystem=system, format="parquet").to_table().to_pandas() if there else None
                held[s] = _by_shard(rows.assign(shard=s)).get(s, []) if there else []
        return _probe(x, y, held, shards)

    return probe


def keys_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.array(host_key(F.col("url")), url_key(F.col("url")))).alias("key"))


def default_listing(pages: DataFrame) -> DataFrame:
    """The production listing: LISTED_HOSTS, and the URL keys a feed names (by digest, for want of a feed's table)."""
    spark = pages.sparkSession
    hosts = spark.createDataFrame([(f"h:{h}",) for h in LISTED_HOSTS], "key string")
    urls = pages.select(url_key(F.col("url")).alias("key")).filter(F.md5("key").startswith(LISTED_DIGEST))
    return hosts.union(urls)


def filtered(pages: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """page_id, url, host_listed, url_listed and blocked (either), one row per row of pages.

    Membership is exact for all keys of pages: hosts and canonical URLs. A null url, or one without a host, has
    no keys and is not blocked. Repeated rows and URLs give the same verdict; an empty table, or listing, is
    fine. Keys are told apart by 128 bits of hash. Other columns are ignored.
    """
    filters, shards = cascade(keys_of(pages), default_listing(pages) if listing is None else listing)
    base = pages.select("page_id", "url")
    out = flagged(base, {"host_listed": host_key(F.col("url")), "url_listed": url_key(F.col("url"))}, filters, shards)
    return out.withColumn("blocked", F.col("host_listed") | F.col("url_listed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_SQL_HOST = rf"regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '{_HOST}', 1)), '\.+$', ''), '^www\.', '')"
ORACLE = rf"""
WITH k AS (
  SELECT page_id, url, {_SQL_HOST} AS host, {_SQL_HOST} || regexp_replace(regexp_extract(trim(url), '{_PATH}', 1), '(\.html?|/+)$', '') AS u FROM pages),
f AS (
  SELECT page_id, url, host <> '' AND host IN ({", ".join(f"'{h}'" for h in LISTED_HOSTS)}) AS host_listed,
    host <> '' AND starts_with(md5('u:' || u), '{LISTED_DIGEST}') AS url_listed FROM k)
SELECT page_id, url, coalesce(host_listed, false) AS host_listed, coalesce(url_listed, false) AS url_listed,
  coalesce(host_listed OR url_listed, false) AS blocked FROM f"""
