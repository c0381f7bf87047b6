"""Operator 5: SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import BROADCAST_BYTES, HashMemo, Renamed, remove, scratch, words, written

WORDS64 = 2  # a fingerprint has this many 64-bit words
BITS = 64 * WORDS64
THRESHOLD = 22  # pairs at this Hamming distance or less are near copies
BUCKET = 1 << 16  # fingerprints a bucket has on average, at most
LEAST_KEY_BITS = 8
SHARED, MET = 0.97, 0.95  # of pairs at THRESHOLD: how many share a bucket, and how many of these meet in it
BLOCKS = 32  # coordinates of the pivot table
FEW = 128  # members of a bucket that are all compared
_TOKENS_AT_ONCE = 60_000


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """splitmix64."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def node_of(prints: np.ndarray) -> np.ndarray:
    """One 64-bit name per fingerprint (n x WORDS64, uint64)."""
    out = np.zeros(len(prints), dtype=np.uint64)
    for k in range(WORDS64):
        out = _mix(out ^ prints[:, k], k + 11)
    return out.view(np.int64)


def _sketch(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of documents, each given as the hashes of its distinct words."""
    sizes = np.array([len(h) for h in hashes])
    flat = np.concatenate(hashes)
    mixed = np.stack([_mix(flat, k) for k in range(WORDS64)], axis=1)
    bits = np.unpackbits(mixed.view(np.uint8).reshape(len(flat), BITS // 8), axis=1)
    ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > sizes[:, None], axis=1).view(np.uint64).reshape(-1, WORDS64)


def fingerprints(texts: list[str | None], memo: HashMemo) -> tuple[np.ndarray, np.ndarray]:
    """(has a fingerprint, fingerprints). A text without word characters is one token; a blank or null one has none."""
    there, prints = np.zeros(len(texts), dtype=bool), np.zeros((len(texts), WORDS64), dtype=np.uint64)
    held: list[np.ndarray] = []
    at: list[int] = []
    n = 0

    def flush() -> None:
        nonlocal n
        if held:
            prints[at] = _sketch(held)
            held.clear()
            at.clear()
            n = 0

    for i, text in enumerate(texts):
        tokens = set(words(text)) if text else set()
        if text and not tokens and text.strip():
            tokens = {text.strip()}
        if tokens:
            there[i] = True
            held.append(np.array([memo[w] for w in tokens], dtype=np.uint64))
            at.append(i)
            n += len(tokens)
            if n >= _TOKENS_AT_ONCE:
                flush()
    flush()
    return there, prints


def _print_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = HashMemo()
    for b in batches:
        there, prints = fingerprints(b["body"].tolist(), memo)
        out = {"doc_id": b["doc_id"], "sig": b["sig"], "row": b["row"], "node": pd.array(node_of(prints), dtype="Int64")}
        for k in range(WORDS64):
            out[f"f{k}"] = pd.array(prints[:, k].view(np.int64), dtype="Int64")
        frame = pd.DataFrame(out)
        frame.loc[~there, ["node", *(f"f{k}" for k in range(WORDS64))]] = pd.NA
        yield frame


def _signature(text: Column) -> Column:
    return F.xxhash64(text)


def printed(docs: DataFrame) -> DataFrame:
    """doc_id, sig (64-bit hash of the text), row (a number of its own), node and the fingerprint words, one row per
    row of docs."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _signature(F.col("text")).alias("sig"), F.monotonically_increasing_id().alias("row"), F.col("text").alias("body"))
    return base.mapInPandas(_print_rows, "doc_id bigint, sig bigint, row bigint, node bigint, " + ", ".join(f"f{k} bigint" for k in range(WORDS64)))


def unflipped(bits: int, among: int, flips: int = THRESHOLD) -> float:
    """The chance that none of flips random bits, of among, is one of bits chosen ones."""
    return math.prod((among - flips - i) / (among - i) for i in range(bits))


def tables_for(bits: int, among: int, recall: float) -> int:
    """Keys of so many bits that a pair at THRESHOLD needs, to have an equal one with probability recall."""
    p = unflipped(bits, among)
    return 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))


def outer_plan(n: int) -> tuple[int, int]:
    """(bits of a bucket key, bucket tables) for n fingerprints: buckets keep their size, whatever n."""
    bits = max(LEAST_KEY_BITS, math.ceil(math.log2(max(n, 1) / BUCKET)))
    return bits, tables_for(bits, BITS, SHARED)


@lru_cache(maxsize=None)
def inner_plan(n: int, bits: int) -> tuple[int, int]:
    """(bits of a key, tables) within a bucket of n, a power of two, with keys of bits: the cheapest that meet MET."""
    plans = ((k, tables_for(k, BITS - bits, MET)) for k in range(0, min(32, BITS - bits)))
    return min(plans, key=lambda p: p[1] * (4.0 * n + n * n / 2 ** (p[0] + 1)))


@lru_cache(maxsize=None)
def chosen_bits(table: int, bits: int) -> np.ndarray:
    """A random order of all bits; the first are those of the table's bucket key."""
    return np.random.default_rng((20240501, table, bits)).permutation(BITS)


def unpacked(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(len(prints), BITS // 8), axis=1)


def bucket_keys(prints: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """n x tables keys.

    A key holds coordinates of unit pivots: for references that differ in one bit, the difference of a
    fingerprint's distances to both is +1 or -1, which is that bit.
    """
    own = unpacked(prints)
    powers = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([own[:, chosen_bits(t, bits)[:bits]] @ powers + (t << bits) for t in range(tables)], axis=1)


def _keyed(batches: Iterator[pd.DataFrame], bits: int, tables: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        prints = np.stack([b[f"f{k}"].to_numpy(np.int64) for k in range(WORDS64)], axis=1).view(np.uint64)
        for lo in range(0, len(prints), 4000):
            part = prints[lo : lo + 4000]
            out = {"key": bucket_keys(part, bits, tables).ravel()}
            for k in range(WORDS64):
                out[f"f{k}"] = np.repeat(part[:, k].view(np.int64), tables)
            yield pd.DataFrame(out)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """n x BLOCKS: the table of distances to all 2**BLOCKS references that are constant on each block of bits.

    A fingerprint's distance to such a reference is the sum, over the blocks, of its ones there or its zeros, so
    the counts of ones hold all of these distances.
    """
    octets = prints.view(np.uint8).reshape(len(prints), BITS // 8)
    return np.concatenate([np.bitwise_count(octets >> 4), np.bitwise_count(octets & 15)], axis=1).view(np.int8)


def coordinate_gap(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest difference that two fingerprints have in any coordinate, which is never above their distance:
    the reference with ones where the one has more, and zeros elsewhere, has the sum of all differences."""
    return np.abs(table[a] - table[b]).sum(axis=1, dtype=np.uint8)


def _linked(prints: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) are near copies: the largest coordinate difference first, then the distance itself."""
    out = np.zeros(len(a), dtype=bool)
    i = np.flatnonzero(coordinate_gap(table, a, b) <= THRESHOLD)
    out[i] = distance(prints[a[i]], prints[b[i]]) <= THRESHOLD
    return out


def _spanning(prints: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that connect a large bucket just as all its near pairs would.

    Every member looks at all that nothing has reached yet, so a dense group costs one sweep, not a square.
    """
    left = np.arange(len(prints))
    front: list[int] = []
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
        x = front.pop()
        if not len(left):
            return
        hit = _linked(prints, table, np.full(len(left), x), left)
        if hit.any():
            new = left[hit]
            yield np.full(len(new), x), new
            front.extend(new.tolist())
            left = left[~hit]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin, and their sizes."""
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


def _pairs_of(rows: np.ndarray, start: np.ndarray, size: np.ndarray, prints: np.ndarray, table: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within runs of rows, of those whose labels differ still."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    end = np.repeat(start + size, size)
    at = np.flatnonzero(np.repeat(size <= FEW, size))
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        for lo in range(0, len(at), 50_000):
            a, b = rows[at[lo : lo + 50_000]], rows[at[lo : lo + 50_000] + step]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            hit = _linked(prints, table, a, b)
            found.append((a[hit], b[hit]))
        step += 1
    for s, n in zip(start[size > FEW], size[size > FEW]):
        own = rows[s : s + n]
        found += [(own[a], own[b]) for a, b in _spanning(prints[own], table[own])]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs' groups became one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        to = np.arange(len(label))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (again := to[to]).tolist() != to.tolist():
            to = again
        label = to[label]


def _pairs_in(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs, by name, of rows sorted by bucket key; of a large bucket, pairs that connect what these would."""
    start, size = _groups(keys)
    table, rows = pivot_table(prints), np.arange(len(keys))
    few = size <= FEW
    inside = np.repeat(few, size)
    own = rows[inside]
    first = np.cumsum(size[few]) - size[few]
    found = [_pairs_of(own, first, size[few], prints, table, rows)] if len(own) else []
    for s, n, key in zip(start[~few], size[~few], keys[start[~few]]):
        mine, gaps = prints[s : s + n], table[s : s + n]
        label, left = np.arange(n), chosen_bits(int(key) >> bits, bits)[bits:]
        width, tables = inner_plan(1 << int(n - 1).bit_length(), bits)
        ones = unpacked(mine)
        for t in range(tables):
            some = left[np.random.default_rng((7, t, width)).permutation(len(left))[:width]]
            inner = ones[:, some] @ (1 << np.arange(width, dtype=np.int64))
            order = np.argsort(inner, kind="stable")
            label = _joined(label, *_pairs_of(order, *_groups(inner[order]), mine, gaps, label))
        led = np.flatnonzero(label != np.arange(n))
        found.append((label[led] + s, led + s))
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])
    node = node_of(prints)
    return node[a], node[b]


def _edges(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """Near pairs within equal keys; the batches are sorted by key, and a bucket may go over several of them."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pd.DataFrame:
        a, b = _pairs_in(np.concatenate([k for k, _ in held]), np.concatenate([p for _, p in held]), bits)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    for batch in batches:
        keys = batch["key"].to_numpy(np.int64)
        prints = np.stack([batch[f"f{k}"].to_numpy(np.int64) for k in range(WORDS64)], axis=1).view(np.uint64)
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1][0][-1] != keys[0]):
            held.append((keys[:cut], prints[:cut]))
            yield out()
            held = []
        held.append((keys[cut:].copy(), prints[cut:].copy()))
    if held:
        yield out()


def near_pairs(prints: DataFrame) -> DataFrame:
    """Edges a < b between the names of distinct fingerprints, enough to connect every bucket's near pairs."""
    names = [f"f{k}" for k in range(WORDS64)]
    distinct = prints.filter("node is not null").select(*names).distinct()
    bits, tables = outer_plan(prints.count())
    keyed = distinct.mapInPandas(partial(_keyed, bits=bits, tables=tables), "key bigint, " + ", ".join(f"{n} bigint" for n in names))
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(partial(_edges, bits=bits), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the connected components of edges (a, b), labelled by one of their nodes.

    Each round maps a node to the smallest of itself and its neighbours and contracts the graph; the nodes that
    still have edges at least halve. Every round is a written table.
    """
    spark = edges.sparkSession
    maps: list[DataFrame] = []
    at = scratch(spark, "edges")
    edges.write.parquet(at)
    edges = spark.read.schema("a bigint, b bigint").parquet(at)
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
        maps.append(least)
        left = least.select(F.col("node").alias("a"), F.col("label").alias("x"))
        right = least.select(F.col("node").alias("b"), F.col("label").alias("y"))
        smaller = edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        new = scratch(spark, "edges")
        smaller.write.parquet(new)
        remove(spark, at)
        at, edges = new, spark.read.schema("a bigint, b bigint").parquet(new)
    if not maps:
        return spark.createDataFrame([], "node bigint, label bigint")
    out = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("node").alias("was"), F.col("label").alias("now"))
        out = out.join(step, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, sig, group_id (the least doc_id of the group) and keep, one row per row of docs.

    Documents whose 128-bit SimHashes over distinct words differ in THRESHOLD bits or less are near copies, and
    groups are the connected components of such pairs. Equal fingerprints meet exactly. Other pairs meet if they
    share a bucket, a key of unit-pivot coordinates: of pairs at 22 bits, 97 % do; at 20, 98.5 %; at 16, 99.8 %.
    The key's bits grow with the logarithm of the number of documents, so that buckets don't, and with them the
    tables. Within a bucket of more than FEW, at least 95 % of pairs at THRESHOLD meet in one of its own, finer
    tables. A pivot distance table discards pairs by their largest coordinate difference (never a true pair, by
    the triangle inequality) and the Hamming distance verifies the rest. keep holds for one row of each group:
    the least doc_id, then the least sig, of repeated rows any one. A null doc_id sorts before all others. A blank
    or null text is in no group but its own; then group_id is its doc_id. An empty table gives an empty one. Other
    columns are ignored, whatever their names.
    """
    prints = written(printed(docs), "prints")
    labels = components(near_pairs(prints))
    rows = prints.select("doc_id", "sig", "row", "node").join(labels, "node", "left")
    named = rows.filter("node is not null").withColumn("mark", F.coalesce("label", "node"))
    first = named.groupBy(F.col("mark").alias("of")).agg(F.min(F.struct("doc_id", "sig", "row")).alias("first"))
    named = named.join(first, F.col("mark") == F.col("of")).select("doc_id", "sig", F.col("first.doc_id").alias("group_id"), (F.col("first.row") == F.col("row")).alias("keep"))
    alone = prints.filter("node is null").select("doc_id", "sig", F.col("doc_id").alias("group_id"), F.lit(True).alias("keep"))
    return named.union(alone)


SEGMENT = 1 << 16  # bytes of a segment of the Bloom filter
_HASHES = 6


def _bit_places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    x = hashes.view(np.uint64)
    a, b = _mix(x, 1), _mix(x, 2) | np.uint64(1)
    return (_mix(x, 3) % np.uint64(segments)).astype(np.int64), np.stack([(a + np.uint64(i) * b) % np.uint64(8 * SEGMENT) for i in range(_HASHES)], axis=1).astype(np.int64)


def _set_bits(batches: Iterator[pd.DataFrame], segments: int) -> Iterator[pd.DataFrame]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        segment, places = _bit_places(b["h"].to_numpy(np.int64), segments)
        for s in np.unique(segment).tolist():
            bits = held.setdefault(s, np.zeros(SEGMENT, dtype=np.uint8))
            at = places[segment == s].ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pd.DataFrame({"segment": pd.Series(list(held), dtype="int32"), "bits": [v.tobytes() for v in held.values()]})


def _perhaps(keys: DataFrame, n: int, limit: int):
    """A test, of a column's hash, that holds for all n hashes h of keys and few others; None beyond limit bytes."""
    segments = max(1, math.ceil(12 * n / (8 * SEGMENT)))
    if segments * SEGMENT > limit:
        return None
    place = F.pmod(F.xxhash64("h"), F.lit(segments))  # any spread will do: parts of a segment are joined below
    bits = np.zeros((segments, SEGMENT), dtype=np.uint8)
    for row in keys.select("h").repartition(min(segments, 64), place).mapInPandas(partial(_set_bits, segments=segments), "segment int, bits binary").toLocalIterator():
        bits[row["segment"]] |= np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def there(h: pd.Series) -> pd.Series:
        segment, places = _bit_places(h.to_numpy(np.int64), segments)
        return pd.Series((shared.value[segment[:, None], places >> 3] >> (places & 7).astype(np.uint8) & 1).all(axis=1))

    return there


def kept(docs: DataFrame, join_bytes: int = BROADCAST_BYTES, filter_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that grouped() keeps, with all their columns.

    What goes is the lesser part, so texts are not shuffled for it: its keys are broadcast if they take
    join_bytes or less; else a Bloom filter of them is, if that takes filter_bytes or less, and only rows that it
    lets through are joined; else all are.
    """
    rows = written(grouped(docs), "groups")
    gone = rows.groupBy(F.col("doc_id").alias("k_id"), F.col("sig").alias("k_sig")).agg(F.count("*").alias("n"), F.sum(F.col("keep").cast("int")).alias("k")).filter("k < n")
    gone = written(gone.select("k_id", "k_sig", (F.col("k") > 0).alias("again"), F.xxhash64("k_id", "k_sig").alias("h")), "gone")
    table = Renamed(docs)
    mine = table.df.withColumns({"id": table["doc_id"].cast("bigint"), "sig": _signature(table["text"])})
    match = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("sig") == F.col("k_sig"))
    own = [*table.df.columns, "id", "sig"]
    sure, unsure, side = None, mine, gone.drop("h")
    if gone.count() * 64 <= join_bytes:
        side = F.broadcast(side)
    elif there := _perhaps(gone, gone.count(), filter_bytes):
        perhaps = there(F.xxhash64("id", "sig"))
        sure, unsure = mine.filter(~perhaps), mine.filter(perhaps)
    joined = unsure.join(side, match, "left")
    out = joined.filter("again is null").select(*own)
    if not gone.filter("again").isEmpty():  # rows that repeat the one that stays
        out = out.union(joined.filter("again").select(*own).dropDuplicates(["id", "sig"]))
    return table.back(out if sure is None else sure.select(*own).union(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "group_id", "keep")
