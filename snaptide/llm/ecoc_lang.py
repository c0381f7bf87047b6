"""Operator 3: language identification by error-correcting output codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snaptide.llm.common import slices

DIM = 4096  # hashed byte n-grams, of two and three bytes
SAMPLE = 3000  # labelled rows the classifiers are fitted on, at most, shared out evenly over the languages
LEAST_EACH = 20  # of a language; so the sample has room for SAMPLE / LEAST_EACH languages, those with the most rows
RIDGE = 1e-2
SHARPNESS = 4.0
MARGIN = 0.3  # two codewords whose mean losses differ by less are not told apart
LEAST_BYTES = 12
SLICE_BYTES = 1 << 20

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalpha()]] = 32


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all splits of the languages up to seven of them, else the best of random codes."""
    if k <= 7:
        splits = [[1 if i == 0 or (s >> (i - 1)) & 1 else -1 for i in range(k)] for s in range(max(1, 2 ** (k - 1) - 1))]
        return np.array(splits, dtype=np.float64).T
    bits, rng = 10 * int(np.ceil(np.log2(k))), np.random.default_rng(3)
    best, most = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        apart = (bits - (code @ code.T)[np.triu_indices(k, 1)].max()) / 2
        if apart > most and (np.abs(code.sum(axis=0)) < k).all():
            best, most = code, apart
    return best


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x DIM features, bytes that are letters): root frequencies of n-grams over the whole text, of length one."""
    low = pc.utf8_lower(texts.cast(pa.string()).fill_null(""))
    offsets = np.frombuffer(low.buffers()[1], dtype=np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if low.buffers()[2] and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    b = _PLAIN[data]
    out, letters = np.zeros((len(low), DIM), dtype=np.float32), np.zeros(len(low), dtype=np.int64)
    lo = 0
    while lo < len(low):
        hi = min(len(low), lo + 64, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1))
        part, at = b[offsets[lo] : offsets[hi]].astype(np.uint32), offsets[lo : hi + 1] - offsets[lo]
        doc = np.repeat(np.arange(hi - lo), np.diff(at))
        letters[lo:hi] = np.bincount(doc, weights=part != 32, minlength=hi - lo)
        counts = np.zeros((hi - lo) * DIM)
        for n in (2, 3):
            if len(part) < n:
                continue
            m = len(part) - n + 1
            gram = part[:m] * np.uint32(256) + part[1 : m + 1]
            if n == 3:
                gram = gram * np.uint32(256) + part[2 : m + 2]
            cell = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - DIM.bit_length() + 1)
            inside = doc[:m] == doc[n - 1 : n - 1 + m]
            counts += np.bincount((doc[:m] * DIM + cell)[inside], minlength=len(counts))
        rows = np.sqrt(counts.reshape(hi - lo, DIM))
        out[lo:hi] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
        lo = hi
    return out, letters


class Classifier:
    """One ridge classifier of n-grams per bit of the code, and the decoding of their outputs."""

    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        self.code = codewords(len(self.languages))
        own = np.array([self.languages.index(y) for y in labels])
        targets = self.code[own]
        shares = np.bincount(own, minlength=len(self.languages))
        weight = np.sqrt(len(own) / (len(self.languages) * shares[own]))[:, None]  # languages count alike
        xs = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64) * weight
        dual = np.linalg.solve(xs @ xs.T + RIDGE * np.eye(len(xs)), targets * weight)
        self.weights = (xs.T @ dual).astype(np.float32)
        right = (np.sign(self.outputs(x)) == targets).astype(np.float64)
        by = np.stack([right[own == i].mean(axis=0) for i in range(len(self.languages))])
        self.trust = by / np.maximum(by.sum(axis=1, keepdims=True), 1e-12)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest codeword, how much farther the next is) by logistic losses, weighted with how
        often a bit's classifier is right on the language."""
        z = SHARPNESS * self.outputs(x).astype(np.float64)
        losses = np.stack([(self.trust[i] * np.logaddexp(0.0, -z * self.code[i])).sum(axis=1) for i in range(len(self.languages))], axis=1)
        order = np.sort(losses, axis=1)
        margin = order[:, 1] - order[:, 0] if losses.shape[1] > 1 else np.full(len(x), np.inf)
        return losses.argmin(axis=1), margin


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, _ = features(b.column(1))
        yield pa.RecordBatch.from_pydict({"lang": b.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fit on at most sample labelled rows with text: of each language those with the least hashes of doc_id. Of more
    languages than sample / LEAST_EACH those with the most rows (ties: the first by name) are fitted."""
    labelled = docs.filter("lang is not null and trim(text) <> ''").select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id").alias("h"))
    by_rows = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    counts = {r["lang"]: r["n"] for r in by_rows.limit(max(1, sample // LEAST_EACH)).collect()}
    if not counts:
        return None
    each = sample // len(counts)
    # a hash bound first, of three times the share, then the exact share of what passes
    bound = F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, int(min(1.0, (3 * each + 50) / n) * 1_000_000))))
    near = labelled.filter(F.pmod("h", F.lit(1_000_000)) < bound[F.col("lang")])
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h", "text"))).filter(F.col("r") <= each)
    rows = first.select("lang", "text").mapInArrow(_sample_rows, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return Classifier(np.stack([np.frombuffer(bytes(r["x"]), dtype=np.float32) for r in rows]), [r["lang"] for r in rows])


def _identify(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    names = np.array(model.languages, dtype=object)
    for b in batches:
        said, margins, sure = [], [], []
        for texts in (part.slice(lo, 512) for _, part in slices(b.column(2), 16 * SLICE_BYTES) for lo in range(0, len(part), 512)):
            x, letters = features(texts)
            best, margin = model.decode(x)
            there = letters > 0
            said += np.where(there, names[best], None).tolist()
            margins += [m if t else None for m, t in zip(margin.tolist(), there.tolist())]
            sure += ((margin >= MARGIN) & (letters >= LEAST_BYTES)).tolist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string()), pa.array(margins, pa.float64()), pa.array([not s for s in sure])], names=["doc_id", "lang", "predicted", "margin", "ambiguous"])


_SCHEMA = "doc_id bigint, lang string, predicted string, margin double, ambiguous boolean"


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang (as given), predicted, margin and ambiguous, one row per row of docs.

    A code assigns every language of the labels a codeword; a classifier of byte n-grams predicts each bit, over
    the whole text. The language with the least weighted loss wins; margin is the next one's loss less that, and
    ambiguous holds where it is under MARGIN (with one language, never) or the text has fewer than LEAST_BYTES bytes of letters. A null
    text, or one without letters, has no prediction and is ambiguous; so is every text if no row has a label.
    Null labels only keep a row out of the sample. Repeated rows give equal answers; other columns are ignored.
    """
    spark = docs.sparkSession
    model = fitted(docs, sample)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")
    if model is None:
        return base.select("doc_id", "lang", F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("margin"), F.lit(True).alias("ambiguous"))
    shared = spark.sparkContext.broadcast(model)
    return base.mapInArrow(lambda batches: _identify(batches, shared), _SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark.read.parquet(f"{sf_dir}/documents.parquet"))
