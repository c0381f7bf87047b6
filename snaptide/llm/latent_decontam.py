"""Operator 8: benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.llm.common import slices

BLOCK = 16  # words; a corpus passage is two neighbouring blocks
PART = 64  # longer benchmark texts are cut into passages of this many words
FEW_WORDS = 8  # a benchmark passage with fewer words must be there as one run
RANK = 256  # directions of the latent space
SPREAD = 256  # random directions that what the latent space leaves over is spread on
SKETCH = 256  # rows of the random sketch of the corpus
CORPUS_SHARE = 0.1  # weight of the corpus, as a whole, against the benchmark in the SVD
COSINE = 0.35
VERBATIM = 0.75  # share of a passage's words in common subsequence
PARAPHRASE, ANSWER = 0.5, 0.6  # or this share, if so much of the answer is there too
SLICE_BYTES = 1 << 20
SCORES = 1 << 17  # scores held at once
SEED = 8

_MARKUP = r"<[/a-z][^<>]{0,300}>|&#?[a-z0-9]{1,8};"
_GAP = r"[^\p{L}\p{N}\p{M} \n]+"
_LONE = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def tokenised(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(where each text's words begin, the words): runs of letters, digits and marks in lower case.

    Tags and character references part words like any other sign; in scripts that put no blanks between words,
    a character is one. Benchmark and corpus are both read this way.
    """
    low = pc.utf8_lower(texts.cast(pa.string()).fill_null(""))
    if pc.any(pc.match_substring_regex(low, "[<&]")).as_py():
        low = pc.replace_substring_regex(low, _MARKUP, " ")
    low = pc.replace_substring_regex(low, _GAP, " ")
    if pc.any(pc.match_substring_regex(low, _LONE)).as_py():
        low = pc.replace_substring_regex(low, f"({_LONE})", r" \1 ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(low))
    return lists.offsets.to_numpy().astype(np.int64), lists.values


def words(text: str | None) -> list[str]:
    return [w for w in tokenised(pa.array([text], pa.string()))[1].to_pylist() if w]


def weight_of(part: list[str]) -> float:
    """How many words a passage is worth; a character of a script without blanks counts as half a word."""
    return sum(0.5 if len(w) == 1 and _DENSE.match(w) else 1.0 for w in part)


def passages(items: list[tuple[int, str | None]]) -> list[tuple[int, list[str], list[str]]]:
    """(item_id, words, answer words) of the benchmark's passages. The answer is the last sentence, or the last
    five words where that has fewer than three."""
    out = []
    for item, text in items:
        tokens = words(text)
        count = max(1, -(-len(tokens) // PART))
        size = -(-len(tokens) // count)
        sentences = [s for s in re.split(r"[.!?\n\u3002\uff01\uff1f]+", text or "") if s.strip()]
        last = words(sentences[-1]) if sentences else []
        for k in range(count):
            part = tokens[k * size : (k + 1) * size]
            if part:
                answer = last if k == count - 1 and 3 <= len(last) <= len(part) else part[-5:]
                out.append((item, part, answer))
    return out


class Running:
    """Documents as runs of words: where each document's begin, and those that the benchmark has."""

    def __init__(self, texts: pa.Array, vocabulary: pa.Array):
        self.offsets, self.tokens = tokenised(texts)
        columns = pc.index_in(self.tokens, value_set=vocabulary).fill_null(-1).to_numpy()
        self.at = np.flatnonzero(columns >= 0)
        self.columns = columns[self.at].astype(np.int64)
        self.doc = np.searchsorted(self.offsets, self.at, side="right") - 1
        self.block = (self.at - self.offsets[self.doc]) // BLOCK
        #: blocks of all documents before each
        self.before = np.concatenate([[0], np.cumsum(-(-np.diff(self.offsets) // BLOCK))])

    def region(self, doc: int, low: int, high: int) -> list[str]:
        first, end = self.offsets[doc], self.offsets[doc + 1]
        low, high = max(first, first + low), min(end, first + high)
        return self.tokens[low:high].to_pylist()


_SUMS = "part int, salt int, total bigint, body binary"
_ROWS = SKETCH // 8  # of the sketch, in a row of a sum


def _sum_rows(salt: int, total: int, df: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    bodies = [df.astype(np.float64).tobytes()] + [sketch[lo : lo + _ROWS].astype(np.float32).tobytes() for lo in range(0, SKETCH, _ROWS)]
    parts = [-1, *range(0, SKETCH, _ROWS)]
    return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "salt": pa.array([salt] * len(parts), pa.int32()), "total": [total] + [0] * (len(parts) - 1), "body": pa.array(bodies, pa.binary())})


def _statistics(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array) -> Iterator[pa.RecordBatch]:
    """Of the partition's passages: how many, in how many each word is, and a random sparse-sign sketch of them.

    A row of the sketch is the signed sum of the term counts of the passages that hash to it, so one pass over
    the corpus gives S x A with S drawn at random; the inverse document frequencies only scale its columns and
    come in later.
    """
    width = len(vocabulary)
    df, sketch, total = np.zeros(width), np.zeros(SKETCH * width), 0
    for b in batches:
        ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
        for low, texts in slices(b.column(1), SLICE_BYTES):
            run = Running(texts, vocabulary)
            total += int(run.before[-1])
            if not len(run.at):
                continue
            pair = np.unique((run.before[run.doc] + run.block) * width + run.columns)
            df += np.bincount(pair % width, minlength=width)
            mixed = (run.block.astype(np.uint64) + ids[low + run.doc] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            row = (mixed % np.uint64(SKETCH)).astype(np.int64)
            sign = ((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2.0 - 1.0
            sketch += np.bincount(row * width + run.columns, weights=sign, minlength=SKETCH * width)
    if total:
        context = TaskContext.get()
        yield _sum_rows((context.partitionId() if context else 0) % 4096, total, df, sketch.reshape(SKETCH, width))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's rows by part; one running sum a part is held, never the rows."""
    sums: dict[int, np.ndarray] = {}
    total, salt = 0, 0
    for b in batches:
        for part, mark, n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            own = np.frombuffer(body.as_buffer(), dtype=np.float64 if part == -1 else np.float32)
            total, salt = total + n, mark
            if part in sums:
                sums[part] += own
            else:
                sums[part] = own.astype(np.float64)
    if sums:
        bodies = [v.astype(np.float64 if k == -1 else np.float32).tobytes() for k, v in sums.items()]
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "salt": pa.array([salt] * len(sums), pa.int32()), "total": [total if k == -1 else 0 for k in sums], "body": pa.array(bodies, pa.binary())})


class Counts:
    """Word counts of the benchmark's passages, a value a passage and word."""

    def __init__(self, parts, vocabulary: pa.Array):
        column = {w: i for i, w in enumerate(vocabulary.to_pylist())}
        cells: dict[tuple[int, int], int] = {}
        for i, (_, part, _) in enumerate(parts):
            for w in part:
                cells[i, column[w]] = cells.get((i, column[w]), 0) + 1
        at = np.array(list(cells), dtype=np.int64).reshape(-1, 2)
        self.shape = (len(parts), len(column))
        self.row, self.column = at[:, 0], at[:, 1]
        self.value = np.array(list(cells.values()), dtype=np.float64)

    def times(self, x: np.ndarray, transposed: bool = False) -> np.ndarray:
        """This matrix, or its transpose, times x."""
        to, of = (self.column, self.row) if transposed else (self.row, self.column)
        out = np.zeros((self.shape[1 if transposed else 0], x.shape[1]))
        order = np.argsort(to, kind="stable")
        for lo in range(0, len(order), 20_000):
            some = order[lo : lo + 20_000]
            first = np.flatnonzero(np.concatenate([[True], np.diff(to[some]) > 0]))
            out[to[some][first]] += np.add.reduceat(x[of[some]] * self.value[some, None], first, axis=0)
        return out


def leading(bench: Counts, corpus: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of bench stacked on corpus, by a randomised range and power iterations."""
    n = bench.shape[0]
    size = min(rank + 16, n + len(corpus), bench.shape[1])
    left = np.random.default_rng(SEED).standard_normal((n + len(corpus), size))
    for _ in range(3):
        basis, _ = np.linalg.qr(bench.times(left[:n], transposed=True) + corpus.T @ left[n:])
        left = np.vstack([bench.times(basis), corpus @ basis])
        left, _ = np.linalg.qr(left)
    _, s, vt = np.linalg.svd(np.vstack([bench.times(basis), corpus @ basis]), full_matrices=False)
    return basis @ vt[: min(rank, int((s > 1e-9 * max(s[0], 1e-300)).sum()))].T


class Model:
    """Latent vectors of the benchmark's passages, and what a task needs to score running text against them.

    A vector has RANK latent coordinates, and SPREAD more that hold a random projection of what the latent space
    leaves over; so a passage keeps a direction of its own however many there are, and a scalar product comes out
    true, but for a few hundredths.
    """

    def __init__(self, parts, vocabulary: pa.Array, total: int, df: np.ndarray, sketch: np.ndarray):
        self.parts, self.vocabulary = parts, vocabulary
        idf = np.log((total + 1.0) / (df + 1.0)) + 0.05
        bench = Counts(parts, vocabulary)
        bench.value *= idf[bench.column]
        norm = np.sqrt(np.bincount(bench.row, weights=bench.value**2, minlength=len(parts)))
        corpus = sketch * idf
        size = np.linalg.norm(corpus)
        if size > 0:
            corpus *= CORPUS_SHARE * np.sqrt((norm**2).sum()) / size
        basis = leading(bench, corpus, RANK)
        signs = np.random.default_rng(SEED + 1).choice([-1.0, 1.0], (len(idf), SPREAD)) / np.sqrt(SPREAD)
        space = np.hstack([basis, signs - basis @ (basis.T @ signs)])
        latent = bench.times(space) / np.maximum(norm, 1e-12)[:, None]
        self.weight = (idf * idf).astype(np.float32)
        table = idf[:, None] * space
        # scores are linear in a passage's words: with few passages the projection is folded into their side
        folded = len(parts) <= space.shape[1]
        table = table @ latent.T if folded else table
        self.table = np.vstack([table, np.zeros(table.shape[1])]).astype(np.float32)
        self.latent = None if folded else latent.T.astype(np.float32)
        #: a passage of few words is a small part of the window around it
        self.gate = np.array([COSINE * min(1.0, weight_of(part) / FEW_WORDS) ** 0.5 for _, part, _ in parts], dtype=np.float32)

    def scores(self, summed: np.ndarray) -> np.ndarray:
        return summed if self.latent is None else summed @ self.latent


def fitted(docs: DataFrame, parts) -> Model:
    """The model over all passages of docs and the benchmark's. Sums meet in two steps, by salts and then whole."""
    vocabulary = pa.array(sorted({w for _, part, _ in parts for w in part}), pa.string())
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("body"))
    sums = base.mapInArrow(partial(_statistics, vocabulary=vocabulary), _SUMS)
    sums = sums.repartition("part", "salt").mapInArrow(_added, _SUMS).repartition("part").mapInArrow(_added, _SUMS)
    width = len(vocabulary)
    total, df, sketch = 0, np.zeros(width), np.zeros((SKETCH, width))
    for row in sums.collect():  # SKETCH / _ROWS + 1 parts, whose size is the vocabulary's
        if row["part"] == -1:
            total, df = total + row["total"], df + np.frombuffer(bytes(row["body"]))
        else:
            sketch[row["part"] : row["part"] + _ROWS] += np.frombuffer(bytes(row["body"]), dtype=np.float32).reshape(_ROWS, width)
    return Model(parts, vocabulary, total, df, sketch)


def common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one integer per row."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = places.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judged(part: list[str], answer: list[str], region: list[str]) -> tuple[float, float, str | None]:
    """(share of part in common subsequence, share of the answer, verdict or None). Of a passage of few words it
    takes the whole run; of one or two words, a text of nothing else."""
    weight = weight_of(part)
    if weight < FEW_WORDS:
        n = len(part)
        there = region == part if n < 3 else any(region[i : i + n] == part for i in range(len(region) - n + 1))
        return (1.0, 1.0, "verbatim") if there else (0.0, 0.0, None)
    lcs = common(part, region) / len(part)
    share = common(answer, region) / len(answer)
    verdict = "verbatim" if lcs >= VERBATIM else "paraphrase" if lcs >= PARAPHRASE and share >= ANSWER else None
    return lcs, share, verdict


def found(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, int, float, float, float, str]]:
    """(row, item, word the passage starts at, cosine, lcs, answer, verdict) of the benchmark passages in texts."""
    for low, part in slices(texts, SLICE_BYTES):
        for hit in _found(part, model):
            yield (low + hit[0], *hit[1:])


def _found(texts: pa.Array, model: Model) -> list[tuple]:
    run = Running(texts, model.vocabulary)
    if not len(run.at):
        return []
    place = run.before[run.doc] + run.block
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    here, doc = place[starts], run.doc[starts]
    seat = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(place))))
    follows = np.flatnonzero((np.diff(here) == 1) & (np.diff(doc) == 0))
    norm = _norms(run.columns, seat, len(starts), model)
    next_of = np.full(len(starts) + 1, -1)
    next_of[follows + 1] = follows  # seats whose words also count for the passage that begins a block earlier
    pair_norm = _norms(np.concatenate([run.columns, run.columns]), np.concatenate([seat, next_of[seat]]), len(starts), model)
    best: dict[tuple[int, int], tuple] = {}
    # the words of each block, filled up with one that weighs nothing
    seats = np.full((len(starts), BLOCK), len(model.table) - 1)
    seats[seat, np.arange(len(place)) - starts[seat]] = run.columns
    at_once = max(16, SCORES // max(len(model.parts), model.table.shape[1]))
    for lo in range(0, len(starts), at_once):  # the scores of so many blocks at once, within the cache; the next one's first is seen twice
        hi = min(lo + at_once + 1, len(starts))
        near = model.table[seats[lo:hi, 0]]
        for k in range(1, BLOCK):
            near += model.table[seats[lo:hi, k]]
        near = model.scores(near)
        pairs = follows[(follows >= lo) & (follows < hi - 1)]
        for score, size, where in ((near, norm[lo:hi], np.arange(lo, hi)), (near[pairs - lo] + near[pairs - lo + 1], pair_norm[pairs], pairs)):
            for w, p in np.argwhere(score >= model.gate * size[:, None]).tolist():
                d = int(doc[where[w]])
                item, part, answer = model.parts[p]
                was = best.get((d, item))
                if was and was[4] == 1.0:
                    continue
                begin = int(here[where[w]] - run.before[d]) * BLOCK
                lcs, share, verdict = judged(part, answer, run.region(d, begin - len(part) - BLOCK, begin + 2 * BLOCK + len(part)))
                if verdict and (not was or (lcs, share) > (was[4], was[5])):
                    best[(d, item)] = (d, item, begin, float(score[w, p] / size[w]), lcs, share, verdict)
    return [*best.values()]


def _norms(columns: np.ndarray, seat: np.ndarray, n: int, model: Model) -> np.ndarray:
    """Length of each seat's vector of counted, weighted words."""
    inside = seat >= 0
    names, times = np.unique(seat[inside] * len(model.weight) + columns[inside], return_counts=True)
    squares = times.astype(np.float64) ** 2 * model.weight[names % len(model.weight)]
    return np.sqrt(np.bincount(names // len(model.weight), weights=squares, minlength=n)).astype(np.float32)


def _search(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in batches:
        rows = [(b.column(0)[hit[0]].as_py(), *hit[1:]) for hit in found(b.column(1), model)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=_NAMES)


_NAMES = ["doc_id", "item_id", "at_word", "cosine", "lcs", "answer", "verdict"]
_KINDS = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.string()]
_SCHEMA = "doc_id bigint, item_id bigint, at_word bigint, cosine double, lcs double, answer double, verdict string"


def model_of(docs: DataFrame, benchmark: DataFrame) -> Model | None:
    """The model, or None if the benchmark has no words. All of the benchmark comes to the driver, once."""
    items = benchmark.filter("text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    parts = passages([(row["item_id"], row["text"]) for row in items.toLocalIterator()])
    return fitted(docs, parts) if parts else None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, at_word, cosine, lcs, answer, verdict.

    Words are runs of letters and digits, of a script without blanks single characters, whatever signs or tags
    stand between them (see tokenised()). Corpus passages are runs of BLOCK words and pairs of neighbouring runs,
    over whole texts. TF-IDF weights count all of them. A random sparse-sign sketch of the corpus, stacked under
    the benchmark's own vectors, gives the leading right singular vectors (see Model); the cosine of a passage is
    its latent score over the length of its vector of benchmark words. Passages at COSINE or more are verified
    against the words around them: verbatim if VERBATIM of the benchmark passage's words are a common
    subsequence, paraphrase if PARAPHRASE of them are and ANSWER of its last sentence is. A benchmark passage of
    fewer than FEW_WORDS words is found, at a gate lowered to its share of the window, as an unbroken run; one of
    one or two words only where a text is nothing else. Of several hits of an item in a document, the best stays;
    of ties, the first. Null and empty texts have no passages; repeated benchmark rows count once, repeated
    documents each report; a null item_id or doc_id is reported as null. Without benchmark words, or documents,
    the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    model = model_of(docs, benchmark)
    if model is None:
        return spark.createDataFrame([], _SCHEMA)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("body"))
    return base.mapInArrow(partial(_search, shared=spark.sparkContext.broadcast(model)), _SCHEMA)


def _leaks(shared) -> Callable[[Column], Column]:
    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        flags = np.zeros(len(text), dtype=bool)
        flags[[h[0] for h in found(text, shared.value)]] = True
        return pa.array(flags)

    return hit


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which contaminated() finds nothing, with all their columns."""
    model = model_of(docs, benchmark)
    if model is None:
        return docs
    return docs.filter(~_leaks(docs.sparkSession.sparkContext.broadcast(model))(F.coalesce(F.col("text"), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
