"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Each whole text becomes a short vector of statistics (lengths, byte classes, word shapes, repetition).  Random Fourier
features of the standardised vector approximate a Gaussian kernel; every partition adds up its own normal equations, one
set per fold, and only those sums travel.  Each fold is scored by the model of the others, the held-out scores are
counted in fixed bins, and pool-adjacent-violators over the bins turns scores into probabilities.

All labelled rows are used; what reaches the driver is ``features``-sized matrices and ``BINS`` counts, whatever the
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import textkernel as tk
from driftwell.llm.scratch import Scratch, settings


@dataclass(frozen=True)
class QualityModel:
    """``features`` cosines of bandwidth ``bandwidth`` (in units of the root of the dimension); ``ridge`` per row.

    ``folds`` are those of the calibration, by a hash of the id; what is held out doesn't depend on them.
    """

    features: int = 256
    bandwidth: float = 1.2
    ridge: float = 1e-3
    threshold: float = 0.3
    folds: int = 4
    partitions: int = 256
    seed: int = 11


BINS, LOW, HIGH = 2048, -0.5, 1.5
#: Documents whose crc32(doc_id as text) is divisible by this are held out.
HELD_OUT = 5

#: Byte classes of the statistics; every other ASCII symbol is in the last.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"!?", b"'\"", b"|", b"#$%&*@^~", b"()[]{}<>", b":;", b"-_=+/\\"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(_CLASSES) + 1
_N = len(_CLASSES) + 2

NAMES = ["bytes", "words", "lines", "word_length", "word_length_spread", "distinct_words", "top_word", "short_words", "long_words", "capital_words", "shouted_words", "ended_words", "repeated_lines", "line_length", "short_lines", "entropy", *[f"class_{i}" for i in range(_N)]]
_SPAN = 4096


def statistics(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text of a batch; null texts are empty."""
    data, offsets = tk.buffers(column)
    out = np.zeros((len(offsets) - 1, len(NAMES)), np.float32)
    for a, b in tk.slices(offsets):
        out[a:b] = _of_slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _of_slice(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets)
    rows = np.repeat(np.arange(n), size)
    kinds = np.bincount(rows * _N + _CLASS[data], minlength=n * _N).reshape(n, _N)
    share = kinds / np.maximum(size, 1)[:, None]

    starts, ends, firsts = tk.words(data, offsets)
    hashes, length, count = tk.word_hashes(data, starts, ends), ends - starts, np.diff(firsts)
    some = np.maximum(count, 1)
    first, last = _CLASS[data[starts]], _CLASS[data[ends - 1]]
    upper = np.concatenate(([0], np.cumsum(_CLASS[data] == 1)))
    mean = _sums(length, firsts) / some
    spread = np.sqrt(np.maximum(_sums(length.astype(np.float64) ** 2, firsts) / some - mean**2, 0))

    owner = np.repeat(np.arange(n), count)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(order)))
    top = np.zeros(n)
    np.maximum.at(top, owner[order][at], runs)
    distinct = np.bincount(owner[order][at], minlength=n)

    is_break = np.zeros(256, bool)
    is_break[10] = True
    lo, hi, lines = tk.words(data, offsets, is_break)
    line_hash, n_lines = tk.word_hashes(data, lo, hi), np.diff(lines)
    line_owner = np.repeat(np.arange(n), n_lines)
    key = np.unique(np.stack([line_owner.astype(np.uint64), line_hash]), axis=1)[0].astype(np.int64) if len(lo) else np.zeros(0, np.int64)
    different = np.bincount(key, minlength=n)
    some_lines = np.maximum(n_lines, 1)

    p = np.where(share > 0, share, 1.0)
    cols = [
        np.log1p(size), np.log1p(count), np.log1p(n_lines), mean, spread, distinct / np.sqrt(some), top / some,
        _sums(length <= 2, firsts) / some, _sums(length >= 12, firsts) / some, _sums(first == 1, firsts) / some,
        _sums((upper[ends] - upper[starts] >= 2) & (2 * (upper[ends] - upper[starts]) >= length), firsts) / some,
        _sums((last >= 5) & (last <= _N - 2), firsts) / some, 1 - different / some_lines, np.log1p(size / some_lines),
        _sums(hi - lo < 20, lines) / some_lines, -(p * np.log(p)).sum(axis=1),
    ]
    return np.column_stack([*cols, np.sqrt(share)]).astype(np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class _Fourier:
    """The random cosines, and a constant, of standardised vectors."""

    def __init__(self, cfg: QualityModel, centre: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(cfg.seed)
        self.centre, self.scale = centre, scale
        self.w = rng.normal(size=(len(centre), cfg.features)) / (cfg.bandwidth * np.sqrt(len(centre)))
        self.phase = rng.uniform(0, 2 * np.pi, cfg.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase), np.ones(len(x))])


def _fit(gram: np.ndarray, right: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights, the constant unpenalised; ``gram``'s last entry is the number of rows."""
    penalty = np.full(len(right), ridge * max(gram[-1, -1], 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), right)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit of ``value`` under ``weight``: pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _curve(bins: list) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibration: one at the weighted middle of each pooled block, with a little smoothing by counts."""
    rows = sorted((r["bin"], r["n"], r["good"]) for r in bins)
    at, n, good = (np.array(x, float) for x in zip(*rows, strict=True))
    level = isotonic(good / n, n)
    middle = LOW + (at + 0.5) * (HIGH - LOW) / BINS
    knots, values = [], []
    for v in np.unique(level):
        own = level == v
        knots.append(float((middle[own] * n[own]).sum() / n[own].sum()))
        values.append(float(v))
    return np.array(knots), np.array(values)


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, cfg: QualityModel = QualityModel()) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every row of ``docs`` (doc_id and text; others ignored).

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out: their labels are never read.  Null texts count as empty
    and get a score like any other; a row without doc_id is held out.  Several labels of a document are averaged, null
    ones ignored.  Without a usable label every score is 0.5, with labels of one kind it is their mean.  Rows that repeat a
    document have one score each, by their own texts.  An empty table gives an empty result.
    """
    scratch = Scratch(spark, "quality")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        return _run(spark, scratch, texts, labels, cfg)


def _run(spark: SparkSession, scratch: Scratch, texts: DataFrame, labels: DataFrame, cfg: QualityModel) -> DataFrame:
    vectors = scratch.keep(texts.mapInArrow(_vectors, "doc_id long, x array<float>"), "vectors")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT)) == 0
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(cfg.folds)).cast("int")
    own = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where(~out)
    known = own.groupBy("doc_id").agg(F.avg("quality").alias("good"))
    learn = scratch.keep(vectors.join(known, "doc_id").select(fold.alias("fold"), "good", "x"), "labelled")

    d = len(NAMES)
    moments = vectors.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    n_learn, mean = learn.agg(F.count("*"), F.avg("good")).first()
    held = F.coalesce(out, F.lit(True)).alias("held_out")

    def result(score) -> DataFrame:
        return vectors.select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))

    if not n_learn:
        return result(F.lit(0.5))
    spread = np.array([moments[f"s{i}"] for i in range(d)])
    fourier = _Fourier(cfg, np.array([moments[f"m{i}"] for i in range(d)]), np.where(spread > 1e-6, spread, 1.0))
    size = cfg.features + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((cfg.folds, size, size + 1))
        for batch in batches:
            folds, good, z = batch.column(0).to_numpy(), batch.column(1).to_numpy(), fourier(_matrix(batch.column(2)))
            for f in np.unique(folds):
                own = folds == f
                gram[f] += z[own].T @ np.column_stack([z[own], good[own]])
        for f in np.flatnonzero(gram[:, -1, -2]):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * (size + 1)), pa.array(gram[f].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, f, np.int32)), pa.array(np.arange(size, dtype=np.int32)), lists], ["fold", "row", "sums"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = _matrix(part["sums"].combine_chunks()).sum(axis=0)
        return pa.table({"fold": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total])})

    shape = "fold int, row int, sums array<double>"
    parts = learn.coalesce(cfg.partitions).mapInArrow(sums, shape)
    gram = np.zeros((cfg.folds, size, size + 1))
    for r in parts.groupBy("fold", "row").applyInArrow(add, shape).collect():
        gram[r["fold"], r["row"]] = r["sums"]
    whole = gram.sum(axis=0)
    final = _fit(whole[:, :-1], whole[:, -1], cfg.ridge)
    apart = np.stack([_fit((whole - g)[:, :-1], (whole - g)[:, -1], cfg.ridge) if 0 < g[-1, -2] < whole[-1, -2] else final for g in gram])

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (fourier(_matrix(batch.column(2))) * apart[batch.column(0).to_numpy()]).sum(axis=1)
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "good"])

    counted = learn.mapInArrow(bins, "bin int, good double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("good").alias("good")).collect()
    knots, values = _curve(counted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.clip(np.interp(fourier(_matrix(batch.column(1))) @ final, knots, values), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "p"])

    vectors = vectors.select("doc_id", "x").mapInArrow(score, "doc_id long, p double")
    return result(F.col("p"))
