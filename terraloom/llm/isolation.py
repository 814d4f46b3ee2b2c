"""Operator 10: quality rules by an isolation forest.

Each document gets statistics that quality rules are commonly made of (symbol
and capital shares, words that end in symbols, word length, repeated words and
lines, ...). A forest
of random splits, each tree grown on ``sample_size`` labelled rows, gives every
document its mean path length; short paths mean anomalous documents. The score
cut is calibrated on all labelled rows: the best balanced cut among those that
flag at most ``max_false`` of the good ones.

Statistics are shares, shrunk towards the typical document by ``SHRINK`` words,
so that length alone never makes a document anomalous.

Edge cases: null or empty text has no words, score 1 and is anomalous; null
labels and ids are left out of training and calibration; an id with labels of
both kinds counts as bad; without good labelled rows no document that has words
is anomalous; equal texts get equal scores, so ties are decided alike; very long
texts are read whole; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import read, table
from terraloom.llm.tokens import chunks, row_of, word_bounds, word_hashes

FEATURES = ("word_length", "symbols", "capitals", "tails", "repeats", "runs", "long_runs", "bare", "same_lines")
COUNTS = 12
TREES, SAMPLE, MAX_FALSE, SHRINK, BINS = 100, 256, 0.005, 20.0, 4096
_SYMBOL, _CAPITAL, _ALPHA = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[[ord(c) for c in "!\"#$%&*;<=>?[]\\^_`{|}~"]] = True
_CAPITAL[65:91] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def _counts(mark: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each row."""
    key = h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    return np.bincount(row[at], minlength=n)


def statistics(text: pa.Array) -> pa.Array:
    """Per document the number of words, then raw counts that shares are made of."""
    out = []
    for a, b, raw, off in chunks(text):
        n = b - a
        starts, ends, first = word_bounds(raw, off)
        words = np.diff(first)
        row, h = row_of(first), word_hashes(raw, starts, ends)
        alpha = _ALPHA[raw]
        run = np.zeros(len(h), bool)
        run[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        third = run.copy()
        third[1:] &= run[:-1]
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(alpha, out=letters[1:])
        bare = letters[ends] == letters[starts]
        # Lines: ends of lines within rows; a line's words are those that start in it.
        breaks = np.union1d(np.flatnonzero(raw == 10) + 1, off)
        edge = np.searchsorted(starts, breaks)
        full = np.flatnonzero(np.diff(edge) > 0)
        # A line's fingerprint: its first word, last word, length in words and in bytes.
        lo, hi = edge[full], edge[full + 1]
        line = h[lo] * np.uint64(3) + h[hi - 1] * np.uint64(5) + (hi - lo).astype(np.uint64) * np.uint64(7) + (ends[hi - 1] - starts[lo]).astype(np.uint64) if len(full) else np.zeros(0, np.uint64)
        line_row = row[lo] if len(full) else np.zeros(0, np.int64)
        lines = np.bincount(line_row, minlength=n)
        out.append(np.stack([words, _counts(alpha, off), _word_bytes(starts, ends, row, n), _counts(_SYMBOL[raw], off), _counts(_CAPITAL[raw], off), np.bincount(row[_SYMBOL[raw[ends - 1]]], minlength=n), words - _distinct(row, h, n), np.bincount(row[run], minlength=n), np.bincount(row[third], minlength=n), np.bincount(row[bare], minlength=n), lines, lines - _distinct(line_row, line, n)], axis=1))
    flat = np.concatenate(out).astype(np.float32).ravel() if out else np.zeros(0, np.float32)
    return pa.FixedSizeListArray.from_arrays(pa.array(flat), COUNTS).cast(pa.list_(pa.float32()))


def _word_bytes(starts: np.ndarray, ends: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Bytes in words, by row."""
    return np.bincount(row, ends - starts, n)


def shares(counts: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """The features, from counts, shrunk towards the typical values."""
    words, _, size, symbols, capitals, tails, repeats, runs, third, bare, lines, same = counts.T
    expect = np.sqrt(np.maximum(words, 1))  # repeats grow with length in any text
    raw = [(size, words), (symbols, size), (capitals, size), (tails, words), (repeats / expect, np.sqrt(np.maximum(words, 1))), (runs, words), (third, words), (bare, words), (same, lines)]
    out = np.empty((len(counts), len(FEATURES)))
    for i, (up, down) in enumerate(raw):
        weight = {"same_lines": 4.0, "symbols": 6 * SHRINK, "capitals": 6 * SHRINK}.get(FEATURES[i], SHRINK)
        out[:, i] = (up + weight * typical[i]) / (down + weight)
    return out


class Forest:
    """Complete binary trees in arrays; a leaf points at itself."""

    def __init__(self, x: np.ndarray, trees: int, size: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        size = min(size, len(x))
        depth = max(int(np.ceil(np.log2(max(size, 2)))), 1)
        n = 2 ** (depth + 1) - 1
        self.depth, self.size = depth, size
        self.feature, self.cut, self.left = np.zeros((trees, n), np.int8), np.zeros((trees, n)), np.tile(np.arange(n), (trees, 1))
        self.path = np.zeros((trees, n))
        # A statistic that never varies among the rows is cut just beside its value, so that others stand out.
        margin = np.where(x.max(axis=0) > x.min(axis=0), 0.0, 0.02)
        for t in range(trees):
            todo = [(0, rng.permutation(len(x))[:size], 0)]
            while todo:
                node, rows, level = todo.pop()
                wide = np.zeros(0, np.int64)
                if level < depth and len(rows) >= 2:
                    low, high = x[rows].min(axis=0) - margin, x[rows].max(axis=0) + margin
                    wide = np.flatnonzero(high > low)
                if not len(wide):
                    self.path[t, node] = level + typical_path(len(rows))
                    continue
                f = int(rng.choice(wide))
                cut = rng.uniform(low[f], high[f])
                self.feature[t, node], self.cut[t, node], self.left[t, node] = f, cut, 2 * node + 1
                below = x[rows, f] < cut
                todo += [(2 * node + 1, rows[below], level + 1), (2 * node + 2, rows[~below], level + 1)]

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        total, r = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, path in zip(self.feature, self.cut, self.left, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                down = left[node]
                node = np.where(down == node, node, down + (x[r, feature[node]] >= cut[node]))
            total += path[node]
        return total / len(self.path)

    def score(self, path: np.ndarray) -> np.ndarray:
        return 2.0 ** (-path / max(typical_path(self.size), 1e-9))


def typical_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def anomalies(documents: DataFrame, labels: DataFrame, trees: int = TREES, sample_size: int = SAMPLE, max_false: float = MAX_FALSE) -> DataFrame:
    """doc_id, n_words, mean_path, score, is_anomalous for every row of documents."""
    stats = table(documents.select("doc_id", F.arrow_udf(statistics, "array<float>")("text").alias("c")), "rule-stats")
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("int").alias("q")).filter("doc_id IS NOT NULL AND q IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("q").alias("q"))
    # A bounded draw of good rows for the trees: trees * sample_size at most.
    good = stats.filter("c[0] > 0").join(known.filter("q = 1"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(trees * sample_size).select("c").toArrow()
    c = good["c"].combine_chunks().flatten().to_numpy().reshape(-1, COUNTS).astype(float)
    if not len(c):
        return stats.select("doc_id", F.col("c")[0].cast("long").alias("n_words"), F.lit(0.0).alias("mean_path"), F.when(F.col("c")[0] > 0, 0.0).otherwise(1.0).alias("score"), (F.col("c")[0] == 0).alias("is_anomalous"))
    typical = np.median(shares(c, np.zeros(len(FEATURES))), axis=0)
    forest = Forest(shares(c, typical), trees, sample_size)

    def path(counts: pa.Array) -> pa.Array:
        x = counts.flatten().to_numpy(zero_copy_only=False).reshape(-1, COUNTS).astype(float)
        return pa.array(forest.mean_path(shares(x, typical)) if len(x) else np.zeros(0))

    scored = stats.select("doc_id", F.col("c")[0].cast("long").alias("n_words"), F.arrow_udf(path, "double").asNondeterministic()("c").alias("mean_path"))
    scored = table(scored.withColumn("score", F.when(F.col("n_words") == 0, 1.0).otherwise(F.pow(F.lit(2.0), -F.col("mean_path") / float(max(typical_path(forest.size), 1e-9))))), "rule-scores")
    bins = scored.filter("n_words > 0").join(known, "doc_id").groupBy(F.floor(F.col("score") * BINS).cast("int").alias("b"), "q").count().collect()
    cut = _calibrate(bins, max_false)
    return scored.select("doc_id", "n_words", "mean_path", "score", ((F.col("n_words") == 0) | (F.col("score") >= cut)).alias("is_anomalous"))


def _calibrate(bins: list, max_false: float) -> float:
    """The score from which documents count as anomalous, on the grid of BINS."""
    n = np.zeros((2, BINS + 2))
    for b, q, k in bins:
        n[q, min(b, BINS)] += k
    bad, ok = (np.cumsum(n[q][::-1])[::-1] for q in (0, 1))
    if not ok[0] or not bad[0]:
        return 2.0
    allowed = ok / ok[0] <= max_false
    value = np.where(allowed, bad / bad[0] - ok / ok[0], -1)
    return float(np.argmax(value)) / BINS


def op10_quality_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
