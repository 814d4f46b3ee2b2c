"""Operator 1: toxicity by a classifier chain.

Categories are predicted in a fixed order by linear models over the words that
a document holds; each model also sees the probabilities of the categories
before it. Those are out-of-fold predictions while training, so later models
learn from errors such as they will meet.

The label table has one flag, toxic. The chain grades it: ``dense`` (share of
marker words at least the median of toxic rows) and ``varied`` (distinct marker
words at least the median) come first, ``toxic`` itself last; it decides.
Markers are the words that the labelled rows tie to the flag.

The fit uses at most ``max_rows`` labelled rows that have a document, the lowest
by hash of doc_id, half of them toxic where there are as many, and every word
that ``LEAST_ROWS`` of them hold; scoring covers every document.

Edge cases: null or empty text holds no words and is never toxic; rows with a
null label or id aren't trained on; an id with labels of both kinds counts as
toxic; without rows of both kinds all probabilities are 0; equal texts count
once in training and get equal results, so ties can't be told apart; very long
texts are read whole; an empty table gives no rows; other columns of the inputs
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm import linear
from terraloom.llm.common import read
from terraloom.llm.tokens import chunks, letter_bounds, row_of, word_hashes

CATEGORIES = ("dense", "varied", "toxic")
MAX_ROWS, LEAST_ROWS, FOLDS = 6000, 3, 5
_RESULT = T.StructType([T.StructField(f"p_{c}", T.DoubleType(), False) for c in CATEGORIES] + [T.StructField("is_toxic", T.BooleanType(), False)])


@dataclass
class Chain:
    """words: sorted fingerprints; weights: per category over the words, over the categories before it, and the bias."""

    words: np.ndarray
    weights: list[tuple[np.ndarray, np.ndarray, float]]
    threshold: float

    def predict(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """Probabilities, one row per document; (row, word) name the known words each document holds, once each."""
        p = np.zeros((n, len(CATEGORIES)))
        for c, (w, v, b) in enumerate(self.weights):
            p[:, c] = linear.sigmoid(np.bincount(row, w[word], n) + p[:, :c] @ v + b)
        return p


def _known(column: pa.Array, words: np.ndarray):
    """(first row, rows, row of a hit, word of a hit), each word once per row."""
    seen = np.zeros(1 << 20, bool)
    seen[(words >> np.uint64(44)).astype(np.int64)] = True
    for a, b, raw, off in chunks(column):
        starts, ends, first = letter_bounds(raw, off)
        h = word_hashes(raw, starts, ends, lower=True)
        at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
        i = np.minimum(np.searchsorted(words, h[at]), max(len(words) - 1, 0))
        ok = words[i] == h[at] if len(words) else np.zeros(0, bool)
        key = np.unique(row_of(first)[at[ok]] * max(len(words), 1) + i[ok])
        yield a, b - a, key // max(len(words), 1), key % max(len(words), 1)


def _distinct_words(text: pa.Array) -> pa.Array:
    out, sizes = [], []
    for _, _, raw, off in chunks(text):
        starts, ends, first = letter_bounds(raw, off)
        h, r = word_hashes(raw, starts, ends, lower=True), row_of(first)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        times = np.diff(np.append(np.flatnonzero(new), len(h)))
        pair = np.empty(2 * new.sum(), np.int64)
        pair[::2], pair[1::2] = h[new].view(np.int64), times
        out.append(pair)
        sizes.append(2 * np.bincount(r[new], minlength=len(off) - 1))
    values = np.concatenate(out) if out else np.zeros(0, np.int64)
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def train(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    """Fits the chain on a bounded sample of labelled rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("i").agg(F.max("y").alias("y")).withColumn("o", F.xxhash64("i"))
    known = known.join(documents.select(F.col("doc_id").cast("long").alias("i")), "i", "left_semi")
    picked = [r for y in (0, 1) for r in known.filter(F.col("y") == y).orderBy("o", "i").limit(max_rows // 2).collect()]
    empty = Chain(np.zeros(0, np.uint64), [(np.zeros(0), np.zeros(c), -35.0) for c in range(len(CATEGORIES))], 1.0)
    if not picked or len({r.y for r in picked}) < 2:
        return empty
    spark = documents.sparkSession
    ids = F.broadcast(spark.createDataFrame([(r.i, r.y) for r in picked], "i long, y int"))  # max_rows bounds it
    words = F.arrow_udf(_distinct_words, "array<long>")
    sample = documents.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")).join(ids, "i").select("i", "y", words("t").alias("w"))
    # Equal texts count once; which of them stands for all doesn't depend on the order of rows.
    got = sample.groupBy("w").agg(F.min("i").alias("i"), F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").toArrow()
    y = got["y"].to_numpy().astype(float)
    lists = got["w"].combine_chunks()
    if not len(lists) or len(set(y)) < 2:
        return empty
    flat = lists.flatten().to_numpy()
    first = lists.offsets.to_numpy().astype(np.int64) // 2
    h, times = flat[::2].view(np.uint64), flat[1::2]
    row = np.repeat(np.arange(len(y)), np.diff(first))
    # How far a word's presence is tied to the label, as a signed root of chi-squared.
    u, inv = np.unique(h, return_inverse=True)
    pos, all_ = np.bincount(inv, y[row], len(u)), np.bincount(inv, minlength=len(u)).astype(float)
    rate = y.mean()
    z = (pos - all_ * rate) / np.sqrt(all_ * rate * (1 - rate) + 1e-9)
    best = np.flatnonzero(all_ >= LEAST_ROWS)
    place = np.full(len(u), -1)
    place[best] = np.arange(len(best))
    f = place[inv]
    x = linear.Rows(f[f >= 0], np.concatenate([[0], np.cumsum(np.bincount(row[f >= 0], minlength=len(y)))]), len(best))
    marker = (z[inv] > 4) & (f >= 0)
    hits, kinds = np.bincount(row[marker], times[marker], len(y)), np.bincount(row[marker], minlength=len(y))
    share = hits / np.maximum(np.bincount(row, times, len(y)), 1)
    t = y == 1
    grades = [t & (share >= np.median(share[t])), t & (kinds >= np.median(kinds[t])), t]
    fold = np.arange(len(y)) % FOLDS
    oof, weights = np.zeros((len(y), len(CATEGORIES))), []
    folds = [(fold != k, x.take(fold != k), x.take(fold == k)) for k in range(FOLDS)]
    for c, g in enumerate(grades):
        target, before = g.astype(float), oof[:, :c]
        for inside, rows, rest in folds:
            w, v, b = linear.fit(rows, before[inside], target[inside])
            oof[~inside, c] = linear.sigmoid(rest.dot(w) + before[~inside] @ v + b)
        weights.append(linear.fit(x, before, target))
    return Chain(u[best], weights, _threshold(oof[:, -1], y))


def _threshold(p: np.ndarray, y: np.ndarray, beta: float = 0.5) -> float:
    """Midway below the out-of-fold cut with the best F-beta; beta under 1 weighs rejected clean documents more than missed toxic ones."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f = (1 + beta**2) * np.cumsum(y) / (np.arange(1, len(y) + 1) + beta**2 * y.sum())
    f[:-1][p[1:] == p[:-1]] = -1
    k = int(np.argmax(f))
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])


def scorer(chain: Chain):
    """A column function: text -> struct of probabilities and the decision."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(chain)  # the words of MAX_ROWS texts at most

    def score(text: pa.Array) -> pa.Array:
        chain = sent.value
        p = np.zeros((len(text), len(CATEGORIES)))
        for a, n, row, word in _known(text, chain.words):
            p[a : a + n] = chain.predict(row, word, n)
        columns = [pa.array(p[:, c]) for c in range(len(CATEGORIES))] + [pa.array(p[:, -1] >= chain.threshold)]
        return pa.StructArray.from_arrays(columns, names=[f.name for f in _RESULT])

    return F.arrow_udf(score, _RESULT).asNondeterministic()  # keeps Catalyst from evaluating it twice


def classify(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, p_dense, p_varied, p_toxic, is_toxic for every row of documents."""
    score = scorer(train(documents, labels, max_rows))
    return documents.select("doc_id", score("text").alias("s")).select("doc_id", "s.*")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that the chain doesn't reject, columns as they are."""
    score = scorer(train(docs, read(spark, sf_dir, "labels")))
    return docs.filter(~score(docs["text"])["is_toxic"])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
