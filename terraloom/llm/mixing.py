"""Operator 4: mixing sources to target weights by the cube method.

Every document of a source gets the same inclusion probability, chosen so that
the expected tokens of the sources stand in the target weights. With given
weights as much of the corpus as possible is kept. Without them a source weighs
its tokens to the power ``alpha``, and the share ``keep`` of all tokens is
expected: a source whose part would be more than it has is kept whole, and the
others share the rest by their weights, so that no small source scales down the
others. A share given with weights has the same effect on them.

The flight phase of the cube method moves these probabilities at random through
the null space of the balancing constraints (documents and tokens of the
source), so that both totals stay exact while probabilities turn 0 or 1. It
runs in blocks of about ``block`` documents of one source; each leaves at most
two undecided, which form the blocks of the next level, until one block per
source is left. Its last undecided documents, two at most, are settled in the
landing phase: among the decisions left the one that misses the totals least,
ties going to the lower doc_id.

Edge cases: a null source is a source of its own; null or empty texts count as
documents of 0 tokens; a source with no tokens at all keeps all its documents;
a source whose target weight is absent, null or not positive is left out;
repeated rows and ids are drawn each on its own; a very long text is one
document of many tokens; an empty table gives no rows.
Columns of the input other than doc_id, text and source are passed on as they
are by ``select_rows`` and ignored by ``mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import free, read, small, table
from terraloom.llm.packing import tokens

ALPHA, KEEP, BLOCK, SEED = 0.5, 0.75, 4096, 11
_UNITS = "s string, d long, u long, c long, n long, pi double, p double"


def flight(p: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: at most two differ from 0 and 1, and sum(p) and sum(p * n) are kept.

    Units stand for pi-weighted constraints: with equal pi in a source, balancing
    documents and tokens in Horvitz-Thompson form is balancing the plain sums.
    """
    p = p.copy()
    open_, draws, at, queue = [], rng.random(len(p)), 0, np.flatnonzero((p > 0) & (p < 1))
    eps, k = 1e-9, 0
    values, sizes = p.tolist(), n.tolist()
    queue = queue.tolist()
    while True:
        while len(open_) < 3 and at < len(queue):
            open_.append(queue[at])
            at += 1
        if len(open_) < 2:
            break
        a, b, *more = open_
        if more:
            c = more[0]
            # The null space of (1, 1, 1) and the tokens.
            v = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(v):
                v = (1.0, -1.0, 0.0)
        elif sizes[a] == sizes[b]:
            v = (1.0, -1.0)
        else:
            break
        up = min((1 - values[i]) / x if x > 0 else -values[i] / x for i, x in zip(open_, v, strict=True) if x)
        down = min(values[i] / x if x > 0 else (values[i] - 1) / x for i, x in zip(open_, v, strict=True) if x)
        step = up if draws[k % len(draws)] * (up + down) < down else -down
        k += 1
        still = []
        for i, x in zip(open_, v, strict=True):
            y = values[i] + step * x
            values[i] = 0.0 if y < eps else 1.0 if y > 1 - eps else y
            if 0 < values[i] < 1:
                still.append(i)
        open_ = still
    return np.asarray(values)


def land(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Decides the units left by the flight of a whole source: the closest totals of documents and tokens, by enumeration."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if not len(left):
        return p
    docs, size = p[left].sum(), (p[left] * n[left]).sum()
    scale = max(float(n[left].mean()), 1.0)
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(m >> j & 1 for j in range(len(left))) - docs) + abs(sum(int(n[left[j]]) for j in range(len(left)) if m >> j & 1) - size) / scale, m))
    p = p.copy()
    p[left] = [float(best >> j & 1) for j in range(len(left))]
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    # Longest first: what is left for the landing is short, so its totals miss little.
    pdf = pdf.sort_values(["n", "u", "d", "c"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    rng = np.random.Generator(np.random.PCG64([SEED, int(pdf["u"].iloc[0]) & 0x7FFFFFFF, len(pdf)]))
    pdf["p"] = flight(pdf["p"].to_numpy(), pdf["n"].to_numpy(), rng)
    return pdf[["s", "d", "u", "c", "n", "pi", "p"]]


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last level: one block per source, flown and landed."""
    pdf = _fly(pdf)
    pdf["p"] = land(pdf["p"].to_numpy(), pdf["n"].to_numpy())
    return pdf


def targets(sources: dict, weights: dict | None, alpha: float, keep: float | None = None) -> dict:
    """Inclusion probability by source, from {source: (documents, tokens)}: for the share keep of the tokens, or the largest that the weights allow."""
    given = {s: float(t) ** alpha for s, (_, t) in sources.items() if t} if weights is None else {s: float(w) for s, w in weights.items() if w and w > 0 and sources.get(s, (0, 0))[1]}
    out = {s: 1.0 for s, (_, t) in sources.items() if not t and (weights is None or (weights.get(s) or 0) > 0)}
    if given and keep is None and weights is not None:
        unit = min(sources[s][1] / w for s, w in given.items())
        out |= {s: min(1.0, unit * w / sources[s][1]) for s, w in given.items()}
    elif given:
        left, weight = (KEEP if keep is None else keep) * sum(sources[s][1] for s in given), sum(given.values())
        # Sources that run out first come first; what they lack goes to the others.
        for s in sorted(given, key=lambda s: sources[s][1] / given[s]):
            out[s] = min(1.0, max(left, 0.0) * given[s] / weight / sources[s][1])
            left, weight = left - out[s] * sources[s][1], weight - given[s]
    return out


def draw(documents: DataFrame, weights: dict | None = None, alpha: float = ALPHA, block: int = BLOCK, keep: float | None = None) -> DataFrame:
    """The documents drawn, as (s source, d doc_id, u hash of the row, c copy, n tokens, pi probability).

    Equal rows, by id and hash, are told apart by their copy number.
    """
    spark = documents.sparkSession
    units = documents.select(F.col("source").cast("string").alias("s"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.lit(SEED), "doc_id", "text", "source").alias("u"), tokens().cast("long").alias("n"))
    units = table(units.groupBy("s", "d", "u", "n").agg(F.count("*").alias("k")), "mixing-units")
    sources = {r.s: (r.docs, r.size) for r in units.groupBy("s").agg(F.sum("k").alias("docs"), F.sum(F.col("n") * F.col("k")).alias("size")).collect()}
    pi = targets(sources, weights, alpha, keep)
    if not pi:
        return units.limit(0).select("s", "d", "u", F.lit(0).cast("long").alias("c"), "n", F.lit(0.0).alias("pi"))
    # One row per source that is drawn from; sources are few, and the size is checked.
    blocks = {s: max(1, -(-sources[s][0] // block)) for s in pi}
    shares = small(spark.createDataFrame([(s, p, blocks[s]) for s, p in pi.items()], "s string, pi double, m long"), len(pi), 64)
    open_ = units.alias("a").join(shares.alias("b"), F.expr("a.s <=> b.s")).select("a.s", "a.d", "a.u", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"), "a.n", "b.pi", F.col("b.pi").alias("p"), "b.m")
    open_ = open_.select(F.col("s"), F.col("d"), F.col("u"), F.col("c").cast("long").alias("c"), "n", "pi", "p", F.expr("pmod(u, m)").alias("g"))
    done, most = [], max(blocks.values())
    while True:
        last = most == 1
        flown = open_.groupBy("s", "g").applyInPandas(_settle if last else _fly, _UNITS)
        flown = table(flown.filter("p > 0"), "mixing-flown")
        done.append(flown.filter("p = 1"))
        if last:
            break
        most = max(1, -(-2 * most // block))
        # Two are left of each block at most, so blocks shrink by block / 2 a level.
        open_ = flown.filter("p < 1").withColumn("g", F.pmod("u", F.lit(most)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("s", "d", "u", "c", "n", "pi")


def mix(documents: DataFrame, weights: dict | None = None, alpha: float = ALPHA, keep: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, inclusion for each document drawn."""
    return draw(documents, weights, alpha, keep=keep).select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("n").alias("n_tokens"), F.col("pi").alias("inclusion"))


def select_rows(documents: DataFrame, weights: dict | None = None, alpha: float = ALPHA, keep: float | None = None) -> DataFrame:
    """The rows drawn, with all their columns."""
    u, d, k, c, v, r = free(documents, "u", "d", "k", "c", "v", "r")
    drawn = draw(documents, weights, alpha, keep=keep).groupBy(F.col("u").alias(u), F.col("d").alias(d)).agg(F.count("*").alias(k), F.max("c").alias(c))
    drawn = table(drawn, "mixing-drawn")
    # Of equal rows only as many stay as were drawn; that takes a count within equal rows, where there are any at all.
    repeated = bool(drawn.filter((F.col(k) > 1) | (F.col(c) > 0)).limit(1).count())
    own = documents.withColumn(v, F.xxhash64(F.lit(SEED), "doc_id", "text", "source"))
    joined = own.join(small(drawn, drawn.count(), 40), (F.col(v) == F.col(u)) & F.col("doc_id").cast("long").eqNullSafe(F.col(d)))
    if repeated:
        joined = joined.withColumn(r, F.row_number().over(W.partitionBy(v, "doc_id").orderBy(v))).filter(F.col(r) <= F.col(k))
    return joined.select(*[F.col(f"`{name}`") for name in documents.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents drawn, columns as they are."""
    return select_rows(docs)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
