"""Operator 8: near duplicates by order MinHash, verified by banded alignment.

A document is its sequence of white-space words, ASCII letters in lower case.
Its k-mers (``K`` words) carry their occurrence number, so repeats count. Each
of ``SKETCHES`` hash functions picks the ``PICKED`` least k-mers, which are kept
in text order: two documents agree in a sketch if they hold the same k-mers in
the same order, which follows edit similarity. Texts of ``MIDDLE`` words get as
many sketches again, since the share of k-mers that edits leave varies more
there. Texts of up to ``SHORT`` words, where one edit touches most k-mers, get
``SHORT_SKETCHES`` more, of ``SHORT_PICKED`` single words.

Documents with equal words are one node. Nodes that agree in a sketch share a
bucket. Verification is complete but avoids what it can: first each node
against the bucket leader it meets in most sketches; after the components of
those pairs, all remaining pairs of a bucket across components. For these the
words of a bucket's members come together once, not once per pair, and pairs
are ruled out by length and by counts of common words before they are aligned;
neither test loses a pair. A bucket of more than ``BLOCK`` members, as a passage
shared by many documents makes, is worked off by pairs of blocks. A pair counts
if 1 - edit distance / longer length is at least ``SIMILAR``, by alignment of
words in a band of the edits allowed. Groups are the connected components.

Edge cases: null and empty texts hold no words and are in no group; rows with a
null doc_id are in no group and stay; repeated rows (equal ids and words) count
as one document, of which ``keep_one`` keeps one row, by the least hash; rows of
one id with different words are judged each by its own words; ties go to the
lower doc_id, which represents its group; texts shorter than K words match equal
ones and, by their single words, similar ones; very long texts are sketched and
aligned whole; an empty table gives no groups; other columns are passed on,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraloom.llm.align import similar
from terraloom.llm.common import drop, free, read, shards, small, table
from terraloom.operators.graph import components
from terraloom.llm.tokens import chunks, mix, row_of, window_hashes, word_bounds, word_hashes

K, PICKED, SKETCHES, SHORT, SHORT_SKETCHES, SHORT_PICKED, SIMILAR, BLOCK = 3, 2, 80, 24, 32, 3, 0.7, 2048
#: From SIMILAR * SHORT words on, so that both texts of a pair have the same kinds of sketches.
MIDDLE = (17, 100)
_U, _MAX = np.uint64, np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = np.random.Generator(np.random.PCG64(8)).integers(1, 1 << 62, (2 * SKETCHES, 2), dtype=np.int64).astype(_U) * _U(2) + _U(1)
_SKETCH = T.StructType([T.StructField("v", T.LongType()), T.StructField("w", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("s", T.ArrayType(T.LongType()))])


def labelled(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """h with the number of its occurrence in the row mixed in, occurrences counted in text order."""
    if not len(h):
        return h
    key = h ^ mix(row.astype(_U) + _U(1))
    order = np.argsort(key)
    sorted_ = key[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.flatnonzero(np.diff(np.append(first, len(h)))[run] > 1)
    number = np.zeros(len(h), _U)
    again = np.sort(run[many].astype(np.int64) * len(h) + order[many])  # equal keys in text order
    number[again % len(h)] = (many - first[run[many]]).astype(_U)
    return mix(h + number * _U(0x9E3779B97F4A7C15))


def order_minhash(h: np.ndarray, row: np.ndarray, picked: int, out: np.ndarray, seed: int = 0) -> None:
    """Sketches of the k-mers h (occurrences labelled) of consecutive rows, written to out (a row each, a column per sketch)."""
    if not len(h):
        return
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(first, len(h)))
    owner = np.repeat(np.arange(len(first)), size)
    for j in range(out.shape[1]):
        a, b = _SEEDS[(j + seed) % len(_SEEDS)]
        x = (h ^ a) * b
        x ^= x >> _U(31)
        places = []
        for k in range(picked):
            least = np.minimum.reduceat(x, first)
            at = np.flatnonzero(x == least[owner])
            at = at[np.searchsorted(at, first)]  # the first, should two be equal
            places.append(at)
            if k < picked - 1:
                x[at] = _MAX
        value = np.full(len(first), _U(j + seed))
        for at in np.sort(np.stack(places), axis=0):
            value = mix(value * _U(0x9E3779B97F4A7C15) + h[at])
        out[row[first], j] = value.view(np.int64)


def _fingerprint(h: np.ndarray, row: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A fingerprint of each row's sequence of words."""
    inside = np.arange(len(h), dtype=_U) - first[:-1][row].astype(_U)
    c = np.zeros(len(h) + 1, _U)
    np.cumsum(mix(h + (inside + _U(1)) * _U(0xD6E8FEB86659FD93 * seed & 0xFFFFFFFFFFFFFFFF)), out=c[1:])
    return mix(c[first[1:]] - c[first[:-1]] + np.diff(first).astype(_U)).view(np.int64)


def sketch(text: pa.Array) -> pa.Array:
    """Per text: two fingerprints of its words (null without words), their number, its sketches."""
    vs, ws, ns, lists, sizes = [], [], [], [], []
    for a, b, raw, off in chunks(text):
        n = b - a
        starts, ends, first = word_bounds(raw, off)
        h, row, count = word_hashes(raw, starts, ends, lower=True), row_of(first), np.diff(first)
        for seed, whole in ((3, vs), (5, ws)):
            whole.append(_fingerprint(h, row, first, seed))
        ns.append(count)
        kmers = window_hashes(h, K)
        ok = row[: len(kmers)] == row[K - 1 :] if len(kmers) else np.zeros(0, bool)
        sk = np.zeros((n, 2 * SKETCHES + SHORT_SKETCHES), np.int64)
        r = row[: len(kmers)][ok]
        order_minhash(labelled(kmers[ok], r), r, PICKED, sk[:, :SKETCHES])
        middle = (count >= MIDDLE[0]) & (count <= MIDDLE[1])
        more = ok & middle[row[: len(kmers)]]
        r = row[: len(kmers)][more]
        order_minhash(labelled(kmers[more], r), r, PICKED, sk[:, SKETCHES : 2 * SKETCHES], SKETCHES)
        short = count[row] <= SHORT
        order_minhash(labelled(h[short], row[short]), row[short], SHORT_PICKED, sk[:, 2 * SKETCHES :], 2 * SKETCHES)
        use = np.repeat(np.stack([count >= K, middle, (count <= SHORT) & (count > 0)], axis=1), [SKETCHES, SKETCHES, SHORT_SKETCHES], axis=1)
        lists.append(sk[use])
        sizes.append(use.sum(axis=1))
    if not vs:
        return pa.array([], pa.struct([("v", pa.int64()), ("w", pa.int64()), ("n", pa.int32()), ("s", pa.list_(pa.int64()))]))
    n = np.concatenate(ns).astype(np.int32)
    s = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)), pa.array(np.concatenate(lists)))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(vs), mask=n == 0), pa.array(np.concatenate(ws)), pa.array(n), s], names=["v", "w", "n", "s"])


def word_codes(text: pa.Array) -> pa.Array:
    """Per text, its words as four bytes each."""
    out = []
    for _, _, raw, off in chunks(text):
        starts, ends, first = word_bounds(raw, off)
        codes = (word_hashes(raw, starts, ends, lower=True) >> _U(32)).astype(np.uint32)
        out += [codes[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
    return pa.array(out, pa.binary())


def _verify(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similar(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), SIMILAR) for x, y in zip(a, b, strict=True)], pa.float64())


def _verified(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose words align well enough."""
    left, right = codes.toDF("a", "ca"), codes.toDF("b", "cb")
    s = F.arrow_udf(_verify, "double").asNondeterministic()("ca", "cb")
    return table(pairs.join(left, "a").join(right, "b").select("a", "b", s.alias("similarity")).filter(f"similarity >= {SIMILAR}").select("a", "b"), "near-edges")


def _bags(codes: list[np.ndarray], width: int) -> np.ndarray:
    """Word counts of each text in `width` cells: what two texts have in common here is at least what they have in words."""
    size = np.array([len(c) for c in codes])
    cell = (np.concatenate(codes).astype(_U) * _U(0x9E3779B97F4A7C15) >> _U(40)).astype(np.int64) % width
    return np.bincount(np.repeat(np.arange(len(codes)), size) * width + cell, minlength=len(codes) * width).reshape(len(codes), width).astype(np.int32)


def pairs_of(v: np.ndarray, n: np.ndarray, label: np.ndarray, codes: list[np.ndarray], block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (a, b) among texts of a bucket, enough to join every two similar ones whose labels differ; with block, only across its two values."""
    order = np.lexsort((v, n))
    v, n, codes = v[order], n[order], [codes[i] for i in order.tolist()]
    block = block[order] if block is not None else None
    _, number = np.unique(label[order], return_inverse=True)
    bags = _bags(codes, 256 if n[-1] <= 1000 else 1024) if len(v) > 8 else None
    edges = []
    for x in range(len(v) - 1):
        hi = int(np.searchsorted(n, n[x] / SIMILAR + 1e-6, "right"))
        rest = np.arange(x + 1, hi)
        rest = rest[number[rest] != number[x]]
        if block is not None:
            rest = rest[block[rest] != block[x]]
        if bags is not None and len(rest):
            rest = rest[np.minimum(bags[rest], bags[x]).sum(axis=1) >= n[rest] - np.floor((1 - SIMILAR) * n[rest] + 1e-9)]
        for y in rest.tolist():
            if number[x] != number[y] and similar(codes[x], codes[y], SIMILAR) >= SIMILAR:
                edges.append((min(int(v[x]), int(v[y])), max(int(v[x]), int(v[y]))))
                number[number == number[y]] = number[x]
    return edges


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets of a partition, whose rows come bucket by bucket."""
    held: list[pa.RecordBatch] = []

    def work(rows: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(rows)
        codes = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["w"]]
        block = t["k"].to_numpy() if t["lo"][0].as_py() != t["hi"][0].as_py() else None
        return pairs_of(t["v"].to_numpy(), t["n"].to_numpy(), t["c"].to_numpy(), codes, block)

    def made(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    last = None
    for batch in batches:
        key = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("i", "lo", "hi")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        edges = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if lo == hi:
                continue
            now = tuple(key[:, lo].tolist())
            if held and now != last:
                edges += work(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
        yield made(edges)
    if held:
        yield made(work(held))


def nodes_of(documents: DataFrame) -> DataFrame:
    """(d, v, w, n, s): doc_id, two fingerprints of the words, their number and the sketches, for rows with an id and words."""
    ids = documents.select(F.col("doc_id").cast("long").alias("d"), F.arrow_udf(sketch, _SKETCH).asNondeterministic()("text").alias("k"))
    return ids.filter("d IS NOT NULL AND k.v IS NOT NULL").select("d", "k.*")


def labelled_rows(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, v, w, n) of the documents, and the group label c of each (v, w, n)."""
    docs = table(nodes_of(documents), "near-sketches")
    nodes = table(docs.groupBy("v", "w", "n").agg(F.min("d").alias("d"), F.min_by("s", "d").alias("s")), "near-nodes")
    sketched, docs = docs, table(docs.select("d", "v", "w", "n").distinct(), "near-documents")
    drop(sketched)
    rows = nodes.select("v", F.explode("s").alias("k")).groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("vs")).filter("size(vs) > 1")
    # Buckets of the same members are one; i names it.
    buckets = table(rows.groupBy("vs").agg(F.count("*").alias("votes")).withColumn("i", F.monotonically_increasing_id()), "near-buckets")
    # Each node against the leader that it meets most often.
    met = buckets.select(F.col("vs")[0].alias("a"), F.explode(F.expr("slice(vs, 2, size(vs) - 1)")).alias("b"), "votes").groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    first = table(met.groupBy("b").agg(F.max_by("a", F.struct("votes", -F.col("a"))).alias("a")).select("a", "b"), "near-pairs")
    members = table(buckets.select(F.explode("vs").alias("v")).distinct(), "near-members")
    wanted = small(nodes.join(members, "v", "left_semi").select("v", "d"), members.count(), 16)
    own = F.arrow_udf(sketch_id, "long").asNondeterministic()("text")
    codes = documents.select(F.col("doc_id").cast("long").alias("d"), "text").join(wanted, "d").select("v", own.alias("o"), F.arrow_udf(word_codes, "binary").asNondeterministic()("text").alias("c")).filter("v = o")
    codes = table(codes.select("v", "c"), "near-codes")
    edges = _verified(first, codes)
    labels = components(edges)
    # Then all pairs of a bucket that are in different components still.
    marked = buckets.select("i", F.explode("vs").alias("v")).join(labels, "v", "left").select("i", "v", F.coalesce("c", "v").alias("c"))
    unlike = marked.groupBy("i").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).filter("lo < hi").select("i", F.ceil(F.col("m") / BLOCK).cast("int").alias("g"))
    held = marked.join(unlike, "i").withColumn("k", F.pmod(F.xxhash64("v"), "g").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    held = held.select("i", F.least("k", "o").alias("lo"), F.greatest("k", "o").alias("hi"), "k", "v", "c").join(codes.select("v", F.expr("length(c) div 4").alias("n"), F.col("c").alias("w")), "v")
    more = held.repartition(shards(documents.sparkSession), "i", "lo", "hi").sortWithinPartitions("i", "lo", "hi").select("i", "lo", "hi", "k", "v", "n", "c", "w").mapInArrow(_within, "a long, b long")
    edges_ = edges.unionByName(table(more.distinct(), "near-edges"))
    labels = table(components(edges_).join(nodes.select("v", "w", "n"), "v", "right").select("v", "w", "n", F.coalesce("c", "v").alias("c")), "near-labels")
    drop(nodes, buckets, first, members, codes)
    return docs, labels


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, group_id (least doc_id of the group), group_size, for the documents of groups of two or more."""
    docs, labels = labelled_rows(documents)
    grouped = docs.join(labels, ["v", "w", "n"]).groupBy("c").agg(F.collect_set("d").alias("ds")).filter("size(ds) > 1")
    return grouped.select(F.explode("ds").alias("doc_id"), F.array_min("ds").alias("group_id"), F.size("ds").alias("group_size"))


def sketch_id(text: pa.Array) -> pa.Array:
    """The first fingerprint alone."""
    out = []
    for _, _, raw, off in chunks(text):
        starts, ends, first = word_bounds(raw, off)
        out.append(_fingerprint(word_hashes(raw, starts, ends, lower=True), row_of(first), first, 3))
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of documents without all but one of each group: the row with the least (doc_id, fingerprints of its words, hash of its text)."""
    docs, labels = labelled_rows(documents)
    d, v, o, r = free(documents, "d", "v", "o", "r")
    best = F.min(F.struct("d", "v", "w", "n"))
    whole = docs.join(labels, ["v", "w", "n"])
    kept = whole.groupBy("c").agg(best.alias("k"), F.count("*").alias("m")).filter("m > 1")
    gone = table(whole.join(kept, "c").filter("d <> k.d OR v <> k.v OR w <> k.w OR n <> k.n").select(F.col("d").alias(d), F.col("v").alias(v)), "near-gone")
    # Rows of ids that come once need no look at their words.
    often = table(documents.groupBy(F.col("doc_id").cast("long").alias(d)).agg(F.count("*").alias("n")).filter((F.col("n") > 1) & F.col(d).isNotNull()).select(d), "near-repeated")
    n, repeated = gone.count(), often.count()
    id_ = F.col("doc_id").cast("long") == F.col(d)
    if not repeated:
        return documents.join(small(gone.select(d), n, 16), id_, "left_anti")
    often = small(often, repeated, 16)
    once = documents.join(often, id_, "left_anti").join(small(gone.select(d).distinct(), n, 16), id_, "left_anti")
    own = F.arrow_udf(sketch_id, "long").asNondeterministic()
    twice = documents.join(often, id_, "left_semi").withColumn(o, own("text"))
    twice = twice.join(gone, id_ & (F.col(o) == F.col(v)), "left_anti")
    # Of rows with one id and equal words, or without any, one stays.
    twice = twice.withColumn(r, F.row_number().over(W.partitionBy("doc_id", o).orderBy(F.xxhash64("text")))).filter(F.col(r) == 1).drop(r, o)
    return once.unionByName(twice)


def deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, columns as they are."""
    return keep_one(docs)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
