"""Operator 5: repeated passages by a logarithmic family of suffix arrays.

A passage is LENGTH words or more, byte for byte apart from white space, that
an earlier document (lower doc_id) holds too. The suffix starting at a word is
ordered by the fingerprint of its first LENGTH words, so suffixes that share as
much are neighbours. An index is a family of such suffix arrays: a new batch
gets its own, is merge-scanned against each level for matches, and levels of
like size are merged, so sizes grow geometrically and every suffix is moved a
logarithmic number of times.

The index is split into shards by content. Two windows of LENGTH words that are
equal share their anchor: the least K-word fingerprint inside, leftmost of
equals (winnowing). Anchors are about 5 % of the words. Only suffixes whose
anchor occurs in two documents or more reach the index, sharded by anchor, so
the restriction loses nothing and most text is never shuffled. Shards read
their suffixes in doc_id order as a stream of batches and hold one entry per
distinct suffix.

Edge cases: null or empty texts and texts under LENGTH words have no passages;
rows without doc_id are neither searched nor cut; rows with equal ids are one
document, and repeats within a document aren't passages; the lowest doc_id
keeps the passage; a very long text is searched whole; an empty table has none;
``cut_rows`` drops rows that lose all their words, passes other columns on,
whatever their names, and sets n_chars of cut rows to the new length where there
is such a column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import drop, free, read, shards, table
from terraloom.llm.tokens import chunks, row_of, window_hashes, word_bounds, word_hashes

LENGTH, K = 50, 13
_U = np.uint64
_INDEX_BITS = _U(28)


def anchors(words: np.ndarray, row: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows of `length` words inside one row, position of each one's anchor, K-word fingerprints).

    Fingerprints are ordered by their upper 36 bits, ties by position.
    """
    n = len(words) - length + 1
    h = window_hashes(words, k)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    low = (h >> _INDEX_BITS << _INDEX_BITS) | np.arange(len(h), dtype=_U)
    span, w = 1, length - k + 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[w - span : w - span + n])
    at = np.flatnonzero(row[:n] == row[length - 1 :])
    return at, (low[at] & ((_U(1) << _INDEX_BITS) - _U(1))).astype(np.int64), h


def _anchor_lists(length: int, k: int):
    def lists(text: pa.Array, salt: pa.Array) -> pa.Array:
        keys, places, sizes = [], [], []
        salts = np.asarray(salt.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(_U)
        for a, b, raw, off in chunks(text):
            starts, ends, first = word_bounds(raw, off)
            words, row = word_hashes(raw, starts, ends), row_of(first)
            _, anchor, h = anchors(words, row, length, k)
            at = np.unique(anchor)
            keys.append((h[at] ^ salts[a:b][row[at]]).view(np.int64))
            places.append((at - first[row[at]]).astype(np.int32))
            sizes.append(np.bincount(row[at], minlength=b - a))
        off = pa.array(np.concatenate([[0], *(np.cumsum(np.concatenate(sizes)),)] if sizes else [[0]]).astype(np.int32))
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
        return pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([cat(keys, np.int64), cat(places, np.int32)], names=["key", "at"]))

    return F.arrow_udf(lists, "array<struct<key: long, at: int>>").asNondeterministic()


def _suffix_lists(length: int, k: int):
    def lists(text: pa.Array, salt: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        salts = np.asarray(salt.fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64).view(_U)
        for a, b, raw, off in chunks(text):
            starts, ends, first = word_bounds(raw, off)
            words, row = word_hashes(raw, starts, ends), row_of(first)
            at, anchor, h = anchors(words, row, length, k)
            part = wanted.slice(a, b - a)
            places = np.concatenate([np.asarray(part[i].values, np.int64) + first[i] for i in range(b - a)]) if b > a else np.zeros(0, np.int64)
            mark = np.zeros(len(words) + 1, bool)
            mark[places] = True
            use = mark[anchor]
            at, anchor = at[use], anchor[use]
            full = window_hashes(words, length)[at] ^ salts[a:b][row[at]]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
            cut = np.append(np.flatnonzero(new), len(at))
            rows = [[] for _ in range(b - a)]
            keys = (h[anchor] ^ salts[a:b][row[at]]).view(np.int64)
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                r = row[at[lo]]
                rows[r].append({"key": int(keys[lo]), "start": int(at[lo] - first[r]), "prints": full[lo:hi].tobytes()})
            out += rows
        return pa.array(out, pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int32()), ("prints", pa.binary())])))

    return F.arrow_udf(lists, "array<struct<key: long, start: int, prints: binary>>").asNondeterministic()


class Index:
    """Levels of suffix arrays, each with the first document of every distinct suffix."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, prints: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Enters a batch, whose documents come in order and after those before, and gives the first document that holds each suffix."""
        order = np.argsort(prints, kind="stable")
        ordered = prints[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        suffixes, first = ordered[new], docs[order][new]
        known = np.zeros(len(suffixes), bool)
        for level, holders in self.levels:
            i = np.minimum(np.searchsorted(level, suffixes), len(level) - 1)
            hit = level[i] == suffixes
            first = np.where(hit, holders[i], first)
            known |= hit
        out = np.empty(len(prints), np.int64)
        out[order] = first[np.cumsum(new) - 1]
        level = (suffixes[~known], first[~known])
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = _merge(self.levels.pop(), level)
        if len(level[0]):
            self.levels.append(level)
        return out


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(a[0], b[0])
    return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])


def _scan(length: int):
    """Streams a shard's suffixes, in order of documents, through an index; gives the stretches that earlier documents hold."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        for batch in batches:
            doc, start = batch["d"].to_numpy(), batch["start"].to_numpy()
            lists = [np.frombuffer(x.as_buffer(), _U) for x in batch["prints"]]
            size = np.array([len(x) for x in lists], np.int64)
            if not size.sum():
                continue
            docs = np.repeat(doc, size)
            place = np.repeat(start.astype(np.int64) - (np.cumsum(size) - size), size) + np.arange(size.sum())
            owner = np.repeat(np.arange(len(size)), size)
            first = index.add(np.concatenate(lists), docs)
            hit = np.flatnonzero(first < docs)
            if not len(hit):
                continue
            new = np.ones(len(hit), bool)
            new[1:] = (owner[hit][1:] != owner[hit][:-1]) | (hit[1:] != hit[:-1] + 1)
            lo = hit[new]
            hi = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(docs[lo]), pa.array(place[lo].astype(np.int32)), pa.array((place[hi] + length).astype(np.int32)), pa.array(first[lo])], names=["d", "start", "end", "first"])

    return scan


def _join_spans(spans: pa.Array) -> pa.Array:
    """Sorted stretches, overlapping or touching ones made one; each keeps the first document of its first stretch."""
    out = []
    for own in spans.to_pylist():
        joined: list[dict] = []
        for s in sorted(own, key=lambda x: (x["start"], -x["end"], x["first"])):
            if joined and s["start"] <= joined[-1]["end"]:
                joined[-1]["end"] = max(joined[-1]["end"], s["end"])
            else:
                joined.append(s)
        out.append(joined)
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int64())])))


def candidates(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(d, salt, places) for the documents of docs (d, salt, text) with anchors that two documents or more have."""
    found = docs.select("d", "salt", F.explode(_anchor_lists(length, k)("text", "salt")).alias("x")).select("d", "salt", "x.key", "x.at")
    found = table(found, "suffix-anchors")
    shared = found.groupBy("key").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).filter("lo < hi").select("key")
    places = table(found.join(shared, "key").groupBy("d", "salt").agg(F.collect_set("at").alias("places")), "suffix-places")
    drop(found)
    return places


def suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(d, key, start, prints): the suffixes of shared anchors; prints are the fingerprints of consecutive windows from start on."""
    both = docs.join(candidates(docs, length, k), ["d", "salt"])
    return both.select("d", F.explode(_suffix_lists(length, k)("text", "salt", "places")).alias("x")).select("d", "x.*")


def repeats(documents: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(d, spans): for each document with repeated passages, its stretches [start, end) of words and the first document that holds them."""
    docs = documents.select(F.col("doc_id").cast("long").alias("d"), F.lit(0).cast("long").alias("salt"), "text").filter("d IS NOT NULL AND text IS NOT NULL")
    found = suffixes(docs, length, k)
    sharded = found.repartition(shards(documents.sparkSession), "key").sortWithinPartitions("d", "start").select("d", "start", "prints")
    spans = sharded.mapInArrow(_scan(length), "d long, start int, end int, first long")
    spans = spans.groupBy("d").agg(F.collect_list(F.struct("start", "end", "first")).alias("spans"))
    joined = F.arrow_udf(_join_spans, "array<struct<start: int, end: int, first: long>>").asNondeterministic()
    return table(spans.select("d", joined("spans").alias("spans")), "suffix-spans")


def passages(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start and length in words, first_doc_id: each stretch of a document that earlier documents hold."""
    return repeats(documents, length).select("d", F.explode("spans").alias("s")).select(F.col("d").alias("doc_id"), "s.start", (F.col("s.end") - F.col("s.start")).alias("length"), F.col("s.first").alias("first_doc_id"))


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words of their spans; null where no word is left."""
    out = []
    for a, b, raw, off in chunks(text):
        starts, ends, first = word_bounds(raw, off)
        for i in range(b - a):
            own, lo, hi = spans[a + i], first[i], first[i + 1]
            if own.values is None:
                out.append(raw[off[i] : off[i + 1]].tobytes().decode())
                continue
            keep, at, left = [], off[i], hi - lo
            for s in own.as_py():
                keep.append(raw[at : starts[lo + s["start"]]].tobytes())
                at = starts[lo + s["end"]] if lo + s["end"] < hi else off[i + 1]
                left -= s["end"] - s["start"]
            keep.append(raw[at : off[i + 1]].tobytes())
            out.append(b"".join(keep).decode() if left else None)
    return pa.array(out, pa.string())


def cut_rows(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of documents with their repeated passages cut out."""
    d, s, t = free(documents, "d", "s", "t")
    spans = repeats(documents, length).toDF(d, s)
    both = documents.join(spans, F.col("doc_id").cast("long") == F.col(d), "left").drop(d)
    hit = F.col(s).isNotNull()
    cut = F.arrow_udf(_cut, "string").asNondeterministic()("text", s)
    both = both.withColumn(t, cut).filter(~hit | F.col(t).isNotNull())
    new = {"text": F.when(hit, F.col(t)).otherwise(F.col("text"))}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(hit, F.length(t).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.withColumns(new).select(*[F.col(f"`{c}`") for c in documents.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without passages that earlier ones hold, other columns as they are."""
    return cut_rows(docs)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))
