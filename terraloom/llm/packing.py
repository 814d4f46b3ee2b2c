"""Operator 3: packing documents into fixed windows by best-fit decreasing.

A document of n tokens (white-space words) is first cut into n // window full
windows; the rest, 1 to window - 1 tokens, is an item. Items go, longest first,
each into the open window with the least room that still fits it.

Items of one length are alike, so the exact sequential result follows from the
histogram of lengths, of at most window - 1 entries whatever the corpus holds.
The planner walks it on the driver: windows of equal room form pools, and a
segment tree indexed by remaining capacity finds the tightest pool that fits.
The plan is a list of runs (length, first rank, ranks, windows, ...), bounded
by the window size too. Documents get their rank within their length by a
two-level count (per bucket, then within it) and look their window up.

``pack`` gives places, ``contents`` the windows with their text.

Edge cases: null or empty text has 0 tokens and gives no piece; null ids are
kept and count as documents of their own; repeated rows are packed each; ties
(equal lengths) go by doc_id, then text hash; a very long text fills windows of
its own and its rest is an item as any other; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terraloom.llm.common import read, shards, small, table
from terraloom.llm.tokens import chunks, word_bounds

WINDOW = 2048


class Tree:
    """Segment tree over capacities 0..size: which pools aren't empty."""

    def __init__(self, size: int):
        self.n = 1 << max(size, 1).bit_length()
        self.any = bytearray(2 * self.n)

    def set(self, at: int, full: bool) -> None:
        at += self.n
        self.any[at] = full
        at >>= 1
        while at:
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least `least` that has a window, or -1."""
        at = least + self.n
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.n:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.n
            at >>= 1
        return -1


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, items, first window, items per window, offset in the window) and the number of windows.

    Item k of a run, from 0, goes to window first + k // per, at offset + (k % per) * length.
    """
    pools: dict[int, list[tuple[int, int]]] = {}  # room: [(first window, windows)], the oldest first
    tree, runs, opened = Tree(window), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, n = window, -(-left // (window // length))
                spans = [(opened, n)]
                opened += n
            else:
                spans = pools.pop(room)
                tree.set(room, False)
            per, rest = room // length, []
            for first, n in spans:
                if not left:
                    rest.append((first, n))
                    continue
                used = min(n, left // per)
                if used:
                    runs.append((length, rank, used * per, first, per, window - room))
                    rank, left = rank + used * per, left - used * per
                    pools.setdefault(room - per * length, []).append((first, used))
                    tree.set(room - per * length, True)
                if used < n and left and left < per:
                    runs.append((length, rank, left, first + used, per, window - room))
                    pools.setdefault(room - left * length, []).append((first + used, 1))
                    tree.set(room - left * length, True)
                    rank, left, used = rank + left, 0, used + 1
                if used < n:
                    rest.append((first + used, n - used))
            if rest:
                pools[room] = rest + pools.get(room, [])
                tree.set(room, True)
    return runs, opened


def tokens(text: str = "text"):
    """White-space words of a text, as a column; null has none."""
    return F.when(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "", 0).otherwise(F.size(F.split(F.trim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), "[ \t\n\x0b\x0c\r]+")))


def pack(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, piece, start, length, window_id, offset: where each stretch of tokens of each document goes."""
    return _places(documents, window).drop("h")


def _places(documents: DataFrame, window: int) -> DataFrame:
    spark = documents.sparkSession
    buckets = shards(spark)
    sized = documents.select(F.col("doc_id").alias("d"), tokens().cast("int").alias("n"), F.xxhash64("text").alias("h")).filter("n > 0")
    sized = table(sized.withColumn("b", F.pmod(F.xxhash64("d", "h"), F.lit(buckets)).cast("int")).withColumn("r", F.col("n") % window), "packing-sizes")
    per_bucket = table(sized.groupBy("r", "b").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {window}")).alias("f")), "packing-counts")
    histogram = {row.r: row.k for row in per_bucket.filter("r > 0").groupBy("r").agg(F.sum("k").alias("k")).collect()}
    runs, opened = plan(histogram, window)
    # Ranks and full windows count on from bucket to bucket; both windows here run over at most window * buckets and buckets rows.
    offsets = per_bucket.select("r", "b", (F.sum("k").over(W.partitionBy("r").orderBy("b")) - F.col("k")).alias("o"))
    fulls = per_bucket.groupBy("b").agg(F.sum("f").alias("f")).select("b", (F.sum("f").over(W.orderBy("b")) - F.col("f") + opened).alias("w0"))
    order = ["d", "h"]
    ranked = sized.withColumn("k", F.row_number().over(W.partitionBy("b", "r").orderBy(*order)) - 1)
    ranked = ranked.withColumn("w", F.sum(F.expr(f"n div {window}")).over(W.partitionBy("b").orderBy("r", "k").rowsBetween(W.unboundedPreceding, -1)))
    ranked = ranked.join(small(fulls, buckets, 24), "b")  # one row per bucket
    full = ranked.filter(f"n >= {window}").select("d", "h", F.col("w0") + F.coalesce("w", F.lit(0)), F.explode(F.sequence(F.lit(0), F.expr(f"int(n div {window}) - 1"))).alias("piece"))
    full = full.toDF("doc_id", "h", "w", "piece").select("doc_id", "h", F.col("piece").cast("int").alias("piece"), (F.col("piece") * window).alias("start"), F.lit(window).alias("length"), (F.col("w") + F.col("piece")).alias("window_id"), F.lit(0).alias("offset"))
    lists = spark.createDataFrame([(n, [(a, m, w, p, o) for _, a, m, w, p, o in own]) for n, own in _by_length(runs).items()], "r int, runs array<struct<a: long, m: long, w: long, p: long, o: long>>")
    items = ranked.filter("r > 0").join(offsets, ["r", "b"]).withColumn("k", F.col("k") + F.col("o")).join(small(lists, len(runs), 64), "r")
    items = items.withColumn("u", F.expr("filter(runs, x -> k >= x.a and k < x.a + x.m)[0]")).withColumn("k", F.expr("k - u.a"))
    items = items.select(F.col("d").alias("doc_id"), "h", F.expr(f"int(n div {window})").alias("piece"), (F.col("n") - F.col("r")).alias("start"), F.col("r").alias("length"), F.expr("u.w + k div u.p").alias("window_id"), F.expr("int(u.o + (k % u.p) * r)").alias("offset"))
    return full.unionByName(items)


def _by_length(runs: list) -> dict[int, list]:
    out: dict[int, list] = {}
    for run in runs:
        out.setdefault(run[0], []).append(run)
    return out


def _pieces(text: pa.Array, places: pa.Array) -> pa.Array:
    """The words [start, start + length) of each place, single spaces between."""
    out = []
    for a, b, raw, off in chunks(text):
        starts, ends, first = word_bounds(raw, off)
        for i in range(b - a):
            own = []
            for place in places[a + i].as_py():
                lo = first[i] + place["start"]
                part = raw[starts[lo] : ends[lo + place["length"] - 1]].tobytes().decode()
                own.append({"window_id": place["window_id"], "offset": place["offset"], "length": place["length"], "text": " ".join(part.split())})
            out.append(own)
    return pa.array(out, pa.list_(pa.struct([("window_id", pa.int64()), ("offset", pa.int32()), ("length", pa.int32()), ("text", pa.string())])))


def contents(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """window_id, n_tokens, doc_ids and text of every window: its pieces in order, a line each, doc_ids beside them."""
    places = _places(documents, window).groupBy(F.col("doc_id").alias("d"), "h").agg(F.collect_list(F.struct("window_id", "offset", "start", "length")).alias("places"))
    # Rows with one id and text are alike, so one of them serves all their places.
    texts = documents.select(F.col("doc_id").alias("e"), F.xxhash64("text").alias("g"), "text").filter("text IS NOT NULL").groupBy("e", "g").agg(F.first("text").alias("text"))
    cut = F.arrow_udf(_pieces, "array<struct<window_id: long, offset: int, length: int, text: string>>").asNondeterministic()
    pieces = places.join(texts, F.expr("d <=> e AND h = g")).select("d", F.explode(cut("text", "places")).alias("p")).select("p.*", "d")
    own = pieces.groupBy("window_id").agg(F.sum("length").cast("int").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "d", "text"))).alias("parts"))
    return own.select("window_id", "n_tokens", F.transform("parts", lambda p: p["d"]).alias("doc_ids"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the windows that the texts fill, with doc_ids and text. Rows without words are in none; null ids stay null in doc_ids; an empty table gives no window."""
    return contents(docs)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
