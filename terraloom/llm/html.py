"""Operator 6: main text of web pages by a suffix array per host.

Markup is dropped (head, scripts, styles, comments, tags; entities decoded) and
the words of a host's pages are taken as one sequence. Its suffixes are ordered
by the fingerprint of their first ``MIN_WORDS`` words, so substrings as long
that occur on distinct pages of the host are neighbours; longer ones are runs of
them. Every word that such a substring covers, on whichever page, is boilerplate
and goes; the runs between are kept.

Pages are parsed once and go, compressed, to parts by host; the suffixes of a
host in one part are settled there. A host of more than ``SPLIT`` bytes has
several parts, and its array is sharded by content: each part ships its distinct
suffixes, sorted and packed, with the page of each, or a mark for those on
several pages; a shard merges these lists and answers each part with those of
its suffixes that two pages or more hold. Then the part cuts its pages.

Edge cases: null or empty html has empty text and 0 words; a page without a host
in its url (null, relative) is compared with no other page; rows with equal
page_id are one page; a null page_id is a page known by its url and html; pages
of fewer than MIN_WORDS words are kept whole; a very long page is read whole;
unclosed comments or scripts run to the end; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import read, shards, small, table
from terraloom.llm.packed import pack, unpack
from terraloom.llm.tokens import chunks, row_of, window_hashes, word_bounds, word_hashes

MIN_WORDS = 6
#: Parts per shuffle partition; bytes of a host's html in one part; suffixes of a task that are held before they are shipped; the mark for several pages.
FINE, SPLIT, HELD, MANY = 4, 16 << 20, 1 << 20, 0xFFFFFFFF
_U = np.uint64
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)|<[!/?a-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|<[!/?a-z][^>]*>", re.S | re.I)
_CODEC = pa.Codec("zstd", 3)
_KEYS = ("page_id", "host", "d", "salt", "split", "part")
_OUT = "page_id long, host string, text string, n_words int, n_removed int"


def visible_text(page: str | None) -> str:
    """The text of a page without markup, white space as it comes."""
    if not page:
        return ""
    text = _MARKUP.sub(" ", page)
    return (entities.unescape(text) if "&" in text else text).replace("\xa0", " ")


def _pages(pages: DataFrame) -> DataFrame:
    """page_id, host (null without), d: the page's identity, salt: the host's hash, html."""
    host = F.nullif(F.regexp_extract(F.lower("url"), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))
    known = F.coalesce(F.col("page_id").cast("long"), F.xxhash64("url", "html"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), known.alias("d"), F.when(host.isNull(), F.xxhash64(F.lit(1), known)).otherwise(F.xxhash64(host)).alias("salt"), "html")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [visible_text(x).encode() for x in batch["html"].to_pylist()]
        text = pa.array([len(r).to_bytes(4, "little") + _CODEC.compress(r, asbytes=True) for r in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([batch[c] for c in _KEYS] + [text], names=[*_KEYS, "text"])


def _texts(column) -> pa.Array:
    return pa.array([_CODEC.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True).decode() for x in column.to_pylist()], pa.large_string())


def _prints(text: pa.Array, salt: np.ndarray, n: int) -> Iterator[tuple]:
    """(first row, raw, offsets, starts, ends, first word of rows, window starts, their rows, salted fingerprints)."""
    for a, b, raw, off in chunks(text):
        starts, ends, first = word_bounds(raw, off)
        row = row_of(first)
        h = window_hashes(word_hashes(raw, starts, ends), n)
        at = np.flatnonzero(row[: len(h)] == row[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        yield a, raw, off, starts, ends, first, at, row[at], h[at] ^ salt[a:b][row[at]].view(_U)


def _shard(h: np.ndarray, parts: int) -> np.ndarray:
    """Shards are ranges of fingerprints."""
    return (((h >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def _pages_of(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct fingerprints in order, a page of each, whether there are several pages)."""
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(h)) - 1 if len(h) else first
    return h[first], d[first], d[first] != d[last]


def _ship(n: int, parts: int):
    """Per part and shard: the distinct suffixes of split hosts, the page of each as a place in a list of pages, or MANY."""

    def flush(part: int, held: list) -> pa.RecordBatch:
        h, d, many = _pages_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
        edge = np.searchsorted(_shard(h, parts), np.arange(parts + 1))
        out = []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            own = slice(edge[s], edge[s + 1])
            pages, place = np.unique(d[own], return_inverse=True)
            out.append((s, part, pack(np.diff(h[own], prepend=_U(0)), np.where(many[own], MANY, place).astype(np.uint32), pages)))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["shard", "part", "blob"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            batch = batch.filter(batch["split"])
            part, d = batch["part"].to_numpy(), batch["d"].to_numpy()
            for a, *_, row, h in _prints(_texts(batch["text"]), batch["salt"].to_numpy(), n):
                for p in np.unique(part[a:][row]).tolist():
                    own = part[a:][row] == p
                    held.setdefault(p, []).append((h[own], d[a:][row[own]]))
                size += len(h)
            if size >= HELD:
                for p in list(held):
                    yield flush(p, held.pop(p))
                size = 0
        for p, own in held.items():
            yield flush(p, own)

    return ship


def _settle(rows: pa.Table) -> pa.Table:
    """One shard: for each part the suffixes that two pages or more hold."""
    hs, ds, marks, owners = [], [], [], []
    for k, blob in enumerate(rows["blob"]):
        gap, place, pages = unpack(blob.as_py(), "<u8", "<u4", "<i8")
        many = place == MANY
        hs.append(np.cumsum(gap, dtype=_U))
        ds.append(pages[np.where(many, 0, place)])
        marks.append(many)
        owners.append(np.full(len(gap), k))
    h, d, many, owner = (np.concatenate(x) for x in (hs, ds, marks, owners))
    _, inv = np.unique(h, return_inverse=True)
    order = np.argsort(inv, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(inv[order]) > 0]))
    repeated = (np.minimum.reduceat(d[order], first) != np.maximum.reduceat(d[order], first)) | np.logical_or.reduceat(many[order], first)
    hit = repeated[inv]
    out = [(p, pack(h[hit & (owner == k)])) for k, p in enumerate(rows["part"].to_pylist())]
    return pa.table([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "blob"])


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _keep(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int, gone: np.ndarray) -> tuple[str, int]:
    """The words lo..hi that aren't gone, with single spaces between."""
    left = np.flatnonzero(~gone[lo:hi]) + lo
    if not len(left):
        return "", 0
    new = np.append(np.flatnonzero(np.diff(left, prepend=-9) > 1), len(left))
    parts = [raw[starts[left[i]] : ends[left[j - 1]]].tobytes().decode() for i, j in zip(new[:-1], new[1:], strict=True)]
    return " ".join(" ".join(parts).split()), len(left)


def _cover(at: np.ndarray, total: int, n: int) -> np.ndarray:
    """Words that windows of n words from `at` on cover."""
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(n: int):
    """One part: its pages without the words that repeated suffixes cover."""

    def cut(pages: pa.Table, answers: pa.Table) -> pa.Table:
        texts, salt, d, split = _texts(pages["text"]), pages["salt"].to_numpy(), pages["d"].to_numpy(), pages["split"].to_numpy()
        own = [(h[~split[a:][row]], d[a:][row[~split[a:][row]]]) for a, *_, row, h in _prints(texts, salt, n)]
        h, _, many = _pages_of(*(np.concatenate(x) for x in zip(*own, strict=True))) if own else (np.zeros(0, _U), None, np.zeros(0, bool))
        known = np.unique(np.concatenate([h[many], *(unpack(b.as_py(), "<u8")[0] for b in answers["blob"])]))
        text, left, size = [], [], []
        for _, raw, off, starts, ends, first, at, _, h in _prints(texts, salt, n):
            gone = _cover(at[_has(known, h)], len(starts), n)
            for i in range(len(off) - 1):
                t, k = _keep(raw, starts, ends, first[i], first[i + 1], gone)
                text.append(t)
                left.append(k)
                size.append(first[i + 1] - first[i] - k)
        return pa.table([pages["page_id"], pages["host"], pa.array(text, pa.string()), pa.array(left, pa.int32()), pa.array(size, pa.int32())], names=["page_id", "host", "text", "n_words", "n_removed"])

    return cut


def extract(pages: DataFrame, min_words: int = MIN_WORDS, split: int = SPLIT) -> DataFrame:
    """page_id, host, text, n_words kept and n_removed, for every page."""
    parts = shards(pages.sparkSession)
    own = _pages(pages)
    large = table(own.groupBy(F.col("salt").alias("__salt")).agg(F.sum(F.octet_length("html")).alias("bytes")).filter(F.col("bytes") > split).select("__salt", F.ceil(F.col("bytes") / split).alias("m")), "host-large")
    own = own.join(small(large, large.count(), 24), F.col("salt") == F.col("__salt"), "left")
    piece = F.coalesce(F.pmod(F.xxhash64(F.lit(3), "d", "html"), "m"), F.lit(0))
    own = own.select("page_id", "host", "d", "salt", F.col("m").isNotNull().alias("split"), F.pmod(F.xxhash64("salt", piece), F.lit(parts * FINE)).cast("int").alias("part"), "html")
    parsed = own.mapInArrow(_parse, "page_id long, host string, d long, salt long, split boolean, part int, text binary")
    # One exchange serves both the lists and the cut: the plan reuses it.
    texts = parsed.repartition(parts, "part")
    shipped = texts.mapInArrow(_ship(min_words, parts), "shard int, part int, blob binary")
    answers = shipped.groupBy("shard").applyInArrow(_settle, "part int, blob binary")
    return texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_cut(min_words), _OUT)


def op6_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
