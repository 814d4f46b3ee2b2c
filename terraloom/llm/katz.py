"""Operator 2: language-model scores by Katz backoff, of order three over the whole vocabulary.

Every word, bigram and trigram of the corpus is counted; each document is framed
by boundaries. N-grams that occur ``least`` times or more count as seen, with
Good-Turing discounts d; the mass that this frees goes to the unseen words of
the history in proportion to the next lower order:

    P3(w | u v) = d3(c) c(u v w) / c(u v)   if seen,   else alpha(u v) P2(w | v)
    P2(w | v)   = d2(c) c(v w) / c(v)       if seen,   else alpha(v) P1(w)
    P1(w)       = c(w) / (tokens + 1), one count being kept for the unknown word

with alpha(h) = (1 - seen mass of h) / (1 - lower mass of the seen words), so
that the probabilities of every history sum to one. Counts above ``LARGE`` aren't
discounted; a history that has no others keeps one count for other words.

Documents are scored by the model that they are counted in. An n-gram seen once
is the document's own there, so ``least`` is 2: with 1 any junk would predict
itself. With 1, for other texts than the corpus, counts of one are discounted
like others.

All n-grams that end in (v, w) live in the shard of v, so counts, weights and
the recursion of a token need one shard only. Words counted more than ``spread``
times have several shards, by u; their bigrams are counted in shards of their
own, and seen ones are copied to the shards of v. What travels is a sorted list
of (v, w, u) per task and shard, packed; words among the ``HOT`` most frequent
travel as numbers of 20 bits, others as 63-bit fingerprints, which changes no
result. Log P1 of a word beyond those is added in the word's own shard.

The model is a table of packed seen n-grams and backoff weights by shard, and a
table of words.

Edge cases: null and empty texts have no words; their score is that of the
boundary following itself. Repeated rows and ids are scored each on its own and
count each; null ids are kept; an empty table gives no rows; a very long text is
counted and scored whole, its n-grams cut into several lists; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import drop, read, shards, table
from terraloom.llm.packed import pack, unpack
from terraloom.llm.tokens import chunks, mix, word_bounds, word_hashes

LEAST, LARGE, HOT, SPREAD = 2, 5, (1 << 20) - 1, 1 << 20
#: Shards per shuffle partition; a worker holds one at a time.
FINE = 2
#: Tokens of a task that are held before they are shipped, and the most in one list: word numbers within a list take 21 bits.
HELD, LIST = 3 << 18, 1 << 21
#: Tokens of a shard that are looked up at once, lists being short where shards are many.
ASKED = 1 << 18
_U = np.uint64
_RARE = _U(1) << _U(63)
_GOLD = _U(0x9E3779B97F4A7C15)
#: The fingerprint that stands for the boundary.
BOUNDARY = _U(0x5BF03635A9D1E1C7) | _RARE
_TINY = 1e-300


# --- Packing ----------------------------------------------------------------------------------------------


def split(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as numbers of up to 20 bits, HOT for an escape, and the escaped fingerprints."""
    rare = codes >= _RARE
    return np.where(rare, _U(HOT), codes).astype(np.uint32), codes[rare]


def valued(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as an index into their distinct values."""
    values, i = np.unique(x, return_inverse=True)
    return values, i.astype(np.uint32)


def joined(small: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = small.astype(_U)
    out[small == HOT] = rare
    return out


def key2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _GOLD + mix(b + _U(1)))


def shard_of(code: np.ndarray, parts: int) -> np.ndarray:
    return (((mix(code + _U(7)) >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def _runs(new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs that begin where new is set."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n)).astype(np.uint32)


# --- Words ------------------------------------------------------------------------------------------------


@dataclass
class Words:
    """The most frequent words, by ascending fingerprint: counts, and over how many shards each is spread (0: one, by word alone)."""

    prints: np.ndarray
    counts: np.ndarray
    spread: np.ndarray
    every: float

    def codes(self, prints: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
        return np.where(self.prints[i] == prints, i.astype(_U), prints)

    def print_of(self, codes: np.ndarray) -> np.ndarray:
        hot = codes < _RARE
        return np.where(hot, self.prints[np.where(hot, codes, 0).astype(np.int64)], codes)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Log P1 of frequent words, 0 for others."""
        hot = codes < _RARE
        return np.where(hot, np.log(self.counts[np.where(hot, codes, 0).astype(np.int64)] / self.every), 0.0)

    def spread_of(self, codes: np.ndarray) -> np.ndarray:
        hot = codes < _RARE
        return np.where(hot, self.spread[np.where(hot, codes, 0).astype(np.int64)], 0)


def framed(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words of each row, fingerprints with two boundaries before and one after each row, places of the tokens among them)."""
    for a, b, raw, off in chunks(text):
        starts, ends, first = word_bounds(raw, off)
        h, n, rows = word_hashes(raw, starts, ends, lower=True) | _RARE, np.diff(first), np.arange(b - a)
        seq, token = np.full(len(h) + 3 * (b - a), BOUNDARY), np.ones(len(h) + 3 * (b - a), bool)
        seq[2 + np.arange(len(h)) + 3 * np.repeat(rows, n)] = h
        begin = first[:-1] + 3 * rows
        token[begin] = token[begin + 1] = False
        yield a, n, seq, np.flatnonzero(token)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for _, _, seq, at in framed(batch["text"]):
            held.append(seq[at])
            size += len(at)
            if size >= HELD:
                yield _counted(held)
                held, size = [], 0
    if held:
        yield _counted(held)


def _counted(held: list) -> pa.RecordBatch:
    u, c = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])


# --- What tasks ship ----------------------------------------------------------------------------------------

_SHIPPED = "shard int, kind int, t long, ids array<long>, a binary, b binary"
TOKENS, PAIRS, RARE = 0, 1, 2
_TOKEN_KINDS = ("<u4", "<u8", "<u4", "<u4", "<u8", "<u4", "<u4", "<u8", "<u4", "<u4")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["shard", "kind", "t", "ids", "a", "b"])


def _by_shard(shard: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by shard that keeps order inside, and (shard, from, to) in it."""
    order = np.argsort(shard.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
    edge = np.searchsorted(shard[order], np.arange(parts + 1))
    return order, [(int(s), int(edge[s]), int(edge[s + 1])) for s in np.flatnonzero(np.diff(edge))]


def _escaped(codes: np.ndarray, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """split() of the stretches of codes between cuts."""
    small, rare = split(codes)
    at = np.searchsorted(np.flatnonzero(small == HOT), cuts).tolist()
    cuts = cuts.tolist()
    return [(small[i:j], rare[k:m]) for i, j, k, m in zip(cuts[:-1], cuts[1:], at[:-1], at[1:], strict=True)]


def _lists(words: Words, parts: int, t: int, seq: np.ndarray, at: np.ndarray, doc: np.ndarray | None) -> list[tuple]:
    """Rows of one list of tokens: (v, w, u) by shard, with documents if there are any, then also the words that aren't frequent; else the bigrams of spread words."""
    lo = int(at[0]) - 2
    own, number = np.unique(seq[lo : int(at[-1]) + 1], return_inverse=True)
    number, code, at = number.astype(np.int32), words.codes(own), at - lo
    rows = []
    if doc is not None:
        rare = np.flatnonzero((code >= _RARE)[number[at]])
        rare = rare[np.argsort(number[at[rare]])]  # numbers follow fingerprints
        w, owner = code[number[at[rare]]], doc[rare].astype(np.uint32)
        order, cuts = _by_shard(shard_of(w, parts), parts)
        w, owner = w[order], owner[order]
        rows += [(s, RARE, t, None, pack(np.diff(w[i:j], prepend=_U(0)), owner[i:j]), None) for s, i, j in cuts]
    base, many = shard_of(code, parts), words.spread_of(code)
    v, u = number[at - 1], number[at - 2]
    key = v.astype(_U) << _U(42) | number[at].astype(_U) << _U(21) | u.astype(_U)
    if doc is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, doc = key[order], doc[order]
    mask = _U((1 << 21) - 1)
    v, w, u = ((key >> _U(s) & mask).astype(np.int32) for s in (42, 21, 0))
    shard = base[v]
    if many.any():
        m = many[v]
        shard = np.where(m > 0, (shard + (mix(code[u]) % np.maximum(m, 1).astype(_U)).astype(np.int64)) % parts, shard)
        if doc is None and m.any():
            pair = key[m > 0] >> _U(21)
            first, n = _runs(np.diff(pair, prepend=~pair[:1]) != 0, len(pair))
            pv, pw = code[(pair[first] >> _U(21)).astype(np.int64)], code[(pair[first] & mask).astype(np.int64)]
            order, cuts = _by_shard(shard_of(key2(pv, pw), parts), parts)
            pv, pw, n = pv[order], pw[order], n[order]
            rows += [(s, PAIRS, t, None, pack(*split(pv[i:j]), *split(pw[i:j]), n[i:j]), None) for s, i, j in cuts]
    order, cuts = _by_shard(shard, parts)
    key, v, w, u = key[order], v[order], w[order], u[order]
    doc = doc[order].astype(np.uint32) if doc is not None else np.zeros(0, np.uint32)
    # Runs of equal (u, v, w), (v, w) and v over all shards at once; a shard begins runs of its own.
    edge = np.array([i for _, i, _ in cuts] + [len(key)])
    change = np.append(~_U(0), key[1:] ^ key[:-1])  # bits in which neighbours differ
    change[edge[:-1]] = ~_U(0)
    fu, nu = _runs(change != 0, len(key))
    fw, _ = _runs(change >> _U(21) != 0, len(key))
    fv, _ = _runs(change >> _U(42) != 0, len(key))
    nw = np.diff(np.append(np.searchsorted(fu, fw), len(fu))).astype(np.uint32)
    nv = np.diff(np.append(np.searchsorted(fw, fv), len(fw))).astype(np.uint32)
    eu, ew, ev = (np.searchsorted(f, edge) for f in (fu, fw, fv))
    us, ws, vs = (_escaped(code[x[f]], e) for x, f, e in ((u, fu, eu), (w, fw, ew), (v, fv, ev)))
    eu, ew, ev = eu.tolist(), ew.tolist(), ev.tolist()
    for k, (s, i, j) in enumerate(cuts):
        rows.append((s, TOKENS, t, None, pack(*vs[k], nv[ev[k] : ev[k + 1]], *ws[k], nw[ew[k] : ew[k + 1]], *us[k], nu[eu[k] : eu[k + 1]], doc[i:j]), None))
    return rows


def _by_bigram(blob: bytes) -> tuple[np.ndarray, ...]:
    """(v and w of each bigram, its number of trigrams, u and occurrences of each trigram, documents by occurrence) of a packed list."""
    vs, vx, nv, ws, wx, nw, us, ux, nu, doc = unpack(blob, *_TOKEN_KINDS)
    return np.repeat(joined(vs, vx), nv), joined(ws, wx), nw, joined(us, ux), nu, doc


def _tokens(blob: bytes) -> tuple[np.ndarray, ...]:
    """(v, w, u, occurrences, documents) of a packed list, documents by occurrence."""
    v, w, n, u, nu, doc = _by_bigram(blob)
    return np.repeat(v, n), np.repeat(w, n), u, nu, doc


def _ship(known, parts: int, scored: bool):
    """Per task: the lists of its tokens; with `scored` also its documents (shard under 0) and its words that aren't frequent."""

    def flush(t: int, ids: list, n: list, seqs: list, ats: list) -> Iterator[pa.RecordBatch]:
        words = known.value
        shift = np.cumsum([0, *(len(s) for s in seqs[:-1])])
        seq, at = np.concatenate(seqs), np.concatenate([a + s for a, s in zip(ats, shift, strict=True)])
        doc = np.repeat(np.arange(len(n)), np.asarray(n) + 1) if scored else None
        rows = [(-1 - (t + (t >> 32)) % parts, RARE, t, ids, np.asarray(n, "<i8").tobytes(), None)] if scored else []
        for i in range(0, len(at), LIST - 2):
            part = slice(i, i + LIST - 2)
            rows += _lists(words, parts, t, seq, at[part], doc[part] if scored else None)
        yield _batch(rows)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = TaskContext.get().partitionId() << 32
        ids, n, seqs, ats, size = [], [], [], [], 0
        for batch in batches:
            own = batch["doc_id"].to_pylist() if scored else None
            for a, count, seq, at in framed(batch["text"]):
                seqs.append(seq)
                ats.append(at)
                n += count.tolist()
                ids += own[a : a + len(count)] if scored else []
                size += len(at)
                if size >= HELD:
                    yield from flush(t, ids, n, seqs, ats)
                    t, ids, n, seqs, ats, size = t + 1, [], [], [], [], 0
        if size:
            yield from flush(t, ids, n, seqs, ats)

    return ship


# --- Counting -----------------------------------------------------------------------------------------------

_COUNTS = "shard int, kind int, tally2 array<long>, tally3 array<long>, bigrams binary, trigrams binary"
_BIGRAM, _TRIGRAM = ("<u4", "<u8", "<u4", "<u8", "<u8", "<u8"), ("<u4", "<u8", "<u4", "<u8", "<u4", "<u8", "<u8", "<u8")


def _added(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one entry of each distinct key, order of the entries by key, sum of c)"""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return order[first], order, np.add.reduceat(c[order].astype(np.int64), first)


def _totals(key: np.ndarray, c: np.ndarray) -> np.ndarray:
    """By entry, the sum of c over the entries with its key."""
    at, order, n = _added(key, c)
    own = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = n[np.cumsum(np.append(False, own[1:] != own[:-1]))] if len(key) else n
    return out


def _tally(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2].tolist()


def _add_up(known, least: int):
    """One shard's seen n-grams: bigrams (v, w, c, c(v)) and trigrams (u, v, w, c, c(u v)); kind PAIRS holds those of spread words, without c(v)."""

    def add(rows: pa.Table) -> pa.Table:
        kind, blobs, shard, out = rows["kind"].to_numpy(), rows["a"], rows["shard"][0].as_py(), []
        parts = [_tokens(blobs[i].as_py())[:4] for i in np.flatnonzero(kind == TOKENS).tolist()]
        if parts:
            v, w, u, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            at, _, c3 = _added(key2(key2(u, v), w), c)
            u, v, w = u[at], v[at], w[at]
            n = _totals(key2(u, v), c3)
            seen = np.flatnonzero(c3 >= least)
            seen = seen[np.lexsort((u[seen], w[seen], v[seen]))]  # in order they pack well
            trigrams = pack(*split(u[seen]), *split(v[seen]), *split(w[seen]), c3[seen].astype(_U), n[seen].astype(_U))
            one = known.value.spread_of(v) == 0
            v, w, c2 = v[one], w[one], c3[one]
            at, _, c2 = _added(key2(v, w), c2)
            v, w = v[at], w[at]
            n = _totals(v, c2)
            seen = np.flatnonzero(c2 >= least)
            seen = seen[np.lexsort((w[seen], v[seen]))]
            out.append((shard, TOKENS, _tally(c2), _tally(c3), pack(*split(v[seen]), *split(w[seen]), c2[seen].astype(_U), n[seen].astype(_U)), trigrams))
        pairs = [unpack(blobs[i].as_py(), "<u4", "<u8", "<u4", "<u8", "<u4") for i in np.flatnonzero(kind == PAIRS).tolist()]
        if pairs:
            v, w, c = (np.concatenate(x) for x in zip(*[(joined(a, b), joined(d, e), n) for a, b, d, e, n in pairs], strict=True))
            at, _, c2 = _added(key2(v, w), c)
            seen = c2 >= least
            out.append((shard, PAIRS, _tally(c2), [], pack(*split(v[at][seen]), *split(w[at][seen]), c2[seen].astype(_U), np.zeros(int(seen.sum()), _U)), None))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["shard", "kind", "tally2", "tally3", "bigrams", "trigrams"])

    return add


def _bigrams(blob: bytes) -> tuple[np.ndarray, ...]:
    vs, vx, ws, wx, c, n = unpack(blob, *_BIGRAM)
    return joined(vs, vx), joined(ws, wx), c.astype(np.int64), n.astype(np.int64)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that aren't frequent and follow a seen history, by shard."""
    for batch in batches:
        for shard, blob in zip(batch["shard"].to_pylist(), batch["bigrams"], strict=True):
            w = np.unique(_bigrams(blob.as_py())[1])
            w = w[w >= _RARE]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), shard, np.int32)), pa.array(w.view(np.int64))], names=["shard", "w"])


def _pairs(known):
    """Bigrams of spread words as rows, P1 of frequent words filled in."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            for blob in batch["bigrams"]:
                v, w, c, _ = _bigrams(blob.as_py())
                hot = w < _RARE
                p = np.where(hot, words.counts[np.where(hot, w, 0).astype(np.int64)], 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(w.view(np.int64)), pa.array(c), pa.array(p, mask=~hot)], names=["v", "w", "c", "known"])

    return rows


def discounts(tally: np.ndarray) -> np.ndarray:
    """Katz's factors by count 0..LARGE + 1 from the numbers of n-grams that occur 1..LARGE + 1 times; a count for which Good-Turing gives none in (0, 1) loses half a count."""
    d = np.ones(LARGE + 2)
    n = np.concatenate([[0], tally]).astype(float)
    for r in range(1, LARGE + 1):
        d[r] = (r - 0.5) / r
        if n[1] and n[r] and n[r + 1]:
            cut = (LARGE + 1) * n[LARGE + 1] / n[1]
            x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut < 1 else -1
            if 0 < x < 1:
                d[r] = x
    return d


# --- The model ----------------------------------------------------------------------------------------------


@dataclass
class Model:
    """words: w, c for every word; shards: kind, a (packed bigrams or words), b (packed trigrams) by shard; known: the frequent words, broadcast."""

    words: DataFrame
    shards: DataFrame
    known: object
    parts: int
    tables: list = field(default_factory=list)

    def drop(self) -> None:
        """Removes the model's tables."""
        drop(*self.tables)


def _weights(seen: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Log alpha; both sums are under 1, since every order keeps mass for the unknown word."""
    return np.log(np.maximum(1 - seen, _TINY) / np.maximum(1 - mass, _TINY))


def _shares(d: np.ndarray, c: np.ndarray, n: np.ndarray, history: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each seen n-gram, their sum by history). A history with no mass freed, as all its counts are above LARGE, keeps one count for other words."""
    p = d[np.minimum(c, LARGE + 1)] * c / np.maximum(n, 1)
    full = np.bincount(history, p, size) > 1 - 1e-9
    p = np.where(full[history], p * n / (n + 1), p)
    return p, np.bincount(history, p, size)


def _finish(known, d2: np.ndarray, d3: np.ndarray, spread: dict):
    """One shard's probabilities and weights, from its counts (left), and counts of words and bigrams of spread words (right)."""

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        words = known.value
        none = pack(*(np.zeros(0, k) for k in _TRIGRAM))
        bigrams, trigrams = (left["bigrams"][0].as_py(), left["trigrams"][0].as_py()) if len(left) else (pack(*(np.zeros(0, k) for k in _BIGRAM)), none)
        v, w, c, n = _bigrams(bigrams)
        is_word = right["v"].is_null().to_numpy()
        rw, rc = right["w"].to_numpy().view(_U)[is_word], right["k"].to_numpy()[is_word]
        order = np.argsort(rw)
        rw, rc = rw[order], rc[order]

        def count_of(code: np.ndarray) -> np.ndarray:
            hot, i = code < _RARE, np.minimum(np.searchsorted(rw, code), max(len(rw) - 1, 0))
            return np.where(hot, words.counts[np.where(hot, code, 0).astype(np.int64)], rc[i] if len(rw) else 0)

        pair = ~is_word
        sv, sw = right["v"].filter(pa.array(pair)).to_numpy().astype(_U), right["w"].filter(pa.array(pair)).to_numpy().view(_U)
        sc, sk = right["c"].filter(pa.array(pair)).to_numpy(), right["k"].filter(pa.array(pair)).to_numpy()
        own, inv = np.unique(v, return_inverse=True)
        p1 = count_of(w) / words.every
        m, seen = _shares(d2, c, n, inv, len(own))
        la2 = _weights(seen, np.bincount(inv, p1, len(own)))
        ov = np.unique(sv)
        norm = np.array([spread[int(x)][0] for x in ov.tolist()])
        sm = d2[np.minimum(sc, LARGE + 1)] * sc / norm[np.searchsorted(ov, sv)] if len(sv) else np.zeros(0)
        own, la2 = np.concatenate([own, ov]), np.concatenate([la2, [spread[int(x)][1] for x in ov.tolist()]])
        v, w, p2, p1 = np.concatenate([v, sv]), np.concatenate([w, sw]), np.concatenate([m, sm]), np.concatenate([p1, sk / words.every])
        us, ux, vs, vx, ws, wx, c, n = unpack(trigrams, *_TRIGRAM)
        tu, tv, tw, c, n = joined(us, ux), joined(vs, vx), joined(ws, wx), c.astype(np.int64), n.astype(np.int64)
        k2 = key2(v, w)
        order = np.argsort(k2)
        at = order[np.searchsorted(k2[order], key2(tv, tw))] if len(tv) else np.zeros(0, np.int64)
        _, first, inv = np.unique(key2(tu, tv), return_index=True, return_inverse=True)
        p3, seen = _shares(d3, c, n, inv, len(first))
        la3 = _weights(seen, np.bincount(inv, p2[at], len(first)))
        # Of words that aren't frequent, log P1 is added by their own shard, so here it is taken off.
        less2 = np.where(w >= _RARE, np.log(np.maximum(p1, _TINY)), 0.0)
        a = pack(*split(v), *split(w), *valued(np.log(p2) - less2), *split(own), la2)
        first, la3 = first[turn := np.argsort(first)], la3[turn]
        b = pack(*split(tu), *split(tv), *split(tw), *valued(np.log(p3) - less2[at]), *split(tu[first]), *split(tv[first]), *valued(la3))
        return _model([((left if len(left) else right)["shard"][0].as_py(), TOKENS, a, b)])

    return finish


def _model(rows: list) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["shard", "kind", "a", "b"])


class _Values:
    """Values by key: sorted keys, 0 for keys that aren't there."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is there, value)"""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key))
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[i] == key
        return hit, np.where(hit, self.value[i], 0.0)


class Shard:
    """Evaluates tokens by one shard's part of the model."""

    def __init__(self, words: Words, a: bytes | None, b: bytes | None):
        self.words = words
        if a is None:
            none = np.zeros(0, _U), np.zeros(0)
            self.two = self.one = self.three = self.both = _Values(*none)
            return
        vs, vx, ws, wx, value, i, os, ox, la = unpack(a, "<u4", "<u8", "<u4", "<u8", "<f8", "<u4", "<u4", "<u8", "<f8")
        self.two, self.one = _Values(key2(joined(vs, vx), joined(ws, wx)), value[i]), _Values(joined(os, ox), la)
        us, ux, vs, vx, ws, wx, value, i, hu, hux, hv, hvx, la, j = unpack(b, *_TRIGRAM[:6], "<f8", "<u4", *_TRIGRAM[:4], "<f8", "<u4")
        self.three = _Values(key2(key2(joined(us, ux), joined(vs, vx)), joined(ws, wx)), value[i])
        self.both = _Values(key2(joined(hu, hux), joined(hv, hvx)), la[j])

    def log_p(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray | int = 1) -> np.ndarray:
        """Log P3(w | u v), less log P1(w) where w isn't frequent: the trigram, else the weight of (u, v) and the bigram, else the weight of v and the word. n: how many of u follow each other for one (v, w)."""
        seen2, p2 = self.two(key2(v, w))
        lower = np.where(seen2, p2, self.one(v)[1] + self.words.log_p(w))
        lower, v, w = (np.repeat(x, n) for x in (lower, v, w))
        uv = key2(u, v)
        seen3, p3 = self.three(key2(uv, w))
        return np.where(seen3, p3, self.both(uv)[1] + lower)


def _packed_words(parts: int):
    """Words that aren't frequent, packed by shard."""

    def flush(held: list) -> pa.RecordBatch:
        w, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(w)
        w, c = w[order], c[order]
        order, cuts = _by_shard(shard_of(w, parts), parts)
        w, c = w[order], c[order]
        return _model([(s, RARE, pack(np.diff(w[i:j], prepend=_U(0)), c[i:j].astype(_U)), None) for s, i, j in cuts]).to_batches()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append((batch["w"].to_numpy().view(_U), batch["c"].to_numpy()))
                size += len(batch)
            if size >= HELD:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return work


def _often(words: DataFrame, most: int, widest: int = 1 << 16) -> int:
    """The least count from which on there are no more than `most` words: from a histogram of at most `widest` rows, beyond it by doubling."""
    n = {r.c: r.n for r in words.groupBy(F.least("c", F.lit(widest)).alias("c")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, widest + 1
    for c in sorted(n, reverse=True):
        total += n[c]
        if total > most:
            break
        least = c
    while least > widest and words.filter(F.col("c") >= least).limit(most + 1).count() > most:
        least *= 2
    return least


def train(documents: DataFrame, least: int = LEAST, hot: int = HOT, spread: int = SPREAD) -> Model:
    """Counts all of documents."""
    spark, texts, parts = documents.sparkSession, documents.select("text"), FINE * shards(documents.sparkSession)
    words = table(texts.mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "katz-words")
    end = int(BOUNDARY.view(np.int64))
    # Words are frequent from the least count on that no more than `hot` of them reach, which bounds what comes to the driver; the boundary always is.
    often, every = _often(words, max(1, min(hot, HOT) - 1)), float((words.agg(F.sum("c")).first()[0] or 0) + 1)
    frequent = (F.col("c") >= often) | (F.col("w") == end)
    top = words.filter(frequent).toArrow()
    prints, counts = top["w"].to_numpy().view(_U), top["c"].to_numpy()
    if not len(prints):
        prints, counts = np.array([BOUNDARY]), np.ones(1, np.int64)
    order = np.argsort(prints)
    prints, counts = prints[order], counts[order]
    known = spark.sparkContext.broadcast(Words(prints, counts, np.where(counts > spread, np.minimum(-(-counts // spread), parts), 0), every))
    shipped = texts.mapInArrow(_ship(known, parts, False), _SHIPPED).select("shard", "kind", "a")
    counted = table(shipped.groupBy("shard").applyInArrow(_add_up(known, least), _COUNTS), "katz-counts")
    d = []
    for name in ("tally2", "tally3"):
        tally = np.zeros(LARGE + 1)
        for r in counted.select(F.posexplode(name).alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect():
            tally[r.r] = r.n
        d.append(discounts(tally))
    plain = counted.filter(F.col("kind") == TOKENS)
    wanted = plain.select("shard", "bigrams").mapInArrow(_wanted, "shard int, w long").join(words.withColumnRenamed("c", "k"), "w")
    right = wanted.select("shard", F.lit(None).cast("long").alias("v"), "w", F.lit(None).cast("long").alias("c"), "k")
    weights: dict[int, tuple[int, float]] = {}
    many = np.flatnonzero(known.value.spread)
    if len(many):
        pairs = counted.filter(F.col("kind") == PAIRS).select("bigrams").mapInArrow(_pairs(known), "v long, w long, c long, known long")
        found = pairs.filter("known IS NULL").drop("known").join(words.withColumnRenamed("c", "k"), "w").select("v", "w", "c", "k")
        pairs = table(pairs.filter("known IS NOT NULL").select("v", "w", "c", F.col("known").alias("k")).unionByName(found), "katz-pairs")
        factor = F.element_at(F.array(*[F.lit(float(x)) for x in d[0]]), F.least("c", F.lit(LARGE + 1)).cast("int") + 1)
        # One row per spread word, of which there are at most `hot`.
        sums = {r.v: r for r in pairs.groupBy("v").agg(F.sum(factor * F.col("c")).alias("seen"), F.sum("k").alias("mass")).collect()}
        for x in many.tolist():
            n = int(known.value.counts[x])
            seen, mass = (sums[x].seen, sums[x].mass) if x in sums else (0.0, 0.0)
            n += seen / n > 1 - 1e-9  # as in _shares
            weights[x] = (n, float(_weights(np.array(seen / n), np.array(mass / every))))
        base, size = shard_of(many.astype(_U), parts), known.value.spread[many]
        where = spark.createDataFrame([(int(x), (int(b) + i) % parts) for x, b, m in zip(many, base, size, strict=True) for i in range(int(m))], "v long, shard int")
        right = right.unionByName(pairs.join(where, "v").select("shard", "v", "w", "c", "k"))
    finished = plain.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_finish(known, *d, weights), "shard int, kind int, a binary, b binary")
    packed = words.filter(~frequent).mapInArrow(_packed_words(parts), "shard int, kind int, a binary, b binary")
    model = table(finished.unionByName(packed), "katz-model")
    drop(counted, *([pairs] if len(many) else []))
    return Model(words, model, known, parts, [words, model])


# --- Scoring ------------------------------------------------------------------------------------------------

_ANSWER = "t long, first int, ids array<long>, a binary, b binary"


def _answer(known):
    """One shard: the sums of each list by document; documents pass."""

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        words, out = known.value, []
        shard = left["shard"][0].as_py() if len(left) else 0
        if shard < 0:
            out = [(t, 0, ids, a, None) for t, ids, a in zip(left["t"].to_pylist(), left["ids"].to_pylist(), left["a"].to_pylist(), strict=True)]
        elif len(left):
            kind, lists, blobs = left["kind"].to_numpy(), left["t"].to_numpy(), left["a"]
            model = [right.slice(i, 1).to_pylist()[0] for i in range(len(right))]
            plain = next((r for r in model if r["kind"] == TOKENS), {"a": None, "b": None})
            known_shard = Shard(words, plain["a"], plain["b"])
            parts = [unpack(r["a"], "<u8", "<u8") for r in model if r["kind"] == RARE]
            counts = _Values(*(np.concatenate(x) for x in zip(*[(np.cumsum(w, dtype=_U), c.astype(float)) for w, c in parts], strict=True))) if parts else _Values(np.zeros(0, _U), np.zeros(0))
            tokens, rare, ts, held = [], [], [], 0
            for i in np.lexsort((kind, lists)).tolist():
                t, blob = int(lists[i]), blobs[i].as_py()
                if not ts or ts[-1] != t:
                    if held >= ASKED:
                        out += _sums(known_shard, counts, tokens, rare, ts)
                        tokens, rare, ts, held = [], [], [], 0
                    ts.append(t)
                if kind[i] == TOKENS:
                    *x, doc = _by_bigram(blob)
                else:
                    gap, doc = unpack(blob, "<u8", "<u4")
                    x = [np.cumsum(gap, dtype=_U)]
                (tokens if kind[i] == TOKENS else rare).append((*x, doc.astype(np.int64) + (len(ts) - 1 << 32)))
                held += len(doc)
            out += _sums(known_shard, counts, tokens, rare, ts)
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["t", "first", "ids", "a", "b"])

    return answer


def _sums(shard: Shard, counts: _Values, tokens: list, rare: list, ts: list) -> list[tuple]:
    """One row a list: the sums by document of what its tokens and its words that aren't frequent come to. Documents carry the place of their list in ts."""
    doc, value = [], []
    if tokens:
        v, w, n, u, c, own = (np.concatenate(x) for x in zip(*tokens, strict=True))
        doc.append(own)
        value.append(np.repeat(shard.log_p(u, v, w, n), c))
    if rare:
        w, own = (np.concatenate(x) for x in zip(*rare, strict=True))
        doc.append(own)
        value.append(np.log(np.maximum(counts(w)[1], 1.0) / shard.words.every))
    if not doc:
        return []
    docs, inv = np.unique(np.concatenate(doc), return_inverse=True)
    sums, own = np.bincount(inv, np.concatenate(value)).astype("<f8"), (docs & 0xFFFFFFFF).astype("<u4")
    cut = np.searchsorted(docs, np.arange(len(ts) + 1) << 32).tolist()
    return [(t, 1, None, pack(own[i:j]), sums[i:j].tobytes()) for t, i, j in zip(ts, cut[:-1], cut[1:], strict=True)]


def _collect(rows: pa.Table) -> pa.Table:
    """All answers to one list of documents."""
    first = rows["first"].to_numpy()
    at = int(np.flatnonzero(first == 0)[0])
    n = np.frombuffer(rows["a"][at].as_py(), "<i8")
    parts = sorted((rows["a"][i].as_py(), rows["b"][i].as_py()) for i in np.flatnonzero(first).tolist())  # sums in one order give one result
    total = np.zeros(len(n))
    for a, b in parts:
        total[unpack(a, "<u4")[0]] += np.frombuffer(b, "<f8")
    return pa.table([pa.array(rows["ids"][at].as_py(), pa.int64()), pa.array(n), pa.array(total), pa.array(np.exp(np.minimum(-total / (n + 1), 700)))], names=["doc_id", "n_tokens", "log_prob", "perplexity"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob (natural, with the end of the text) and perplexity for every row of documents."""
    asked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ship(model.known, model.parts, True), _SHIPPED).drop("b")
    answers = asked.groupBy("shard").cogroup(model.shards.groupBy("shard")).applyInArrow(_answer(model.known), _ANSWER)
    return answers.groupBy("t").applyInArrow(_collect, "doc_id long, n_tokens long, log_prob double, perplexity double")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, train(documents))
