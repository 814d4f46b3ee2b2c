r"""Operator 7: token ids in a wavelet matrix per shard.

Texts are tokenised by a byte-level BPE of a given file of ranks. Its pattern
never joins a letter to white space after it, so a text is cut into units of
white space and the word that follows, each distinct unit is encoded once, and
the ids are put together again; texts with white space beyond ASCII, where that
doesn't hold, are encoded whole. The ids of SHARD_TOKENS tokens or a little more
form a shard: as many bit-planes as the ids of the vocabulary take, 16 at least, each stably partitioned by the bits before it, with
counts of ones per 512 bits, compressed plane by plane into one file together
with the documents' ids and ends. The file answers access, rank, count, select
and the places of a token without the text.

Edge cases: null and empty texts are documents of no tokens; null ids are kept;
repeated rows are stored each; a document is never split, so a very long one
makes a larger shard; an empty table gives no shard; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from terraloom.llm.common import read
from terraloom.llm.tokens import chunks, word_bounds, word_hashes

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BITS, SHARD_TOKENS, BLOCK, KNOWN = 16, 1 << 20, 512, 200_000
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_OUT = "shard_id long, n_docs int, n_tokens long, doc_ids array<long>, doc_ends array<long>, file binary"


@cache
def encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class Tokenizer:
    """Ids of texts, by distinct units; known units are forgotten when there are too many."""

    def __init__(self, ranks: str = RANKS):
        self.encode, self.known = encoding(ranks).encode_ordinary, {}
        self.kind = np.uint16 if encoding(ranks).max_token_value < 1 << BITS else np.uint32

    def __call__(self, text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, end of each row in ids) by chunk of rows."""
        for a, b, raw, off in chunks(text):
            n = b - a
            starts, ends, first = word_bounds(raw, off)
            # A unit runs from the end of the word before it; what is left at the end of a row is one too.
            last = off[:-1].copy()
            some = np.diff(first) > 0
            last[some] = ends[first[1:][some] - 1]
            tail = np.flatnonzero(last < off[1:])
            row = np.repeat(np.arange(n), np.diff(first))
            begin = np.concatenate([off[:1], ends[:-1]])[: len(ends)] if len(ends) else ends
            begin = np.maximum(begin, off[row])
            u0, u1, ur = np.concatenate([begin, last[tail]]), np.concatenate([ends, off[1:][tail]]), np.concatenate([row, tail])
            order = np.lexsort((u0, ur))
            u0, u1, ur = u0[order], u1[order], ur[order]
            blob = raw.tobytes()
            whole = {int(np.searchsorted(off, m.start(), "right")) - 1 for m in _WIDE_SPACE.finditer(blob)}
            if whole:
                keep = ~np.isin(ur, list(whole))
                w = np.array(sorted(whole))
                u0, u1, ur = (np.concatenate([x[keep], y]) for x, y in ((u0, off[w]), (u1, off[w + 1]), (ur, w)))
                order = np.lexsort((u0, ur))
                u0, u1, ur = u0[order], u1[order], ur[order]
            h, at, inv = np.unique(word_hashes(raw, u0, u1), return_index=True, return_inverse=True)
            if len(self.known) > KNOWN:
                self.known = {}
            known, encode, parts = self.known, self.encode, []
            for key, i, j in zip(h.tolist(), u0[at].tolist(), u1[at].tolist(), strict=True):
                ids = known.get(key)
                if ids is None:
                    ids = known[key] = np.array(encode(blob[i:j].decode()), self.kind)
                parts.append(ids)
            size = np.array([len(p) for p in parts], np.int64)
            flat, from_ = np.concatenate(parts) if parts else np.zeros(0, self.kind), np.cumsum(size) - size
            k = size[inv]
            place = np.repeat(from_[inv] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            yield a, flat[place], np.cumsum(np.bincount(ur, k, n)).astype(np.int64)


class WaveletMatrix:
    """A sequence of numbers of 16 bits, or as many more as the largest takes, as bit-planes with ranks."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray], ids: list, ends: np.ndarray):
        self.n, self.zeros, self.planes, self.ranks, self.ids, self.ends = n, zeros, planes, ranks, ids, ends
        self.bits = len(zeros)

    @classmethod
    def build(cls, tokens: np.ndarray, ids: list | None = None, ends: np.ndarray | None = None) -> WaveletMatrix:
        bits = max(BITS, int(tokens.max()).bit_length() if len(tokens) else 0)
        kind = np.uint16 if bits <= 16 else np.uint32
        seq, zeros, planes, ranks = tokens.astype(kind), [], [], []
        blocks = len(seq) // BLOCK + 1
        for level in range(bits - 1, -1, -1):
            bit = (seq >> kind(level)) & kind(1) == 1
            packed = np.zeros(blocks * BLOCK // 8, np.uint8)
            own = np.packbits(bit, bitorder="little")
            packed[: len(own)] = own
            ones = np.bitwise_count(packed).reshape(blocks, -1).sum(axis=1, dtype=np.uint32)
            planes.append(packed)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32))
            low = seq[~bit]
            zeros.append(len(low))
            seq = np.concatenate([low, seq[bit]])
        return cls(len(tokens), zeros, planes, ranks, ids or [], np.asarray([] if ends is None else ends, np.int64))

    def to_bytes(self) -> bytes:
        codec = pa.Codec("zstd", 1)
        known = np.array([i is not None for i in self.ids], np.uint8)
        plain = np.array([i or 0 for i in self.ids], "<i8")
        parts = [p.tobytes() for pair in zip(self.planes, self.ranks, strict=True) for p in pair] + [known.tobytes(), plain.tobytes(), self.ends.astype("<i8").tobytes()]
        packed = [codec.compress(p, asbytes=True) if p else b"" for p in parts]
        head = struct.pack("<4sQI", b"WVM2", self.n, self.bits) + struct.pack(f"<{self.bits}Q", *self.zeros) + struct.pack("<I", len(parts))
        return head + b"".join(struct.pack("<QQ", len(p), len(z)) for p, z in zip(parts, packed, strict=True)) + b"".join(packed)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, n, bits = struct.unpack_from("<4sQI", data)
        assert magic == b"WVM2", "not a wavelet matrix"
        zeros = list(struct.unpack_from(f"<{bits}Q", data, 16))
        at = 16 + 8 * bits
        (k,) = struct.unpack_from("<I", data, at)
        sizes = [struct.unpack_from("<QQ", data, at + 4 + 16 * i) for i in range(k)]
        at, codec, parts = at + 4 + 16 * k, pa.Codec("zstd"), []
        for full, small in sizes:
            parts.append(codec.decompress(data[at : at + small], full, asbytes=True) if small else b"")
            at += small
        known, plain = np.frombuffer(parts[-3], np.uint8), np.frombuffer(parts[-2], "<i8")
        ids = [int(i) if ok else None for ok, i in zip(known, plain, strict=True)]
        return cls(n, zeros, [np.frombuffer(p, np.uint8) for p in parts[: 2 * bits : 2]], [np.frombuffer(p, np.uint32) for p in parts[1 : 2 * bits : 2]], ids, np.frombuffer(parts[-1], "<i8"))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        plane, byte = self.planes[level], at >> 3
        block = at // BLOCK
        i = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        inside = np.where(i < byte[:, None], np.bitwise_count(plane[np.minimum(i, len(plane) - 1)]), 0).sum(axis=1, dtype=np.int64)
        rest = np.bitwise_count(plane[np.minimum(byte, len(plane) - 1)] & ((1 << (at & 7)) - 1).astype(np.uint8))
        return self.ranks[level][block].astype(np.int64) + inside + rest.astype(np.int64)

    def access(self, at) -> np.ndarray:
        """The tokens at positions."""
        at = np.atleast_1d(np.asarray(at, np.int64)).copy()
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit = (self.planes[level][at >> 3] >> (at & 7)) & 1 == 1
            ones = self.ones(level, at)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            out = out << 1 | bit
        return out

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before end lie below the last plane."""
        span = np.array([0, end], np.int64)
        for level in range(self.bits):
            ones = self.ones(level, span)
            span = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before a position."""
        lo, hi = self._span(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, level: int, one: bool, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        before = self.ranks[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token, or -1."""
        lo, hi = self._span(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def locate(self, token: int) -> list[tuple[int | None, int]]:
        """(document id, place in the document) of all occurrences."""
        at = np.array([self.select(token, k) for k in range(self.count(token))], np.int64)
        doc = np.searchsorted(self.ends, at, "right")
        begin = np.concatenate([[0], self.ends[:-1]])
        return [(self.ids[d], int(p - begin[d])) for d, p in zip(doc.tolist(), at.tolist(), strict=True)]


def shards(documents: DataFrame, ranks: str = RANKS, size: int = SHARD_TOKENS) -> DataFrame:
    """shard_id, n_docs, n_tokens, doc_ids, doc_ends, file: one row per shard, in the order documents are read."""

    def row(k: int, ids: list, held: list, ends: list) -> pa.RecordBatch:
        tokens, end = np.concatenate(held), np.cumsum(ends)
        data = WaveletMatrix.build(tokens, ids, end).to_bytes()
        shard = TaskContext.get().partitionId() << 32 | k
        return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([len(ids)], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([end.tolist()], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["shard_id", "n_docs", "n_tokens", "doc_ids", "doc_ends", "file"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks)
        k, ids, held, ends, n = 0, [], [], [], 0
        for batch in batches:
            own = batch["d"].to_pylist()
            for a, tokens, end in tokenizer(batch["text"]):
                ids += own[a : a + len(end)]
                held.append(tokens)
                ends += np.diff(end, prepend=0).tolist()
                n += len(tokens)
                if n >= size:
                    yield row(k, ids, held, ends)
                    k, ids, held, ends, n = k + 1, [], [], [], 0
        if ids:
            yield row(k, ids, held, ends)

    return documents.selectExpr("CAST(doc_id AS LONG) d", "text").mapInArrow(work, _OUT)


def write_files(shards_: DataFrame, folder: str) -> DataFrame:
    """Writes each shard's file into a folder that all executors share; gives (shard_id, path)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for i, data in zip(batch["shard_id"].to_pylist(), batch["file"].to_pylist(), strict=True):
                paths.append(f"{folder}/shard-{i:016x}.wvm")
                with open(paths[-1], "wb") as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([batch["shard_id"], pa.array(paths, pa.string())], names=["shard_id", "path"])

    return shards_.select("shard_id", "file").mapInArrow(work, "shard_id long, path string")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents"))
