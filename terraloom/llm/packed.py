"""Arrays of numbers as compressed bytes, for rows that stand for many."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)


def pack(*pieces: np.ndarray) -> bytes:
    """Arrays of 16-, 32- or 64-bit numbers, byte plane by byte plane, without the upper planes of unsigned numbers that hold nothing, compressed."""
    head, body = [len(pieces)], []
    for p in pieces:
        width = p.dtype.itemsize
        planes = max(1, (int(p.max()).bit_length() + 7) // 8) if p.dtype.kind == "u" and len(p) else width
        head += [planes, len(p)]
        body.append(p.view(np.uint8).reshape(-1, width)[:, :planes].T.tobytes())
    raw = np.array(head, "<u4").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)
    head, out = raw[: 4 * (1 + 2 * len(kinds))].view("<u4")[1:].tolist(), []
    at = 4 * (1 + 2 * len(kinds))
    for kind, width, n in zip(kinds, head[::2], head[1::2], strict=True):
        x = np.zeros(n, kind)
        if n:
            x.view(np.uint8).reshape(n, -1)[:, :width] = raw[at : at + width * n].reshape(width, n).T
        out.append(x)
        at += width * n
    return out
