"""Logistic regression on sparse binary rows plus a few dense columns, with numpy alone."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Binary features as a flat list: feature ids per row, rows told apart by first. Sums run over stretches of the list, and of a copy of it ordered by feature."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, width: int):
        self.ids, self.first, self.width = ids, first, width
        self.row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.filled = np.flatnonzero(np.diff(first) > 0)
        order = np.argsort(ids, kind="stable")
        self.by_id, ordered = self.row[order], ids[order]
        self.starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ids) else np.zeros(0, np.int64)
        self.used = ordered[self.starts]

    def __len__(self) -> int:
        return len(self.first) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        if len(self.ids):
            out[self.filled] = np.add.reduceat(w[self.ids], self.first[self.filled])
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.ids):
            out[self.used] = np.add.reduceat(r[self.by_id], self.starts)
        return out

    def take(self, mask: np.ndarray) -> Rows:
        keep = mask[self.row]
        n = np.diff(self.first)[mask]
        return Rows(self.ids[keep], np.concatenate([[0], np.cumsum(n)]), self.width)


def fit(x: Rows, dense: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 10, inner: int = 8, gain: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """(sparse weights, dense weights, bias) of the L2-penalised fit, by Newton steps solved with conjugate gradients, until one wins less than the share `gain` of the loss."""
    k, d = x.width, dense.shape[1]
    ridge = np.concatenate([np.full(k + d, l2), [1e-6]])

    def forward(p: np.ndarray) -> np.ndarray:
        return x.dot(p[:k]) + dense @ p[k : k + d] + p[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([x.back(r), dense.T @ r, [r.sum()]])

    def loss(p: np.ndarray) -> float:
        z = forward(p)
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * p * p).sum())

    p = np.zeros(k + d + 1)
    now = loss(p)
    for _ in range(steps):
        q = sigmoid(forward(p))
        g, h = back(q - y) + ridge * p, q * (1 - q)
        s, r = np.zeros_like(p), -g
        v, rr = r.copy(), float(r @ r)
        for _ in range(inner):
            if rr <= 1e-4 * float(g @ g):
                break
            hv = back(h * forward(v)) + ridge * v
            a = rr / max(float(v @ hv), 1e-12)
            s, r = s + a * v, r - a * hv
            rr, old = float(r @ r), rr
            v = r + rr / old * v
        t = 1.0
        while t > 1e-3 and (then := loss(p + t * s)) > now:
            t /= 2
        if t <= 1e-3:
            break
        p, won, now = p + t * s, now - then, then
        if won < gain * max(now, 1):
            break
    return p[:k], p[k : k + d], float(p[-1])
