"""Positions along polylines, as numpy kernels over Arrow batches.

The lines of a batch are one flat array of vertices, so the work is a handful of
array operations whatever the lines' lengths, and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Paths:
    """Lines of a batch: vertices x, y, the distance along up to each, first vertex of each line (one more at the end)."""

    def __init__(self, column: pa.Array):
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = np.asarray(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        points = lists.flatten()
        self.x, self.y = (np.asarray(points.field(k).to_numpy(zero_copy_only=False), float) if len(points) else np.zeros(0) for k in (0, 1))
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.line = np.repeat(np.arange(len(size)), size)
        self.n = len(size)
        self.along = np.zeros(len(self.x))
        step = np.hypot(np.diff(self.x), np.diff(self.y)) if len(self.x) else np.zeros(0)
        for lo, hi in _equal_runs(size, self.first):  # lines of one size are a matrix, so sums start at 0 for each
            at = lo[:, None] + np.arange(hi)
            if hi > 1:
                self.along[at[:, 1:]] = np.cumsum(step[at[:, :-1]], axis=1)

    @property
    def total(self) -> np.ndarray:
        """Length by line; 0 for lines of fewer than two vertices."""
        out = np.zeros(self.n)
        some = np.diff(self.first) > 0
        out[some] = self.along[self.first[1:][some] - 1]
        return out

    def at(self, line: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points at distances, clamped to the ends; lines must have vertices."""
        n = len(self.x)
        # Vertices and questions merged in one order: a question comes after the vertices up to its distance.
        order = np.lexsort((np.repeat([0, 1], [n, len(line)]), np.concatenate([self.along, distance]), np.concatenate([self.line, line])))
        vertex = order < n
        before = np.empty(len(line), np.int64)
        before[order[~vertex] - n] = np.cumsum(vertex)[~vertex] - 1
        last = self.first[line + 1] - 1
        a = np.clip(before, self.first[line], last)
        b = np.minimum(a + 1, last)
        span = self.along[b] - self.along[a]
        t = np.clip(np.divide(distance - self.along[a], span, out=np.zeros(len(line)), where=span > 0), 0, 1)
        return self.x[a] + t * (self.x[b] - self.x[a]), self.y[a] + t * (self.y[b] - self.y[a])


def _equal_runs(size: np.ndarray, first: np.ndarray):
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield first[:-1][part], int(size[part[0]])


def pieces(total: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, number within it) of the pieces of fixed length; the last one may be shorter."""
    n = np.ceil(total / length).astype(np.int64)
    line = np.repeat(np.arange(len(n)), n)
    return line, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def azimuth(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    return (np.degrees(np.arctan2(dx, dy)) + 360.0) % 360.0


def crossing_angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.abs(a - b) % 180.0
    return np.minimum(d, 180.0 - d)


def lists(line: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> pa.Array:
    """One list of structs per line, from columns in order of lines."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns)))


SEGMENT = "array<struct<i: int, x1: double, y1: double, x2: double, y2: double, azimuth_deg: double>>"


def segments(length: float, least: float = 0.01):
    """Arrow function: lines to their chords between points `length` apart, those shorter than `least` left out and not counted in i."""

    def cut(coords: pa.Array) -> pa.Array:
        p = Paths(coords)
        total = np.where(np.diff(p.first) >= 2, p.total, 0.0)
        line, k = pieces(total, length)
        (x1, y1), (x2, y2) = p.at(line, k * length), p.at(line, np.minimum((k + 1) * length, total[line]))
        keep = (x2 - x1) ** 2 + (y2 - y1) ** 2 >= least * least
        line, x1, y1, x2, y2 = (v[keep] for v in (line, x1, y1, x2, y2))
        size = np.bincount(line, minlength=p.n)
        i = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
        return lists(line, p.n, {"i": i.astype(np.int32), "x1": x1, "y1": y1, "x2": x2, "y2": y2, "azimuth_deg": azimuth(x2 - x1, y2 - y1)})

    return cut


STATION = "array<struct<k: int, s: double, e: double, path_m: double, distance: double, angle: double>>"
#: Station and leg pairs that are measured at once.
_AT_ONCE = 1 << 18
#: Stations of the paths that are measured at once.
_STATIONS = 1 << 16


def stations(length: float):
    """Arrow function: a path and a line to the path's stations, with the distance of each middle to the line and the angle between both there."""

    def measure(path: pa.Array, other: pa.Array) -> pa.Array:
        """So many rows at a time as have about _STATIONS stations: a batch of long paths has millions."""
        n = np.ceil(Paths(path).total / length)
        upto, out, lo = np.cumsum(n), [], 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _STATIONS, "right")))
            out.append(measured(path.slice(lo, hi - lo), other.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays(out) if out else measured(path, other)

    def measured(path: pa.Array, other: pa.Array) -> pa.Array:
        p, q = Paths(path), Paths(other)
        legs = np.maximum(np.diff(q.first) - 1, 0)
        total = np.where((np.diff(p.first) >= 2) & (legs > 0), p.total, 0.0)
        line, k = pieces(total, length)
        s, e = k * length, np.minimum((k + 1) * length, total[line])
        (ax, ay), (bx, by), (mx, my) = p.at(line, s), p.at(line, e), p.at(line, (s + e) / 2)
        distance, best = np.full(len(line), np.inf), np.zeros(len(line), np.int64)
        ends = np.cumsum(legs[line])
        lo = 0
        while lo < len(line):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _AT_ONCE, "right")))
            n = legs[line[lo:hi]]
            own = np.repeat(np.arange(lo, hi), n)
            leg = q.first[line[own]] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            dx, dy = q.x[leg + 1] - q.x[leg], q.y[leg + 1] - q.y[leg]
            size = dx * dx + dy * dy
            t = np.clip(np.divide((mx[own] - q.x[leg]) * dx + (my[own] - q.y[leg]) * dy, size, out=np.zeros(len(leg)), where=size > 0), 0, 1)
            d = np.hypot(mx[own] - q.x[leg] - t * dx, my[own] - q.y[leg] - t * dy)
            begin = np.cumsum(n) - n
            distance[lo:hi] = np.minimum.reduceat(d, begin)
            at = np.flatnonzero(d == np.repeat(distance[lo:hi], n))
            best[lo:hi] = leg[at[np.searchsorted(at, begin)]]  # the first of equally near legs
            lo = hi
        angle = crossing_angle(azimuth(bx - ax, by - ay), azimuth(q.x[np.minimum(best + 1, max(len(q.x) - 1, 0))] - q.x[best], q.y[np.minimum(best + 1, max(len(q.y) - 1, 0))] - q.y[best])) if len(line) else np.zeros(0)
        still = np.hypot(bx - ax, by - ay) <= 0.1
        columns = {"k": k.astype(np.int32), "s": s.astype(float), "e": e, "path_m": total[line], "distance": distance}
        ends_ = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=p.n))]).astype(np.int32)
        fields = [pa.array(v) for v in columns.values()] + [pa.array(angle, mask=still)]
        return pa.ListArray.from_arrays(pa.array(ends_), pa.StructArray.from_arrays(fields, names=[*columns, "angle"]))

    return measure
