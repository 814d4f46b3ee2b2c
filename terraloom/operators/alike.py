"""Kernels on shapes that are moved to the origin, run once for those that are the same but for their place.

Layers repeat a few shapes at many places: masts, lots, standard buffers. Near the
origin tolerances don't grow with the distance of the map's zero point, either.
Shapes that don't repeat are worked out one by one, as ever.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of rows and results that a process keeps.
KEPT = 32 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out over all cores: a file that is small for Spark is read in few tasks, but kernels are slow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ("fid",)))


class Rows:
    """The rows of a column of nested lists of points: offsets of the lists at each level, rows first, and the points' fields."""

    def __init__(self, column: pa.Array):
        self.offsets = []
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            self.offsets.append(np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            column = column.flatten()
        self.points = np.stack([np.asarray(column.field(k).to_numpy(zero_copy_only=False), float) for k in range(column.type.num_fields)], axis=1)
        ends = self.offsets[0]
        self.ends = [ends]
        for o in self.offsets[1:]:
            ends = o[ends]
            self.ends.append(ends)

    def move(self, to: np.ndarray) -> None:
        """Subtracts a place of its own from the points of each row."""
        self.moved = self.points.copy()
        self.moved[:, :2] -= np.repeat(to, np.diff(self.ends[-1]), axis=0)
        self.moved += 0.0  # no negative zeros

    def keys(self) -> list[Sequence[bytes]]:
        """What tells rows apart that aren't the same, after a move: the sizes of their lists and their points."""
        parts = []
        for sizes, ends in [(np.diff(o), e) for o, e in zip(self.offsets[1:], self.ends, strict=False)] + [(self.moved, self.ends[-1])]:
            raw, width = sizes.tobytes(), sizes.itemsize * (sizes.shape[1] if sizes.ndim > 1 else 1)
            at = (ends * width).tolist()
            parts.append([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)])
        return list(zip(*parts, strict=True))

    def row(self, k: int, moved: bool = True) -> list | np.ndarray:
        """Row k as nested lists of arrays of points."""
        points = self.moved if moved else self.points

        def cut(level: int, i: int):
            a, b = int(self.offsets[level][i]), int(self.offsets[level][i + 1])
            return points[a:b] if level == len(self.offsets) - 1 else [cut(level + 1, m) for m in range(a, b)]

        return cut(0, k)


def _bytes(value) -> int:
    if isinstance(value, np.ndarray):
        return value.nbytes + 100
    return 60 + sum(map(_bytes, value)) if isinstance(value, (list, tuple)) else 60


#: What the kernels of this process have found, by kernel and row; a worker of Spark keeps it from task to task.
_KNOWN: dict = {}
_kept = 0


class Once:
    """work(row of each column, *extras) for each row, the rows moved by the first point of the first column. The name, with all that the work depends on, tells kernels apart."""

    def __init__(self, work: Callable, *name):
        self.work, self.name = work, name

    def __call__(self, *columns: pa.Array, extras: list[tuple] | None = None, extras_of: Callable | None = None) -> tuple[list, np.ndarray, list[Rows]]:
        """(results, places, rows): the results by row, to be moved back by places if they are places themselves."""
        global _kept
        rows = [Rows(c) for c in columns]
        first = rows[0]
        at, end = first.ends[-1][:-1], first.ends[-1][1:]
        place = np.zeros((len(at), 2))
        some = end > at
        place[some] = first.points[at[some], :2]
        place[~np.isfinite(place).all(axis=1)] = 0.0
        for r in rows:
            r.move(place)
        extras = extras_of(place) if extras_of else extras or [()] * len(at)
        out = []
        known = _KNOWN.setdefault(self.name, {})
        for k, key in enumerate(zip(extras, *[r.keys() for r in rows], strict=True)):
            found = known.get(key)
            if found is None:
                found = (self.work(*[r.row(k) for r in rows], *extras[k]),)
                _kept += _bytes(found) + sum(len(b) for part in key[1:] for b in part)
                if _kept > KEPT:
                    _KNOWN.clear()
                    known = _KNOWN[self.name] = {}
                    _kept = 0
                known[key] = found
            out.append(found[0])
        return out, place, rows
