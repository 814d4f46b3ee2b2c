"""What many short lists cost: a lookup touches the words asked for, not all frequent ones, and a shard answers each list in one row."""

import numpy as np
import pyarrow as pa
from test_llm import words


def test_katz_short_lists(monkeypatch):
    from terraloom.llm import katz

    texts = [" ".join(words(30, i, 200)) + f" rare{i}" for i in range(400)]
    framed = [next(katz.framed(pa.array([t]))) for t in texts]
    prints, counts = np.unique(np.concatenate([seq[at] for _, _, seq, at in framed]), return_counts=True)
    hot = counts > 1
    more = np.setdiff1d(np.random.Generator(np.random.PCG64(1)).integers(1 << 62, 1 << 63, 300_000).astype(np.uint64) | katz._RARE, prints)
    held = np.concatenate([prints[hot], more])
    order, every, parts = np.argsort(held), float(counts.sum() + 1), 6
    known = katz.Words(held[order], np.concatenate([counts[hot], np.full(len(more), 2)])[order], np.zeros(len(held), np.int64), every)
    rows = []
    for t in range(40):  # ten documents a list
        own = framed[10 * t : 10 * t + 10]
        shift = np.cumsum([0, *(len(f[2]) for f in own[:-1])])
        at = np.concatenate([f[3] + s for f, s in zip(own, shift, strict=True)])
        doc = np.repeat(np.arange(10), [len(f[3]) for f in own])
        rows += katz._lists(known, parts, t, np.concatenate([f[2] for f in own]), at, doc)
    logged, log = [0], np.log
    monkeypatch.setattr(np, "log", lambda x, *a, **k: (logged.__setitem__(0, logged[0] + np.size(x)), log(x, *a, **k))[1])
    got, model = np.zeros(400), katz._model([])
    known_broadcast = type("Known", (), {"value": known})
    for s in range(parts):
        answer = katz._answer(known_broadcast)(pa.Table.from_batches([katz._batch([r for r in rows if r[0] == s])]), model)
        assert len(answer) == len(set(answer["t"].to_pylist()))
        for r in answer.to_pylist():
            docs = katz.unpack(r["a"], "<u4")[0].astype(np.int64)
            got[10 * r["t"] + docs] += np.frombuffer(r["b"], "<f8")
    assert logged[0] < 4 * counts.sum()
    # Without n-grams in the model every word has its own probability, and one that it doesn't know a count of one.
    p = dict(zip(prints.tolist(), log(np.where(hot, counts, 1) / every).tolist(), strict=True))
    want = [sum(p[w] for w in seq[at].tolist()) for _, _, seq, at in framed]
    assert np.allclose(got, want)


def test_packed_numbers_keep_their_values():
    from terraloom.llm.packed import pack, unpack

    x = [np.array(v, k) for v, k in (([], "<u4"), ([0, 0], "<u8"), ([1, 255], "<u4"), ([256, 3], "<u4"), ([1 << 63, 5], "<u8"), ([-1.5, 0.0], "<f8"), ([70_000, 1], "<u8"))]
    for a, b in zip(x, unpack(pack(*x), "<u4", "<u8", "<u4", "<u4", "<u8", "<f8", "<u8"), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()
