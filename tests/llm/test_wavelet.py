"""Wavelet shards: exact round trips, ranks and places, and the tokens of odd texts."""

import numpy as np
import pyarrow as pa
import pytest

ODD = [None, "", " ", "\n\n a", "x  \n b", "a  b\t\tc  ", "end \n", "it's  we'll x", "\r\n\r\n z", "0" * 50, "a\u00a0\n b", "\u3000 c d", "na\u00efve caf\u00e9 \u4e2d\u6587", "word " * 3000]


def test_units_give_the_tokens_of_whole_texts():
    from terraloom.llm.wavelet import RANKS, Tokenizer, encoding

    got = []
    for _, ids, ends in Tokenizer()(pa.array(ODD)):
        got += [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [encoding(RANKS).encode_ordinary(t or "") for t in ODD]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_matrix_answers(n):
    from terraloom.llm.wavelet import WaveletMatrix

    x = np.random.default_rng(n).integers(0, 60, n) * 800
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(x, [7, None], [n // 2, n]).to_bytes())
    assert (w.ids, w.ends.tolist()) == ([7, None], [n // 2, n])
    if n:
        assert (w.access(np.arange(n)) == x).all()
    for c in (0, 800, 47200, 5):
        at = np.flatnonzero(x == c).tolist()
        assert (w.count(c), w.rank(c, n // 2)) == (len(at), sum(p < n // 2 for p in at))
        assert [w.select(c, k) for k in range(len(at))] == at and w.select(c, len(at)) == -1
        assert w.locate(c) == [(7, p) if p < n // 2 else (None, p - n // 2) for p in at]


def test_matrix_of_large_numbers():
    from terraloom.llm.wavelet import WaveletMatrix

    x = np.random.default_rng(1).integers(0, 200_000, 3000)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(x, [1], [3000]).to_bytes())
    assert w.bits == 18 and (w.access(np.arange(3000)) == x).all()
    c = int(x[77])
    assert w.count(c) == (x == c).sum() and w.select(c, 0) == int(np.flatnonzero(x == c)[0])


def test_shards_round_trip(spark, tmp_path):
    from terraloom.llm.wavelet import RANKS, WaveletMatrix, encoding, shards, write_files

    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(ODD * 2)] + [(3, "again", "x"), (3, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string")
    got = []
    out = shards(df, size=200)
    for r in out.collect():
        w = WaveletMatrix.from_bytes(bytes(r.file))
        assert r.n_tokens == w.n and r.doc_ids == w.ids and r.doc_ends == w.ends.tolist()
        ids = w.access(np.arange(w.n)) if w.n else np.zeros(0)
        got += [(i, x.tolist()) for i, x in zip(w.ids, np.split(ids, w.ends)[:-1], strict=True)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted([(i, encoding(RANKS).encode_ordinary(t or "")) for i, t, _ in rows], key=key)
    files = write_files(out, str(tmp_path)).collect()
    assert files and all(WaveletMatrix.from_bytes(open(f.path, "rb").read()).n >= 0 for f in files)
    assert shards(df.limit(0)).count() == 0
