"""The Katz model against plain dictionaries: probabilities, sums to one, spread words, rare words, other counts."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm import CLASH, ODD, docs, words

LARGE = 5


def good_turing(counts):
    """Katz's factors by count, written again from the formula."""
    n = [0] * (LARGE + 2)
    for c in counts:
        if c <= LARGE + 1:
            n[c] += 1
    d = {}
    for r in range(1, LARGE + 1):
        d[r] = (r - 0.5) / r
        if n[1] and n[r] and n[r + 1]:
            k = (LARGE + 1) * n[LARGE + 1] / n[1]
            if k < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - k) / (1 - k)
                if 0 < x < 1:
                    d[r] = x
    return lambda c: d.get(c, 1.0)


def plain(texts, least):
    """P(w | u v) by dictionaries of words."""
    framed = [["<>", "<>", *t.lower().split(), "<>"] for t in texts]
    uni, bi, tri = Counter(), Counter(), Counter()
    for w in framed:
        uni.update(w[2:])
        bi.update(zip(w[1:], w[2:]))
        tri.update(zip(w, w[1:], w[2:]))
    every, d2, d3 = sum(uni.values()) + 1, good_turing(bi.values()), good_turing(tri.values())
    n1, n2 = Counter(), Counter()
    for (v, _), c in bi.items():
        n1[v] += c
    for (u, v, _), c in tri.items():
        n2[u, v] += c
    after1, after2 = {}, {}
    for (v, w), c in bi.items():
        if c >= least:
            after1.setdefault(v, []).append(w)
    for (u, v, w), c in tri.items():
        if c >= least:
            after2.setdefault((u, v), []).append(w)

    def p1(w):
        return max(uni[w], 1) / every

    # A history that frees no mass keeps one count.
    for n, d, count, after in ((n1, d2, bi, after1), (n2, d3, tri, after2)):
        for h, ws in after.items():
            keys = [(*h, w) if isinstance(h, tuple) else (h, w) for w in ws]
            n[h] += sum(d(count[k]) * count[k] for k in keys) / n[h] > 1 - 1e-9

    def seen2(v, w):
        return d2(bi[v, w]) * bi[v, w] / n1[v]

    a1 = {v: (1 - sum(seen2(v, w) for w in ws)) / (1 - sum(p1(w) for w in ws)) for v, ws in after1.items()}

    def p2(v, w):
        return seen2(v, w) if bi[v, w] >= least else a1.get(v, 1.0) * p1(w)

    def seen3(u, v, w):
        return d3(tri[u, v, w]) * tri[u, v, w] / n2[u, v]

    a2 = {(u, v): (1 - sum(seen3(u, v, w) for w in ws)) / (1 - sum(p2(v, w) for w in ws)) for (u, v), ws in after2.items()}

    def p3(u, v, w):
        return seen3(u, v, w) if tri[u, v, w] >= least else a2.get((u, v), 1.0) * p2(v, w)

    for u, v in list(after2)[:40]:
        assert abs(sum(p3(u, v, w) for w in uni) + p3(u, v, "never seen") - 1) < 1e-9

    def log_p(t):
        w = ["<>", "<>", *t.lower().split(), "<>"]
        return sum(math.log(p3(*x)) for x in zip(w, w[1:], w[2:]))

    return log_p


def corpus():
    rows = [(i, " ".join(words(40, i % 17, 30)), "s") for i in range(60)] + [(100 + i, " ".join(words(50, i + 40, 5000)), "s") for i in range(20)]
    return rows + [(200 + i, " ".join(words(300, 70 + i, 40)), "s") for i in range(20)] + ODD


@pytest.mark.parametrize(("hot", "spread", "least"), [(1, 1 << 20, 2), (9, 200, 2), (1 << 16, 1 << 20, 2), (1 << 16, 60, 1)])
def test_katz_matches_plain_dictionaries(spark, hot, spread, least):
    from terraloom.llm.katz import score, train

    rows = corpus()
    log_p = plain([t or "" for _, t, _ in rows], least)
    model = train(docs(spark, rows, CLASH), least=least, hot=hot, spread=spread)
    got = Counter((r.doc_id, r.n_tokens, round(r.log_prob, 6)) for r in score(docs(spark, rows, CLASH), model).collect())
    assert got == Counter((i, len((t or "").split()), round(log_p(t or ""), 6)) for i, t, _ in rows)
    for t in ("w1 neverseen w2 alsonever", "neverseen", "w3 w4 w5 w6 w7 w8 w9"):
        assert abs(score(docs(spark, [(1, t, "s")]), model).first().log_prob - log_p(t)) < 1e-6
    model.drop()


def test_katz_empty_table(spark):
    from terraloom.llm.katz import score, train

    model = train(docs(spark, []))
    assert score(docs(spark, []), model).count() == 0
    assert [r.n_tokens for r in score(docs(spark, [(1, "a b", "s")]), model).collect()] == [2]


def test_katz_long_text_in_several_lists(spark, monkeypatch):
    """A text longer than what is held and than a list, counted and scored as any other."""
    from terraloom.llm import katz

    rows = [(1, " ".join(words(5000, 1, 50)), "s"), (2, " ".join(words(60, 2, 50)), "s")]
    want = plain([t for _, t, _ in rows], 2)
    known = katz.train(docs(spark, rows)).known.value
    seq = np.concatenate([s for _, _, s, _ in katz.framed(pa.array([rows[0][1]]))])
    at = np.arange(2, len(seq))
    one = katz._lists(known, 1, 0, seq, at, None)
    two = katz._lists(known, 1, 0, seq, at[:2000], None) + katz._lists(known, 1, 0, seq, at[2000:], None)
    total = lambda rows_: sum((Counter(dict(zip(zip(*(x.tolist() for x in katz._tokens(r[4])[:3])), katz._tokens(r[4])[3].tolist()))) for r in rows_), Counter())
    assert total(one) == total(two)
    got = {r.doc_id: r.log_prob for r in katz.score(docs(spark, rows), katz.train(docs(spark, rows))).collect()}
    assert all(abs(got[i] - want(t)) < 1e-5 for i, t, _ in rows)


def test_katz_rare_words_keep_their_own_probability(spark):
    """Junk of words that occur once is as unlikely as it is, beyond any number of frequent words."""
    from terraloom.llm.katz import score, train

    rows = [(i, " ".join(f"a{(i * 1000 + j) % 70000}" for j in range(1000)), "s") for i in range(210)]
    rows.append((999, " ".join(f"junk{j}" for j in range(300)), "s"))
    model = train(docs(spark, rows))
    assert model.words.count() == 70301  # and the boundary
    got = {r.doc_id: r.perplexity for r in score(docs(spark, rows), model).collect()}
    assert got[999] > 100_000 and max(v for k, v in got.items() if k != 999) < 10
