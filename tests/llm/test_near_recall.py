"""Pairs at the threshold itself become candidates: recall of planted pairs by length, scattered substitutions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_llm import docs, words


def planted(n, similarity, r):
    a = words(n, r.random(), 10**6)
    b = list(a)
    for i in r.sample(range(n), int((1 - similarity) * n + 1e-9)):
        b[i] = f"e{r.randrange(10**9)}"
    return a, b


@pytest.mark.parametrize("n", [25, 30, 60, 100, 120, 200, 1000])
def test_near_recall_at_threshold(n):
    from terraloom.llm.align import similar
    from terraloom.llm.near import sketch, word_codes

    for similarity in (0.7, 0.72, 0.75, 0.8):
        r = random.Random(n)
        texts = [" ".join(x) for _ in range(100) for x in planted(n, similarity, r)]
        codes = [np.frombuffer(c, np.uint32) for c in word_codes(pa.array(texts)).to_pylist()]
        assert all(similar(codes[i], codes[i + 1], 0.7) >= 0.7 for i in range(0, 200, 2))
        s = [set(x["s"]) for x in sketch(pa.array(texts)).to_pylist()]
        assert sum(bool(s[i] & s[i + 1]) for i in range(0, 200, 2)) >= 90, similarity


def test_near_groups_hold_planted_pairs(spark):
    from terraloom.llm.near import groups

    r = random.Random(9)
    rows = []
    for k in range(150):
        for w in planted(r.choice([25, 40, 60, 150]), r.choice([0.72, 0.75]), r):
            rows.append((len(rows), " ".join(w), "s"))
    got = {x.doc_id: x.group_id for x in groups(docs(spark, rows)).collect()}
    assert sum(got.get(2 * k + 1) == 2 * k for k in range(150)) >= 0.9 * 150
    assert all(v == d - d % 2 for d, v in got.items())
