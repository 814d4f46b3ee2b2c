"""One tiny source doesn't scale down the others, and the stated share of the tokens is drawn."""

import pytest
from test_llm import docs, words


def test_mixing_tiny_source(spark):
    from terraloom.llm.mixing import KEEP, mix, targets

    sources = {f"s{i}": (1000, 200_000) for i in range(20)} | {None: (1, 100), "hot": (10**6, 10**9)}
    pi = targets(sources, None, 0.5)
    assert sum(pi[s] * t for s, (_, t) in sources.items()) == pytest.approx(KEEP * sum(t for _, t in sources.values()))
    assert pi[None] == 1 and all(pi[f"s{i}"] == 1 for i in range(20)) and pi["hot"] > 0.74
    unequal = targets({"a": (10, 1000), "b": (40, 4000)}, None, 0.5, 0.5)
    assert unequal["b"] * 4000 / (unequal["a"] * 1000) == pytest.approx(2)
    assert targets({"a": (10, 1000), "b": (40, 4000)}, {"a": 1.0, "b": 1.0}, 0.5) == {"a": 1.0, "b": 0.25}
    rows = [(i, " ".join(words(50, i)), f"s{i % 3}") for i in range(600)] + [(900, "one two three", None)]
    n = sum(r.n_tokens for r in mix(docs(spark, rows)).collect())
    assert abs(n - KEEP * 30_003) <= 3 * 50 + 3
