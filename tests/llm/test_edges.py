"""Every operator and stage on very long texts, empty tables and clashing columns; parts against plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import CLASH, ODD, docs, toxic_corpus, words

#: Columns that the operators use inside.
NAMES = [*CLASH, "i", "y", "w", "h", "a", "b", "c", "r", "g", "lo", "hi", "e", "places", "window_id", "__near_d", "__mix_u", "__suffix_d", "key", "at", "f", "o", "x", "z", "pi", "u", "m", "vs"]


@pytest.fixture(scope="module")
def long_rows():
    """A text above a megabyte, a near copy of it, one that shares its last passage, and short ones."""
    long = words(190_000, 77, 30_000)
    near = [w if i % 97 else f"z{i}" for i, w in enumerate(long)]
    rows = [(1, " ".join(long), "s0"), (2, " ".join(near), "s0"), (3, " ".join(words(100, 5) + long[-70:]), "s1"), *((10 + i, " ".join(words(60, 100 + i)), f"s{i % 2}") for i in range(30))]
    assert len(rows[0][1]) > 1 << 20
    return rows


def test_long_texts_are_read_whole(spark, long_rows):
    from terraloom.llm.isolation import anomalies
    from terraloom.llm.katz import score, train
    from terraloom.llm.mixing import mix
    from terraloom.llm.near import groups
    from terraloom.llm.packing import contents
    from terraloom.llm.suffix import passages
    from terraloom.llm.toxicity import classify

    d = docs(spark, long_rows, NAMES)
    assert {(r.doc_id, r.group_id) for r in groups(d).collect()} == {(1, 1), (2, 1)}
    got = [(r.doc_id, r.start, r.length, r.first_doc_id) for r in passages(d).collect() if r.doc_id == 3]
    assert got == [(3, 100, 70, 1)]
    assert {r.doc_id: r.n_tokens for r in score(d, train(d)).collect()}[1] == 190_000
    assert {r.doc_id: r.n_tokens for r in mix(d, keep=1.0).collect()}[1] == 190_000
    assert {r.doc_id: r.n_words for r in anomalies(d, spark.createDataFrame([(10, 1, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")).collect()}[1] == 190_000
    windows = contents(d, 4096).collect()
    assert sum(r.n_tokens for r in windows) == sum(len(t.split()) for _, t, _ in long_rows) and all(r.n_tokens == len(r.text.split()) for r in windows)
    rows, labels = toxic_corpus()
    late = (9000, " ".join([*(f"q{j % 20_000}" for j in range(150_000)), "vile", "nasty", "vile", "nasty"]), "s")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = {r.doc_id: r for r in classify(docs(spark, [*rows, late], NAMES), table).collect()}
    assert p[9000].p_toxic > p[1].p_toxic  # its last words count


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    full, none = docs(spark, [(i, t, f"s{i % 2}") for i, t, _ in rows[:60]] + ODD, NAMES), docs(spark, [], NAMES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        a, b = stage(spark, full, str(tmp_path)), stage(spark, none, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert a.columns == b.columns == full.columns, name
        assert a.count() > 0 and b.count() == 0, name


def test_run_keeps_what_the_stages_keep(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_corpus()
    docs(spark, [(i, t, f"s{i % 2}") for i, t, _ in rows] + ODD).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    toxic = {i for i, _, y in labels if y}
    text = {i: t for i, t, _ in rows + ODD}
    for r in got:
        at = 0
        w = r.text.split()
        assert len(w) == r.n_tokens <= 2048 and not set(r.doc_ids) & toxic
        for i, line in zip(r.doc_ids, r.text.split("\n"), strict=True):
            own = line.split()
            assert w[at : at + len(own)] == own and " ".join(own) in " ".join((text[i] or "").split())
            at += len(own)


def test_contents_match_places(spark):
    from terraloom.llm.packing import contents, pack

    rows = [(i, " ".join(words(n, i)), "s") for i, n in enumerate([3, 10, 10, 7, 55, 20, 1, 19, 100])] + ODD
    d = docs(spark, rows, CLASH)
    text = defaultdict(set)
    for i, t, _ in rows:
        text[i].add(t)
    want = defaultdict(list)
    for r in pack(d, 20).collect():
        (t,) = text[r.doc_id]
        want[r.window_id].append((r.offset, r.doc_id, " ".join(t.split()[r.start : r.start + r.length])))
    got = {r.window_id: (list(r.doc_ids), r.text) for r in contents(d, 20).collect()}
    assert got == {k: ([i for _, i, _ in sorted(v, key=lambda p: p[0])], "\n".join(t for _, _, t in sorted(v, key=lambda p: p[0]))) for k, v in want.items()}


def test_mixing_inclusion_frequencies():
    from terraloom.llm.mixing import flight, land

    n = np.array([5, 9, 9, 14, 20, 31, 7, 12, 40, 3, 3, 25], float)
    pi, times, kept = 0.4, 4000, np.zeros(len(n))
    for seed in range(times):
        kept += land(flight(np.full(len(n), pi), n, np.random.Generator(np.random.PCG64(seed))), n)
    # The landing rounds, which shows in single frequencies of so few units; sums are kept.
    assert np.abs(kept / times - pi).max() < 0.15 and abs(kept.sum() / times - pi * len(n)) < 0.3
    assert abs((kept * n).sum() / times - pi * n.sum()) < 4


def test_flight_is_a_martingale():
    from terraloom.llm.mixing import flight

    n, total = np.array([3.0, 8.0, 8.0, 20.0, 11.0, 6.0, 15.0]), np.zeros(7)
    for seed in range(6000):
        total += flight(np.full(7, 0.3), n, np.random.Generator(np.random.PCG64(seed)))
    assert np.abs(total / 6000 - 0.3).max() < 0.03


def test_isolation_paths_match_recursion():
    from terraloom.llm.isolation import Forest, typical_path

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 9))
    forest = Forest(x, 7, 64)

    def depth(t, node, row):
        if forest.left[t, node] == node:
            return forest.path[t, node]
        return depth(t, forest.left[t, node] + int(row[forest.feature[t, node]] >= forest.cut[t, node]), row)

    new = rng.normal(size=(40, 9)) * 2
    assert np.allclose(forest.mean_path(new), [np.mean([depth(t, 0, row) for t in range(7)]) for row in new])
    # A leaf's path is its level and what an unsplit rest would take, so that its rows' sum is a tree's.
    harmonic = lambda k: sum(1 / i for i in range(1, k + 1))
    assert all(abs(typical_path(k) - (2 * harmonic(k - 1) - 2 * (k - 1) / k)) < 0.15 for k in (10, 256))
    far = np.full((1, 9), 9.0)
    assert forest.score(forest.mean_path(far))[0] > forest.score(forest.mean_path(x)).mean()


def test_linear_fit_matches_dense_newton():
    from terraloom.llm.linear import Rows, fit

    rng = np.random.default_rng(5)
    dense_x = (rng.random((200, 12)) < 0.3).astype(float)
    extra = rng.random((200, 2))
    y = (rng.random(200) < 1 / (1 + np.exp(-(dense_x[:, 0] * 2 - dense_x[:, 1] + extra[:, 0])))).astype(float)
    r, c = np.nonzero(dense_x)
    rows = Rows(c, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=200))]), 12)
    w, v, b = fit(rows, extra, y, steps=50, inner=200, gain=1e-12)
    full, ridge, p = np.column_stack([dense_x, extra, np.ones(200)]), np.diag([1.0] * 14 + [1e-6]), np.zeros(15)
    for _ in range(50):
        q = 1 / (1 + np.exp(-full @ p))
        p -= np.linalg.solve(full.T * (q * (1 - q)) @ full + ridge, full.T @ (q - y) + ridge @ p)
    assert np.abs(np.concatenate([w, v, [b]]) - p).max() < 0.02


def test_chain_feeds_earlier_probabilities(spark):
    from terraloom.llm.tokens import chunks, letter_bounds, word_hashes
    from terraloom.llm.toxicity import classify, train

    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    chain = train(d, table)
    import pyarrow as pa

    got = {r.doc_id: (r.p_dense, r.p_varied, r.p_toxic, r.is_toxic) for r in classify(d, table).collect()}
    place = {int(h): k for k, h in enumerate(chain.words.tolist())}
    for i, t, _ in rows[:60]:
        (_, _, raw, off) = next(chunks(pa.array([t])))
        starts, ends, _ = letter_bounds(raw, off)
        own = {place[h] for h in word_hashes(raw, starts, ends, lower=True).tolist() if h in place}
        p = []
        for w, v, b in chain.weights:
            p.append(1 / (1 + math.exp(-(sum(w[k] for k in own) + sum(x * y for x, y in zip(v, p)) + b))))
        assert np.allclose(got[i][:3], p) and got[i][3] == (p[-1] >= chain.threshold)
    assert [len(v) for _, v, _ in chain.weights] == [0, 1, 2]


def test_ties_and_repeated_labels(spark):
    from terraloom.llm.isolation import anomalies
    from terraloom.llm.toxicity import classify

    rows, labels = toxic_corpus()
    both = spark.createDataFrame(labels + [(0, 1, 0), (1, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows + [(7000, rows[3][1], "s"), (7000, rows[3][1], "s")])
    p = defaultdict(set)
    for r in classify(d, both).collect():
        p[r.doc_id].add((r.p_toxic, r.is_toxic))
    assert p[7000] == p[3] and len(p[7000]) == 1
    q = Counter((r.doc_id, r.score) for r in anomalies(d, both).collect())
    assert {s for i, s in q if i == 7000} == {s for i, s in q if i == 3}


def test_near_rows_of_one_id_are_judged_by_their_words(spark):
    from terraloom.llm.near import keep_one

    a, b, c = (" ".join(words(80, 900 + k)) for k in range(3))
    d = docs(spark, [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, c, "s"), (3, None, "s"), (4, None, "s")], NAMES)
    got = Counter((r.doc_id, r.text) for r in keep_one(d).collect())
    assert got == Counter([(1, a), (2, b), (3, c), (3, None), (4, None)])


def test_near_blocks_of_a_large_bucket_lose_no_pair(spark, monkeypatch):
    from terraloom.llm import near

    monkeypatch.setattr(near, "BLOCK", 4)
    passage = words(200, 31)
    rows = [(i, " ".join(words(40, 400 + i) + passage), "s") for i in range(30)]  # shared words are 200 of 240: similar by pairs
    rows += [(100 + i, " ".join(words(400, 700 + i) + passage), "s") for i in range(30)]  # 200 of 600: not
    got = defaultdict(set)
    for r in near.groups(docs(spark, rows)).collect():
        got[r.group_id].add(r.doc_id)
    assert dict(got) == {0: set(range(30))}
