"""Small tests of the text operators: against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=None):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC)
    for name in extra or ():
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


CLASH = ["d", "v", "k", "n", "label", "toxic", "score", "p", "spans"]
ODD = [(None, "null id here " * 30, "a"), (901, None, "a"), (902, "", None), (903, " \n\t ", "b"), (904, "one", "b"), (904, "one", "b")]


# --- toxicity -------------------------------------------------------------------------------------------


def toxic_corpus():
    rows, labels = [], []
    for i in range(480):
        w = words(60, i)
        if i % 3 == 0:
            w[i % 50] = w[(i + 7) % 50] = "vile" if i % 2 else "nasty"
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    return rows, labels


def test_toxicity_held_out(spark):
    from terraloom.llm.toxicity import classify

    rows, labels = toxic_corpus()
    table = spark.createDataFrame(labels[:360] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.is_toxic for r in classify(docs(spark, rows + ODD, CLASH), table).collect()}
    held = list(range(360, 480))
    assert sum(got[i] == (i % 3 == 0) for i in held) >= 0.95 * len(held)
    assert not any(got[i] for i in (901, 902, 903))


def test_toxicity_without_labels(spark):
    from terraloom.llm.toxicity import classify

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.is_toxic for r in classify(docs(spark, ODD), none).collect()] == [False] * len(ODD)
    assert classify(docs(spark, []), none).count() == 0


# --- packing --------------------------------------------------------------------------------------------


def best_fit(items, window):
    rooms = []
    for s in sorted(items, reverse=True):
        best = min((r for r in rooms if r >= s), default=None)
        if best is None:
            rooms.append(window - s)
        else:
            rooms[rooms.index(best)] = best - s
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_packing_plan_is_best_fit_decreasing(seed):
    from terraloom.llm.packing import plan

    r = random.Random(seed)
    window = r.choice([5, 16, 50, 128])
    items = [r.randint(1, window - 1) for _ in range(r.randint(0, 300))]
    runs, n = plan(Counter(items), window)
    fill = defaultdict(list)
    for length, _, m, first, per, offset in runs:
        for k in range(m):
            fill[first + k // per].append((offset + k % per * length, length))
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
    assert sorted(window - sum(x for _, x in fill[w]) for w in range(n)) == best_fit(items, window)


def test_packing_covers_every_token(spark):
    from terraloom.llm.packing import pack

    rows = [(i, " ".join(words(n, i)), "s") for i, n in enumerate([3, 10, 10, 7, 55, 20, 1, 19, 100])] + ODD
    out = pack(docs(spark, rows, CLASH), 20).collect()
    spans = defaultdict(list)
    for r in out:
        spans[r.window_id].append((r.offset, r.length))
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 20
    assert sum(r.length for r in out) == sum(len((t or "").split()) for _, t, _ in rows)
    assert sorted(spans) == list(range(len(spans)))
    assert pack(docs(spark, []), 20).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------


def test_mixing_balances_documents_and_tokens(spark):
    from terraloom.llm.mixing import draw, select_rows

    rows = [(i, " ".join(words(20 + i * 7 % 80, i)), f"s{min(i % 5, 2)}") for i in range(900)] + ODD
    d = docs(spark, rows, CLASH)
    by = defaultdict(list)
    for r in draw(d, alpha=0.5, block=64).collect():
        by[r.s].append((r.n, r.pi))
    for s in ("s0", "s1", "s2"):
        own = [len(t.split()) for _, t, x in rows if x == s]
        pi = by[s][0][1]
        assert abs(len(by[s]) - pi * len(own)) <= 1
        assert abs(sum(n for n, _ in by[s]) - pi * sum(own)) <= max(own)
    kept = select_rows(d, alpha=0.5)
    assert kept.columns == d.columns and kept.filter("source IS NULL").count() == 1
    weights = {r["source"]: r["count"] for r in select_rows(d, {"s0": 1.0, "s1": 0.0}).groupBy("source").count().collect()}
    assert list(weights) == ["s0"]
    assert select_rows(docs(spark, [])).count() == 0


def test_flight_keeps_totals():
    from terraloom.llm.mixing import flight, land

    rng = np.random.Generator(np.random.PCG64(1))
    n = rng.integers(1, 500, 400).astype(float)
    p = flight(np.full(400, 0.3), n, rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - 120) < 1e-6 and abs((p * n).sum() - 0.3 * n.sum()) < 1e-4
    assert set(land(p, n)) <= {0.0, 1.0}


# --- suffix-array dedup ---------------------------------------------------------------------------------


def repeated_words(rows, length):
    first, out = {}, set()
    for i, t, _ in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        w = t.split()
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            if first.setdefault(key, i) < i:
                out |= {(i, j) for j in range(a, a + length)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_suffix_matches_brute_force(spark, seed):
    from terraloom.llm.suffix import passages

    r = random.Random(seed)
    shared = [words(r.randint(50, 90), 1000 + i) for i in range(4)] + [["a"] * 70, words(49, 7)]
    rows = []
    for i in range(40):
        w = words(r.randint(0, 120), seed * 100 + i)
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(w))
            w[at:at] = r.choice(shared)
        rows.append((i, " ".join(w), "s"))
    rows += ODD + [(500, rows[3][1], "s"), (500, rows[3][1], "s")]
    got = {(x.doc_id, j) for x in passages(docs(spark, rows, CLASH)).collect() for j in range(x.start, x.start + x.length)}
    assert got == repeated_words(rows, 50)


def test_suffix_cut(spark):
    from terraloom.llm.suffix import cut_rows

    p = " ".join(words(60, 5))
    d = docs(spark, [(1, f"head {p} tail", "s"), (2, f"Other  {p}\nend", "s"), (3, p, "s"), *ODD], CLASH)
    got = {r.doc_id: r.text for r in cut_rows(d).collect() if r.doc_id in (1, 2, 3)}
    assert got == {1: f"head {p} tail", 2: "Other  end"}
    assert cut_rows(d).columns == d.columns and cut_rows(d).count() == 2 + len(ODD)
    assert cut_rows(docs(spark, [])).count() == 0


def test_level_sizes_are_geometric():
    from terraloom.llm.suffix import Index

    index, rng = Index(), np.random.Generator(np.random.PCG64(3))
    for i in range(60):
        index.add(rng.integers(0, 1 << 60, 50).astype(np.uint64), np.full(50, i))
    sizes = [len(x) for x, _ in index.levels]
    assert sum(sizes) == 3000 and len(sizes) <= 7 and all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


# --- HTML -----------------------------------------------------------------------------------------------


def page_rows():
    rows = []
    for i in range(60):
        host = f"h{i % 3}.example.org"
        body = " ".join(words(i % 40, i)) + (" shared block of exactly eight words in here " if i % 4 == 0 else "")
        rows.append((i, f"https://{host}/p{i}", f"<html><head><title>t{i}</title></head><body><nav>home about contact us now please {host}</nav><script>x</script><p>{body}&amp;</p><!-- c --></body></html>"))
    return rows + [(70, None, "<p>home about contact us now please</p>"), (71, "x", ""), (72, "https://h0.example.org", None), (None, "https://h0.example.org/z", "<p>home about contact us now please"), (3, rows[3][1], rows[3][2])]


@pytest.mark.parametrize(("held", "most"), [(1 << 20, 1 << 24), (50, 1 << 24), (50, 4000), (1 << 20, 1)])
def test_html_matches_brute_force(spark, monkeypatch, held, most):
    from terraloom.llm import html
    from terraloom.llm.html import extract, visible_text

    monkeypatch.setattr(html, "HELD", held)
    rows = page_rows()
    rows.append((5, rows[5][1], "<p>quite another page of the same number home about contact us now please x</p>"))
    seen = defaultdict(set)
    split = [(i, u.split("/")[2] if u and "//" in u else f"none{k}", visible_text(h).split()) for k, (i, u, h) in enumerate(rows)]
    for k, (i, host, w) in enumerate(split):
        for a in range(len(w) - 5):
            seen[host, tuple(w[a : a + 6])].add(("null", k) if i is None else i)
    want = Counter()
    for i, host, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - 5):
            if len(seen[host, tuple(w[a : a + 6])]) > 1:
                gone[a : a + 6] = [True] * 6
        want[i, " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS d", "'y' AS salt")
    assert Counter((r.page_id, r.text) for r in extract(df, split=most).collect()) == want
    assert extract(df.limit(0)).count() == 0


# --- near duplicates ------------------------------------------------------------------------------------


def edited(w, share, r):
    return [f"e{r.randrange(10**6)}" if r.random() < share else x for x in w]


def test_banded_alignment_is_edit_distance():
    from terraloom.llm.align import banded

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for seed in range(3000):
        r = random.Random(seed)
        a, b = ([r.randrange(r.choice([2, 5, 20])) for _ in range(r.randint(0, 12))] for _ in "ab")
        for most in (0, 2, 5, 20):
            assert banded(a, b, most) == min(full(a, b), most + 1)


def test_near_groups_match_brute_force(spark):
    from terraloom.llm.align import similar
    from terraloom.llm.near import groups, keep_one, word_codes

    r, rows = random.Random(4), []
    passage = words(60, 999)
    for g in range(25):
        base = words(r.randint(5, 300), g)
        for _ in range(r.randint(1, 4)):
            rows.append((len(rows), " ".join(edited(base, r.choice([0, 0.03, 0.1]), r)), "s"))
    for _ in range(30):
        rows.append((len(rows), " ".join(words(150, 5000 + len(rows)) + passage), "s"))
    rows += ODD + [(2, rows[2][1], "s")]
    codes = [np.frombuffer(x, np.uint32) for x in word_codes(pa.array([t for _, t, _ in rows])).to_pylist()]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if rows[a][0] is not None and rows[b][0] is not None and len(codes[a]) and len(codes[b]) and similar(codes[a], codes[b], 0.7) >= 0.7:
                parent[find(a)] = find(b)
    want = defaultdict(set)
    for i, (d, t, _) in enumerate(rows):
        if d is not None and (t or "").split():
            want[find(i)].add(d)
    want = {frozenset(x) for x in want.values() if len(x) > 1}
    d = docs(spark, rows, CLASH)
    got = defaultdict(set)
    for x in groups(d).collect():
        got[x.group_id].add(x.doc_id)
    assert {frozenset(x) for x in got.values()} == want and all(min(x) == k for k, x in got.items())
    kept = keep_one(d)
    gone = sum(len(x) - 1 for x in want)
    assert kept.columns == d.columns and kept.count() == len(rows) - gone - 2  # two ids come twice
    assert groups(docs(spark, [])).count() == 0 and keep_one(docs(spark, [])).count() == 0


# --- nearest neighbours ---------------------------------------------------------------------------------


def test_ann_recall(spark):
    from terraloom.llm.ann import neighbours

    x = np.random.Generator(np.random.PCG64(2)).normal(size=(900, 16)).astype(np.float32)
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(5, x[5].tolist(), "c"), (None, x[0].tolist(), "c"), (2000, None, "c"), (2001, [], "c"), (2002, [1.0] * 5, "c"), (2003, [float("nan")] * 16, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = defaultdict(list)
    for r in neighbours(df, 10, shard_rows=300).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbor_id)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :10]
    assert sorted(got) == list(range(900))
    assert np.mean([len(set(got[i]) & set(true[i].tolist())) / 10 for i in range(900)]) >= 0.9
    assert neighbours(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, [0.0, 0.0], "c"), (2, [0.0, 0.0], "c")], "vec_id long, embedding array<float>, shard string")
    assert sorted((r.vec_id, r.neighbor_id, r.distance) for r in neighbours(few).collect()) == [(1, 2, 0.0), (2, 1, 0.0)]


# --- isolation forest -----------------------------------------------------------------------------------


def test_isolation_flags_junk_and_keeps_clean(spark):
    from terraloom.llm.isolation import anomalies

    rows, labels = [], []
    for i in range(300):
        w = words(80, i)
        bad = i % 10 == 0
        rows.append((i, " ".join(f"{x}%%%" for x in w) if bad and i % 20 else " ".join(["again"] * 80) if bad else " ".join(w), "s"))
        labels.append((i, int(not bad), 0))
    table = spark.createDataFrame(labels[:200] + [(None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.is_anomalous for r in anomalies(docs(spark, rows + ODD, CLASH), table).collect()}
    held = range(200, 300)
    assert all(got[i] for i in held if i % 10 == 0) and sum(got[i] for i in held if i % 10) <= 2
    assert got[901] and got[902] and got[903]
    assert anomalies(docs(spark, []), table).count() == 0


# --- pipeline -------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = toxic_corpus()
    copy, passage = rows[1][1], " ".join(words(60, 7777))
    rows = [(i, t, f"s{i % 2}") for i, t, _ in rows]
    rows += [(600, copy, "s0"), (601, f"{' '.join(words(90, 601))} {passage}", "s0"), (602, f"{' '.join(words(90, 602))} {passage}", "s0"), *ODD]
    docs(spark, rows, ["extra"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = stage["toxicity"](spark, start, str(tmp_path))
    assert clean.columns == start.columns
    assert not {r.doc_id for r in clean.collect()} & {i for i in range(0, 480, 3)}
    one = stage["near duplicates"](spark, start, str(tmp_path))
    assert {1, 600} & {r.doc_id for r in one.collect()} == {1}
    cut = {r.doc_id: r.text for r in stage["suffix-array dedup"](spark, start, str(tmp_path)).collect()}
    assert passage in cut[601] and passage not in cut[602]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and not {i for r in out for i in r.doc_ids} & {0, 3, 6, 600}
