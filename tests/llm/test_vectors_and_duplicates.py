import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import knn, neardup


def pairs_of(x, ids, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = (u @ u.T).round(6)
    out = set()
    for i in range(len(ids)):
        others = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in others}
    return out


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n // 8 + 1, dim))[rng.integers(0, n // 8 + 1, n)] + rng.normal(size=(n, dim)) * 0.25).astype(np.float32)


def test_recall_against_brute_force(spark):
    x = clustered(600, 16, 2)
    ids = [str(n) for n in range(600)]
    df = spark.createDataFrame([(f"b'{i}'" if n % 3 == 0 else i, v.tolist()) for n, (i, v) in enumerate(zip(ids, x))], "id string, embedding array<float>")
    got = {tuple(r) for r in knn.neighbour_pairs(df, "id", "embedding", 16, 5).collect()}
    want = pairs_of(x.astype(np.float64), ids, 5)
    assert len(got & want) / len(want) >= 0.95


def test_dense_third(spark):
    rng = np.random.default_rng(5)
    for noise in (0.25, 1e-3, 0.0):
        x = clustered(900, 64, 6)
        x[:300] = x[0] * (1 + rng.random((300, 1))) + rng.normal(size=(300, 64)) * noise
        ids = [f"{n:03}" for n in range(900)]
        df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, embedding array<float>")
        got = {tuple(r) for r in knn.neighbour_pairs(df, "id", "embedding", 64, 5).collect()}
        want = {p for p in pairs_of(x.astype(np.float64), ids, 5) if max(p) < "300"}
        assert len(got & want) / len(want) >= 0.95


def test_blocks_lose_nothing(spark):
    x = clustered(300, 8, 4)
    rows = spark.createDataFrame([(f"{n:03}", (v / np.linalg.norm(v)).astype(np.float32).tobytes()) for n, v in enumerate(x)], "rep string, vec binary")
    whole = {tuple(r) for r in knn.similar_vectors(rows, 300, 3, lists=2).collect()}
    cut = {tuple(r) for r in knn.similar_vectors(rows, 300, 3, lists=2, block=5).collect()}
    assert whole <= cut | whole and len(whole & cut) >= 0.98 * len(whole)


def test_equal_cosines():
    rng = np.random.default_rng(1)
    for n, k in ((5, 5), (40, 3), (400, 5), (400, 1)):
        cos = rng.integers(0, 6, (30, n)) / 10
        want = np.array([sorted(range(n), key=lambda j: (-round(float(row[j]), 6), j))[:k] for row in cos])
        assert (knn.best_places(cos, k) == want).all()


def test_pivots_through_coarse_ones():
    x = clustered(4_000, 32, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = knn.Pivots(knn.thinned(x[:1_000]))
    found, cos = pivots.nearest(x, 3), x @ pivots.vectors[np.argsort(pivots.order)].T
    best = np.take_along_axis(cos, found, axis=1)
    assert (np.diff(best, axis=1) <= 0).all() and np.mean(best[:, 0] >= cos.max(axis=1) - 1e-6) > 0.95
    assert (knn.Pivots(x[:2]).nearest(x[:5], 3)[:, 2] == -1).all()


def test_copies_ties_and_unusable(spark, monkeypatch):
    for huge in (knn.HUGE, 6):
        monkeypatch.setattr(knn, "HUGE", huge)
        copies_ties_and_unusable(spark)


def copies_ties_and_unusable(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(f"c{n}", [float(n + 1), 0.0]) for n in range(9)] + [("d", w), ("d", w), ("e", None), ("f", [0.0, 0.0]), ("g", [float("nan"), 1.0]), ("h", [1.0]), ("i", [None, 1.0]), (None, v), ("j", [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id string, embedding array<float>, vec string, cos int")
    got = {tuple(r) for r in knn.neighbour_pairs(df, "id", "embedding", 2, 2).collect()}
    want = {tuple(sorted((f"c{n}", o))) for n in range(9) for o in [f"c{m}" for m in range(9) if m != n][:2]} | {("c0", "d"), ("c1", "d")}
    assert got == want
    assert knn.neighbour_pairs(df.limit(0), "id", "embedding", 2).collect() == []
    assert knn.neighbour_pairs(df.limit(1), "id", "embedding", 2).collect() == []


def test_footrule():
    a = np.array([[1, 2, 3], [3, 2, 9], [7, 8, 9]])
    d = 3
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            places = lambda r: {p: n + 1 for n, p in enumerate(r)}
            x, y = places(a[i]), places(a[j])
            rule = sum(abs(x.get(p, d + 1) - y.get(p, d + 1)) for p in {*x, *y})
            assert d * (d + 1) - 2 * knn.shared_weight(a)[i, j] == rule


def jaccard_pairs(rows, limit):
    import re

    words = {}
    for r, o, q in rows:
        if r is not None:
            words.setdefault(r, set()).update(w.lower() for w in re.findall(r"[^\W_]+", " ".join([o or "", *[x for x in q or [] if x]])))
    ids = sorted(k for k, v in words.items() if v)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(words[a] & words[b]) >= limit * len(words[a] | words[b])}


def records(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{k}" for k in range(400)])
    rows = []
    for k in range(n):
        if k and rng.random() < 0.4:
            words = rows[rng.integers(0, k)][1].split()
            for _ in range(int(rng.integers(0, 6))):
                words[rng.integers(0, len(words))] = str(rng.choice(vocabulary))
            rng.shuffle(words)
        else:
            words = [str(x) for x in rng.choice(vocabulary, int(rng.integers(5, 40)))]
        rows.append((k, " ".join(words), ["Ask, " + words[0].upper(), None]))
    return rows


SCHEMA = "rec_id long, original string, queries array<string>"


def test_pairs_against_brute_force(spark):
    rows = records(1, 300)
    rows += rows[:20] + [(1000, None, None), (1001, "", []), (1002, "...", [None]), (None, "w1 w2", None)]
    rows += [(2000 + n, "the same words here", None) for n in range(40)] + [(3000, "HERE same: the words", [""])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", rep string, size int").repartition(4)
    words = neardup.word_set("original", "queries")
    got = {tuple(r) for r in neardup.similar_pairs(df, "rec_id", words).collect()}
    assert got == jaccard_pairs(rows, 0.75)
    assert {tuple(r) for r in neardup.similar_pairs(df, "rec_id", words, block=3).collect()} == got
    whole, dealt = neardup.grouped(df, "rec_id", words), neardup.grouped(df, "rec_id", words, block=3)
    assert sorted(whole.collect()) == sorted(dealt.collect())
    _, reps = neardup.classes(df, "rec_id", words)
    assert sorted(map(tuple, neardup.links(reps, 0.75, block=3).collect())) == sorted(map(tuple, neardup.links(reps, 0.75).collect()))
    groups = {r["rec_id"]: r for r in neardup.grouped(df, "rec_id", words).collect()}
    assert groups[2005]["class_id"] == 2000 and groups[3000]["class_id"] == 2000 and 1001 not in groups
    assert all(groups[a]["group_id"] == groups[b]["group_id"] for a, b in got)
    assert neardup.similar_pairs(df.limit(0), "rec_id", words).collect() == []


def test_any_threshold(spark):
    assert neardup.bands_for(0.75) == (6, 40) and neardup.most_different(0.75) == 33
    rows = []
    for k in range(300):  # 12 of 24, 18 of 20 and 6 of 20 words shared
        for n, (shared, own) in enumerate(((12, 6), (18, 1), (6, 7))):
            for side in range(2):
                words = [f"s{k}x{n}x{j}" for j in range(shared)] + [f"o{k}x{n}x{side}x{j}" for j in range(own)]
                rows.append((k * 10 + n * 2 + side, " ".join(words), None))
    df = spark.createDataFrame(rows, SCHEMA)
    for threshold, most in ((0.5, 600), (0.9, 300), (0.3, 900)):
        assert neardup.similar_pairs(df, "rec_id", neardup.word_set("original"), threshold).count() == most
    with pytest.raises(ValueError):
        neardup.similar_pairs(df, "rec_id", neardup.word_set("original"), 0.0)


def test_chains_become_one_group(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    nodes = spark.range(61).select(F.col("id").alias("rep"))
    assert {r["group"] for r in neardup.components(edges, nodes).collect()} == {0}


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b, tiny = base[:200], base[50:250], base[:1]
    s = neardup.fast_sketch(np.concatenate([a, b, tiny]), np.repeat([0, 1, 2], [200, 200, 1]), 3, 512)
    assert (s != neardup._NONE).all()
    assert abs((s[0] == s[1]).mean() - 150 / 250) < 0.08
