import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import termfreq, topn

SCHEMA = "qid string, tag string, passage_id string, score double, rank string, item string, bound double"


def best(rows, n):
    """Brute force."""
    held = {}
    for q, t, p, s in rows:
        if p is not None and s is not None and s == s:
            held.setdefault((q, t), {})[p] = max(s, held.get((q, t), {}).get(p, s))
    return {(q, t, p) for (q, t), g in held.items() for p, _ in sorted(g.items(), key=lambda x: (-x[1], x[0]))[:n]}


def found(df, n):
    return {tuple(r) for r in topn.top_n_per_group(df, ["qid", "tag"], "passage_id", "score", n).select("qid", "tag", "passage_id").collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        q = "hot" if rng.random() < 0.4 else rng.choice(["a", "", "=", None, "é"])
        s = rng.choice([None, float("nan"), -0.0, 0.0, float("inf"), -float("inf"), rng.randrange(30) / 10])
        rows.append((q, rng.choice(["x", None]), rng.choice([None, *map(str, range(150))]), s))
    rows += rows[:200]
    # extra columns with the names that are used inside
    df = spark.createDataFrame([(*r, "z", "z", 9.0) for r in rows], SCHEMA).repartition(5)
    for n in (1, 3, 10, 500):
        assert found(df, n) == best(rows, n)


def test_bounds_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(topn, "BROADCAST_BYTES", 0)
    rows = [("g", "t", str(i), 1.0) for i in range(300)] + [("h", None, str(i), float(i % 7)) for i in range(40)]
    df = spark.createDataFrame([(*r, "z", "z", 9.0) for r in rows], SCHEMA).repartition(6)
    assert found(df, 4) == best(rows, 4)


def test_only_what_reaches_the_bound_is_shuffled(spark):
    """One scan, pruned once, and the filter stands before the only exchange of the rows."""
    df = spark.range(40_000).select(F.lit("g").alias("qid"), F.lit("t").alias("tag"), F.col("id").cast("string").alias("passage_id"), F.lit(1.0).alias("score"))
    ranked = topn.top_n_per_group(df.repartition(4), ["qid", "tag"], "passage_id", "score", 10)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin") and ranked.count() == 10


def test_pruning_while_gathering(spark, monkeypatch):
    df = spark.range(20_000).select(F.lit("g").alias("qid"), F.lit("t").alias("tag"), F.col("id").cast("string").alias("passage_id"), (F.col("id") % 1000).cast("double").alias("score"))
    run = topn._survivors(5, 2)
    monkeypatch.setattr(topn, "PRUNE_ROWS", 100)
    import pyarrow as pa

    table = pa.table({"g0": ["=g"] * 1000, "g1": ["=t"] * 1000, "item": [str(n) for n in range(1000)], "score": [float(n % 100) for n in range(1000)]})
    out = pa.Table.from_batches(list(run(iter(table.to_batches(max_chunksize=64)))))
    assert out.num_rows == 5 and set(out["score"].to_pylist()) == {99.0} and sum(out["is_bound"].to_pylist()) == 1
    assert len(found(df, 5)) == 5


def test_empty_and_types(spark):
    assert found(spark.createDataFrame([], SCHEMA), 3) == set()
    df = spark.createDataFrame([(1, 5, 2.0), (1, 6, 2.0), (2, 7, 1.0)], "k int, item int, score double")
    got = topn.top_n_per_group(df, ["k"], "item", "score", 1)
    assert got.schema["k"].dataType.simpleString() == "int" and {tuple(r)[:2] for r in got.collect()} == {(1, 5), (2, 7)}
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["k"], "item", "score", 0)


def counts(rows):
    pairs = {}
    for t, d, f in rows:
        if t is not None and d is not None and f is not None and f >= 1:
            t = t.strip().lower()
            pairs[t, d] = max(f, pairs.get((t, d), 0))
    out = {}
    for (t, _), f in pairs.items():
        a, b = out.get(t, (0, 0))
        out[t] = (a + f, b + 1)
    return out


@pytest.mark.parametrize("capacity", [50, 100_000])
def test_terms_against_brute_force(spark, capacity, monkeypatch):
    monkeypatch.setattr(termfreq, "LEAST", 10)
    rng = random.Random(5)
    rows = [(rng.choice([None, "", " ", "HOT", "hot", " Hot　", "hot", *[f"t{n}" for n in range(80)]]), rng.choice([None, *range(40)]), rng.choice([None, -1, 0, 1, 2, 7])) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "term string, doc int, freq int, h string, target int")
    got = {r["term"]: (r["freq"], r["docs"]) for r in termfreq.term_frequencies(df, "term", "doc", "freq", capacity).collect()}
    assert got == counts(rows)
    records = {d for t, d, f in rows if t is not None and d is not None and f is not None and f >= 1}
    marks = {r["term"]: r["mark"] for r in termfreq.marked_terms(df, "term", "doc", "freq", 3, 0.5, capacity).collect()}
    assert marks == {t: "rare" if f <= 3 else "common" if n > 0.5 * len(records) else None for t, (f, n) in counts(rows).items()}


def placed(df, capacity, n=None):
    rows = df.select("term", F.col("doc").cast("string").alias("doc"), F.col("freq").cast("long").alias("freq")).withColumn("h", F.xxhash64("term"))
    return termfreq.radix_placed(rows, n or df.count(), capacity)


def test_hot_terms_are_cut_by_record(spark):
    df = spark.range(6_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("term"), F.col("id").alias("doc"), F.lit(1).alias("freq"))
    got, parts, by_record = placed(df, 300)
    held = {r["target"]: (r["count"], r["terms"]) for r in got.groupBy("target").agg(F.count(F.lit(1)).alias("count"), F.collect_set("term").alias("terms")).collect()}
    assert by_record and max(held) < parts and max(n for n, _ in held.values()) <= 300 and sum("hot" in t for _, t in held.values()) > 13
    assert all(len(t) == 1 or "hot" not in t for _, t in held.values())


def test_one_pair_in_most_rows(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "LEAST", 10)
    df = spark.range(4_000).select(F.lit("hot").alias("term"), F.greatest(F.col("id") - 3_500, F.lit(0)).alias("doc"), (F.col("id") % 5 + 1).alias("freq"))
    got, _, _ = placed(df, 300)
    assert got.count() < 600
    assert termfreq.term_frequencies(df, "term", "doc", "freq", 300).collect() == [("hot", 5 + sum(n % 5 + 1 for n in range(3_501, 4_000)), 500)]


def test_the_plan_does_not_grow_with_the_buckets(spark):
    df = spark.range(50_000).select(F.col("id").cast("string").alias("term"), F.lit(1).alias("doc"), F.lit(1).alias("freq"))
    got, parts, _ = placed(df, 1)
    assert parts > 50_000 and len(got._jdf.queryExecution().optimizedPlan().toString()) < 10_000


def test_no_folder_to_spill_to(spark, monkeypatch):
    monkeypatch.setattr(termfreq, "durable_folder", lambda _: "hdfs://there/shared")
    with pytest.raises(ValueError):
        termfreq.term_frequencies(spark.createDataFrame([], "term string, doc int, freq int"), "term", "doc", "freq")


def test_no_terms(spark):
    assert termfreq.marked_terms(spark.createDataFrame([], "term string, doc int, freq int"), "term", "doc", "freq").collect() == []
