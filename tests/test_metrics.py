import pytest

from quernstone.operators import metrics


def rows(spark):
    run = spark.createDataFrame([("q", d, n, 1.0 / n, "t") for n, d in enumerate("abcd", 1)] + [("u", "a", 1, 1.0, "t")], "qid string, doc_id string, rank int, score double, tag string")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "c", 1), ("q", "z", 1), ("q", "a", 0)], "qid string, doc_id string, rel int")
    return run, qrels


def test_hand_checked(spark):
    run, qrels = rows(spark)
    r = metrics.evaluate(run, qrels, ks=(4,)).collect()
    assert len(r) == 1  # the query without judgements is left out
    r = r[0]
    assert r["mrr@10"] == 0.5 and r["recall@4"] == pytest.approx(2 / 3) and r["map"] == pytest.approx(0.388889, abs=1e-6)
    assert r["ndcg@4"] == pytest.approx(0.669672, abs=1e-6) and r["p@10"] == 0.2
    assert metrics.evaluate(run, qrels, ks=(4,), ideal="qrels").first()["ndcg@4"] == pytest.approx(0.562727, abs=1e-6)
    assert metrics.evaluate(run, qrels, ks=(4,), min_rel=None).first()["mrr@10"] == 1.0


def test_summary_and_improvement(spark):
    run, qrels = rows(spark)
    s = metrics.compare(run, qrels)
    assert s.first()["num_queries"] == 1 and s.first()["method"] == "t"
    table = spark.createDataFrame([("m", "original", 0.5), ("m", "x", 0.75), ("n", "x", 0.1)], "g string, v string, value double")
    got = {(r["g"], r["v"]): r["improvement"] for r in metrics.relative_improvement(table, "value", "original", "g", "v").collect()}
    assert got == {("m", "original"): 0.0, ("m", "x"): 0.5, ("n", "x"): None}
