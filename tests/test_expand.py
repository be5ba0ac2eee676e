"""What happens when providers fail, and the jobs around the expansion."""

import numpy as np

from quernstone.operators import expand, metrics, providers


def failing():
    """Made in a function, so they travel to the tasks by value."""

    class Failing(providers.NegationClassifier):
        """Fails on every batch that holds the word poison."""

        def classify(self, pairs):
            if any("poison" in h for _, h in pairs):
                raise RuntimeError("no label")
            return super().classify(pairs)

    class FailingEncoder(providers.HashingEncoder):
        def encode(self, texts):
            if any("poison" in t for t in texts):
                raise RuntimeError("no code")
            return super().encode(texts)

    class Mute:
        def generate(self, prompts):
            if any("poison" in p for p in prompts):
                raise RuntimeError("no answer")
            return [" one more fact. "] * len(prompts)

    return Failing(), FailingEncoder(), Mute()


def test_a_failing_classifier_rejects_its_pairs_only(spark):
    df = spark.createDataFrame([(1, "It works.", ["It works.", "the poison pair", "a fine pair"]), (2, "Other.", ["it never works", "plain"]), (3, "None.", None)], "id int, p string, h array<string>")
    got = {r["id"]: (r["valid"], r["valid_error"]) for r in providers.entail(df, "p", "h", failing()[0]).collect()}
    assert got == {1: (["It works.", "a fine pair"], "no label"), 2: (["plain"], None), 3: ([], None)}


def test_combining_falls_back(spark):
    rows = [(1, "A text on valves.", ["the poison of the river", "the poison of the river"], ["what about valves"]), (2, "Another text.", ["a fact of some length", "a fact of some length"], [])]
    df = spark.createDataFrame(rows, "id int, doc string, sem array<string>, ask array<string>")
    got = {r["id"]: r for r in expand.combine(df, "doc", "sem", "ask", failing()[1]).collect()}
    assert got[1]["final"] == ["the poison of the river", "the poison of the river", "what about valves"] and got[1]["combine_error"] == "no code"
    assert got[1]["expanded"].startswith("A text on valves. the poison")
    assert got[2]["final"] == ["a fact of some length"] and got[2]["combine_error"] is None


def test_single_prompt(spark):
    docs = spark.createDataFrame([("a", "A text."), ("b", "poison"), ("c", None)], "doc_id string, text string").repartition(3, "doc_id")
    got = {r["doc_id"]: (r["expanded"], r["error"]) for r in expand.expand_single_prompt(docs, failing()[2]).collect()}
    assert got["a"][0] in ("A text. one more fact.", "A text.") and got["b"] == ("poison", "no answer") and got["c"][0] is None


def test_timed(spark):
    run, latency = metrics.timed(lambda: spark.range(3).withColumnRenamed("id", "qid"), 3)
    assert run.count() == 3 and latency > 0


def test_matrix_with_ids(spark, tmp_path):
    from quernstone.sources import tables as S

    (tmp_path / "m.bin").write_bytes(S.matrix_bytes(np.arange(6).reshape(3, 2)))
    (tmp_path / "ids.txt").write_text("x\ny\nz\n")
    got = {r["doc_id"]: list(r["embedding"]) for r in S.read_matrix(spark, str(tmp_path / "m.bin"), 2, str(tmp_path / "ids.txt")).collect()}
    assert got == {"x": [0, 1], "y": [2, 3], "z": [4, 5]}


def test_limits_of_query_files(spark, tmp_path):
    from quernstone.sources import tables as S

    (tmp_path / "q.tsv").write_text("1\ta\n2\tb\n3\tc\n")
    assert S.read_queries(spark, str(tmp_path / "q.tsv"), limit=2).count() == 2
