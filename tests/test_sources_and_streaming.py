import numpy as np
from pyspark.sql import functions as F

from quernstone import cli
from quernstone.operators import expand, providers
from quernstone.sources import tables as S
from quernstone.streaming.incremental import expand_new


def test_text_dialects(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('1\tone\ttab\nno text\n2\t"quoted"\n')
    assert sorted(map(tuple, S.read_pairs(spark, str(tmp_path / "c.tsv")).collect())) == [("1", "one\ttab"), ("2", '"quoted"')]
    assert sorted(map(tuple, S.read_pairs_csv(spark, str(tmp_path / "c.tsv")).collect())) == [("1", "one"), ("2", "quoted")]
    (tmp_path / "ids").write_text(" 1 \n\n2\n2\n")
    assert sorted(r[0] for r in S.read_ids(spark, str(tmp_path / "ids")).collect()) == ["1", "2"]
    both = S.read_queries(spark, str(tmp_path / "c.tsv"), str(tmp_path / "missing"))
    assert both.count() == 2
    (tmp_path / "qrels").write_text("q 0 d 1\nq\t0\te\t-1\nbad\n")
    assert sorted(map(tuple, S.read_qrels(spark, str(tmp_path / "qrels")).collect())) == [("q", "d", 1), ("q", "e", -1)]


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("10", "a", 1, 0.5, "t"), ("9", "b", 1, 0.25, "t"), ("x", "c", 2, 0.125, "t")], S.RUN)
    S.write_run(run, str(tmp_path / "run"))
    assert sorted(map(tuple, S.read_run(spark, str(tmp_path / "run")).collect())) == sorted(map(tuple, run.collect()))
    assert [r["value"].split()[0] for r in S.run_lines(run).collect()] == ["9", "10", "x"]
    keys = spark.createDataFrame([("9",)], "qid string")
    assert S.read_run(spark, str(tmp_path / "run"), 1, keys).count() == 1
    assert S.read_run(spark, str(tmp_path / "run"), qids=keys.limit(0)).count() == 3  # no keys filter nothing


def test_matrix(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    (tmp_path / "m.bin").write_bytes(S.matrix_bytes(x))
    rows = S.read_matrix(spark, str(tmp_path / "m.bin"), 3).orderBy("row").collect()
    assert [r["embedding"] for r in rows] == x.tolist()


def test_hashed_sample_of_a_hot_key(spark):
    rows = spark.range(20_000).select((F.col("id") % 4 * (F.col("id") % 7 == 0).cast("int")).alias("k"), F.col("id").alias("v"))
    assert sorted(map(tuple, S.hashed_sample(rows, "k", 100).collect())) == [(0, 0), (1, 21), (2, 14), (3, 7)]
    many = spark.range(9_000).select(F.greatest(F.col("id") - 3_000, F.lit(0)).alias("k"), F.lit(1).alias("v"))
    assert S.hashed_sample(many.repartition(5), "k", 30).count() == 30
    assert sorted(S.hashed_sample(many, "k", 30).collect()) == sorted(S.hashed_sample(many.repartition(5), "k", 30).collect())


def test_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(100).repartition(8).write.option("parquet.block.size", 1024).parquet(f"{tmp_path}/many")
    assert S.spread(spark.read.parquet(f"{tmp_path}/one")).rdd.getNumPartitions() == 4
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert "Exchange" not in S.spread(spark.read.parquet(f"{tmp_path}/many"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hashed_sample_is_the_same_at_any_size(spark):
    rows = spark.range(5000).withColumn("text", F.lit("x"))
    want = [r["id"] for r in rows.orderBy(F.xxhash64("id")).limit(20).collect()]
    assert [r["id"] for r in S.hashed_sample(rows, "id", 20, 5000).collect()] == want


def test_greedy_keep():
    sims = np.array([[1, 0.9, 0.1], [0.9, 1, 0.9], [0.1, 0.9, 1]])
    assert expand.greedy_keep(sims) == [0, 2]


def test_expand_goes_on_after_errors(spark):
    class Broken:
        def generate(self, prompts):
            raise RuntimeError("no model")

    docs = spark.createDataFrame([(1, "A first sentence about pulleys here. Another sentence about levers here."), (2, ""), (3, None)], "doc_id long, text string")
    parts = providers.NegationClassifier(), providers.HeadingQueries(), providers.HashingEncoder()
    fine = {r["doc_id"]: r for r in expand.expand(docs, providers.EchoGenerator(), *parts).collect()}
    assert fine[1]["raw_expansions"] and fine[1]["error"] is None and fine[1]["expanded"].startswith(fine[1]["original"] + " ")
    bad = {r["doc_id"]: r for r in expand.expand(docs, Broken(), *parts).collect()}
    assert bad[1]["raw_expansions"] == [] and "no model" in bad[1]["error"] and bad[1]["queries"]


def test_validate_added(spark):
    originals = spark.createDataFrame([(1, "A b c."), (2, "")], "doc_id long, text string")
    expanded = spark.createDataFrame([(1, "A b c. This is a long addition. This is not so at all."), (2, "kept as is"), (3, "no original")], "doc_id long, text string")
    done = expand.validate_added(expanded, originals, providers.NegationClassifier())
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got == {1: "A b c. This is a long addition.", 2: "kept as is", 3: "no original"}
    assert tuple(expand.keep_rates(done).first()) == (1, 1, 50.0)


def test_incremental_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    upper = lambda df: df.select("doc_id", F.upper("text").alias("text"))
    for n in range(2):
        spark.createDataFrame([(n, "a"), (n + 1, "b")], "doc_id long, text string").write.mode("append").parquet(source)
        expand_new(spark, source, target, mark, upper).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "d.tsv").write_text("1\tapple banana split\n2\tcherry pie now\n")
    (tmp_path / "q.tsv").write_text("q1\tcherry\n")
    (tmp_path / "qrels").write_text("q1 0 2 1\n")
    at = lambda x: str(tmp_path / x)
    cli.main(["index", at("d.tsv"), at("index")], spark)
    cli.main(["search", at("index"), at("q.tsv"), at("run")], spark)
    cli.main(["evaluate", at("run"), at("qrels")], spark)
    assert "| bm25 |" in capsys.readouterr().out
    cli.main(["expand", at("d.tsv"), at("expanded"), "--queries-only"], spark)
    assert S.read_pairs(spark, at("expanded")).count() == 2
    cli.main(["info"], spark)
