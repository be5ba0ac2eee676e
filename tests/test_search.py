import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import dense, fusion, index, sparse


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "apple banana"), (2, "apple apple cherry"), (3, "date"), (4, "elder"), (5, "fig"), (6, "the of"), (7, None)], "doc_id long, text string")


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "qid string, text string")


def test_index_counts_only_documents_with_terms(docs):
    own = index.build_index(docs)
    assert tuple(own.stats.first()) == (5, 1.6)
    assert {r["term"]: r["df"] for r in own.lexicon.collect()}["apple"] == 2


def test_bm25(spark, docs):
    own = index.build_index(docs)
    rows = sparse.bm25(own, ask(spark, ("a", "apple cherry"), ("b", "apple"), ("c", "apple apple"), ("d", "zzz")), 10).collect()
    by = {(r["qid"], r["doc_id"]): r for r in rows}
    assert by["a", 2]["rank"] == 1 and by["a", 1]["rank"] == 2
    idf = math.log(3.5 / 2.5)
    assert by["b", 1]["score"] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 1.6)), abs=1e-6)
    assert by["c", 2]["score"] == pytest.approx(2 * by["b", 2]["score"], abs=2e-6)
    assert not any(r["qid"] == "d" for r in rows)
    both = sparse.bm25(own, ask(spark, ("a", "apple cherry")), 10, mode="and").collect()
    assert [r["doc_id"] for r in both] == [2]


def test_frequent_terms_count_against(spark):
    docs = spark.createDataFrame([(n, "common") for n in range(4)] + [(4, "other")], "doc_id long, text string")
    own = index.build_index(docs)
    assert all(r["score"] < 0 for r in sparse.bm25(own, ask(spark, ("q", "common")), 10).collect())
    assert sparse.bm25(own, ask(spark, ("q", "common")), 10, positive=True).isEmpty()
    assert len(sparse.bm25(own, ask(spark, ("q", "common")), 10, posting_cap=2).collect()) == 2


def test_blocks_read_back(spark):
    docs = spark.createDataFrame([(n * 3, "word " * (n % 3 + 1)) for n in range(300)], "doc_id long, text string")
    postings = index.build_index(docs).postings
    blocks = index.posting_blocks(postings)
    assert sorted(r["n"] for r in blocks.collect()) == [44, 128, 128]
    more = postings.unionByName(postings.where("doc_id < 90").withColumn("term", F.lit("other")))
    assert sorted(map(tuple, index.posting_blocks(more, hot=40).collect())) == sorted(map(tuple, index.posting_blocks(more).collect()))
    assert sorted(map(tuple, index.unpacked(blocks).collect())) == sorted(map(tuple, postings.select("term", "doc_id", "tf").collect()))


def test_stored_index(spark, docs, tmp_path, monkeypatch):
    own = index.build_index(docs)
    index.write_index(own, str(tmp_path))
    stored = index.read_index(spark, str(tmp_path))
    queries = ask(spark, ("a", "apple cherry"), ("b", "fig"), ("d", "zzz"))
    want = sorted(map(tuple, sparse.bm25(own, queries, 10).collect()))
    assert sorted(map(tuple, sparse.bm25(stored, queries, 10).collect())) == want
    assert sorted(map(tuple, sparse.bm25(stored, queries, 10, floor=0.25).collect())) == sorted(map(tuple, sparse.bm25(own, queries, 10, floor=0.25).collect()))
    plan = stored.lookup(sparse.query_terms(queries))[0]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan and "ReadSchema: struct<term:string,doc_id:bigint,dl:bigint,tf:bigint>" in plan
    monkeypatch.setattr(index, "PUSHED_TERMS", 1)
    assert sorted(map(tuple, sparse.bm25(stored, queries, 10).collect())) == want


def test_many_queries_at_once():
    """Of 100,000 queries no more than AT_ONCE scores are worked out at a time, so a batch of 10,000 is taken in slices."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(2)
    q, x = rng.integers(-3, 4, (100_000, 2)).astype(np.float64), rng.integers(-3, 4, (120, 2)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(x.tolist(), pa.list_(pa.float32()))], ["doc_id", "embedding"])
    tracemalloc.start()
    out = list(dense._local_best(SimpleNamespace(value=(np.arange(100_000), q)), 2, "l2")(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()
    got = np.concatenate([b.column(1).to_numpy() for b in out]).reshape(-1, 2)
    for row in range(0, 100_000, 9_973):
        far = ((q[row] - x.astype(np.float64)) ** 2).sum(axis=1)
        assert sorted(got[row].tolist()) == sorted(np.lexsort((np.arange(120), far))[:2].tolist())


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(5)
    asked = rows.where("doc_id < 7").selectExpr("doc_id AS qid", "embedding")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for metric, score in (("cosine", u @ u.T), ("l2", -((x[:, None] - x[None]) ** 2).sum(-1))):
        want = {q: [int(i) for i in np.lexsort((np.arange(200), -score[q].astype(np.float64).round(6)))[:5]] for q in range(7)}
        got = {}
        for r in sorted(dense.dense_search(asked, rows, 5, metric).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["qid"], []).append(r["doc_id"])
        assert got == want
    assert dense.dense_search(asked.where("qid < 0"), rows, 5).isEmpty()


def test_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 3_000)] + rng.normal(size=(3_000, 16)) * 0.3).astype(np.float32)
    x[7] = 0
    rows = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "doc_id long, embedding array<float>").repartition(5)
    asked = rows.where("doc_id % 30 = 1").selectExpr("doc_id AS qid", "embedding")
    dense.write_lists(rows, str(tmp_path))
    found = {(r["qid"], r["doc_id"]) for r in dense.approximate_search(asked, str(tmp_path), 10, probes=12).collect()}
    true = {(r["qid"], r["doc_id"]) for r in dense.dense_search(asked, rows, 10).collect()}
    assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)
    assert spark.read.parquet(f"{tmp_path}/lists").count() == 2_999
    dense.write_lists(rows.limit(0), f"{tmp_path}/none")
    assert dense.approximate_search(asked, f"{tmp_path}/none", 3).isEmpty()


def test_rrf(spark):
    a = spark.createDataFrame([("q", d, n) for n, d in enumerate("xyz", 1)], "qid string, doc_id string, rank int")
    b = spark.createDataFrame([("q", d, n) for n, d in enumerate("yw", 1)], "qid string, doc_id string, rank int")
    got = {r["doc_id"]: round(r["score"], 6) for r in fusion.rrf([a, b]).collect()}
    assert got == {"y": 0.032522, "x": 0.016393, "w": 0.016129, "z": 0.015873}
    assert sorted(map(tuple, fusion.rrf([b, a]).collect())) == sorted(map(tuple, fusion.rrf([a, b]).collect()))
    assert {r["doc_id"] for r in fusion.rrf([a, b], depth=1).collect()} == {"x", "y"}


def test_hybrid_search_takes_whole_lists(spark, tmp_path):
    from quernstone.plans import catalog

    # of query 0, passage 11 is twelfth in both lists and each list has other passages before it
    words = {n: "apple " * (30 - n) + "filler " * n for n in range(12)}
    docs = [(n if n == 11 else 100 + n, w) for n, w in words.items()] + [(200 + n, "zebra") for n in range(40)]
    vectors = [(0, [1.0, 0.0])] + [(300 + n, [1.0, 0.01 * n]) for n in range(1, 11)] + [(11, [1.0, 0.2])] + [(400 + n, [1.0, 1.0 + n]) for n in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([("0", "apple")], "qid string, text string").selectExpr("*", "'dev' AS set_name", "timestamp '2020-01-01' AS created_at").write.parquet(f"{tmp_path}/queries.parquet")
    rows = catalog.QUERIES["hybrid_search_deep"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["rank"] for r in rows}[11] == 1
    assert len(rows) == 12 + 42 - 1
    assert next(r["score"] for r in rows if r["doc_id"] == 11) == pytest.approx(2 / 72, abs=1e-9)


def _by_rows(index_, queries, k, **more):
    """bm25 with no depth makes a row for each query and document."""
    rows = sparse.bm25(index_, queries, None, **more).where(F.col("rank") <= k)
    return sorted(map(tuple, rows.collect()))


def test_no_row_for_each_query_and_document(spark):
    """2,000 documents that all hold the query's words: the k best of a task are exchanged, not all that match."""
    docs = spark.range(2_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("apple banana "), F.repeat(F.lit("pear "), (F.col("id") % 7).cast("int"))).alias("text"))
    run = sparse.bm25(index.build_index(docs), ask(spark, ("a", "apple banana"), ("b", "pear apple")), 3)
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    assert len(run.collect()) == 6


def test_bounds_lose_no_document(spark, monkeypatch):
    """The same rows as from all pairs of query and document: frequent and rare terms, terms that count against, ties,
    repeated words, small blocks and parts."""
    from quernstone.operators import scoring

    rng = np.random.default_rng(5)
    words = np.array([f"w{n}" for n in range(60)])
    odds = 1 / np.arange(1, 61) ** 0.8
    odds /= odds.sum()
    rows = [(int(n) * 7 % 601, " ".join(["every"] * int(rng.integers(0, 3)) + rng.choice(words, int(rng.integers(1, 30)), p=odds).tolist())) for n in range(601)]
    rows += [(1_000 + n, rows[5][1]) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 7)), p=odds)) for _ in range(30)] + ["every", "every w3", "w1 w1 w40", rows[5][1], "nowhere", "nowhere w2"]
    queries = ask(spark, *[(f"q{n}", t) for n, t in enumerate(texts)])
    own = index.build_index(docs)
    monkeypatch.setattr(scoring, "DOCS", 100)
    for more in ({}, {"positive": True, "floor": 0.25}, {"mode": "and"}):
        assert sorted(map(tuple, sparse.bm25(own, queries, 5, **more).collect())) == _by_rows(own, queries, 5, **more)
    monkeypatch.setattr(sparse, "RESULTS", 60)
    named = index.build_index(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))
    assert sorted(map(tuple, sparse.bm25(named, queries, 5).collect())) == _by_rows(named, queries, 5)
    stems = index.build_index(docs, stem=True)
    assert sorted(map(tuple, sparse.bm25(stems, queries, 5).collect())) == _by_rows(stems, queries, 5)


@pytest.mark.parametrize("more", [{"mode": "and"}, {"stem": True}])
def test_no_row_for_each_query_and_document_in_other_searches(spark, more):
    docs = spark.range(500, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("apples banana").alias("text"))
    run = sparse.bm25(index.build_index(docs, stem=more.get("stem", False)), ask(spark, ("a", "apples banana")), 3, mode=more.get("mode", "or"))
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    assert [r["doc_id"] for r in sorted(run.collect(), key=lambda r: r["rank"])] == [0, 1, 2]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lexicon_exchanges_no_posting(spark, docs):
    """Terms are counted by document before the exchange, so a posting (with its doc_id) is never moved."""
    own = index.build_index(docs)
    lexicon = own.lexicon
    assert "doc_id" not in _plan(lexicon).split("Exchange")[0] and "hashpartitioning(doc_id" not in _plan(lexicon)
    assert {r["term"]: r["df"] for r in lexicon.collect()} == {"apple": 2, "banana": 1, "cherry": 1, "date": 1, "elder": 1, "fig": 1}


def test_hybrid_searches_each_vector_once(spark, tmp_path, monkeypatch):
    """Queries that share a vector make one dense search, and a qid stays the text it is."""
    from quernstone.plans import catalog

    spark.createDataFrame([(5, "apple"), (6, "pear")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, [1.0, float(n)]) for n in range(6)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = [("1", "apple"), ("101", "apple"), ("0201", "zebra"), ("2", "pear")]
    spark.createDataFrame(asked, "qid string, text string").selectExpr("*", "'dev' AS set_name", "timestamp '2020-01-01' AS created_at").write.parquet(f"{tmp_path}/queries.parquet")
    sizes, search = [], dense.dense_search
    monkeypatch.setattr(dense, "dense_search", lambda queries, *a, **b: sizes.append(queries.count()) or search(queries, *a, **b))
    rows = catalog.QUERIES["hybrid_search"](spark, str(tmp_path)).collect()
    assert sizes == [2]
    of = {q: [(r["doc_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["qid"] == q] for q, _ in asked}
    assert of["1"] == of["101"] and len(of["0201"]) == 6 and of["0201"][0][0] == 1 and of["2"][0][0] == 2


def test_lists_are_those_of_the_rows(spark, monkeypatch):
    """bm25_lists gives the documents of bm25, and fuse_lists the rows of rrf: ties, small blocks and parts, terms that
    count against, queries without terms or documents. Lists of queries are not exchanged."""
    from quernstone.operators import scoring

    rng = np.random.default_rng(6)
    words = [f"w{n}" for n in range(30)]
    docs = spark.createDataFrame([(int(n) * 7 % 301, "every " + " ".join(rng.choice(words, int(rng.integers(1, 9))))) for n in range(301)], "doc_id long, text string").repartition(3)
    queries = ask(spark, *[(f"q{n}", " ".join(rng.choice(words, int(rng.integers(1, 5))))) for n in range(20)], ("all", "every w1"), ("none", "nowhere"), ("empty", "the"), ("null", None))
    monkeypatch.setattr(scoring, "LIST_DOCS", 50)
    monkeypatch.setattr(sparse, "RESULTS", 200)
    for made in (docs, docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")):
        own = index.build_index(made)
        for more in ({}, {"floor": 0.25, "positive": True}, {"mode": "and"}):
            want: dict = {q: [] for q in [r["qid"] for r in queries.collect()]}
            for r in sorted(sparse.bm25(own, queries, 40, **more).collect(), key=lambda r: r["rank"]):
                want[r["qid"]].append(r["doc_id"])
            lists = sparse.bm25_lists(own, queries, 40, **more)
            assert {r["qid"]: r["docs"] for r in lists.collect()} == want
    rows = lists.select("qid", F.col("docs").alias("first"), F.when(F.col("qid") != "q3", F.slice(F.reverse("docs"), 1, 5)).alias("second"))
    runs = [rows.select("qid", F.posexplode(c).alias("rank", "doc_id")).withColumn("rank", F.col("rank") + 1) for c in ("first", "second")]
    want = sorted(tuple(r)[:4] for r in fusion.rrf(runs, keep=30).collect())
    assert sorted(map(tuple, fusion.fuse_lists(rows, keep=30).collect())) == want


def test_stored_postings_travel_in_lists(spark, tmp_path, monkeypatch):
    """The stored index has the postings and lengths of the rows, for any kind of id, and a search of many terms of it the
    same results; between them a batch of documents has one row a term, and postings one row a chunk."""
    from quernstone.operators import scoring

    monkeypatch.setattr(index, "PUSHED_TERMS", 1)
    rows = [(n, " ".join([f"w{n % 5}"] * (n % 3 + 1) + ["pear", f"x{n}"])) for n in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, docs in enumerate((made, made.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"))):
        own = index.build_index(docs)
        index.write_index(own, f"{tmp_path}/{n}")
        stored = index.read_index(spark, f"{tmp_path}/{n}")
        assert sorted(map(tuple, stored.postings.collect())) == sorted(map(tuple, own.postings.collect()))
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{n}/lengths").collect())) == sorted(map(tuple, own.terms.select("doc_id", "dl").collect()))
        assert tuple(stored.stats.first()) == tuple(own.stats.first())
        asked = ask(spark, ("a", "w1 pear"), ("b", "x7 w2"))
        assert sorted(map(tuple, sparse.bm25(stored, asked, 7).collect())) == sorted(map(tuple, sparse.bm25(own, asked, 7).collect()))
    lists = own.terms.coalesce(1).mapInArrow(scoring.by_term, "term string, docs array<string>, dls array<int>, tfs array<int>")
    assert lists.where("term = 'pear'").select(F.size("docs")).collect() == [(60,)]


def test_subset_and_results_make_no_row_for_each_query_and_document(spark):
    docs = spark.range(500, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("apple banana").alias("text"))
    run = sparse.bm25(index.build_index(docs, subset=docs.where("doc_id >= 10")), ask(spark, ("a", "apple banana")), 3)
    whole = sparse.search_results(run, docs)
    for df in (run, whole):
        assert "MapInArrow" in _plan(df) and "HashAggregate" not in _plan(df)
    assert sorted((r["doc_id"], r["text"]) for r in whole.collect()) == [(n, "apple banana") for n in (10, 11, 12)]
