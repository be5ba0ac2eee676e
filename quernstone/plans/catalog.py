"""The engine's queries over the test tables, by name, and SQL that gives the same rows.

A limit stands only where it is the feature (the k best of a query, the first
rows of a scan). Searches over vectors ask with every vector whose id is
divisible by 100, against all vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text as X
from quernstone.functions.stem import stem_sql, stemmed
from quernstone.operators import dense, expand, fusion, index, metrics, providers, sparse
from quernstone.session import durable_folder
from quernstone.sources import tables as S

K = 10
#: What a hybrid search takes of each list, and gives.
DEPTH = 1000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- shared inputs


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return S.spread(S.table(spark, folder, "documents").select("doc_id", "text"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """Queries, of each qid the last."""
    rows = S.table(spark, folder, "queries").where("qid IS NOT NULL")
    return S.last_of_each(rows.select("qid", "text", "set_name", "created_at"), ["qid"], "created_at").select("qid", "text")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of all tags, from what was retrieved: of a passage its best score, ranked by score, then passage."""
    rows = S.table(spark, folder, "search_result").where("qid IS NOT NULL AND tag IS NOT NULL AND passage_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy("qid", "tag", F.col("passage_id").alias("doc_id")).agg(F.max("score").alias("score"))
    return S.numbered(best, [F.desc("score"), F.asc("doc_id")], ["qid", "tag"]).select("qid", "doc_id", "rank", "score", "tag")


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements, of each qid and passage the highest."""
    rows = S.table(spark, folder, "qrels").where("qid IS NOT NULL AND doc_id IS NOT NULL")
    return rows.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Expansion records, each once."""
    return S.table(spark, folder, "expander").where("rec_id IS NOT NULL").dropDuplicates(["rec_id"])


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return S.table(spark, folder, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("doc_id"), "embedding")


def passage_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, vec_id, embedding) of passages with a usable vector, each once; doc_id is the group of 100 ids a passage is in."""
    rows = S.clean_ids(S.table(spark, folder, "run_hnsw").where("id IS NOT NULL"), "id").where(
        (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    one = rows.groupBy(F.col("id").cast("long").alias("vec_id")).agg(F.max("embedding").alias("embedding")).where("vec_id IS NOT NULL")
    return one.select(F.expr("vec_id div 100").alias("doc_id"), "vec_id", "embedding")


_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_STOP_SHORT = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS_SHORT) + "]"
TOK = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t))"
TOK_LOWER = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: NOT list_contains({_STOP_SHORT}, t))"
DOCS = "SELECT doc_id, text FROM documents"
ASKED = (
    "SELECT qid, text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY created_at DESC NULLS LAST, text DESC NULLS LAST, set_name DESC NULLS LAST) AS r"
    " FROM queries WHERE qid IS NOT NULL) WHERE r = 1"
)
RUNS = (
    "SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid, tag ORDER BY score DESC, doc_id) AS INT) AS rank, score, tag FROM"
    " (SELECT qid, tag, passage_id AS doc_id, max(score) AS score FROM search_result WHERE qid IS NOT NULL AND tag IS NOT NULL AND passage_id IS NOT NULL"
    " AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)"
)
JUDGED = "SELECT qid, doc_id, max(rel) AS rel FROM qrels WHERE qid IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL"
RECORDS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id) AS r FROM expander WHERE rec_id IS NOT NULL) WHERE r = 1"
PASSAGES = (
    "SELECT vec_id // 100 AS doc_id, vec_id, embedding FROM (SELECT TRY_CAST(regexp_replace(id, '^b''(.*)''$', '\\1') AS BIGINT) AS vec_id, CAST(any_value(embedding) AS DOUBLE[]) AS embedding"
    " FROM run_hnsw WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    " AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1) WHERE vec_id IS NOT NULL"
)


def index_sql(tok: str = TOK, stem: bool = False, where: str = "") -> str:
    """Relations of the index: dt, tf, dl, st, df; q and qt of the queries."""
    raw = f"SELECT doc_id, unnest({tok}) AS term FROM ({DOCS} {where})"
    asked_ = f"SELECT qid, unnest({tok}) AS term FROM ({ASKED})"
    if stem:
        voc = f"voc AS MATERIALIZED ({stem_sql('SELECT DISTINCT term FROM (SELECT term FROM d0 UNION ALL SELECT term FROM q0)')}), "
        head = f"d0 AS MATERIALIZED ({raw}), q0 AS MATERIALIZED ({asked_}), {voc}dt AS MATERIALIZED (SELECT doc_id, stem AS term FROM d0 JOIN voc USING (term)), q1 AS (SELECT qid, stem AS term FROM q0 JOIN voc USING (term))"
    else:
        head = f"dt AS MATERIALIZED ({raw}), q1 AS ({asked_})"
    return (
        f"WITH {head}, tf AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM dt GROUP BY ALL),"
        " st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),"
        " qt AS (SELECT qid, term, count(*) AS qtf FROM q1 GROUP BY ALL)"
    )


def bm25_sql(tok: str = TOK, stem: bool = False, idf: str = "w", k1: float = 1.2, b: float = 0.75, having: str = "", cap: str = "", extra: str = "", where: str = "") -> str:
    return (
        f"{index_sql(tok, stem, where)}, idf AS (SELECT term, avgdl, ln(CAST(n - df + 0.5 AS DOUBLE) / CAST(df + 0.5 AS DOUBLE)) AS w FROM df, st){extra},"
        f" p AS (SELECT * FROM tf {cap}),"
        f" s AS (SELECT qid, doc_id, round(sum(qtf * {idf} * tf * CAST({k1} + 1 AS DOUBLE) / (tf + CAST({k1} AS DOUBLE) * (CAST({1 - b} AS DOUBLE) + CAST({b} AS DOUBLE) * dl / avgdl))), 6) AS score"
        f" FROM p JOIN dl USING (doc_id) JOIN qt USING (term) JOIN idf USING (term) GROUP BY qid, doc_id {having})"
        f" SELECT qid, doc_id, rank, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM s) WHERE rank <= {K}"
    )


def found(run: DataFrame) -> DataFrame:
    return run.select("qid", "doc_id", "rank", "score")


# ---------------------------------------------------------------- scans


@query(f"{DOCS} ORDER BY doc_id LIMIT 100")
def collection_scan_limit(spark, folder):
    return S.table(spark, folder, "documents").select("doc_id", "text").orderBy("doc_id").limit(100)


@query("SELECT doc_id, collection_variant, n_chars FROM documents WHERE collection_variant = 'doc2query'")
def variant_scan(spark, folder):
    return S.table(spark, folder, "documents").where("collection_variant = 'doc2query'").select("doc_id", "collection_variant", "n_chars")


@query(f"{DOCS} WHERE doc_id IN (SELECT TRY_CAST(doc_id AS BIGINT) FROM expander)")
def subset_filter(spark, folder):
    wanted = S.table(spark, folder, "expander").select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"))
    return S.keep_keys(S.table(spark, folder, "documents").select("doc_id", "text"), wanted, "doc_id")


@query("SELECT qid, text, set_name FROM queries WHERE set_name = 'dev' UNION ALL SELECT qid, text, set_name FROM queries WHERE set_name <> 'dev'")
def union_queries(spark, folder):
    rows = S.table(spark, folder, "queries").select("qid", "text", "set_name")
    return rows.where("set_name = 'dev'").unionByName(rows.where("set_name <> 'dev'"))


@query(ASKED)
def queries_last_wins(spark, folder):
    return asked(spark, folder)


@query("SELECT qid FROM queries WHERE qid IS NOT NULL UNION SELECT qid FROM qrels WHERE qid IS NOT NULL")
def distinct_qids(spark, folder):
    return S.table(spark, folder, "queries").select("qid").union(S.table(spark, folder, "qrels").select("qid")).where("qid IS NOT NULL").distinct()


@query(JUDGED)
def qrels_clean(spark, folder):
    return judged(spark, folder)


@query(f"SELECT * FROM ({JUDGED}) WHERE qid IN (SELECT qid FROM search_result WHERE tag = 'bm25_original')")
def qrels_of_run(spark, folder):
    return S.keep_keys(judged(spark, folder), S.table(spark, folder, "search_result").where("tag = 'bm25_original' AND qid IS NOT NULL"), "qid")


@query(f"SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT TRY_CAST(doc_id AS BIGINT) FROM expander WHERE TRY_CAST(doc_id AS BIGINT) IS NOT NULL)")
def incremental_expand(spark, folder):
    done = S.table(spark, folder, "expander").select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id")).where("doc_id IS NOT NULL")
    return expand.not_yet_done(S.table(spark, folder, "documents").select("doc_id", "text"), done)


# ---------------------------------------------------------------- analysis and index


@query(f"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INT) AS pos, unnest(t) AS term FROM (SELECT doc_id, {TOK} AS t FROM documents) WHERE len(t) > 0")
def tokenize_tokens(spark, folder):
    return documents(spark, folder).select("doc_id", F.posexplode(X.tokens(F.col("text"))).alias("pos", "term"))


@query(f"SELECT doc_id, unnest(t) AS term FROM (SELECT doc_id, {TOK_LOWER} AS t FROM documents) WHERE len(t) > 0")
def tokenize_lower(spark, folder):
    return documents(spark, folder).select("doc_id", F.explode(X.tokens(F.col("text"), "lower")).alias("term"))


@query(stem_sql(f"SELECT DISTINCT unnest({TOK}) AS term FROM documents"))
def stem_vocab(spark, folder):
    return stemmed(documents(spark, folder).select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct())


@query(f"{index_sql()} SELECT term, doc_id, tf FROM tf")
def term_frequency(spark, folder):
    return index.build_index(documents(spark, folder)).postings.select("term", "doc_id", "tf")


@query(f"{index_sql()} SELECT doc_id, dl FROM dl")
def doc_length(spark, folder):
    return index.document_terms(documents(spark, folder)).select("doc_id", "dl")


@query(f"{index_sql()} SELECT term, df FROM df")
def document_frequency(spark, folder):
    return index.build_index(documents(spark, folder)).lexicon


@query(f"{index_sql()} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS n_terms, (SELECT count(*) FROM tf) AS n_postings FROM st")
def collection_stats(spark, folder):
    own = index.build_index(documents(spark, folder))
    size = own.lexicon.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    return own.stats.join(F.broadcast(size)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", "n_postings")


@query(
    f"{index_sql()}, a AS (SELECT *, CAST((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS INT) AS block FROM tf),"
    " d AS (SELECT *, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term, block ORDER BY doc_id), 0) AS delta FROM a)"
    " SELECT term, block, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc, string_agg(CAST(delta AS VARCHAR), ',' ORDER BY doc_id) AS deltas,"
    " string_agg(CAST(tf AS VARCHAR), ',' ORDER BY doc_id) AS freqs FROM d GROUP BY term, block"
)
def posting_blocks(spark, folder):
    blocks = index.posting_blocks(index.build_index(documents(spark, folder)).postings)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return blocks.select("term", "block", "n", "first_doc", "last_doc", text("deltas"), text("freqs"))


@query(f"{index_sql()} SELECT term, doc_id, tf FROM tf")
def posting_blocks_read(spark, folder):
    return index.unpacked(index.posting_blocks(index.build_index(documents(spark, folder)).postings))


# ---------------------------------------------------------------- sparse search


@query(bm25_sql())
def bm25_topk(spark, folder):
    return found(sparse.bm25(index.build_index(documents(spark, folder)), asked(spark, folder), K))


@query(bm25_sql())
def bm25_from_index(spark, folder):
    """The same from an index that is written first and of which only the terms of the queries are read."""
    at = f"{durable_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index.write_index(index.build_index(documents(spark, folder)), at)
    return found(sparse.bm25(index.read_index(spark, at), asked(spark, folder), K))


@query(bm25_sql(stem=True))
def bm25_stemmed_topk(spark, folder):
    return found(sparse.bm25(index.build_index(documents(spark, folder), stem=True), asked(spark, folder), K))


@query(bm25_sql(cap="QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id) <= 128"))
def bm25_first_block(spark, folder):
    return found(sparse.bm25(index.build_index(documents(spark, folder)), asked(spark, folder), K, posting_cap=128))


@query(
    bm25_sql(
        TOK_LOWER, idf="(CASE WHEN w < 0 THEN 0.25::DOUBLE * mean_w ELSE w END)", k1=1.5, extra=", mw AS (SELECT avg(w) AS mean_w FROM idf)",
        having="HAVING round(sum(qtf * (CASE WHEN w < 0 THEN 0.25::DOUBLE * mean_w ELSE w END) * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) > 0",
    ).replace("JOIN idf USING (term) GROUP BY", "JOIN idf USING (term), mw GROUP BY")
)
def bm25_okapi_floor(spark, folder):
    return found(_okapi(spark, folder, K))


@query(bm25_sql(having="HAVING count(*) = any_value(n_terms)").replace("JOIN idf USING (term) GROUP BY", "JOIN idf USING (term) JOIN (SELECT qid, count(*) AS n_terms FROM qt GROUP BY qid) USING (qid) GROUP BY"))
def bm25_all_terms(spark, folder):
    return found(sparse.bm25(index.build_index(documents(spark, folder)), asked(spark, folder), K, mode="and"))


@query(bm25_sql(where="WHERE doc_id IN (SELECT TRY_CAST(doc_id AS BIGINT) FROM expander)"))
def bm25_subset(spark, folder):
    wanted = S.table(spark, folder, "expander").select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"))
    return found(sparse.bm25(index.build_index(documents(spark, folder), subset=wanted), asked(spark, folder), K))


@query(f"SELECT qid, doc_id, rank, score, text FROM ({bm25_sql()}) JOIN documents USING (doc_id)")
def search_results(spark, folder):
    docs = documents(spark, folder)
    return sparse.search_results(sparse.bm25(index.build_index(docs), asked(spark, folder), K), docs)


# ---------------------------------------------------------------- dense search


def dense_sql(score: str, order: str) -> str:
    return (
        "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id,"
        f" round({score}, 6) AS score FROM v q, v d WHERE q.vec_id % 100 = 0) SELECT qid, doc_id, rank, score FROM"
        f" (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score {order}, doc_id) AS INT) AS rank FROM s) WHERE rank <= {K}"
    )


def _hundredth(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), "embedding")


@query(dense_sql("list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e)))", "DESC"))
def dense_topk(spark, folder):
    rows = vectors(spark, folder)
    return found(dense.dense_search(_hundredth(rows), rows, K))


@query(dense_sql("list_distance(q.e, d.e) * list_distance(q.e, d.e)", "ASC"))
def dense_l2_topk(spark, folder):
    rows = vectors(spark, folder)
    return found(dense.dense_search(_hundredth(rows), rows, K, "l2"))


@query()
def ann_topk(spark, folder):
    """dense_topk from an inverted file; what it finds of it is in the README."""
    rows, at = vectors(spark, folder), f"{durable_folder(spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    dense.write_lists(rows, at)
    return found(dense.approximate_search(_hundredth(rows), at, K))


@query(
    f"WITH p AS ({PASSAGES}) SELECT x.doc_id, x.vec_id AS i, y.vec_id AS j, round(list_dot_product(x.embedding, y.embedding) / (sqrt(list_dot_product(x.embedding, x.embedding))"
    " * sqrt(list_dot_product(y.embedding, y.embedding))), 6) AS sim FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.vec_id < y.vec_id"
)
def cosine_matrix(spark, folder):
    return dense.similarity_matrix(passage_vectors(spark, folder), "doc_id")


@query(f"SELECT vec_id, round(sqrt(list_dot_product(embedding, embedding)), 5) AS length, round(embedding[1] / sqrt(list_dot_product(embedding, embedding)), 5) AS first FROM ({PASSAGES})")
def embedding_normalise(spark, folder):
    rows = passage_vectors(spark, folder)
    return rows.select("vec_id", F.round(F.sqrt(dense.dot("embedding", "embedding")), 5).alias("length"), F.round(dense.unit("embedding")[0], 5).alias("first"))


@query(
    f"WITH p AS ({PASSAGES}), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),"
    f" c AS (SELECT qid, CAST(doc_id AS BIGINT) AS vec_id, CAST(qid AS BIGINT) % 100 AS q FROM ({RUNS}) WHERE tag = 'bm25_original' AND rank <= 1000),"
    " s AS (SELECT qid, p.vec_id AS doc_id, round(list_dot_product(v.e, p.embedding) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(p.embedding, p.embedding))), 6) AS score"
    " FROM c JOIN p ON p.vec_id = c.vec_id JOIN v ON v.vec_id = c.q)"
    " SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank, score FROM s"
)
def dense_rerank(spark, folder):
    run = runs(spark, folder).where("tag = 'bm25_original'").withColumn("doc_id", F.col("doc_id").cast("long"))
    own = run.select("qid").distinct().withColumn("doc_id", F.col("qid").cast("long") % 100)
    queries = own.join(vectors(spark, folder), "doc_id").select("qid", "embedding")
    passages = passage_vectors(spark, folder).select(F.col("vec_id").alias("doc_id"), "embedding")
    return found(dense.rerank(run, passages, queries))


# ---------------------------------------------------------------- fusion


def rrf_sql(source: str, by: str = "") -> str:
    cols = by + ", " if by else ""
    return (
        f"WITH s AS (SELECT {cols}qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({source}) WHERE rank <= 1000 GROUP BY {cols}qid, doc_id)"
        f" SELECT * FROM (SELECT {cols}qid, doc_id, CAST(row_number() OVER (PARTITION BY {cols}qid ORDER BY score DESC, doc_id) AS INT) AS rank, score FROM s) WHERE rank <= 1000"
    )


@query(rrf_sql(f"SELECT * FROM ({RUNS}) WHERE tag IN ('bm25_original', 'hnsw_original')"))
def rrf_hybrid(spark, folder):
    rows = runs(spark, folder)
    return found(fusion.rrf([rows.where("tag = 'bm25_original'"), rows.where("tag = 'hnsw_original'")]))


@query(rrf_sql(RUNS))
def rrf_nway(spark, folder):
    return found(fusion.fuse(runs(spark, folder)))


@query(rrf_sql(f"SELECT r.*, collection_variant FROM ({RUNS}) r JOIN run_tags USING (tag)", "collection_variant"))
def rrf_by_variant(spark, folder):
    tagged = runs(spark, folder).join(S.table(spark, folder, "run_tags").select("tag", "collection_variant"), "tag")
    return fusion.fuse(tagged, by=("collection_variant",)).drop("tag")


@query(rrf_sql(f"SELECT * FROM ({RUNS}) WHERE qid IN (SELECT qid FROM qrels)"))
def hybrid_qid_filter(spark, folder):
    return found(fusion.fuse(S.keep_keys(runs(spark, folder), judged(spark, folder), "qid")))


def hybrid_sql(bm25: str) -> str:
    return (
        f"WITH b AS ({bm25}), d AS (WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT qid, vec_id AS doc_id,"
        f" round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 6) AS score"
        f" FROM ({ASKED}) a JOIN (SELECT vec_id AS v, e FROM v) q ON q.v = CAST(a.qid AS BIGINT) % 100, v d)"
        f" SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= {K}),"
        " s AS (SELECT qid, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT qid, doc_id, rank FROM b UNION ALL SELECT qid, doc_id, rank FROM d) GROUP BY ALL)"
        " SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank, score FROM s"
    )


@query(hybrid_sql(bm25_sql()))
def hybrid_search(spark, folder):
    return _hybrid(spark, folder, K)


def _okapi(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    own = index.build_index(documents(spark, folder), "lower")
    return sparse.bm25(own, asked(spark, folder), depth, k1=1.5, analyzer="lower", floor=0.25, positive=True)


@query(hybrid_sql(ORACLES["bm25_okapi_floor"]))
def hybrid_okapi(spark, folder):
    return _hybrid(spark, folder, K, _okapi(spark, folder, K))


def _vector_of(qid: str) -> Column:
    """The id of the vector that stands for a query's own."""
    return F.col(qid).cast("long") % 100


def _dense_lists(spark: SparkSession, folder: str, own: DataFrame, depth: int) -> DataFrame:
    """(vec_id, doc_id, rank): the best of each vector that queries (vec_id) have. Many share one, which is searched for once."""
    docs = vectors(spark, folder)
    each = docs.join(own.select(F.col("vec_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("qid"), "embedding")
    return dense.dense_search(each, docs, depth).select(F.col("qid").alias("vec_id"), "doc_id", "rank")


def _hybrid(spark: SparkSession, folder: str, depth: int, left: DataFrame | None = None) -> DataFrame:
    queries = asked(spark, folder)
    left = left or sparse.bm25(index.build_index(documents(spark, folder)), queries, depth)
    own = queries.select("qid", _vector_of("qid").alias("vec_id"))
    right = own.join(F.broadcast(_dense_lists(spark, folder, own, depth)), "vec_id").select("qid", "doc_id", "rank")
    return found(fusion.rrf([left, right]))


@query(f"SELECT * FROM ({ORACLES['hybrid_search'].replace(f'rank <= {K}', f'rank <= {DEPTH}')}) WHERE rank <= {DEPTH}")
def hybrid_search_deep(spark, folder):
    queries = asked(spark, folder)
    own = queries.select("qid", _vector_of("qid").alias("vec_id"))
    left = sparse.bm25_lists(index.build_index(documents(spark, folder)), queries, DEPTH).select("qid", F.col("docs").alias("first"), _vector_of("qid").alias("vec_id"))
    best = F.array_sort(F.collect_list(F.struct("rank", "doc_id")))
    right = _dense_lists(spark, folder, own, DEPTH).groupBy("vec_id").agg(F.transform(best, lambda x: x["doc_id"]).alias("second"))
    return fusion.fuse_lists(left.join(F.broadcast(right), "vec_id", "left"), keep=DEPTH)


@query(f"SELECT printf('%s Q0 %s %d %.6f %s', qid, doc_id, rank, score, tag) AS value FROM ({RUNS})")
def run_file_lines(spark, folder):
    return S.run_lines(runs(spark, folder))


@query(f"SELECT qid, doc_id, rank, CAST(printf('%.6f', score) AS DOUBLE) AS score, tag FROM ({RUNS}) WHERE rank <= 100")
def run_file_parsed(spark, folder):
    return S.parse_run(S.run_lines(runs(spark, folder)), 100)


# ---------------------------------------------------------------- evaluation


def eval_sql(ideal: str = "retrieved", min_rel: int | None = 1) -> str:
    good = "TRUE" if min_rel is None else f"coalesce(rel >= {min_rel}, FALSE)"
    ks = metrics.KS
    dcg = ", ".join(
        f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS dcg{k}, sum(CASE WHEN best <= {k} THEN rel / log2(best + 1) ELSE 0 END) AS idcg{k},"
        f" count(DISTINCT CASE WHEN hit AND rank <= {k} THEN doc_id END) AS hits{k}"
        for k in ks
    )
    full = ", ".join(f"sum(CASE WHEN best <= {k} THEN rel / log2(best + 1) ELSE 0 END) AS full{k}" for k in ks)
    out = ", ".join(
        f"round(CASE WHEN {x}{k} = 0 THEN 0 ELSE dcg{k} / {x}{k} END, 9) AS \"ndcg@{k}\", round(CASE WHEN n_rel = 0 THEN 0 ELSE hits{k} / n_rel END, 9) AS \"recall@{k}\""
        for k in ks
        for x in ["full" if ideal == "qrels" else "idcg"]
    )
    return (
        f"WITH k AS (SELECT qid, doc_id, CAST(coalesce(rel, 0) AS DOUBLE) AS rel, {good} AS ok FROM ({JUDGED})), n AS (SELECT qid, CAST(sum(CAST(ok AS INT)) AS DOUBLE) AS n_rel FROM k GROUP BY qid),"
        f" h AS (SELECT r.tag, r.qid, r.doc_id, rank, coalesce(k.rel, 0) AS rel, coalesce(ok, FALSE) AS hit FROM ({RUNS}) r LEFT JOIN k ON k.qid = r.qid AND k.doc_id = r.doc_id WHERE r.qid IN (SELECT qid FROM n)),"
        " w AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY tag, qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS found, row_number() OVER (PARTITION BY tag, qid ORDER BY rel DESC, rank) AS best FROM h),"
        f" f AS (SELECT qid, {full} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS best FROM k) GROUP BY qid),"
        " a AS (SELECT tag, qid, coalesce(1.0::DOUBLE / min(CASE WHEN hit AND rank <= 10 THEN rank END), 0) AS mrr, sum(CASE WHEN hit THEN found / rank ELSE 0 END) AS ap,"
        f" count(CASE WHEN hit AND rank <= 10 THEN 1 END) / 10.0::DOUBLE AS \"p@10\", {dcg} FROM w GROUP BY tag, qid)"
        f" SELECT tag, qid, round(mrr, 9) AS \"mrr@10\", round(CASE WHEN n_rel = 0 THEN 0 ELSE ap / n_rel END, 9) AS map, \"p@10\", {out} FROM a JOIN n USING (qid) JOIN f USING (qid)"
    )


_NAMES = ["mrr@10", "map", "p@10", *[f"{m}@{k}" for k in metrics.KS for m in ("ndcg", "recall")]]
SUMMARY = f"SELECT tag AS method, count(*) AS num_queries, {', '.join(f'round(avg("{c}"), 6) AS "{c}"' for c in _NAMES)} FROM ({eval_sql()}) GROUP BY tag"


@query(eval_sql())
def eval_per_query(spark, folder):
    return metrics.evaluate(runs(spark, folder), judged(spark, folder), by=("tag",))


@query(eval_sql("qrels"))
def eval_ndcg_qrels_ideal(spark, folder):
    return metrics.evaluate(runs(spark, folder), judged(spark, folder), ideal="qrels", by=("tag",))


@query(eval_sql(min_rel=None))
def eval_all_judged_relevant(spark, folder):
    return metrics.evaluate(runs(spark, folder), judged(spark, folder), min_rel=None, by=("tag",))


@query(SUMMARY)
def compare_methods(spark, folder):
    return metrics.compare(runs(spark, folder), judged(spark, folder))


@query(
    f"WITH s AS (SELECT method_name, collection_variant, \"mrr@10\" AS value FROM ({SUMMARY}) m JOIN run_tags t ON t.tag = m.method), b AS (SELECT method_name, value AS base FROM s WHERE collection_variant = 'original')"
    " SELECT method_name, collection_variant, value, round(CASE WHEN base <> 0 THEN (value - base) / base END, 6) AS improvement FROM s LEFT JOIN b USING (method_name)"
)
def relative_improvement(spark, folder):
    summary = metrics.compare(runs(spark, folder), judged(spark, folder)).withColumnRenamed("method", "tag")
    named = summary.join(S.table(spark, folder, "run_tags"), "tag")
    return metrics.relative_improvement(named, "mrr@10", "original", "method_name", "collection_variant")


# ---------------------------------------------------------------- expansion


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{X.SPACE}+|{X.SPACE}+$', '', 'g')"


_GENERIC = "[" + ", ".join(f"'{w}'" for w in X.GENERIC_WORDS) + "]"


@query(
    f"WITH e AS (SELECT rec_id, original, {_strip('x')} AS item, i AS pos FROM (SELECT rec_id, original, unnest(raw_expansions) AS x, generate_subscripts(raw_expansions, 1) AS i FROM ({RECORDS})) WHERE x IS NOT NULL),"
    f" w AS (SELECT *, list_filter(string_split_regex(lower(item), '{X.SPACE}+'), lambda y: y <> '') AS ws FROM e)"
    f" SELECT rec_id, item FROM w WHERE len(ws) BETWEEN 3 AND 50 AND len(list_filter(ws, lambda y: list_contains({_GENERIC}, y))) / len(ws) <= 0.5"
    " AND NOT coalesce(contains(lower(original), lower(item)), FALSE)"
)
def expansion_filter(spark, folder):
    kept = X.useful_expansions(F.col("raw_expansions"), F.col("original"))
    return records(spark, folder).select("rec_id", F.explode(kept).alias("item"))


@query(
    f"WITH a AS (SELECT rec_id, {_strip('substring(expanded, length(original) + 1)')} AS added FROM ({RECORDS}) WHERE starts_with(expanded, original)),"
    f" s AS (SELECT rec_id, {_strip('unnest(string_split(regexp_replace(added, ' + chr(39) + '([.!?])[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'x0B' + chr(92) + 'f' + chr(92) + 'r]+' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ' || chr(1), ' + chr(39) + 'g' + chr(39) + '), chr(1)))')} AS sentence FROM a)"
    " SELECT rec_id, sentence FROM s WHERE length(sentence) > 15"
)
def sentence_split_added_text(spark, folder):
    added = X.added_sentences(F.col("original"), F.col("expanded"))
    return records(spark, folder).select("rec_id", F.explode(added).alias("sentence"))


@query(
    f"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '' AND x NOT LIKE '#%') AS ls FROM documents WHERE text IS NOT NULL),"
    f" n AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^\\p{{Nd}}') AND contains(x, '.') THEN {_strip('substring(x, instr(x, chr(46)) + 1)')} ELSE x END) AS ls FROM l),"
    f" d AS (SELECT doc_id, list_transform(ls, lambda x: CASE WHEN x LIKE '-%' THEN {_strip('substring(x, 2)')} ELSE x END) AS ls FROM n)"
    " SELECT doc_id, unnest(list_slice(list_filter(ls, lambda x: length(x) > 5), 1, 5)) AS item FROM d"
)
def llm_parse_lines(spark, folder):
    return documents(spark, folder).select("doc_id", F.explode(X.parsed_lines(F.col("text"))).alias("item"))


@query(
    f"SELECT rec_id, '{X.INSTRUCT[0]}' || 'Analyze this document and list semantic gaps (max 5):' || chr(10) || original || chr(10) || chr(10) || 'Gaps:' || '{X.INSTRUCT[1]}' AS gap_prompt,"
    f" '{X.CHAT[0]}' || 'Generate brief factual expansions for this document:' || chr(10) || original || chr(10) || chr(10) || 'Gaps: ' || coalesce(array_to_string(gaps, ', '), 'none') || chr(10) || chr(10) || 'Expansions:' || '{X.CHAT[1]}' AS expand_prompt"
    f" FROM ({RECORDS}) WHERE original IS NOT NULL".replace("\n", "' || chr(10) || '")
)
def prompt_format(spark, folder):
    rows = records(spark, folder).where("original IS NOT NULL")
    gaps = F.coalesce(F.array_join("gaps", ", "), F.lit("none"))
    return rows.select(
        "rec_id", X.filled(X.GAP_PROMPT, X.INSTRUCT, document=F.col("original")).alias("gap_prompt"), X.filled(X.EXPAND_PROMPT, X.CHAT, document=F.col("original"), gaps=gaps).alias("expand_prompt")
    )


@query(f"SELECT rec_id, original || '</s></s>' || x AS pair FROM (SELECT rec_id, original, unnest(raw_expansions) AS x FROM ({RECORDS})) WHERE original IS NOT NULL AND x IS NOT NULL")
def nli_pair_format(spark, folder):
    rows = records(spark, folder).select("rec_id", "original", F.explode("raw_expansions").alias("x")).where("original IS NOT NULL AND x IS NOT NULL")
    return rows.select("rec_id", X.entailment_input(F.col("original"), F.col("x")).alias("pair"))


@query(
    f"WITH RECURSIVE p AS ({PASSAGES}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY vec_id) AS i FROM p), r AS ("
    " SELECT doc_id, vec_id, i, TRUE AS keep, [embedding] AS kept FROM n WHERE i = 1 UNION ALL"
    " SELECT n.doc_id, n.vec_id, n.i, ok, CASE WHEN ok THEN list_append(kept, e) ELSE kept END FROM (SELECT n.doc_id, n.vec_id, n.i, n.embedding AS e, r.kept,"
    " len(list_filter(r.kept, lambda x: list_dot_product(x, n.embedding) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(n.embedding, n.embedding))) >= 0.85)) = 0 AS ok"
    " FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1) n) SELECT doc_id, vec_id FROM r WHERE keep"
)
def dedup_greedy(spark, folder):
    return expand.deduplicated_vectors(passage_vectors(spark, folder), "doc_id", "vec_id", "embedding")


# The stand-in providers in SQL. x is an expression, of a text or a list of texts.


def _cut(x: str) -> str:
    """Sentences, cut at white space after . ! or ?"""
    return f"string_split(regexp_replace({x}, '([.!?]){X.SPACE}+', '\\1' || chr(1), 'g'), chr(1))"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{X.SPACE}+'), lambda y: y <> '')"


def _echo(rest: str) -> str:
    """What the generator answers to a prompt, from what follows its first line."""
    said = f"list_slice(list_filter(list_transform({_cut(rest)}, lambda s: {_strip('s')}), lambda s: length(s) > 15), 1, 3)"
    return f"array_to_string(list_transform({said}, lambda s, i: i || '. ' || s), chr(10))"


def _parsed(x: str) -> str:
    """The items of an answer."""
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), lambda l: l <> '' AND l NOT LIKE '#%')"
    plain = f"list_transform({lines}, lambda l: CASE WHEN regexp_matches(l, '^\\p{{Nd}}') AND contains(l, '.') THEN {_strip('substring(l, instr(l, chr(46)) + 1)')} ELSE l END)"
    bare = f"list_transform({plain}, lambda l: CASE WHEN l LIKE '-%' THEN {_strip('substring(l, 2)')} ELSE l END)"
    return f"list_slice(list_filter({bare}, lambda l: length(l) > 5), 1, 5)"


def _asked(x: str) -> str:
    """The queries of a text, each once."""
    made = f"list_transform(list_filter(list_slice({_cut(x)}, 1, 3), lambda s: {_strip('s')} <> ''), lambda s: 'what about ' || lower(array_to_string(list_slice({_words('s')}, 1, 4), ' ')))"
    return f"list_filter({made}, lambda q, i: list_position({made}, q) = i)"


def _passes(doc: str, h: str, strict: bool = False) -> str:
    no = lambda x: f"regexp_matches(lower({x}), '(^|[^\\p{{L}}\\p{{N}}_])(not|no|never|cannot)($|[^\\p{{L}}\\p{{N}}_])')"
    return f"contains({doc}, {h})" if strict else f"(contains({doc}, {h}) OR NOT ({no(h)} AND NOT {no(doc)}))"


def _code(x: str) -> str:
    """The 32 numbers of the hashing encoder, before they are brought to length one."""
    own = f"list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: md5(w))"
    at = "CAST('0x' || substring(h, 15, 2) AS INT) % 32"
    return f"list_transform(range(32), lambda b: CAST(coalesce(list_sum(list_transform(list_filter({own}, lambda h: {at} = b), lambda h: CASE WHEN h >= '8' THEN 1 ELSE -1 END)), 0) AS DOUBLE))"


def _cosine(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


def _deduplicated(source: str) -> str:
    """(id, kept) of source (id, doc, items): greedy over the items, then those unlike the document; one item or none stays."""
    return (
        f"dd AS MATERIALIZED (SELECT id, items, {_code('doc')} AS code, coalesce(doc, '') <> '' AS held FROM {source}),"
        f" di AS MATERIALIZED (SELECT id, i, x, {_code('x')} AS v FROM (SELECT id, generate_subscripts(items, 1) AS i, unnest(items) AS x FROM dd)),"
        " dr AS (SELECT id, 0 AS i, CAST([] AS STRUCT(x VARCHAR, v DOUBLE[])[]) AS kept FROM dd UNION ALL"
        f" SELECT dr.id, di.i, CASE WHEN len(list_filter(kept, lambda k: {_cosine('k.v', 'di.v')} >= 0.85)) = 0 THEN list_append(kept, struct_pack(x := di.x, v := di.v)) ELSE kept END"
        " FROM dr JOIN di ON di.id = dr.id AND di.i = dr.i + 1),"
        " dk AS (SELECT id, CASE WHEN coalesce(len(items), 0) <= 1 THEN coalesce(items, []) ELSE list_transform(list_filter(kept, lambda k: NOT held OR"
        f" {_cosine('k.v', 'code')} < 0.85), lambda k: k.x) END AS kept FROM dd JOIN dr USING (id) WHERE i = coalesce(len(items), 0))"
    )


def _useful(items: str, doc: str) -> str:
    stripped = f"list_transform(list_filter(coalesce({items}, []), lambda x: x IS NOT NULL), lambda x: {_strip('x')})"
    own = _words("lower(x)")
    return (
        f"list_filter({stripped}, lambda x: len({own}) BETWEEN 3 AND 50 AND len(list_filter({own}, lambda y: list_contains({_GENERIC}, y))) / len({own}) <= 0.5"
        f" AND NOT coalesce(contains(lower({doc}), lower(x)), FALSE))"
    )


@query(
    f"SELECT rec_id, pos, expansion FROM (SELECT *, {_code('expansion')} AS v, {_code('original')} AS d FROM (SELECT rec_id, original, CAST(generate_subscripts(raw_expansions, 1) - 1 AS INT) AS pos,"
    f" unnest(raw_expansions) AS expansion FROM ({RECORDS}) WHERE original IS NOT NULL)) WHERE expansion IS NOT NULL AND {_cosine('v', 'd')} < 0.85"
)
def filter_similar_to_doc(spark, folder):
    encoder = providers.HashingEncoder()
    rows = records(spark, folder).select("rec_id", "original", F.posexplode("raw_expansions").alias("pos", "expansion")).where("original IS NOT NULL AND expansion IS NOT NULL")
    coded = providers.encode(providers.encode(rows, "expansion", encoder, "item"), "original", encoder, "doc")
    return expand.unlike_document(coded).select("rec_id", "pos", "expansion")


@query(
    f"WITH RECURSIVE r AS (SELECT rec_id AS id, original AS doc, list_filter(raw_expansions, lambda x: x IS NOT NULL) AS items FROM ({RECORDS})), {_deduplicated('r')}"
    " SELECT id AS rec_id, CAST(generate_subscripts(kept, 1) - 1 AS INT) AS pos, unnest(kept) AS expansion FROM dk"
)
def expansion_dedup(spark, folder):
    rows = records(spark, folder).select("rec_id", "original", F.filter("raw_expansions", lambda x: x.isNotNull()).alias("items"))
    done = expand.deduplicated(rows, "items", "original", providers.HashingEncoder(), "kept")
    return done.select("rec_id", F.posexplode("kept").alias("pos", "expansion"))


def _providers():
    return providers.EchoGenerator(), providers.NegationClassifier(), providers.HeadingQueries(), providers.HashingEncoder()


_FRAMED = X.INSTRUCT[1]


@query(
    f"WITH RECURSIVE g AS MATERIALIZED (SELECT doc_id, text, {_parsed(_echo(f"text || chr(10) || chr(10) || 'Gaps:{_FRAMED}'"))} AS gaps FROM documents),"
    " e AS MATERIALIZED (SELECT doc_id, text, coalesce("
    + _parsed(_echo(f"text || chr(10) || chr(10) || 'Gaps: ' || CASE WHEN len(gaps) > 0 THEN array_to_string(gaps, chr(10)) ELSE 'none' END || chr(10) || chr(10) || 'Expansions:{_FRAMED}'"))
    + ", []) AS raw FROM g),"
    f" v AS MATERIALIZED (SELECT *, list_filter(raw, lambda h: {_passes('text', 'h')}) AS valid, coalesce({_asked('text')}, []) AS queries FROM e),"
    f" a AS (SELECT doc_id AS id, text AS doc, list_concat({_useful('valid', 'text')}, {_useful('queries', 'text')}) AS items FROM v), {_deduplicated('a')}"
    " SELECT doc_id, len(raw) AS n_raw, len(valid) AS n_valid, len(queries) AS n_queries, len(list_slice(kept, 1, 10)) AS n_final,"
    " text || ' ' || coalesce(array_to_string(list_slice(kept, 1, 10), ' '), '') AS expanded, CAST(NULL AS VARCHAR) AS error FROM v JOIN dk ON dk.id = doc_id"
)
def expand_combine(spark, folder):
    done = expand.expand(documents(spark, folder), *_providers())
    return done.select("doc_id", F.size("raw_expansions").alias("n_raw"), F.size("valid_expansions").alias("n_valid"), F.size("queries").alias("n_queries"), F.size("final").alias("n_final"), "expanded", "error")


@query(f"SELECT doc_id, text || ' ' || coalesce(array_to_string({_asked('text')}, ' '), '') AS expanded FROM documents")
def expand_d2q_only(spark, folder):
    return expand.expand_queries_only(documents(spark, folder), providers.HeadingQueries()).select("doc_id", "expanded")


_PASSAGE = X.PASSAGE_PROMPT.split("{document}")[0].replace("\n", "' || chr(10) || '")


@query(
    "SELECT doc_id, text || ' ' || "
    + _strip(_echo(f"(chr(10) || '{_PASSAGE}' || substring(text, 1, 500) || chr(10) || chr(10) || 'Expansion:{X.CHAT[1]}')".replace("\n", "' || chr(10) || '")))
    + " AS expanded FROM documents"
)
def expand_single_prompt(spark, folder):
    return expand.expand_single_prompt(documents(spark, folder), providers.EchoGenerator()).select("doc_id", "expanded")


def _validated(spark, folder, mode="lenient"):
    rows = records(spark, folder)
    original = rows.select(F.col("rec_id").alias("doc_id"), F.col("original").alias("text"))
    return expand.validate_added(rows.select(F.col("rec_id").alias("doc_id"), F.col("expanded").alias("text")), original, providers.NegationClassifier(), mode)


def validated_sql(strict: bool = False) -> str:
    added = f"list_filter(list_transform({_cut(_strip('substring(expanded, length(original) + 1)'))}, lambda s: {_strip('s')}), lambda s: length(s) > 15)"
    return (
        f"WITH a AS MATERIALIZED (SELECT rec_id AS doc_id, original, expanded, coalesce(original <> '', FALSE) AS known, CASE WHEN coalesce(original <> '', FALSE) AND starts_with(expanded, original) THEN {added} ELSE [] END AS added FROM ({RECORDS})),"
        f" k AS (SELECT *, list_filter(added, lambda h: {_passes('original', 'h', strict)}) AS kept FROM a)"
        " SELECT doc_id, CASE WHEN NOT known THEN expanded WHEN len(kept) > 0 THEN original || ' ' || array_to_string(kept, ' ') ELSE original END AS text, len(added) AS n_added, len(kept) AS n_kept FROM k"
    )


@query(validated_sql())
def nli_validate_join(spark, folder):
    return _validated(spark, folder)


@query(
    " UNION ALL ".join(
        f"SELECT CAST(sum(n_kept) AS BIGINT) AS kept, CAST(sum(n_added) - sum(n_kept) AS BIGINT) AS removed, round(100.0::DOUBLE * sum(n_kept) / nullif(sum(n_added), 0), 6) AS keep_rate, '{m}' AS mode FROM ({validated_sql(m == 'strict')})"
        for m in ("lenient", "strict")
    )
)
def nli_keep_rates(spark, folder):
    rates = [expand.keep_rates(_validated(spark, folder, m)).withColumn("mode", F.lit(m)) for m in ("lenient", "strict")]
    return rates[0].unionByName(rates[1])


@query(f"SELECT rec_id, original || ' ' || coalesce(array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL), ' '), '') AS expanded FROM (SELECT rec_id, original, list_filter(queries, lambda x, i: NOT list_contains(list_slice(queries, 1, i - 1), x)) AS list_distinct_ordered FROM ({RECORDS})) WHERE original IS NOT NULL AND list_distinct_ordered IS NOT NULL")
def expanded_with_queries(spark, folder):
    rows = records(spark, folder).where("original IS NOT NULL AND queries IS NOT NULL")
    once = F.filter(F.array_distinct("queries"), lambda x: x.isNotNull())
    return rows.select("rec_id", X.joined(F.col("original"), once).alias("expanded"))
