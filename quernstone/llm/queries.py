"""The queries of the problems, over whole tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import knn, neardup, packing, pairs, sentences, termfreq, tokens, topn
from quernstone.sources.tables import spread

CONTAINER = 2048


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for work in Python; a table of fewer files than tasks is dealt over all tasks."""
    return spread(table(spark, folder, name).select(*columns))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "search_result").where("qid IS NOT NULL")
    return topn.top_n_per_group(rows, ["qid", "tag"], "passage_id", "score", 10).select("qid", "tag", "passage_id")


P1_SQL = """
SELECT qid, tag, passage_id FROM (
  SELECT *, row_number() OVER (PARTITION BY qid, tag ORDER BY score DESC, passage_id) AS r FROM (
    SELECT qid, tag, passage_id, max(score) AS score FROM search_result
    WHERE qid IS NOT NULL AND passage_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
    GROUP BY qid, tag, passage_id))
WHERE r <= 10
"""


def p2_terms(spark: SparkSession, folder: str) -> DataFrame:
    return termfreq.marked_terms(table(spark, folder, "entry"), "term", "doc", "freq")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_terms(spark, folder).where("mark IS NOT NULL").select("term", "mark")


P2_TERMS_SQL = rf"""
WITH pairs AS (
  SELECT term, doc, max(freq) AS freq FROM (
    SELECT lower(regexp_replace(term, '^[{termfreq.WHITE}]+|[{termfreq.WHITE}]+$', '', 'g')) AS term, doc, freq FROM entry
    WHERE term IS NOT NULL AND doc IS NOT NULL AND freq >= 1)
  GROUP BY term, doc)
SELECT term, CAST(sum(freq) AS BIGINT) AS freq, count(*) AS docs,
       CASE WHEN sum(freq) <= 3 THEN 'rare' WHEN count(*) > 0.1 * (SELECT count(DISTINCT doc) FROM pairs) THEN 'common' END AS mark
FROM pairs GROUP BY term
"""
P2_SQL = f"SELECT term, mark FROM ({P2_TERMS_SQL}) WHERE mark IS NOT NULL"


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return knn.neighbour_pairs(table(spark, folder, "run_hnsw"), "id", "embedding", dim=64, k=5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(dealt(spark, folder, "expander", "rec_id", "original", "raw_expansions", "queries"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = dealt(spark, folder, "expander", "rec_id", "original", "queries")
    return neardup.similar_pairs(rows, "rec_id", neardup.word_set("original", "queries"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    rows = dealt(spark, folder, "expander", "rec_id", "original", "queries")
    return neardup.grouped(rows, "rec_id", neardup.word_set("original", "queries"))


P5_SQL = r"""
WITH w AS (
  SELECT DISTINCT rec_id, lower(unnest(regexp_extract_all(concat_ws(' ', original, array_to_string(queries, ' ')), '[\p{L}\p{N}]+'))) AS word
  FROM expander WHERE rec_id IS NOT NULL),
n AS (SELECT rec_id, count(*) AS n FROM w GROUP BY rec_id),
s AS (SELECT a.rec_id AS rec_a, b.rec_id AS rec_b, count(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.rec_id < b.rec_id GROUP BY ALL)
SELECT rec_a, rec_b FROM s JOIN n x ON x.rec_id = rec_a JOIN n y ON y.rec_id = rec_b WHERE shared >= 0.75 * (x.n + y.n - shared)
"""


P5_GROUPS_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT DISTINCT rec_id, lower(unnest(regexp_extract_all(concat_ws(' ', original, array_to_string(queries, ' ')), '[\p{{L}}\p{{N}}]+'))) AS word
  FROM expander WHERE rec_id IS NOT NULL),
c AS MATERIALIZED (SELECT rec_id, min(rec_id) OVER (PARTITION BY words) AS class_id FROM (SELECT rec_id, string_agg(word, ' ' ORDER BY word) AS words FROM w GROUP BY rec_id)),
e AS MATERIALIZED (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM ({P5_SQL}) JOIN c x ON x.rec_id = rec_a JOIN c y ON y.rec_id = rec_b WHERE x.class_id <> y.class_id),
l AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
g AS (SELECT DISTINCT class_id AS x, class_id AS y FROM c UNION SELECT x, b FROM g JOIN l ON a = y),
m AS (SELECT x, min(y) AS group_id FROM g GROUP BY x)
SELECT rec_id, class_id, group_id, (SELECT count(*) FROM l WHERE a = class_id) AS n_links FROM c JOIN m ON x = class_id
"""


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_corpus(dealt(spark, folder, "documents", "doc_id", "text"))


def p7_bins(spark: SparkSession, folder: str) -> DataFrame:
    docs = dealt(spark, folder, "documents", "doc_id", "text").where("text <> ''")
    return packing.pack(tokens.count_tokens(docs), "doc_id", "n_tokens", CONTAINER)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    units = sentences.sentence_units(dealt(spark, folder, "documents", "doc_id", "text"))
    return units.select("doc_id", "start_pos", "end_pos")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_terms": p2_terms, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_groups": p5_groups, "p6_ids": p6_ids, "p7_bins": p7_bins, "p8_found": p8_found}
ORACLES = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_terms": P2_TERMS_SQL, "p5_found": P5_SQL, "p5_groups": P5_GROUPS_SQL}
