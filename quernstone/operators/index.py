"""The inverted index as relations: postings, lexicon, document lengths and statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.stem import stemmed
from quernstone.functions.text import tokens
from quernstone.operators.scoring import by_term, chunked, opened, packed
from quernstone.session import settle, shuffle_width, written

BLOCK = 128
#: Postings of a term that one task numbers.
HOT = 10_000_000


#: Terms of queries that are pushed into the scan of a stored index; more are joined to it.
PUSHED_TERMS = 1_000


@dataclass
class Index:
    """terms: (doc_id, dl, terms array) of the documents with a term, or stored: the folder of a written index, of
    which a search reads only the terms it asks for; stats: one row of n_docs and avgdl."""

    terms: DataFrame | None
    stats: DataFrame
    stem: bool = False
    stored: str | None = None

    def _read(self, name: str) -> DataFrame:
        return self.stats.sparkSession.read.parquet(f"{self.stored}/{name}")

    @property
    def documents_kind(self) -> str:
        return (self._read("postings") if self.stored else self.terms).schema["doc_id"].dataType.simpleString()

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, dl, tf)"""
        return self._read("postings") if self.stored else posted(self.terms, self.stem)

    @property
    def lexicon(self) -> DataFrame:
        """(term, df). A document is one row, so without stemming its terms are counted there and no posting is exchanged."""
        if self.stored:
            return self._read("lexicon")
        each = self.postings if self.stem else self.terms.select(F.explode(F.array_distinct("terms")).alias("term"))
        return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def lookup(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings and the lexicon of wanted terms (term)."""
        terms = wanted.select("term").distinct()
        if self.stored:
            few = [r["term"] for r in terms.limit(PUSHED_TERMS + 1).collect()]
            if len(few) <= PUSHED_TERMS:
                return self.postings.where(F.col("term").isin(few)), self.lexicon.where(F.col("term").isin(few))
            return self.postings.join(terms, "term", "left_semi"), self.lexicon.join(terms, "term", "left_semi")
        if self.stem:
            postings = self.postings.join(terms, "term", "left_semi")
        else:  # only occurrences of these terms are counted at all
            flat = self.terms.select("doc_id", "dl", F.explode("terms").alias("term")).join(terms, "term", "left_semi")
            postings = flat.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))
        return postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def by_document(self, numbers: DataFrame) -> DataFrame:
        """(doc_id, dl, terms, tfs) of one row a document: its terms among numbers (term, t), as t in order. Written once.
        Of documents that aren't stored all stand there, also those with none of these terms; no posting is exchanged."""
        spark = self.stats.sparkSession
        if self.stored:
            postings = self.lookup(numbers)[0] if numbers.count() <= PUSHED_TERMS else self.postings  # the join keeps the terms
            chunk = F.pmod(F.xxhash64("doc_id"), F.lit(4 * shuffle_width(spark))).cast("int")
            found = postings.join(F.broadcast(numbers), "term").select("doc_id", "dl", "t", F.col("tf").alias("n"), chunk.alias("chunk"))
            rows = found.drop("chunk").schema
            flat = found.mapInArrow(chunked, "chunk int, held binary").repartition("chunk").mapInArrow(opened, rows).sortWithinPartitions("doc_id")
        else:
            if self.stem:
                vocabulary = settle(stemmed(self.terms.select(F.explode("terms").alias("term")).distinct()))  # a table of its own, as in posted()
                terms = vocabulary.join(F.broadcast(numbers.withColumnRenamed("term", "stem")), "stem").select("term", "t")
            else:
                terms = numbers
            every = spark.createDataFrame([("", -1)], terms.schema)  # no term is empty: this one stands for the document
            flat = self.terms.select("doc_id", "dl", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
            flat = flat.join(F.broadcast(terms.unionByName(every)), "term").select("doc_id", "dl", "t", F.lit(1).cast("long").alias("n"))
        kind = flat.schema["doc_id"].dataType.simpleString()
        return written(flat.mapInArrow(packed, f"doc_id {kind}, dl long, terms array<int>, tfs array<int>"), "by-document")


def posted(terms: DataFrame, stem: bool = False) -> DataFrame:
    """Postings of documents. With stemming, the distinct terms are stemmed, not every occurrence."""
    flat = terms.select("doc_id", "dl", F.explode("terms").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    if stem:
        # A table of its own: else filters on stems would be pushed through the stemmer's steps and blow up.
        vocabulary = settle(stemmed(flat.select("term").distinct()))
        flat = flat.join(vocabulary, "term").groupBy("doc_id", "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return flat.select("term", "doc_id", "dl", "tf")


def document_terms(docs: DataFrame, analyzer: str = "ascii", subset: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, terms) of every document with a term; those without count nowhere. subset: doc_ids to keep."""
    if subset is not None:
        docs = docs.join(subset.select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.select("doc_id", tokens(F.col("text"), analyzer).alias("terms")).where(F.size("terms") > 0).select("doc_id", F.size("terms").cast("long").alias("dl"), "terms")


def build_index(docs: DataFrame, analyzer: str = "ascii", stem: bool = False, subset: DataFrame | None = None) -> Index:
    terms = document_terms(docs, analyzer, subset)
    stats = terms.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return Index(terms, stats, stem)


def _numbered(postings: DataFrame, hot: int) -> DataFrame:
    """The postings with nth, from 0 in document order within a term. Terms of more than hot postings, of which there
    are postings / hot at most, are numbered part by part, so no task holds all postings of a frequent term."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    cut = df.where(F.col("df") > hot).select("term", "low", F.expr(f"(high - low) div (df div {int(hot)} + 1) + 1").alias("width"))
    parted = postings.join(F.broadcast(cut), "term", "left").withColumn("part", F.coalesce(F.expr("(doc_id - low) div width"), F.lit(0))).drop("low", "width")
    before = Window.partitionBy("term").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = parted.join(F.broadcast(cut.select("term")), "term", "left_semi").groupBy("term", "part").agg(F.count(F.lit(1)).alias("n"))
    start = start.select("term", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("term", "part").orderBy("doc_id")
    return parted.withColumn("nth", F.row_number().over(order) - 1).join(F.broadcast(start), ["term", "part"], "left").withColumn(
        "nth", F.col("nth") + F.coalesce("start", F.lit(0))
    ).drop("part", "start")


def posting_blocks(postings: DataFrame, size: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Runs of at most size postings of a term in document order: (term, block, n, first_doc, last_doc, deltas, freqs).

    The first delta of a block is the document itself, so each block reads on its own.
    """
    postings = written(postings, "postings")  # read several times
    placed = _numbered(postings, hot).withColumn("block", F.floor(F.col("nth") / size).cast("int"))
    before = F.lag("doc_id").over(Window.partitionBy("term", "block").orderBy("doc_id"))
    steps = placed.withColumn("delta", F.col("doc_id") - F.coalesce(before, F.lit(0)))
    held = F.array_sort(F.collect_list(F.struct("doc_id", "delta", "tf"))).alias("held")
    return steps.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), held).select(
        "term", "block", "n", "first_doc", "last_doc", F.transform("held", lambda x: x["delta"]).alias("deltas"), F.transform("held", lambda x: x["tf"]).alias("freqs")
    )


def unpacked(blocks: DataFrame) -> DataFrame:
    """The postings of blocks, by prefix sums of the deltas: (term, doc_id, tf)."""
    pairs = blocks.select("term", F.posexplode(F.arrays_zip("deltas", "freqs")).alias("at", "x"), "block")
    running = Window.partitionBy("term", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return pairs.select("term", F.sum(F.col("x")["deltas"]).over(running).alias("doc_id"), F.col("x")["freqs"].alias("tf"))


def write_index(index: Index, folder: str) -> None:
    """Postings and lexicon sorted by term, so files and row groups that hold no term of a query are skipped; the
    lengths of documents and the statistics beside them."""
    spark = index.stats.sparkSession
    stats = index.stats
    if index.stem or index.terms is None:
        postings = index.postings.repartitionByRange("term", "doc_id")
        lengths = index.terms.select("doc_id", "dl") if index.terms is not None else None
    else:  # a batch of documents has one row for each of its terms, so few rows are exchanged; written, as they are read again
        kind = index.documents_kind
        lists = written(index.terms.mapInArrow(by_term, f"term string, docs array<{kind}>, dls array<int>, tfs array<int>"), "by-term")
        each = F.inline(F.arrays_zip("docs", F.col("dls").cast("array<bigint>").alias("dls"), F.col("tfs").cast("array<bigint>").alias("tfs")))
        postings = lists.where("term <> ''").repartitionByRange("term", F.col("docs")[0]).select("term", each.alias("doc_id", "dl", "tf"))
        lengths = lists.where("term = ''").select(each.alias("doc_id", "dl", "tf")).drop("tf")
        stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/postings")
    counted = spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/lexicon")
    if lengths is not None:
        lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    stats.write.mode("overwrite").parquet(f"{folder}/stats")


def read_index(spark: SparkSession, folder: str, stem: bool = False) -> Index:
    return Index(None, spark.read.parquet(f"{folder}/stats"), stem, folder)
