"""Problem 2: frequency of every distinct term, by recursive radix spilling.

The first bits of a term's hash, as many as the number of rows asks for, name
its partition. A pass counts the partitions; one over the capacity is split by
further bits of the hash, as many as its own rows ask for, and counted again. A
partition of one hash only (one hot term), or one that further bits don't bring
under the capacity, is split by the hash of the record instead, which keeps all
rows of a (term, record) pair together; its partial sums are added up at the
end. Spark's shuffle spills the partitions to disk, and each is aggregated by
DuckDB, out of core below the shared folder.

A partition's place is computed from the hash. Only those that are split stand
in a table, one row each; there are no more than rows / capacity of them, and
the capacity grows beyond MOST times its size, so the table that is broadcast
has MOST rows at most, whatever the data.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import durable_folder, scratch_path, written

#: Passes that count, and the bits that a split takes at least.
LEVELS, LEAST_BITS = 3, 4
#: Rows of a partition: some 100 MB in DuckDB. Larger inputs have larger partitions, so that there are 2 * MOST or so.
CAPACITY, MOST = 4_000_000, 32_768
#: Rows that are worth a task of their own.
LEAST = 100_000
#: What Unicode calls white space.
WHITE = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def normal_term(term: Column) -> Column:
    """The term without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(term, f"^[{WHITE}]+|[{WHITE}]+$", ""))


def _digit(used: str, bits: str) -> Column:
    """The bits of h after the first used ones."""
    return F.expr(f"shiftrightunsigned(h, 64 - {used} - {bits}) & (shiftleft(1L, {bits}) - 1)").cast("int")


def bits_for(rows: int, capacity: int) -> int:
    """Bits whose partitions are half full on average (all, where one is enough)."""
    return 0 if rows <= capacity else (-(-2 * rows // capacity) - 1).bit_length()


def radix_placed(rows: DataFrame, n: int, capacity: int) -> tuple[DataFrame, int, bool]:
    """Of n rows (term, doc, freq, h): the rows with their partition (target), the number of partitions, and whether
    some are split by record."""
    bits = bits_for(n, capacity)
    placed = rows.select("*", _digit("0", str(bits)).alias("target"), F.lit(bits).alias("used"), F.lit(False).alias("late"))
    parts, new, by_record = 1 << bits, 0, False
    if not bits:
        return placed, parts, by_record
    for level in range(LEVELS + 1):
        found = placed.where(F.col("target") >= new).groupBy("target", "used", "late").agg(F.count(F.lit(1)).alias("n"), (F.min("h") == F.max("h")).alias("one"))
        needed = F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(2 * F.col("n") / F.lit(capacity)))).cast("int")
        over = found.where(F.col("n") > capacity).select(
            F.col("target").alias("old"),
            F.col("late").alias("stays"),
            (F.col("one") | F.lit(level >= LEVELS - 1) | (F.col("used") + needed > 64)).alias("by_record"),
            needed.alias("bits"),
            F.ceil(2 * F.col("n") / F.lit(capacity)).cast("int").alias("lots"),
        )
        over = over.withColumn("pieces", F.when(F.col("stays"), 0).when(F.col("by_record"), F.col("lots")).otherwise(F.expr("shiftleft(1, bits)")))
        so_far = Window.orderBy("old").rowsBetween(Window.unboundedPreceding, -1)  # over MOST rows at most
        over = written(over.withColumn("base", (F.lit(parts) + F.coalesce(F.sum("pieces").over(so_far), F.lit(0))).cast("int")), "splits")
        more, repeated, hot = over.agg(F.sum("pieces"), F.count(F.when(F.col("stays"), 1)), F.count(F.when(F.col("by_record") & ~F.col("stays"), 1))).first()
        if repeated:  # more than a capacity of rows of one term and record, which are one row
            late = placed.where("late").groupBy("term", "doc", "target").agg(F.max("freq").alias("freq"))
            placed = placed.where("NOT late").select("term", "doc", "freq", "target").unionByName(late)
        if repeated or not more:
            break
        apart = F.when(F.col("by_record"), F.pmod(F.xxhash64("doc"), F.col("pieces")).cast("int")).otherwise(_digit("used", "bits"))
        placed = placed.join(F.broadcast(over.where("NOT stays")), F.col("target") == F.col("old"), "left").select(
            *rows.columns,
            F.coalesce(F.col("base") + apart, F.col("target")).alias("target"),
            (F.col("used") + F.coalesce("bits", F.lit(0))).alias("used"),
            (F.col("late") | F.coalesce("by_record", F.lit(False))).alias("late"),
        )
        new, parts, by_record = parts, parts + more, by_record or hot > 0
    return placed, parts, by_record


def _aggregate(folder: str, memory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        own = f"{folder}/radix-{uuid.uuid4().hex}"
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "preserve_insertion_order": False, "temp_directory": own})
        try:

            def stream():
                yield first
                yield from batches

            reader = pa.RecordBatchReader.from_batches(first.schema, stream())
            con.register("part", reader)
            out = con.sql(
                "SELECT term, CAST(sum(freq) AS BIGINT) AS freq, count(*) AS docs FROM"
                " (SELECT term, doc, max(freq) AS freq FROM part GROUP BY term, doc) GROUP BY term"
            ).to_arrow_reader(50_000)
            for batch in out:
                yield batch.cast(pa.schema([("term", pa.string()), ("freq", pa.int64()), ("docs", pa.int64())]))
        finally:
            con.close()
            shutil.rmtree(own, ignore_errors=True)

    return run


def term_frequencies(df: DataFrame, term: str, doc: str, freq: str, capacity: int = CAPACITY, memory: str = "400MB", scratch: str | None = None) -> DataFrame:
    """Of every distinct term: freq (sum over records) and docs (number of records); columns term, freq, docs.

    Terms are compared without surrounding white space and in lower case; a term of white space only is the term ''.
    Rows with a null term, doc or freq, or a freq below 1, don't count. A term and record in several rows count once,
    with the largest freq. Further columns are ignored, an empty table gives an empty result. capacity: rows of a
    partition; memory: of a DuckDB instance, beyond which it spills below scratch, a path all executors see: the shared
    folder where that is a file path; else it must be given.
    """
    spark = df.sparkSession
    scratch = scratch or scratch_path(durable_folder(spark))
    if scratch is None:
        raise ValueError("spark.checkpoint.dir is no file path; give scratch, a mounted path for DuckDB's spill")
    rows = df.where(df[term].isNotNull() & df[doc].isNotNull() & (df[freq] >= 1)).select(
        normal_term(df[term].cast("string")).alias("term"), df[doc].cast("string").alias("doc"), df[freq].cast("long").alias("freq")
    ).withColumn("h", F.xxhash64("term"))
    n = df.count()  # from the files' footers; those that don't count included
    capacity = max(1, min(capacity, max(LEAST, -(-n // spark.sparkContext.defaultParallelism))), -(-n // MOST))
    placed, parts, by_record = radix_placed(rows, n, capacity)
    moved = placed.repartitionById(parts, "target").select("term", "doc", "freq")
    found = moved.mapInArrow(_aggregate(scratch, memory), "term string, freq long, docs long")
    return found.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs")) if by_record else found


def counted_records(df: DataFrame, term: str, doc: str, freq: str) -> int:
    """Distinct records with a row that counts."""
    return df.where(df[term].isNotNull() & df[doc].isNotNull() & (df[freq] >= 1)).select(df[doc]).distinct().count()


def marked_terms(df: DataFrame, term: str, doc: str, freq: str, rare: int = 3, common: float = 0.1, capacity: int = CAPACITY) -> DataFrame:
    """term_frequencies() with mark: rare (freq of at most rare), common (in more than that share of records) or null.

    A term that is both, which takes few records, is rare.
    """
    records = counted_records(df, term, doc, freq)
    return term_frequencies(df, term, doc, freq, capacity).withColumn(
        "mark", F.when(F.col("freq") <= rare, "rare").when(F.col("docs") > F.lit(common) * F.lit(records), "common")
    )
