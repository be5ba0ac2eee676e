"""Command line: expand, demo, index, search, hybrid, evaluate, info."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quernstone import __version__
from quernstone.functions import text as X
from quernstone.operators import expand, fusion, index, metrics, providers, sparse
from quernstone.session import build_session
from quernstone.sources import tables as S


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernstone", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("expand", help="expand a collection with the stand-in providers")
    p.add_argument("input"), p.add_argument("output"), p.add_argument("--limit", type=int), p.add_argument("--queries-only", action="store_true")
    p = sub.add_parser("demo", help="expand one text and show every stage")
    p.add_argument("text")
    p = sub.add_parser("index", help="index a collection")
    p.add_argument("input"), p.add_argument("output"), p.add_argument("--subset"), p.add_argument("--stem", action="store_true")
    p = sub.add_parser("search", help="search an index")
    p.add_argument("index"), p.add_argument("queries"), p.add_argument("output"), p.add_argument("--k", type=int, default=1000), p.add_argument("--stem", action="store_true"), p.add_argument("--limit", type=int)
    p = sub.add_parser("hybrid", help="fuse runs")
    p.add_argument("output"), p.add_argument("runs", nargs="+"), p.add_argument("--depth", type=int, default=1000)
    p = sub.add_parser("evaluate", help="metrics of runs as a table")
    p.add_argument("runs", nargs="+"), p.add_argument("qrels"), p.add_argument("--results")
    sub.add_parser("info", help="version and constants")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "info":
        print(f"quernstone {__version__}: BM25 k1 1.2, b 0.75; fusion constant {fusion.CONSTANT}; similarity limit {expand.THRESHOLD}; at most {expand.MOST} expansions")
        return
    spark = spark or build_session()
    if a.command == "expand":
        docs = S.read_pairs(spark, a.input)
        docs = docs if a.limit is None else docs.limit(a.limit)
        if a.queries_only:
            done = expand.expand_queries_only(docs, providers.HeadingQueries())
        else:
            done = expand.expand(docs, providers.EchoGenerator(), providers.NegationClassifier(), providers.HeadingQueries(), providers.HashingEncoder(), X.CHAT)
        S.write_pairs(done.select("doc_id", F.col("expanded").alias("text")), a.output)
    elif a.command == "demo":
        docs = spark.createDataFrame([("demo", a.text)], "doc_id string, text string")
        done = expand.expand(docs, providers.EchoGenerator(), providers.NegationClassifier(), providers.HeadingQueries(), providers.HashingEncoder(), X.CHAT).first()
        print("\n".join(f"{name}: {done[name]}" for name in ("gaps", "raw_expansions", "valid_expansions", "queries", "final", "expanded")))
    elif a.command == "index":
        subset = S.read_ids(spark, a.subset) if a.subset else None
        index.write_index(index.build_index(S.read_pairs(spark, a.input), stem=a.stem, subset=None if subset is None or subset.isEmpty() else subset), a.output)
    elif a.command == "search":
        queries = S.read_queries(spark, a.queries, limit=a.limit)
        run, latency = metrics.timed(lambda: sparse.bm25(index.read_index(spark, a.index, a.stem), queries, a.k), queries.count())
        S.write_run(run, a.output)
        print(f"mean latency {latency:.1f} ms")
    elif a.command == "hybrid":
        S.write_run(fusion.rrf([S.read_run(spark, r) for r in a.runs], depth=a.depth), a.output)
    elif a.command == "evaluate":
        runs = None
        for r in a.runs:
            runs = S.read_run(spark, r) if runs is None else runs.unionByName(S.read_run(spark, r))
        summary = metrics.compare(runs, S.read_qrels(spark, a.qrels))
        if a.results:
            S.write_results(summary, a.results)
        print(S.report(summary))


if __name__ == "__main__":
    main()
