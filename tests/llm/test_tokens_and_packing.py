import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quernstone.llm import packing, tokens

TEXTS = [None, "", " ", "Hello world", "  two  spaces\n\n\tand tabs ", "naïve café — 東京タワー ไทยไทย हिन्दी العربية 👍🏽", "it's we'll <|endoftext|> 12345 x", "a" * 50_000, "\x00\x1f​﻿", "é" * 3]
needs_files = pytest.mark.skipif(not Path(tokens.BYTE_BPE).exists(), reason="no vocabulary files here")


@needs_files
def test_same_ids_as_the_vocabulary_s_own_library(spark):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.read_ranks(tokens.BYTE_BPE), special_tokens={})
    df = spark.createDataFrame([(n, t, "x", [1]) for n, t in enumerate(TEXTS)], "doc_id long, text string, id string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df).collect()}
    assert got == {n: own.encode_ordinary(t) if t else [] for n, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert counts == {n: len(ids) for n, ids in got.items()}
    assert tokens.encode_corpus(df.limit(0)).collect() == []
    codec = tokens.codec()
    assert all(codec.decode(got[n]) == (t or "") for n, t in enumerate(TEXTS))


@needs_files
def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    codec = tokens.Codec()
    a = [codec.encode(t) for t in TEXTS]
    assert [codec.encode(t) for t in reversed(TEXTS)] == a[::-1]


def test_ranks_without_gaps():
    with pytest.raises(ValueError):
        tokens.serialise_model({b"a": 0, b"b": 2})


def slow_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for n, r in enumerate(room):
            if r >= s:
                break
        else:
            n = len(room)
            room.append(capacity)
        room[n] -= s
        out.append(n)
    return out


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    import numpy as np

    for n in (1, 2, 7, 300):
        sizes = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
        assert packing.first_fit_decreasing(np.array(sizes), 50).tolist() == slow_first_fit(sizes, 50)


@pytest.mark.parametrize("group", [20, 20_000])
def test_nothing_is_lost_or_overfull(spark, group):
    rng = random.Random(2)
    rows = [(n, rng.choice([1, 5, 30, 64, 100, 101, 250, 1000])) for n in range(500)] + [(7, 5), (900, 0), (901, None), (None, 4), (902, -3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_tokens long, lot string")
    out = packing.pack(df, "doc_id", "n_tokens", 100, group).collect()
    fill, whole = {}, {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
        whole.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"]))
    assert max(fill.values()) <= 100
    want = [(n, s) for n, s in rows if n is not None and s and s > 0]
    assert sum(fill.values()) == sum(s for _, s in want) and set(whole) == {n for n, _ in want}
    sizes = dict(rows)
    for n, parts in whole.items():
        if n != 7:
            assert len(parts) == -(-sizes[n] // 100) and sorted(p[0] for p in parts) == list(range(0, sizes[n], 100))
    if group > 500:
        assert len(fill) <= -(-sum(fill.values()) // 100) + 3
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", 100).collect() == []


def test_one_key_in_most_rows(spark):
    """Its rows are dealt over all groups."""
    df = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), (F.col("id") % 40 + 1).alias("n"))
    got = packing.pack(df, "k", "n", 100, group_items=500).collect()
    assert len(got) == 3_000 and sum(r["n_tokens"] for r in got) == sum(n % 40 + 1 for n in range(3_000))
    lots = [r["container"].split("-")[0] for r in got]
    assert len(set(lots)) == 6 and max(lots.count(x) for x in set(lots)) < 800
