"""What generates, judges and encodes texts: interfaces, and stand-ins that need no model.

A provider is made on the driver, travels to the tasks by pickle, and loads
what it needs (a model, say) once in each Python worker, on first use.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TextGenerator(Protocol):
    """Answers prompts."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class NliClassifier(Protocol):
    """For each pair of premise and hypothesis a label (entailment, neutral, contradiction) and its probability."""

    def classify(self, pairs: list[tuple[str, str]]) -> list[tuple[str, float]]: ...


class QueryGenerator(Protocol):
    """The queries that a text answers."""

    def queries(self, texts: list[str], n: int) -> list[list[str]]: ...


class Encoder(Protocol):
    """Vectors of length one."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class EchoGenerator:
    """Stand-in: an answer of numbered lines, of the first sentences after the prompt's first line."""

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            found = [x.strip() for x in re.split(r"(?<=[.!?])\s+", prompt.partition("\n")[2]) if len(x.strip()) > 15][:3]
            out.append("\n".join(f"{n}. {x}" for n, x in enumerate(found, 1)))
        return out


class NegationClassifier:
    """Stand-in: a hypothesis with a negation contradicts a premise without one; a part of the premise is entailed."""

    def classify(self, pairs: list[tuple[str, str]]) -> list[tuple[str, float]]:
        no = re.compile(r"\b(?:not|no|never|cannot)\b").search
        return [
            ("entailment", 0.9) if h in p else ("contradiction", 0.8) if no(h.lower()) and not no(p.lower()) else ("neutral", 0.6) for p, h in pairs
        ]


class HeadingQueries:
    """Stand-in: questions about the first words of the first sentences."""

    def queries(self, texts: list[str], n: int) -> list[list[str]]:
        return [["what about " + " ".join(s.split()[:4]).lower() for s in re.split(r"(?<=[.!?])\s+", t)[:n] if s.strip()] for t in texts]


class HashingEncoder:
    """Stand-in: hashed words, at length one."""

    def __init__(self, dim: int = 32):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                out[row, h % self.dim] += 1 if h >> 63 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)


def _batched(call, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                part = whole.slice(at, size)
                new = call(*[part.column(c).to_pylist() for c in range(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([part.column(part.num_columns - 1), *new], ["_row", *[f"_{n}" for n in range(len(new))]])

    return run


def apply_batched(df: DataFrame, inputs: list[str], outputs: list[tuple[str, str]], call, size: int) -> DataFrame:
    """The rows with new columns from call(lists of the inputs), size rows at a time; call gives one Arrow array each."""
    kept = F.struct(*df.columns)
    kind = T.StructType([T.StructField("_row", df.schema)])
    schema = T.StructType([*kind.fields, *[T.StructField(f"_{n}", T._parse_datatype_string(t)) for n, (_, t) in enumerate(outputs)]])
    rows = df.select(*[df[c] for c in inputs], kept.alias("_row"))
    done = rows.toDF(*[f"i{n}" for n in range(len(inputs))], "_row").mapInArrow(_batched(call, size), schema)
    return done.select("_row.*", *[F.col(f"_{n}").alias(name) for n, (name, _) in enumerate(outputs)])


def encode(df: DataFrame, text: str, encoder: Encoder, out: str = "embedding", size: int = 256) -> DataFrame:
    def call(texts):
        return [pa.array([v.tolist() for v in encoder.encode([t or "" for t in texts])], pa.list_(pa.float32()))]

    return apply_batched(df, [text], [(out, "array<float>")], call, size)


def answer(df: DataFrame, prompt: str, generator: TextGenerator, out: str = "answer", size: int = 8) -> DataFrame:
    """The rows with an answer and an error: a batch that fails gives null answers and the error's text."""

    def call(prompts):
        try:
            return [pa.array(generator.generate([p or "" for p in prompts]), pa.string()), pa.nulls(len(prompts), pa.string())]
        except Exception as error:  # the provider's, reported with its rows
            return [pa.nulls(len(prompts), pa.string()), pa.array([str(error)] * len(prompts), pa.string())]

    return apply_batched(df, [prompt], [(out, "string"), (f"{out}_error", "string")], call, size)


def ask(df: DataFrame, text: str, generator: QueryGenerator, n: int = 3, out: str = "queries", size: int = 8) -> DataFrame:
    """The rows with at most n queries, without repetitions, in the order they were made, and an error."""

    def call(texts):
        try:
            made = [list(dict.fromkeys(q)) for q in generator.queries([t or "" for t in texts], n)]
            return [pa.array(made, pa.list_(pa.string())), pa.nulls(len(texts), pa.string())]
        except Exception as error:
            return [pa.array([[]] * len(texts), pa.list_(pa.string())), pa.array([str(error)] * len(texts), pa.string())]

    return apply_batched(df, [text], [(out, "array<string>"), (f"{out}_error", "string")], call, size)


def entail(df: DataFrame, premise: str, hypotheses: str, classifier: NliClassifier, out: str = "valid", mode: str = "lenient", size: int = 64) -> DataFrame:
    """The rows with the hypotheses that pass: lenient drops those labelled as contradictions, strict keeps entailments
    of at least 0.5. Where the classifier fails on a batch its pairs are asked one by one, and a pair it fails on
    doesn't pass; the row gives the error."""

    def fine(label: str, p: float) -> bool:
        return label != "contradiction" if mode == "lenient" else label == "entailment" and p >= 0.5

    def one(pair: tuple[str, str]) -> tuple[bool, str | None]:
        try:
            return fine(*classifier.classify([pair])[0]), None
        except Exception as error:
            return False, str(error)

    def call(premises, lists):
        flat = [(p or "", h) for p, hs in zip(premises, lists) for h in hs or []]
        try:
            told = [(fine(*x), None) for x in classifier.classify(flat)]
        except Exception:  # the provider's, reported with its rows
            told = [one(pair) for pair in flat]
        kept, errors, rest = [], [], iter(told)
        for hs in lists:
            own = [next(rest) for _ in hs or []]
            kept.append([h for h, (good, _) in zip(hs or [], own) if good])
            errors.append(next((e for _, e in own if e is not None), None))
        return [pa.array(kept, pa.list_(pa.string())), pa.array(errors, pa.string())]

    return apply_batched(df, [premise, hypotheses], [(out, "array<string>"), (f"{out}_error", "string")], call, size)
