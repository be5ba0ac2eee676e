"""Problem 6: encoding the whole corpus with a public tokenizer.

A sentencepiece BPE model is serialised directly from the public vocabulary,
without training: each token's bytes are mapped to one printable character
each and become a piece, scored by its negative rank, under identity
normalisation. Merging the best-scored neighbours is then the same as merging
those of lowest rank, and a piece's place is the token's id. Texts are cut
into pre-tokens by the tokenizer's public pattern; each distinct pre-token is
encoded once per task and looked up after that.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's public pattern for pre-tokens (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a task remembers before it starts anew; it changes the time only.
REMEMBERED = 400_000
#: Characters of text that are cut at once.
SLICE_CHARS = 2_000_000


def byte_letters() -> list[str]:
    """One printable character for every byte: itself where it is printable Latin-1, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file with lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto in wire format, whose piece ids are the ranks; the unknown piece comes last.

    Fields by the public sentencepiece_model.proto: pieces 1 (piece 1, score 2, type 3), trainer_spec 2
    (model_type 3, vocab_size 4, unk_id 40, bos_id 41, eos_id 42, pad_id 43), normalizer_spec 3 (name 1, charsmap 2,
    add_dummy_prefix 3, remove_extra_whitespaces 4, escape_whitespaces 5).
    """
    letters = byte_letters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [rank for _, rank in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must count from 0 without gaps")
    out = bytearray()
    for token, rank in by_rank:
        piece = "".join(letters[b] for b in token).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + np.float32(-rank).tobytes())
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + np.float32(0).tobytes() + _int_field(3, 2))
    minus = (1 << 64) - 1
    trainer = _int_field(3, 2) + _int_field(4, len(by_rank) + 1) + _int_field(40, len(by_rank))
    trainer += b"".join(_int_field(k, minus) for k in (41, 42, 43))
    out += _bytes_field(2, trainer)
    out += _bytes_field(3, _bytes_field(1, b"identity") + _bytes_field(2, b"") + b"".join(_int_field(k, 0) for k in (3, 4, 5)))
    return bytes(out)


class Codec:
    """Encodes and decodes texts with the serialised model."""

    def __init__(self, path: str = BYTE_BPE, pattern: str = PATTERN):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise_model(ranks))
        self.cut = regex.compile(pattern).findall
        self.letters = byte_letters()
        self.back = {c: b for b, c in enumerate(self.letters)}
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.known: dict[str, list[int]] = {}

    def knows(self, rows: list[list[str]]) -> dict[str, list[int]]:
        """The ids of every pre-token of the rows, by pre-token."""
        from itertools import chain

        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list(set(chain.from_iterable(rows)).difference(known))
        if new:
            letters = self.letters
            mapped = [p.translate(_ASCII) if p.isascii() else "".join([letters[b] for b in p.encode()]) for p in new]
            known.update(zip(new, self.model.encode(mapped, num_threads=1)))
        return known

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty or null text has none."""
        if not text:
            return []
        pieces = self.cut(text)
        known = self.knows([pieces])
        return [i for p in pieces for i in known[p]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the inverse mapping; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.tokens[i] for i in ids).decode(errors="replace")


_ASCII = {b: c for b, c in enumerate(byte_letters()) if b < 128}
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str = BYTE_BPE, pattern: str = PATTERN) -> Codec:
    """This worker's codec of a vocabulary, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in runs of about SLICE_CHARS, so that a batch of very long texts stays small in memory."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text) if text else 0
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoder(path: str, pattern: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain

        own = codec(path, pattern)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1).to_pylist()):
                keys = batch.column(0).slice(at, len(texts))
                at += len(texts)
                pieces = [own.cut(x) if x else [] for x in texts]
                known = own.knows(pieces)
                if count_only:
                    counts = [sum([len(known[p]) for p in row]) for row in pieces]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64())], ["id", "n_tokens"])
                    continue
                rows = [list(chain.from_iterable([known[p] for p in row])) for row in pieces]
                offsets = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(offsets[-1])))
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "ids"])

    return run


def _mapped(df: DataFrame, key: str, text: str, path: str, pattern: str, count_only: bool) -> DataFrame:
    kind = df.select(key).schema[0].dataType.simpleString()
    out = "n_tokens long" if count_only else "ids array<int>"
    rows = df.select(df[key].alias("id"), df[text].cast("string").alias("text"))
    name = "n_tokens" if count_only else "ids"
    return rows.mapInArrow(_encoder(path, pattern, count_only), f"id {kind}, {out}").toDF(key, name)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE, pattern: str = PATTERN) -> DataFrame:
    """key and ids (array<int>) of every row, without special tokens.

    An empty and a null text give an empty list; strings that look like special tokens are ordinary text; texts of any
    length are encoded whole; a null key stays null; repeated rows are encoded each; an empty table gives an empty
    result; further columns are ignored. It is one narrow stage: no shuffle.
    """
    return _mapped(df, key, text, path, pattern, False)


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = BYTE_BPE, pattern: str = PATTERN) -> DataFrame:
    """key and n_tokens of every row; else as encode_corpus()."""
    return _mapped(df, key, text, path, pattern, True)
