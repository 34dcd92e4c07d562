"""Byte-level BPE through a sentencepiece model that is serialised from the ranks themselves."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strataframe.llm.common import in_small_batches, table

#: Pre-tokens whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where it is printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes are length-delimited, integers varints, floats fixed 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ids are the ranks.

    Pieces are spelled in ``byte_letters`` and score the negative rank, so the merge that sentencepiece
    prefers is the one of lowest rank, leftmost first.  Normalisation is the identity: no prefix, no
    white space removed or escaped.  The unknown piece that the format wants comes after the last rank.
    Ranks without a piece are filled by unused pieces.
    """
    letters = byte_letters()
    by_rank = {r: "".join(letters[b] for b in piece) for piece, r in ranks.items()}
    top = max(by_rank, default=-1)
    normal, unknown, unused = 1, 2, 5  # kinds of pieces in the model format
    pieces = [(by_rank.get(r, f"<unused{r}>"), -float(r), normal if r in by_rank else unused) for r in range(top + 1)] + [("<unk>", 0.0, unknown)]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, kind)) for p, s, kind in pieces)
    off = 0
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(24, off) + _field(40, len(pieces) - 1)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, off) + _field(4, off) + _field(5, off)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes one text at a time, as ``tiktoken`` does for ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.known = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, r in ranks.items():
            self.pieces[r] = piece
        self.memory: dict[str, tuple[int, ...]] = {}

    def _ids(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        if (whole := self.known.get(raw)) is not None:
            return (whole,)
        return tuple(self.model.encode(raw.decode("latin-1").translate(self.letters)))

    def encode(self, text: str) -> list[int]:
        tokens, memory = self.split(text), self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        for token in set(tokens).difference(memory):
            memory[token] = self._ids(token)
        return list(chain.from_iterable(map(memory.__getitem__, tokens)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(file: str, pattern: str | None = None) -> Codec:
    """The codec of a vocabulary file, built once in a Python worker.

    ``file`` is a path, or the name of a file that the installed tokenizer package knows on each machine.
    """
    import os

    import public_tokenizers

    path = file if os.path.isabs(file) else public_tokenizers.path(file)
    return Codec(read_ranks(path), pattern or public_tokenizers.PATTERN)


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def map_texts(docs: DataFrame, text: str, made: list[tuple[str, T.DataType]], start: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """Add columns that ``start()`` (called once a task) computes from each whole text, null read as empty.

    Arrow batches pass through; other columns are carried unchanged, and clashing names are replaced.
    """
    names = [n for n, _ in made]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, k) for n, k in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        of, kinds = start(), [to_arrow_type(k) for _, k in made]
        for batch in batches:
            rows = [of(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in kept], *columns], [*[f.name for f in kept], *names])

    return in_small_batches(docs).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, text: str = "text", file: str = VOCABULARY) -> DataFrame:
    """Add ``ids array<int>`` and ``decoded binary`` to each row.

    Whole texts; null and empty ones give no ids and empty bytes.  Rows are encoded one by one, repeats included; an
    empty table stays empty; columns of the added names are replaced.
    """

    def start() -> Callable[[str], tuple]:
        c = codec(file)

        def of(t: str) -> tuple:
            ids = c.encode(t)
            return ids, c.decode(ids)

        return of

    return map_texts(docs, text, [("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())], start)


def digest_documents(docs: DataFrame, text: str = "text", file: str = VOCABULARY) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; the ids stay in the task that made them.

    Nulls, repeats, empty tables and clashing names as in ``encode_documents``; no ids have the digest of nothing.
    """

    def start() -> Callable[[str], tuple]:
        c = codec(file)
        spelled = [str(i) for i in range(len(c.pieces))].__getitem__

        def of(t: str) -> tuple:
            ids = c.encode(t)
            return len(ids), hashlib.sha256(",".join(map(spelled, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        return of

    return map_texts(docs, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], start)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_documents(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
SQL: dict[str, str] = {}
