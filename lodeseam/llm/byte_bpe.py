"""Byte-level BPE by a sentencepiece model that is serialised straight from a vocabulary of ranks.

Each token of the rank file becomes a piece: its bytes mapped to 256 printable characters, its score the negative rank,
so that sentencepiece merges in rank order. Normalisation is the identity, without a dummy prefix and without any change of
white space. The text is cut by the pre-token pattern, each pre-token is mapped to characters and encoded by itself; ids
are the ranks. Decoding maps ids back to pieces, characters and bytes.

Scale: a map over the rows, no shuffle. The model (about 1 MB, fixed by the vocabulary) is broadcast; each worker keeps a bounded
table of pre-tokens that it has already encoded, over all its tasks, and passes new ones to sentencepiece in batches.

Cases: a null or empty text gives no ids; text of any length is taken whole; bytes outside the vocabulary can't occur, as
all 256 single bytes are pieces (checked when the model is made); other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import table

#: Bytes of pre-tokens, ids and decoded bytes that a worker remembers at most; beyond that it starts anew.
REMEMBERED = 96_000_000
#: What the tables themselves take for an entry.
ENTRY_BYTES = 300


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    """A protobuf field: varint, length-delimited or 32-bit float."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ``i`` is token ``i``; the piece after them is <unk>."""
    if missing := set(range(256)) - {t[0] for t in tokens if len(t) == 1}:
        raise ValueError(f"{len(missing)} single bytes are not in the vocabulary")
    letters = byte_characters()
    normal, unknown = 1, 2
    pieces = [_field(1, "".join(letters[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    bpe = 2
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes and decodes texts by a serialised model; one per worker."""

    def __init__(self, model: bytes, pattern: str, remembered: int = REMEMBERED):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_characters()))
        self.bytes_of = {c: b for b, c in self.letters.items()}
        self.remembered = remembered
        self.pieces = [bytes(self.bytes_of[c] for c in self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.shown: dict[str, str] = {}  # a pre-token's ids in decimal
        self.back: dict[str, bytes] = {}  # and what they decode to
        self.held = 0

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        return self.sp.encode([w.encode().decode("latin-1").translate(self.letters) for w in words], num_threads=1)

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_words(self.find(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids in decimal joined by spaces, and the decoded bytes; a pre-token met before is not encoded and decoded again."""
        words = self.find(text or "")
        shown, back = self.shown, self.back
        if new := {w for w in words if w not in shown}:
            if self.held > self.remembered:
                shown.clear()
                back.clear()
                self.held, new = 0, set(words)
            new = list(new)
            for word, ids in zip(new, self.encode_words(new), strict=True):
                shown[word] = " ".join(map(str, ids))
                back[word] = self.decode(ids)
                self.held += 2 * len(word) + len(shown[word]) + ENTRY_BYTES
        line = " ".join(map(shown.__getitem__, words))
        return line.count(" ") + bool(line), line.encode(), b"".join(map(back.__getitem__, words))


@lru_cache(maxsize=1)
def worker_coder(model: bytes, pattern: str) -> Coder:
    """The coder of this worker, which outlives its tasks."""
    return Coder(model, pattern)


def _rows(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` on slices of at most about 8 MB of text."""
    for batch in batches:
        step = max(1, int(8e6 * batch.num_rows / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield work(batch.slice(at, step))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids)``: the ids of every text, as ``array<int>``."""
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value, pattern)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([coder.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([b.column("key"), ids], ["key", "ids"])

        yield from _rows(batches, work)

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode_documents(rows: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, bytes)``: the bytes that each list of ids stands for."""
    model = rows.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))
    rows = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model.value, "")
        for b in batches:
            out = pa.array([coder.decode(x or []) for x in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), out], ["key", "bytes"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, bytes binary").withColumnRenamed("key", key)


def encoding_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document: number of ids, and SHA-256 of the ids in decimal and of the bytes that they decode to."""
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(model.value, pattern)

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], []]
            for t in b.column("text"):
                n, shown, back = coder.digests(t.as_py())
                out[0].append(n)
                out[1].append(hashlib.sha256(shown).hexdigest())
                out[2].append(hashlib.sha256(back).hexdigest())
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        yield from _rows(batches, work)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
