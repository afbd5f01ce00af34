"""Best-fit packing by sums of squares.

A document goes where the sum of the squared counts of open sequences per residual gap becomes smallest, of all open sequences that it fits into; only if there
is none, a new one is opened (the plain rule opens one also where that makes the sum smaller; on the test documents this took 978 sequences instead of 965). Largest documents go first. The rule looks at sizes only, so it runs over the histogram of sizes (at most ``capacity``
counts, whatever the corpus): a histogram of more than ``limit`` documents is divided by a whole number, packed, and each
resulting sequence is repeated that many times; what the division leaves over is packed in the same way. The plan says for each
size which ranks go to which sequences and offsets; documents get their rank among those of their size by a distributed
numbering and look it up.

Scale: tokenising is a map; its pieces (some 30 bytes each) are checkpointed, the driver sees ``capacity`` counts, and the
broadcast plan has at most ``limit`` entries a level with a few levels (the logarithm of the corpus over ``limit``). A size that a third of all rows
share is cut into blocks by the numbering.

Cases: a null or empty text is one piece that holds the end token; longer ones are cut into pieces of ``capacity``, the rest first;
repeated rows are packed one by one; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.byte_bpe import byte_characters
from lodeseam.llm.common import durable, gapless_numbers, table

CAPACITY = 1024
END_TOKEN = 2
#: Documents that one level of the plan places one by one.
LIMIT = 300_000


def tokenizer_ranks(path: str) -> tuple[dict[bytes, int], str, dict[str, int]]:
    """Ranks, pre-token pattern and added tokens for the ids of a ``tokenizers`` byte-level BPE file.

    Ids are ranks if each merge makes the next id; that is checked here, as the faster encoder of the same vocabulary relies on it.
    """
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    model, added = read["model"], read.get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take their surroundings in")
    vocabulary, merges = model["vocab"], model["merges"]
    last = -1
    for m in merges:
        made = vocabulary["".join(m if isinstance(m, list) else m.split(" "))]
        if made <= last:
            raise ValueError("ids do not follow the merges")
        last = made
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {t["content"]: t["id"] for t in added}
    return {bytes(back[c] for c in token): i for token, i in vocabulary.items() if token not in special}, _pattern(), special


def _pattern() -> str:
    """The pre-token pattern of the byte-level tokenizers."""
    return r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of each piece of a document; the first takes what is over."""
    first = length % capacity or min(length, capacity)
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_ranks(vocabulary))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern, special = shared.value
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        encode = partial(encoding.encode, allowed_special="all")  # added tokens in a text get their ids, as from the file's own encoder
        for b in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for at in range(b.num_rows):
                ids = encode(b.column("text")[at].as_py() or "")
                ids.append(end_token)
                packed, doc_id = np.array(ids, "<u4"), b.column("doc_id")[at].as_py()
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(packed[start : start + length].tobytes())))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences (lists of sizes) for ``counts[size]`` documents of each size, largest sizes first; a sequence is opened where none fits."""
    gaps = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences: list[list[int]] = []
    for size in range(capacity, 0, -1):
        here = gaps[size:]  # a gap g = size + i becomes the gap i
        for _ in range(int(counts[size])):
            # change of the sum of squares: -2 N(g) + 1 for leaving g, + 2 N(g - size) + 1 for entering g - size (none for a full one)
            change = 2 * (gaps[: capacity + 1 - size] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = np.iinfo(np.int64).max
            at = int(change.argmin())
            if here[at]:
                k = stacks[size + at].pop()
                gaps[size + at] -= 1
                left = at
            else:
                k, left = len(sequences), capacity - size
                sequences.append([])
            sequences[k].append(size)
            if left:
                gaps[left] += 1
                stacks[left].append(k)
    return sequences


def plan(counts: np.ndarray, capacity: int, limit: int = LIMIT) -> dict[int, np.ndarray]:
    """Per size, rows (first rank, first sequence, offset): the ranks from there on go to consecutive sequences from there on."""
    counts = counts.astype(np.int64).copy()
    ranks = np.zeros(capacity + 1, np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    if counts[capacity]:  # whole pieces fill a sequence each
        rows[capacity], sequence = [(0, 0, 0)], int(counts[capacity])
        counts[capacity] = 0
    while counts.sum():
        times = max(1, int(-(-counts.sum() // limit)))
        if times > 1 and not (counts // times).any():
            times = int(counts.max())
        for sizes in sum_of_squares(counts // times, capacity):
            offset = 0
            for size in sizes:
                rows.setdefault(size, []).append((int(ranks[size]), sequence, offset))
                ranks[size] += times
                offset += size
            sequence += times
        counts %= times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def pack(found: DataFrame, capacity: int = CAPACITY, limit: int = LIMIT) -> DataFrame:
    """``found`` (rows with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``, which replace columns of these names."""
    found = durable(found.drop("sequence_id", "offset"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    shared = found.sparkSession.sparkContext.broadcast(plan(counts, capacity, limit))
    numbered = gapless_numbers(found, ["length"], "_ls_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_ls_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                rows, here = shared.value[int(size)], length == size
                at = np.searchsorted(rows[:, 0], rank[here], "right") - 1
                sequence[here] = rows[at, 1] + rank[here] - rows[at, 0]
                offset[here] = rows[at, 2]
            keep = [n for n in b.schema.names if n != "_ls_rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return numbered.select(*found.columns, "_ls_rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """One row per piece of every document, with its sequence and its place there."""
    return pack(pieces(docs, vocabulary, capacity, end_token), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
