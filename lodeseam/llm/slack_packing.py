"""Minimum bin slack packing.

Sequences are filled one after the other: the longest remaining piece opens a sequence, and of all multisets of the remaining lengths one whose sum comes closest to what is left is taken, found by a subset-sum
dynamic programme over bitsets (bit ``s`` of a whole number: the sum ``s`` can be made) and traced back to how often each length is used. Only the histogram of lengths is needed, so a multiset found
once fills as many sequences as the histogram can serve at once; each time at least one length falls below its use. Documents are cut only where that takes padding away: longer ones into whole
sequences and a rest; where no multiset closes a sequence, a longer piece gives its first part to the gap and its rest returns to the histogram; what the very last sequence lacks is avoided by cutting it into powers
of two, which are not padded.

Scale: tokenising is a map; its rows are checkpointed and get a rank among those of the same length by a distributed numbering. The driver sees ``capacity`` counts and makes a plan of lots (runs of ranks
of a length, their part of the document, the run of sequences that takes them), whose number is bounded by the lengths and the uses of them, not by the corpus; it is broadcast, and its size is checked. Documents
that the plan cuts are encoded once more for the checksums of their parts: they are told by id and the text's hash, never gathered.

Cases: a null or empty text is one piece that holds the end token; repeated rows are packed one by one; documents of the same length are alike (which of them is cut is decided by their rank); an empty table gives no rows; other
columns play no part; a document's length is not limited, its ids are held in one task at a time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import durable, gapless_numbers, table
from lodeseam.llm.packing import tokenizer_ranks

CAPACITY = 2048
END_TOKEN = 1
#: Lots that a plan may have; far above what lengths and their uses allow, it guards the broadcast.
MOST_LOTS = 5_000_000


class Lot(NamedTuple):
    """``count`` documents of ``size`` (as they were counted) from rank ``first`` on: their ``length`` ids from ``start`` on go to as many sequences from ``sequence`` on, at ``offset``."""

    size: int
    first: int
    count: int
    start: int
    length: int
    sequence: int
    offset: int


def closest(counts: dict[int, int], most: int) -> dict[int, int]:
    """How often each length is used by a multiset of ``counts`` with the largest sum of at most ``most``; longer lengths are tried first."""
    mask, reach = (1 << most + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, sums before
    for size in sorted((s for s, n in counts.items() if n and s <= most), reverse=True):
        left, times = min(counts[size], most // size), 1
        while left and not reach >> most:
            times = min(times, left)
            steps.append((size, times, reach))
            reach |= reach << size * times & mask
            left -= times
            times *= 2
        if reach >> most:
            break
    used: dict[int, int] = {}
    total = reach.bit_length() - 1
    for size, times, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + times
            total -= size * times
    return used


class Planner:
    """Pieces that are left, by length, and the lots made so far."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.stock: dict[int, int] = {}
        self.left: dict[int, deque[tuple[int, int, int, int]]] = {}  # by length: size, first rank, count, start
        self.lots: list[Lot] = []
        for length in np.flatnonzero(counts).tolist():
            self.put(length, (length, 0, int(counts[length]), 0))

    def put(self, length: int, lot: tuple[int, int, int, int]) -> None:
        self.stock[length] = self.stock.get(length, 0) + lot[2]
        self.left.setdefault(length, deque()).append(lot)

    def place(self, length: int, times: int, offset: int, part: int) -> None:
        """The first ``part`` ids of ``times`` pieces of ``length`` go to the next sequences, one to each; what is over returns."""
        self.stock[length] -= times
        sequence, waiting = self.sequence, self.left[length]
        while times:
            size, first, count, start = waiting.popleft()
            if count > times:
                waiting.appendleft((size, first + times, count - times, start))
                count = times
            self.lots.append(Lot(size, first, count, start, part, sequence, offset))
            if part < length:
                self.put(length - part, (size, first, count, start + part))
            sequence += count
            times -= count
        if len(self.lots) > MOST_LOTS:
            raise ValueError("a plan of too many lots")

    def fill(self) -> bool:
        """Fills as many sequences as it can with one multiset; whether something was left to be placed."""
        longest = max((s for s, n in self.stock.items() if n), default=0)
        if not longest:
            return False
        rest = self.stock | {longest: self.stock[longest] - 1}
        used = closest(rest, self.capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        gap = self.capacity - sum(s * n for s, n in used.items())
        spare = {s: n // (used.get(s, 0) + 1) for s, n in self.stock.items() if gap and n > used.get(s, 0)}  # all longer than the gap, or they would be used
        cut = max(spare, key=lambda s: (spare[s], -s), default=0)  # the one that serves most sequences
        if gap and not cut:
            self.fill_powers(self.capacity - gap)
            return False
        times = min(self.stock[s] // (n + (s == cut)) for s, n in (used | {cut: used.get(cut, 0)} if cut else used).items())
        offset = 0
        for size in sorted(used, reverse=True):
            for _ in range(used[size]):
                self.place(size, times, offset, size)
                offset += size
        if cut:
            self.place(cut, times, offset, gap)
        self.sequence += times
        return True

    def fill_powers(self, total: int) -> None:
        """All that is left, ``total`` ids, in sequences of a power of two each."""
        for power in range(total.bit_length() - 1, -1, -1):
            room = total & 1 << power
            offset = 0
            while offset < room:
                longest = max(s for s, n in self.stock.items() if n)
                part = min(longest, room - offset)
                self.place(longest, 1, offset, part)
                offset += part
            self.sequence += bool(room)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Lot]:
    """Lots that place ``counts[length]`` pieces of each length of at most ``capacity``."""
    planner = Planner(counts, capacity)
    while planner.fill():
        pass
    return planner.lots


def by_size(lots: list[Lot]) -> dict[int, list[np.ndarray]]:
    """Per size, arrays (first rank, count, start, length, first sequence, offset) in order of rank; the ranks of one array do not overlap, and a later one holds later parts."""
    found: dict[int, list[list[Lot]]] = {}
    for lot in sorted(lots, key=lambda x: (x.size, x.start, x.first)):
        layers = found.setdefault(lot.size, [])
        for layer in layers:  # parts of a rank come in order of start
            if layer[-1].first + layer[-1].count <= lot.first:
                layer.append(lot)
                break
        else:
            layers.append([lot])
    return {size: [np.array([x[1:] for x in layer], np.int64) for layer in layers] for size, layers in found.items()}


def _encoder(vocabulary: tuple[dict[bytes, int], str, dict[str, int]]) -> Callable[[str], list[int]]:
    import tiktoken

    ranks, pattern, special = vocabulary
    return partial(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special).encode, allowed_special="all")


def _checksum(ids: np.ndarray, start: int, length: int) -> int:
    return zlib.crc32(ids[start : start + length].tobytes())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(schema.names), schema.types, strict=True)], schema=schema)


def _identified(docs: DataFrame) -> DataFrame:
    """Documents as (``doc_id``, hash of the text, text); rows equal in both have the same ids."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def whole_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """``(doc_id, text_hash, doc_tokens, start, length, ids_crc32)``: each document in pieces of ``capacity`` and a rest."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_ranks(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value)
        for b in batches:
            rows = []
            for at in range(b.num_rows):
                ids = np.array([*encode(b.column("text")[at].as_py()), end_token], "<u4")
                doc = (b.column("doc_id")[at].as_py(), b.column("text_hash")[at].as_py(), len(ids))
                for start in range(0, len(ids), capacity):
                    length = min(capacity, len(ids) - start)
                    rows.append((*doc, start, length, _checksum(ids, start, length)))
            yield _batch(rows, schema)

    return _identified(docs).mapInArrow(run, "doc_id long, text_hash long, doc_tokens long, start long, length long, ids_crc32 long")


def _placed(numbered: DataFrame, lots: list[Lot]) -> DataFrame:
    """Pieces with a rank among those of their length, divided and placed as the lots say; ``ids_crc32`` is null for parts."""
    shared = numbered.sparkSession.sparkContext.broadcast(by_size(lots))
    names = ["doc_id", "text_hash", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            for s in np.unique(size):
                here = np.flatnonzero(size == s)
                for layer in shared.value[int(s)]:
                    at = np.searchsorted(layer[:, 0], rank[here], "right") - 1
                    holds = (at >= 0) & (rank[here] < layer[at, 0] + layer[at, 1])
                    rows, lot = b.take(pa.array(here[holds])), layer[at[holds]]
                    start = rows.column("start").to_numpy() + lot[:, 2]
                    crc = pa.array(rows.column("ids_crc32").to_numpy(), mask=lot[:, 3] != s)
                    sequence = lot[:, 4] + rank[here][holds] - lot[:, 0]
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names[:3]), *map(pa.array, (start, lot[:, 3])), crc, *map(pa.array, (sequence, lot[:, 5]))], names)

    return numbered.select(*names[:6], "rank").mapInArrow(run, "doc_id long, text_hash long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _part_checksums(docs: DataFrame, parts: DataFrame, vocabulary: str, end_token: int) -> DataFrame:
    """``(doc_id, text_hash, start, length, ids_crc32)`` of ``parts``, from their documents, which are encoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_ranks(vocabulary))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value)
        for b in batches:
            rows = []
            for at in range(b.num_rows):
                ids = np.array([*encode(b.column("text")[at].as_py()), end_token], "<u4")
                doc = (b.column("doc_id")[at].as_py(), b.column("text_hash")[at].as_py())
                rows += [(*doc, p["start"], p["length"], _checksum(ids, p["start"], p["length"])) for p in b.column("parts")[at].as_py()]
            yield _batch(rows, schema)

    wanted = parts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "length")).alias("parts"))  # a document has fewer different parts than a piece has ids, squared
    own, w = _identified(docs).alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash"))
    texts = own.join(w, same).select("d.*", "w.parts").dropDuplicates(["doc_id", "text_hash"])
    return texts.mapInArrow(run, "doc_id long, text_hash long, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: one row per piece of every document, with its sequence and its place there."""
    found = durable(whole_pieces(docs, vocabulary, capacity, end_token))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    lots = plan(counts, capacity)
    placed = durable(_placed(gapless_numbers(found, ["length"], "rank"), lots))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if all(lot.length == lot.size for lot in lots):
        return placed.select(*columns)
    parts = placed.where("ids_crc32 IS NULL").drop("ids_crc32").alias("p")
    known = _part_checksums(docs, parts, vocabulary, end_token).alias("k")
    same = F.col("p.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("p.text_hash") == F.col("k.text_hash")) & (F.col("p.start") == F.col("k.start")) & (F.col("p.length") == F.col("k.length"))
    return placed.where("ids_crc32 IS NOT NULL").select(*columns).unionByName(parts.join(known, same).select("p.*", "k.ids_crc32").select(*columns))


def op12_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
