"""Substring dedup by compaction of the de Bruijn graph of token k-mers.

Nodes are runs of ``k - 1`` words, edges are windows of ``k`` words, from the node of the first ``k - 1`` of them to that of the last. Consecutive windows of a document that share their minimizer (the
smallest hash of ``m`` words in a window) form a path, known by its minimizer and a hash of its words. Joins keep what repeats and compact it:

1. Minimizers that occur once are dropped with all their windows; paths with a repeated minimizer are counted and get the coordinates (document, word) of their first occurrence.
2. The node at a path's end does not branch if all occurrences of the path go on to one and the same path (one way out) which occurs as often (one way in). A join on coordinates finds such
   neighbours, and a running sum along the source makes one path of each run of them, known by its first part: what repeats in one stretch is one row an occurrence.
3. A minimizer with a single path has no other windows. One with several paths branches inside: their first occurrences are opened into windows, compared by minimizer and window hash
   (together 128 bits).
4. Spans that copy neighbouring stretches of one source are one span. The words at the source's coordinates are read and digested, and a later span goes only if its own words have the same
   digest (BLAKE2, 128 bits).

The result is exact for windows: a word goes if some window over it has the same words as a window that starts earlier (smaller document, or earlier in the same one).

Scale: paths hold about ``(k - m + 2) / 2`` windows, so the shuffles carry a ninth of the words, and after the first join only repeated ones. Counts, degrees and first
occurrences are combined before their shuffles; joins are equi-joins that AQE splits if a passage is hot. Texts move only for documents with repeats and their sources; a source that many
others copy is asked for at most ``ASKED`` spans in a row.

Cases: null, empty and short texts have no window and stay; words are runs of anything but ASCII white space, compared byte by byte; rows that repeat an id with the same text are one
document to each other (neither is earlier); rows with one id and different texts are told apart by a hash of the text; a null id comes before all others; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeseam.llm.common import durable, table

WINDOW = 20
MINIMIZER = 5
#: Documents with repeats up to which their ids (16 bytes each) are broadcast, to leave other texts where they are.
BROADCAST_IDS = 500_000
#: Bytes of text that are hashed at a time.
SLICE = 1_000_000
#: Spans of a source that are looked up together.
ASKED = 4_096

_RANDOM = np.random.default_rng(20)
_LETTERS = _RANDOM.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_Q_BACK = pow(_Q, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(max(1, n), base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for every word of all texts, in order, and the number of words of each text."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[buffer]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    lengths = ends - starts
    place = np.zeros(len(buffer), np.int64)  # of each byte in its word
    place[starts[0] :] = np.arange(starts[0], len(buffer)) - np.repeat(starts, np.diff(starts, append=len(buffer)))
    place[space] = 0
    values = _LETTERS[buffer] * _powers(_P, int(lengths.max()))[place]
    values[space] = 0
    return _mix(np.add.reduceat(values, starts) ^ (lengths.astype(np.uint64) * np.uint64(_P))), counts


class Windows:
    """Windows of ``k`` words over several texts at once."""

    def __init__(self, texts: list[bytes], k: int = WINDOW, m: int = MINIMIZER):
        self.k, self.m = k, m
        self.words, self.counts = word_hashes(texts)
        n = len(self.words)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))[:-1].astype(np.int64)  # of each text
        self.back = _powers(_Q_BACK, n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * _powers(_Q, n), dtype=np.uint64)))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words from ``start`` to before ``end``, whatever stands around them."""
        return _mix((self.sums[end] - self.sums[start]) * self.back[start] ^ ((end - start).astype(np.uint64) * np.uint64(_P)))

    def paths(self) -> dict[str, np.ndarray]:
        """``text``, ``p`` (word in the text), ``n`` (windows), ``mz`` and ``c`` (hashes) of each path, and ``next``, the ``c`` of the path behind it (0 at the end of a text)."""
        k, m, n = self.k, self.m, len(self.words)
        empty = {name: np.empty(0, kind) for name, kind in (("text", np.int64), ("p", np.int64), ("n", np.int64), ("mz", np.uint64), ("c", np.uint64), ("next", np.uint64))}
        if n < k:
            return empty
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.arange(n - m + 1)
        small = self.span_hash(at, at + m)
        place, width = at, 1
        while width < k - m + 1:  # the leftmost smallest of twice as many, as far as the window goes
            step = min(width, k - m + 1 - width)
            left, right = place[:-step], place[step:]
            place = np.where(small[left] <= small[right], left, right)
            width += step
        starts = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
        if not len(starts):
            return empty
        place = place[starts]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)))
        begin = np.flatnonzero(new)
        length = np.diff(begin, append=len(starts))
        start = starts[begin]
        text = owner[start]
        c = _mix(self.span_hash(start, start + length + k - 1) + (place[begin] - start).astype(np.uint64))
        follows = np.append(c[1:], np.uint64(0)) * np.append(text[1:] == text[:-1], False)
        return {"text": text, "p": start - self.first[text], "n": length, "mz": small[place[begin]], "c": c, "next": follows}


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(SLICE * batch.num_rows / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64, copy=False).view(np.int64))


def _minimizers(keyed: DataFrame, k: int, m: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            values, n = np.unique(Windows(_texts(b), k, m).paths()["mz"], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(values), pa.array(np.minimum(n, 2).astype(np.int32))], ["mz", "times"])

    return keyed.select("text").mapInArrow(run, "mz long, times int")


def _occurrences(keyed: DataFrame, k: int, m: int) -> DataFrame:
    names = ["mz", "c", "next", "_ls_did", "_ls_th", "p", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = Windows(_texts(b), k, m).paths()
            own = pa.array(x["text"])
            columns = [_signed(x["mz"]), _signed(x["c"]), _signed(x["next"]), b.column("_ls_did").take(own), b.column("_ls_th").take(own), pa.array(x["p"].astype(np.int32)), pa.array(x["n"].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed.mapInArrow(run, "mz long, c long, next long, _ls_did long, _ls_th long, p int, n int")


def _opened(keyed: DataFrame, k: int, m: int) -> DataFrame:
    """Windows ``(mz, w, _ls_did, _ls_th, p)`` of the paths listed in ``todo`` (structs of p, n, mz) of each document."""
    names = ["mz", "w", "_ls_did", "_ls_th", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = Windows(_texts(b), k, m)
            lists = b.column("todo")
            flat, own = lists.flatten(), np.repeat(np.arange(b.num_rows), np.asarray(lists.value_lengths()))
            p, n = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("p", "n"))
            each = np.repeat(np.arange(len(p)), n)
            word = p[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            start, owner = x.first[own[each]] + word, pa.array(own[each])
            columns = [flat.field("mz").take(pa.array(each)), _signed(x.span_hash(start, start + k)), b.column("_ls_did").take(owner), b.column("_ls_th").take(owner), pa.array(word.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return keyed.mapInArrow(run, "mz long, w long, _ls_did long, _ls_th long, p int")


def _keyed(docs: DataFrame) -> DataFrame:
    """``_ls_did`` (the id, the smallest long for null) and ``_ls_th`` (a hash of the text where an id repeats, else 0)."""
    ids = docs.select("doc_id")
    repeated = ids.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    return docs.withColumn("_ls_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("_ls_th", F.xxhash64("text") if repeated else F.lit(0).cast("long"))


_KEY = ["_ls_did", "_ls_th"]


def _with(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to per-document ``lists``; texts of documents without one are not shuffled if the ids are few enough to send around."""
    lists = durable(lists)
    if lists.count() > BROADCAST_IDS:
        return docs.join(lists, _KEY, how)
    ids = F.broadcast(lists.select(*_KEY).distinct())
    some = docs.join(ids, _KEY, "left_semi").join(lists, _KEY)
    if how != "left":
        return some
    rest = docs.join(ids, _KEY, "left_anti").withColumn(lists.columns[-1], F.lit(None).cast(lists.schema[-1].dataType))
    return some.unionByName(rest)


def repeated_spans(keyed: DataFrame, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """``(_ls_did, _ls_th, start, end, s_did, s_th, s_start)``: paths and windows that start earlier elsewhere, with the coordinates of the first such start."""
    keyed = keyed.select(*_KEY, "text")
    # written first, so that the join sees two plain sides and AQE can split the minimizer of a passage that many documents share
    shared = durable(_minimizers(keyed, k, m).groupBy("mz").agg(F.sum("times").alias("times")).where("times > 1").select("mz"))
    seen = durable(_occurrences(keyed, k, m).join(shared, "mz", "left_semi"))
    first = F.struct(F.col("_ls_did").alias("did"), "p", F.col("_ls_th").alias("th"))
    earlier = ~((F.col("_ls_did") == F.col("first.did")) & (F.col("p") == F.col("first.p")))
    source = [F.col("first.did").alias("s_did"), F.col("first.th").alias("s_th"), F.col("first.p").alias("s_start")]
    paths = durable(seen.groupBy("mz", "c").agg(F.min(first).alias("first"), F.first("n").alias("n"), F.count(F.lit(1)).alias("times"), F.min("next").alias("low"), F.max("next").alias("high")))
    runs = durable(compacted(paths.where("times > 1")))
    later = seen.join(runs, ["mz", "c"]).where(earlier)
    whole = later.select(*_KEY, F.col("p").alias("start"), (F.col("p") + F.col("windows") + (k - 1)).alias("end"), *source)
    branching = paths.groupBy("mz").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("mz")
    todo = paths.join(branching, "mz", "left_semi").select(F.col("first.did").alias("_ls_did"), F.col("first.th").alias("_ls_th"), F.struct("first.p", "n", "mz").alias("path")).groupBy(*_KEY).agg(F.collect_list("path").alias("todo"))
    windows = durable(_opened(_with(keyed, todo, "inner"), k, m))
    firsts = durable(windows.groupBy("mz", "w").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"))
    again = windows.join(firsts, ["mz", "w"]).where(earlier)
    return whole.unionByName(again.select(*_KEY, F.col("p").alias("start"), (F.col("p") + k).alias("end"), *source))


def compacted(paths: DataFrame) -> DataFrame:
    """``(mz, c, first, windows)``: runs of repeated ``paths`` that no node between them branches, each under its first path, with the number of windows of all.

    Where all occurrences of a path go on to one path that occurs as often, they are the occurrences of that one, in the same order: its first occurrence stands right behind the first one
    of the path before. So runs lie along the coordinates of first occurrences.
    """
    at = [F.col("first.did").alias("did"), F.col("first.th").alias("th")]
    ends = paths.where("low = high").select(*at, (F.col("first.p") + F.col("n")).alias("p"), F.col("high").alias("c"), "times", F.lit(1).alias("joined"))
    placed = paths.select("mz", "c", "first", "n", "times", *at, F.col("first.p").alias("p")).join(ends, ["did", "th", "p", "c", "times"], "left")
    along = Window.partitionBy("did", "th").orderBy("p")  # one text
    numbered = placed.withColumn("run", F.sum(F.when(F.col("joined").isNull(), 1).otherwise(0)).over(along))
    head = F.min_by(F.struct("mz", "c", "first"), "p").alias("head")
    return numbered.groupBy("did", "th", "run").agg(head, F.sum("n").alias("windows")).select("head.*", "windows")


_SPAN = ["start", "end", "s_did", "s_th", "s_start"]


def merged_spans(spans: DataFrame) -> DataFrame:
    """The same columns, with the overlapping or touching copies of one stretch of one source made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            lists = part.column("spans")
            own, flat = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths())), lists.flatten()
            start, end, did, th, source = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in _SPAN)
            shift = start - source
            order = np.lexsort((start, shift, th, did, own))
            own, start, end, did, th, shift = (x[order] for x in (own, start, end, did, th, shift))
            same = np.ones(len(order), bool)
            same[:1] = False
            for x in (own, did, th, shift):
                same[1:] &= x[1:] == x[:-1]
            same[1:] &= start[1:] <= end[:-1]  # on one shift, ends grow with starts
            head = np.flatnonzero(~same)
            last = np.append(head[1:], len(order)) - 1
            columns = [*(part.column(c).take(pa.array(own[head])) for c in _KEY), *(pa.array(x) for x in (start[head], end[last], did[head], th[head], start[head] - shift[head]))]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, *_SPAN])

    lists = spans.groupBy(*_KEY).agg(F.collect_set(F.struct(*[F.col(c).cast("long").alias(c) for c in _SPAN])).alias("spans"))
    return lists.mapInArrow(run, ", ".join(f"{c} long" for c in [*_KEY, *_SPAN]))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def source_digests(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with ``digest``, that of the words which stand at the source's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows: list[tuple] = []
            for did, th, text, todo in zip(*(b.column(c).to_pylist() for c in (*_KEY, "text", "todo")), strict=True):
                words = (text or "").encode().split()
                rows += [(did, th, t["s_start"], t["n"], _digest(words[t["s_start"] : t["s_start"] + t["n"]])) for t in todo]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["s_did", "s_th", "s_start", "n", "digest"])

    spans = durable(spans.withColumn("n", F.col("end") - F.col("start")))
    asked = durable(spans.select("s_did", "s_th", "s_start", "n").distinct())
    parts = asked.groupBy("s_did", "s_th").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("parts"))
    part = F.pmod(F.xxhash64("s_start", "n"), F.col("parts"))
    todo = asked.join(parts, ["s_did", "s_th"]).groupBy("s_did", "s_th", part.alias("part")).agg(F.collect_list(F.struct("s_start", "n")).alias("todo"))
    todo = todo.select(F.col("s_did").alias("_ls_did"), F.col("s_th").alias("_ls_th"), "todo")
    # rows that repeat an id with one text are one document: each source is read once
    found = _with(keyed.select(*_KEY, "text"), todo, "inner").mapInArrow(run, "s_did long, s_th long, s_start long, n long, digest binary")
    found = durable(found.dropDuplicates(["s_did", "s_th", "s_start", "n"]))
    return spans.join(found, ["s_did", "s_th", "s_start", "n"]).drop("n")


def _kept(words: list[bytes], spans: list | None) -> tuple[list[bytes], int]:
    """The words outside of the spans whose words are those of their source, and the number of the others."""
    spans = [s for s in spans or [] if _digest(words[s["start"] : s["end"]]) == s["digest"]]
    if not spans:
        return words, 0
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, [s["start"] for s in spans], 1)
    np.add.at(drop, [s["end"] for s in spans], -1)
    gone = np.cumsum(drop)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def _marked(docs: DataFrame, k: int, m: int) -> DataFrame:
    keyed = _keyed(docs)
    spans = source_digests(keyed, merged_spans(repeated_spans(keyed, k, m)))
    return _with(keyed, spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end", "digest")).alias("_ls_spans")), "left")


def drop_repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """``docs`` with the words of repeated spans gone from ``text``; a text without any stays as it is, others are joined by single spaces."""
    marked, names = _marked(docs, k, m), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_ls_spans").to_pylist(), strict=True):
                kept, gone = _kept(text.encode().split(), spans) if spans else ([], 0)
                if gone:
                    text = b" ".join(kept).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field("text").type) if c == "text" else b.column(c) for c in names], names)

    return marked.select(*names, "_ls_spans").mapInArrow(run, docs.schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _marked(table(spark, sf_dir, "documents").select("doc_id", "text"), WINDOW, MINIMIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            n, removed, digests = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_ls_spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept, gone = _kept(words, spans)
                n.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return marked.select("doc_id", "text", "_ls_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
