"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits link if at most ``distance`` (1 or 2) bits differ. Cut into two segments of 32 bits, one segment of a linked pair
differs by at most one bit; each segment is indexed under its 32 one-wildcard variants (one bit position deleted), and
an equality join on the variants, then a count of differing bits, finds every link.

Links by similarity: ``similar_groups`` first links the texts of the fingerprints that link (SimHash over the shingles, as above), each candidate verified on its sets, and goes on with those that fingerprints are too coarse for: at a
similarity of 0.8 some 10 bits differ. It links texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``, exactly (shingles are compared by
64-bit hashes). Equal sets become one node. Shingles get one order for all texts, rare ones first; texts that are similar enough share a shingle within their prefixes, the first
shingles of each in that order, and where they first do, enough shingles must be left after it. Such pairs are candidates. Those whose bitmaps (a bit for each range of hashes
that a set has a shingle in) show too many shingles of one that the other lacks go, and the rest are verified with their sets. A shingle in
more than ``small`` prefixes compares its texts with the one that has it earliest; after components of these links, all pairs of it that are still in different ones.

Scale: equal fingerprints become one node first, however many documents share them. Variants are counted with combining before the shuffle and
only those that two nodes share are joined. A variant with at most ``SMALL`` nodes is verified within a list of that length; nodes of any larger
one go to an exact detour without pairs: each node is sent to the points within one flip (two nodes within 2 bits share such a
point, and a point has at most 65 nodes); at distance 1 nodes one flip apart are joined. Components come from star
contraction. Nothing is gathered on the driver.

Cases: a null, empty or blank text has fingerprint 0 and links like any other; fewer words than a shingle give one shingle of all words; repeated
rows are documents of their own; a null doc_id takes part with the smallest non-null id of its component (null if there is none); other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodeseam.llm.common import connected_components, durable, table

WORDS = 3
DISTANCE = 2
SEED = 42
#: Nodes of one variant that are compared with each other.
SMALL = 24
#: For groups by similarity: words of a shingle, least Jaccard similarity.
STAGE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: Texts of one shingle that are compared pair by pair at once there.
STAGE_SMALL = 8
#: Part of the texts (one in so many) in which shingles are counted and the count from which one is common; the commonest are ranked, the others marked in a bitmap of that power
#: of two of bits. All this sets the order of shingles only.
SAMPLED, COMMON, MOST_COMMON, COMMON_BITS = 4, 3, 100_000, 27
#: Power of two of the bits of a bitmap.
BITMAP = 11
#: Nodes to verify that are sent to every task; more are joined.
BROADCAST_NODES = 1_000_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # most significant first


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle (of all words if there are fewer), repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half of ``hashes``."""
    columns = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def simhash(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of a text."""
    hashes = shingle_hashes(text, words, seed)
    return _majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, digest, fp)`` with a hash of the text and the fingerprint as a signed long; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [simhash(t.as_py(), words, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest long, fp long")


def _variants(fp: Column) -> Column:
    """The 64 one-wildcard variants: segment, wildcard position and the segment's other bits, in one long."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return F.array(*[F.lit(((s << 5) + i) << 32).cast("long").bitwiseOR(part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i)))) for s, part in enumerate((low, high)) for i in range(32)])


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _flips(fp: Column) -> list[Column]:
    return [fp.bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")) for i in range(64)]


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE, small: int = SMALL) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` that connect all pairs at most ``distance`` bits apart."""
    if distance not in (1, 2):
        raise ValueError("two segments serve a distance of 1 or 2 here")
    signed = nodes.select("fp", F.explode(_variants(F.col("fp"))).alias("variant"))
    shared = durable(signed.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = signed.join(shared.where(F.col("n") <= small), "variant").groupBy("variant").agg(F.collect_list("fp").alias("fps"))
    close = F.flatten(F.transform("fps", lambda a: F.transform(F.filter("fps", lambda b: (b > a) & (_apart(a, b) <= distance)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    direct = members.select(F.explode(close).alias("p")).select("p.a", "p.b").distinct()
    crowded = signed.join(shared.where(F.col("n") > small), "variant").select("fp").distinct()
    # nodes at most 2 bits apart share a point that is at most one flip from each; at distance 1 the nodes are such points themselves
    reach = [F.col("fp"), *_flips(F.col("fp"))] if distance == 2 else None
    if reach is None:
        return direct.unionByName(_adjacent(crowded))
    points = crowded.select("fp", F.explode(F.array(*reach)).alias("point")).groupBy("point").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
    around = points.where(F.size("fps") > 1).select("a", F.explode("fps").alias("b")).where("a <> b")
    return direct.unionByName(around.distinct())


def _adjacent(nodes: DataFrame) -> DataFrame:
    """Links between nodes one bit apart."""
    flipped = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*_flips(F.col("fp")))).alias("b"))
    return flipped.where("a < b").join(nodes.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")


_KEY = ["_ls_none", "_ls_id", "_ls_digest"]


def _first_key() -> Column:
    """What tells the document of a group that stays: the smallest id (none comes last), then the smallest ``digest``."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")).alias("first")


def _classes(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``nodes`` (``node``, ``first``) with the ``first`` of their components, written, so that AQE sees two plain sides where a node that many documents share is joined."""
    linked = nodes.select(node, "first").join(roots.withColumnRenamed("node", node), node)
    moved = linked.join(linked.groupBy("root").agg(F.min("first").alias("of_root")), "root").select(node, "of_root")
    return durable(nodes.select(node, "first").join(moved, node, "left").select(node, F.coalesce("of_root", "first").alias("first")))


def near_duplicate_groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """``(doc_id, digest, fp, component_id, first)`` for each row of ``docs``."""
    prints = durable(fingerprints(docs, words, seed))
    nodes = durable(prints.groupBy("fp").agg(_first_key()))
    classes = _classes(nodes, connected_components(fingerprint_links(nodes, distance)), "fp")
    return prints.join(classes, "fp").select("doc_id", "digest", "fp", F.col("first.id").alias("component_id"), "first")


def differing_bits(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of texts with that Jaccard similarity differ, on average."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in small ones: a text's set can take some 100 kB."""
    for b in batches:
        yield from (b.slice(at, rows) for at in range(0, b.num_rows, rows))


def _common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What sets the order of shingles, as far as a part of the texts shows: the commonest, sorted, with their ranks (rarer ones first), and a bitmap of all common ones by their last bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            found = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], ["shingle"])

    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").distinct()
    counts = durable(texts.mapInArrow(run, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON))
    first = counts.orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).select("shingle").toArrow()  # bounded, as is the bitmap
    listed = first.column("shingle").to_numpy()[::-1].view(np.uint64)
    by = np.argsort(listed)
    place = F.col("shingle").bitwiseAND(F.lit((1 << COMMON_BITS) - 1))
    parts = counts.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(shingle & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << COMMON_BITS - 6, np.uint64)
    bitmap[parts.column("at").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return listed[by], by.astype(np.uint64), bitmap


def _prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, ranks: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order that holds for all texts: as many as a similar text cannot miss all of. ``common`` is sorted, ``ranks`` are places in the order."""
    place = shingles & np.uint64((1 << COMMON_BITS) - 1)
    marked = bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)
    order = (shingles >> np.uint64(2)) | marked << np.uint64(62)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        order = np.where(common[at] == shingles, ranks[at] | np.uint64(1 << 63), order)
    n = len(shingles)
    return shingles[np.lexsort((shingles, order))][: n - math.ceil(similarity * n - 1e-9) + 1]


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITMAP, bool)
    bits[(shingles >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


def _lacking(a: Column, b: Column) -> Column:
    """Bits of bitmap ``a`` that ``b`` lacks: as many shingles of ``a``, at least, are not in ``b``."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)


def _may_link(similarity: float, at_a: Column, size_a: Column, at_b: Column, size_b: Column) -> Column:
    """Whether two sets whose first common shingle stands at these places have enough left to be similar."""
    return (F.least(size_a - at_a, size_b - at_b) * (1 + similarity)) >= (size_a + size_b) * similarity - 1e-9


def _may_hold(similarity: float, bitmap_a: Column, size_a: Column, bitmap_b: Column, size_b: Column) -> Column:
    """Whether two sets with these bitmaps can have enough shingles in common to be similar."""
    most = F.least(size_a - _lacking(bitmap_a, bitmap_b), size_b - _lacking(bitmap_b, bitmap_a))
    return most * (1 + similarity) >= (size_a + size_b) * similarity - 1e-9


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)``: the ``pairs`` (``one``, ``other``) whose sets of shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            sets = pa.array([np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), sets], ["node", "shingles"])

    of = lambda name: nodes.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col("bitmap").alias(f"of_{name}"))
    pairs = pairs.distinct().join(of("one"), "one").join(of("other"), "other").where(_may_hold(similarity, F.col("of_one"), F.col("size_one"), F.col("of_other"), F.col("size_other")))
    pairs = durable(pairs.select("one", "other"))
    asked = durable(pairs.select(F.explode(F.array("one", "other")).alias("node")).distinct().join(nodes.select("node", "digest"), "node"))
    if asked.count() <= BROADCAST_NODES:
        asked = F.broadcast(asked)
    texts = docs.select(F.xxhash64("text").alias("digest"), "text").join(asked, "digest").groupBy("node").agg(F.first("text").alias("text"))
    sets = durable(texts.mapInArrow(run, "node long, shingles array<long>"))
    of = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = F.size(F.array_intersect("of_one", "of_other"))
    near = both >= similarity * (F.size("of_one") + F.size("of_other") - both) - 1e-9
    return durable(pairs.join(of("one"), "one").join(of("other"), "other").where(near).select(F.col("one").alias("a"), F.col("other").alias("b")))


def _near_prints(nodes: DataFrame) -> DataFrame:
    """Candidates ``(one, other)`` by SimHash: sets of the same fingerprint with the first of them, and the first ones of fingerprints that link."""
    firsts = durable(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.select("fp", "node").join(firsts, "fp").where("node <> first").select(F.col("first").alias("one"), F.col("node").alias("other"))
    of = lambda name, to: firsts.select(F.col("fp").alias(name), F.col("first").alias(to))
    near = fingerprint_links(firsts.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return same.unionByName(near.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("other")))


def similar_groups(docs: DataFrame, words: int = STAGE_WORDS, similarity: float = STAGE_SIMILARITY, small: int = STAGE_SMALL) -> DataFrame:
    """``(doc_id, digest, component_id, first)`` of each row of ``docs``: components of the texts with that similarity of word shingles or more, all of them."""
    shared = docs.sparkSession.sparkContext.broadcast(_common_shingles(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in _few(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column("text")]
            node = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
            prints = pa.array(np.array([_majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64))
            first = pa.array([_prefix(s, similarity, *shared.value).view(np.int64) for s in sets], pa.list_(pa.int64()))
            bits = pa.array([_bitmap(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), node, pa.array(list(map(len, sets)), pa.int32()), prints, bits, first], ["doc_id", "digest", "node", "size", "fp", "bitmap", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    prints = durable(rows.mapInArrow(run, "doc_id long, digest long, node long, size int, fp long, bitmap array<long>, prefix array<long>"))
    nodes = durable(prints.groupBy("node").agg(_first_key(), F.first("digest").alias("digest"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bitmap").alias("bitmap"), F.first("prefix").alias("prefix")))
    signed = nodes.select("node", "size", F.posexplode("prefix").alias("at", "shingle"))
    counts = durable(signed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = durable(signed.join(counts, "shingle"))
    lists = met.where(F.col("n") <= small).groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("node", "at", "size"))).alias("all"))
    may = lambda a, b: _may_link(similarity, a["at"], a["size"], b["at"], b["size"])
    each = F.flatten(F.transform("all", lambda a, i: F.transform(F.filter(F.slice("all", i + 2, small), lambda b: may(a, b)), lambda b: F.struct(a["node"].alias("one"), b["node"].alias("other")))))
    pairs = lists.select(F.explode(each).alias("p")).select("p.one", "p.other")
    crowded = met.where(F.col("n") > small)
    earliest = crowded.groupBy("shingle").agg(F.min(F.struct("at", "node", "size")).alias("first"))
    stars = crowded.join(earliest, "shingle").where((F.col("node") != F.col("first.node")) & may(F.col("first"), {"at": F.col("at"), "size": F.col("size")}))
    stars = stars.select(F.least("node", "first.node").alias("one"), F.greatest("node", "first.node").alias("other"))
    links = _verified(pairs.unionByName(stars).unionByName(_near_prints(nodes)), docs, nodes, words, similarity)
    roots = connected_components(links)
    # what crowded shingles have not compared yet: their pairs across components
    placed = durable(crowded.join(roots, "node", "left").select("shingle", "node", "at", "size", F.coalesce("root", "node").alias("root")))
    split = placed.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    open_rows = placed.join(split, "shingle", "left_semi").join(nodes.select("node", "bitmap"), "node")
    a, b = open_rows.alias("a"), open_rows.alias("b")
    near = _may_link(similarity, F.col("a.at"), F.col("a.size"), F.col("b.at"), F.col("b.size")) & _may_hold(similarity, F.col("a.bitmap"), F.col("a.size"), F.col("b.bitmap"), F.col("b.size"))
    apart = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.root") < F.col("b.root")) & near)
    across = durable(apart.select(F.least("a.node", "b.node").alias("one"), F.greatest("a.node", "b.node").alias("other")).distinct())
    if not across.isEmpty():
        more = _verified(across, docs, nodes, words, similarity)
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more))
    classes = _classes(nodes, roots, "node")
    return prints.select("doc_id", "digest", "node").join(classes, "node").select("doc_id", "digest", F.col("first.id").alias("component_id"), "first")


def drop_near_duplicates(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one document of each group left, its ``first`` (see ``_first_key``).

    A document is told by id and text (its hash), so different texts under one id are two documents, and rows that repeat both are one, of which one row stays. Of texts, only those of rows that
    repeat and stay are shuffled (combined first), if the documents to drop are few enough for AQE to send around.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "digest")
    told = groups.select(F.coalesce("doc_id", F.lit(0)).alias("_ls_id"), F.col("doc_id").isNull().alias("_ls_none"), F.col("digest").alias("_ls_digest"), own.eqNullSafe(F.col("first")).alias("stays"))
    counts = told.groupBy(*_KEY).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    listed = durable(counts.where("NOT stays OR n > 1").select(*_KEY, "stays"))
    keyed = docs.withColumn("_ls_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn("_ls_none", F.col("doc_id").isNull()).withColumn("_ls_digest", F.xxhash64("text"))
    rest = keyed.join(listed.select(*_KEY), _KEY, "left_anti").select(*docs.columns)
    repeated = keyed.join(listed.where("stays").select(*_KEY), _KEY, "left_semi")
    return rest.unionByName(repeated.groupBy(*_KEY).agg(F.first(F.struct(*docs.columns)).alias("_ls_row")).select("_ls_row.*"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id").cast(T.LongType()).alias("component_id"))
