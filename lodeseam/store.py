"""The index as segments of Parquet tables under a namespace, with a pointer that is renamed into place.

A segment holds the rows that one write put in (partitioned by source), the ids and paths that it took out, the postings of their text and path, their lengths, and the manifest entries
that it set. The pointer lists the segments in order, with the corpus figures and the cursors of the feeds. A write touches nothing but its own segment and the
pointer, so it costs what it changes; a reader sees whole states. Once there are more than ``MOST_SEGMENTS``, the next write makes one of all but the first, or of all if the others hold half as many
rows as the first: what is rewritten stays in proportion to what was written. There is one writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.errors import StoreError
from lodeseam.operators import block_index, changes, filters, retrieval
from lodeseam.sources import files

ROWS = (
    "id string, source string, vector array<float>, text string, path_text string, path string, language string, kind string, symbol string, file_hash string, start_line int, end_line int, "
    "sha string, committed_at long, author string, is_merge boolean, session_id string, ts long, role string"
)
MANIFEST = "path string, file_hash string, chunk_ids array<string>, size long, mtime_ms double"
CACHE = "key string, vector array<float>"
IDS, PATHS, LENGTHS, POSTINGS = "id string", "path string", "id string, text int, path_text int", "term string, id string, tf int, length int, source string, language string, kind string"
#: Columns of a row that its postings hold, so that text is searched under a filter without the rows.
FILTERED = ("source", "language", "kind")
INDEXED = ("text", "path_text")
#: What rows are laid out by in the blocks of the text index, so that like rows share a block.
LAID_BY = ("source", "language", "path")
MOST_SEGMENTS = 8


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class State:
    version: int = 0
    root: str = ""
    meta: dict[str, str] = field(default_factory=dict)
    segments: list[int] = field(default_factory=list)
    #: Live rows, and the terms that they have in ``text`` and ``path_text``.
    figures: dict[str, int] = field(default_factory=lambda: {"rows": 0, "text": 0, "path_text": 0})
    #: Rows that each segment was written with.
    sizes: dict[str, int] = field(default_factory=dict)
    #: Segments that the last merge replaced; they go with the next one, when no reader is left.
    replaced: list[int] = field(default_factory=list)


class IndexStore:
    def __init__(self, spark: SparkSession, base: str, namespace: str, root: str = ""):
        self.spark, self.folder, self.root = spark, f"{base.rstrip('/')}/{namespace}", root
        self._opened: dict[tuple[int, str], DataFrame] = {}  # tables of segments, which never change

    def state(self) -> State:
        """The pointer; a missing, broken or foreign one counts as an empty index."""
        try:
            found = json.loads(files.read_text(self.spark, f"{self.folder}/CURRENT") or "{}")
            state = State(int(found["version"]), str(found["root"]), dict(found["meta"]), list(found["segments"]), dict(found["figures"]), dict(found["sizes"]), list(found["replaced"]))
        except (OSError, ValueError, KeyError, TypeError):
            return State(0, self.root)
        return state if state.root == self.root else State(0, self.root)

    def _point(self, state: State) -> None:
        files.replace_text(self.spark, f"{self.folder}/CURRENT", json.dumps({**state.__dict__, "root": self.root}))

    # reading

    def _segment(self, segment: int, name: str, schema: str) -> DataFrame:
        if (segment, name) not in self._opened:
            where = f"{self.folder}/s{segment}/{name}"
            self._opened[segment, name] = self.spark.read.schema(schema).parquet(where) if files.exists(self.spark, where) else self.spark.createDataFrame([], schema)
        return self._opened[segment, name]

    def _live(self, name: str, schema: str, key: str, gone: str, segments: list[int] | None = None) -> DataFrame:
        """A table over all segments (or some), without what later ones of them took out."""
        segments = self.state().segments if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], schema)
        parts = []
        for i, segment in enumerate(segments):
            part = self._segment(segment, name, schema)
            if later := segments[i + 1 :]:
                dead = reduce(DataFrame.unionByName, [self._segment(s, gone, f"{key} string") for s in later])
                part = part.join(dead.distinct(), key, "left_anti").select(*_names(schema))
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    def rows(self, state: State | None = None) -> DataFrame:
        return self._live("rows", ROWS, "id", "gone", state.segments if state else None)

    def segment_rows(self, version: int) -> DataFrame:
        """The rows that one write put in."""
        return self._segment(version, "rows", ROWS)

    def manifest(self) -> DataFrame:
        return self._live("manifest", MANIFEST, "path", "paths_gone")

    def text_index(self, column: str, state: State | None = None) -> retrieval.TextIndex | None:
        """The index over ``text`` or ``path_text``; None if there is nothing to find."""
        state = state or self.state()
        if not state.figures["rows"]:
            return None
        postings = self._live(f"{column}_postings", POSTINGS, "id", "gone", state.segments)
        return retrieval.TextIndex(postings, state.figures["rows"], state.figures[column] / state.figures["rows"], self.rows(state).select("id", F.col(column).alias("text")))

    def block_index(self, column: str, state: State | None = None) -> block_index.BlockIndex | None:
        """The index over ``text`` or ``path_text`` in blocks; None if there is nothing to find.

        It is written by the first search of a state that asks for it, from the postings of all segments, and kept until a later state's is written; the one before stays for readers that are at it.
        """
        state = state or self.state()
        index = self.text_index(column, state)
        if index is None:
            return None
        base = f"{self.folder}/blocks/{column}"
        try:
            kept = [int(v) for v in json.loads(files.read_text(self.spark, f"{base}/CURRENT") or "[]")]
        except (OSError, ValueError, TypeError):
            kept = []
        if state.version in kept:
            return block_index.BlockIndex.open(index, f"{base}/{state.version}")
        built = block_index.BlockIndex.build(index, self.rows(state), f"{base}/{state.version}", LAID_BY, column)
        files.replace_text(self.spark, f"{base}/CURRENT", json.dumps([*kept[-1:], state.version]))
        for version in kept[:-1]:
            files.remove(self.spark, f"{base}/{version}")
        return built

    # writing

    def _write(self, segment: int, name: str, df: DataFrame, schema: str, *by: str) -> DataFrame:
        kinds = {c.split()[0]: c.split(maxsplit=1)[1] for c in schema.split(", ")}
        full = df.select(*[F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        where = f"{self.folder}/s{segment}/{name}"
        self._opened.pop((segment, name), None)
        writer = full.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(where)
        return self.spark.read.schema(schema).parquet(where)

    def _index(self, segment: int, rows: DataFrame) -> dict[str, int]:
        """Writes lengths and postings of a segment's rows; returns their figures."""
        figures = self._write(segment, "lengths", retrieval.lengths(rows, *INDEXED), LENGTHS).agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in INDEXED]).first()
        for column in INDEXED:
            # in runs sorted by term, so that a query's terms are found by the pages' statistics
            self._write(segment, f"{column}_postings", retrieval.postings(rows, column, kept=FILTERED), POSTINGS)
        return {c: int(figures[c]) for c in ("rows", *INDEXED)}

    def write(self, new: DataFrame | None = None, gone: DataFrame | None = None, entries: DataFrame | None = None, gone_paths: DataFrame | None = None, meta: dict[str, str] | None = None) -> int:
        """One change: ``gone`` (``id``) and rows with the ids of ``new`` out, ``new`` in; likewise ``gone_paths`` (``path``) and ``entries`` in the manifest."""
        state = self.state()
        if len(state.segments) > MOST_SEGMENTS:
            state = self.merge()
        version = state.version + 1
        none = lambda schema: self.spark.createDataFrame([], schema)
        rows = self._write(version, "rows", none(ROWS) if new is None else new, ROWS, "source")
        dead = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id"))
        dead = self._write(version, "gone", dead.distinct(), IDS)
        manifest = self._write(version, "manifest", none(MANIFEST) if entries is None else entries, MANIFEST)
        paths = manifest.select("path") if gone_paths is None else manifest.select("path").unionByName(gone_paths.select("path"))
        self._write(version, "paths_gone", paths.distinct(), PATHS)
        lost = self._live("lengths", LENGTHS, "id", "gone", state.segments).join(dead, "id", "left_semi").agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in INDEXED]).first()
        own = self._index(version, rows)
        figures = {c: state.figures[c] + own[c] - int(lost[c]) for c in own}
        sizes = {**state.sizes, str(version): own["rows"]}
        self._point(State(version, self.root, {**state.meta, **(meta or {})}, [*state.segments, version], figures, sizes, state.replaced))
        return version

    def commit(self, rows: DataFrame, manifest: DataFrame | None = None, meta: dict[str, str] | None = None) -> int:
        """All rows (and manifest entries) anew, as one segment."""
        state = self.state()
        version = state.version + 1
        written = self._write(version, "rows", rows, ROWS, "source")
        self._write(version, "manifest", self.manifest() if manifest is None else manifest, MANIFEST)
        figures = self._index(version, written)
        self._replace(state, [], version, figures["rows"], State(version, self.root, {**state.meta, **(meta or {})}, figures=figures))
        return version

    def _replace(self, before: State, kept: list[int], version: int, rows: int, after: State) -> None:
        """Points at ``kept`` segments and a merged one. What an earlier merge replaced goes now; what this one does stays for readers that are at it."""
        for segment in before.replaced:
            files.remove(self.spark, f"{self.folder}/s{segment}")
        after.segments = [*kept, version]
        after.sizes = {**{str(s): before.sizes[str(s)] for s in kept}, str(version): rows}
        after.replaced = [s for s in before.segments if s not in kept]
        self._point(after)

    def merge(self) -> State:
        """All segments but the first as one, or all if the others are not small beside the first."""
        state = self.state()
        if not state.segments:
            return state
        first, others = state.segments[0], state.segments[1:]
        if not others or 2 * sum(state.sizes[str(s)] for s in others) >= state.sizes[str(first)]:
            self.commit(self.rows())
            return self.state()
        version = state.version + 1
        rows = self._write(version, "rows", self._live("rows", ROWS, "id", "gone", others), ROWS, "source")
        self._write(version, "manifest", self._live("manifest", MANIFEST, "path", "paths_gone", others), MANIFEST)
        for name, schema in (("gone", IDS), ("paths_gone", PATHS)):
            self._write(version, name, reduce(DataFrame.unionByName, [self._segment(s, name, schema) for s in others]).distinct(), schema)
        size = self._index(version, rows)["rows"]
        self._replace(state, [first], version, size, State(version, self.root, state.meta, figures=state.figures))
        return self.state()

    def set_meta(self, **meta: str) -> None:
        state = self.state()
        state.meta.update(meta)
        self._point(state)

    def upsert(self, new: DataFrame) -> int:
        return self.write(new)

    def replace_file(self, path: str, new: DataFrame) -> int:
        return self.write(new, self.rows().where(F.col("path") == path).select("id"))

    def delete_ids(self, ids: DataFrame) -> int:
        return self.write(gone=ids)

    def delete_files(self, paths: list[str]) -> int:
        return self.delete_by_filter(["Or", [["path", "Eq", p] for p in paths]])

    def delete_by_filter(self, tree: list) -> int:
        return self.write(gone=self.rows().where(F.coalesce(filters.compile_filter(tree), F.lit(False))).select("id"))

    def query(self, tree: list | None = None) -> DataFrame:
        """Rows that pass a filter, without vectors: the scan that arms share."""
        return self.rows().where(filters.compile_filter(tree)).drop("vector")

    def warm(self) -> None:
        self.rows().cache().count()

    def clear(self) -> None:
        self._opened.clear()
        files.remove(self.spark, self.folder)

    def entry(self, path: str) -> dict | None:
        """The manifest entry of a path."""
        found = self.manifest().where(F.col("path") == path).first()
        return found.asDict() if found else None

    def known_paths(self) -> DataFrame:
        return self.manifest().select("path")

    def record(self, entries: DataFrame) -> int:
        """Manifest entries in place of those of the same paths."""
        return self.write(entries=entries)

    def forget(self, paths: DataFrame) -> int:
        """Manifest entries (``path``) out; their rows stay."""
        return self.write(gone_paths=paths)

    def meta(self, key: str) -> str | None:
        return self.state().meta.get(key)

    def cache(self) -> DataFrame:
        where = f"{self.folder}-vectors"
        return self.spark.read.schema(CACHE).parquet(where) if files.exists(self.spark, where) else self.spark.createDataFrame([], CACHE)

    def remember(self, vectors: DataFrame) -> None:
        """Adds vectors that the cache lacks."""
        changes.missing_from(vectors, self.cache(), "key").select("key", "vector").write.mode("append").option("compression", "zstd").parquet(f"{self.folder}-vectors")

    def require(self) -> None:
        if not self.state().version:
            raise StoreError("there is no index yet", missing=True)
