"""Which files are indexed, and the filter language of searches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam.config import Indexing
from lodeseam.functions.text import extension, glob_regex


@dataclass(frozen=True)
class Rules:
    """Compiled exclusion rules; every test exists for Python strings and for columns."""

    extensions: frozenset[str]
    dirs: frozenset[str]
    files: frozenset[str]
    pattern: str
    max_bytes: int

    @classmethod
    def of(cls, indexing: Indexing) -> Rules:
        low = lambda xs: frozenset(x.lower() for x in xs)
        pattern = "|".join(f"(?:{glob_regex(p)})" for p in indexing.exclude_patterns) or r"\b\B"
        return cls(low(indexing.extensions), low(indexing.exclude_dirs), low(indexing.exclude_files), pattern, indexing.max_file_bytes)

    def enters(self, name: str) -> bool:
        return not name.startswith(".") and name.lower() not in self.dirs

    def matches(self, path: str) -> bool:
        return re.search(self.pattern.replace(r"\z", r"\Z"), path.lower()) is not None

    def considers(self, path: str) -> bool:
        from lodeseam.operators.chunking import extension as of

        name = path.rsplit("/", 1)[-1].lower()
        return not (name.startswith(".env") or name in self.files or self.matches(path)) and of(path) in self.extensions

    def indexes(self, path: str, size: int) -> bool:
        return 0 < size <= self.max_bytes and self.considers(path)

    def watches(self, path: str) -> bool:
        return all(self.enters(s) for s in path.split("/")[:-1] if s) and not self.matches(path)

    def enters_column(self, name: Column) -> Column:
        return ~name.startswith(".") & ~F.lower(name).isin(sorted(self.dirs))

    def considers_column(self, path: Column) -> Column:
        name = F.lower(F.regexp_extract(path, r"([^/]*)\z", 1))
        return ~name.startswith(".env") & ~name.isin(sorted(self.files)) & ~F.lower(path).rlike(self.pattern) & extension(path).isin(sorted(self.extensions))

    def indexes_column(self, path: Column, size: Column) -> Column:
        return (size > 0) & (size <= self.max_bytes) & self.considers_column(path)

    def watches_column(self, path: Column) -> Column:
        parents = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: s != "")
        return F.forall(parents, self.enters_column) & ~F.lower(path).rlike(self.pattern)


def is_binary(content: Column, probe: int = 8000) -> Column:
    """A zero byte among the first ``probe`` bytes."""
    return F.contains(F.substring(content, 1, probe), F.lit(bytearray(b"\x00")))


_COMPARE = {
    "Eq": lambda c, v: c.isNull() if v is None else c == v,
    "NotEq": lambda c, v: c.isNotNull() if v is None else ~c.eqNullSafe(v),
    "In": lambda c, v: c.isin(list(v)) if v else F.lit(False),
    "NotIn": lambda c, v: ~F.coalesce(c.isin(list(v)), F.lit(False)) if v else F.lit(True),
    "Lt": lambda c, v: c < v,
    "Lte": lambda c, v: c <= v,
    "Gt": lambda c, v: c > v,
    "Gte": lambda c, v: c >= v,
    "Glob": lambda c, v: F.lower(c).rlike(glob_regex(v)),
    "Regex": lambda c, v: c.rlike(v),
    "Contains": lambda c, v: F.contains(c, F.lit(v)),
    "ContainsAllTokens": lambda c, v: reduce(lambda a, b: a & b, [F.lower(c).rlike(rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])") for t in v.lower().split()], F.lit(True)),
}


def compile_filter(tree: list | tuple | None) -> Column:
    """A filter such as ``["And", [["source", "In", ["code"]], ["kind", "Eq", "test"]]]`` as a predicate that Catalyst pushes down."""
    if not tree:
        return F.lit(True)
    if tree[0] in ("And", "Or"):
        parts = [compile_filter(t) for t in tree[1]]
        return reduce((lambda a, b: a & b) if tree[0] == "And" else (lambda a, b: a | b), parts, F.lit(tree[0] == "And"))
    if tree[0] == "Not":
        return ~F.coalesce(compile_filter(tree[1]), F.lit(False))
    name, how, value = tree
    if how not in _COMPARE:
        raise ValueError(f"unknown filter {how}")
    return _COMPARE[how](F.col(name), value)


def search_filter(sources: list[str], language: str | None = None, kind: str | None = None) -> list:
    parts: list = [["source", "In", list(sources)]]
    if language and language.strip():
        parts.append(["language", "Eq", language.strip().lower()])
    if kind:
        parts.append(["kind", "Eq", kind])
    return parts[0] if len(parts) == 1 else ["And", parts]
