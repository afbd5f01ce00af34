"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseam import constants as C

_WHITE = r"[ \t\n\r\f\x0B]"


def text_or(column: Column | str, default: str = "") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(default))


def strip(column: Column) -> Column:
    """Without white space (of any kind, unlike ``trim``) at either end."""
    return F.regexp_replace(column, rf"^{_WHITE}+|{_WHITE}+\z", "")


def rstrip(column: Column) -> Column:
    return F.rtrim(column, F.lit(" \t\n\r\f\x0b"))


def solid_length(column: Column) -> Column:
    """Number of characters that are not white space."""
    return F.length(F.regexp_replace(column, _WHITE, ""))


def query_tokens(column: Column) -> Column:
    """At most twelve tokens of at least two characters; repeats stay."""
    return F.slice(F.filter(F.split(F.lower(column), r"[^a-z0-9_.$/-]+"), lambda t: F.length(t) >= 2), 1, C.QUERY_TOKENS)


def path_text(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"[/_.\-]+", " "))


def path_prefix(column: Column) -> Column:
    """A prefix as it is compared: trimmed, lower case, without ``./`` before or slashes behind; null if blank."""
    cleaned = F.lower(F.regexp_replace(F.regexp_replace(F.trim(column), r"^\./", ""), r"/+\z", ""))
    return F.when(F.trim(column) != "", cleaned)


def sha(column: Column, n: int = 64) -> Column:
    return F.substring(F.sha2(column, 256), 1, n)


def chunk_id(path: Column, symbol: Column, raw: Column) -> Column:
    return sha(F.concat_ws("\n", path, symbol, raw), 40)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a bare ``Dockerfile`` has one of its own."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    found = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)\z", 1))
    return F.when(found != "", found).when(F.lower(name) == "dockerfile", ".dockerfile").otherwise("")


def language(path: Column) -> Column:
    own = extension(path)
    known = F.create_map(*[F.lit(x) for e, n in C.LANGUAGES.items() for x in (f".{e}", n)])
    return F.coalesce(F.element_at(known, own), F.when(own == "", "plain").otherwise(F.substring(own, 2, 100)))


def kind(path: Column) -> Column:
    own = extension(path)
    return (
        F.when(F.lower(path).rlike(C.TEST_PATH.replace("$", r"\z")), "test")
        .when(own.isin(".md", ".mdx"), "docs")
        .when(own.isin(".json", ".jsonc", ".yaml", ".yml", ".toml"), "config")
        .otherwise("code")
    )


def redact(column: Column) -> Column:
    for pattern in C.SECRETS:
        column = F.regexp_replace(column, pattern, C.REDACTED)
    return column


def symbol(raw: Column) -> Column:
    head = F.array_join(F.slice(F.split(raw, "\n"), 1, C.SYMBOL_LINES), "\n")
    found = [F.substring(F.trim(F.regexp_extract(head, p, 1)), 1, C.SYMBOL_CHARS) for p in C.SYMBOLS]
    return F.coalesce(*[F.when(f != "", f) for f in found], F.lit(""))


def iso_date(epoch: Column) -> Column:
    return F.when(epoch > 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd")).otherwise("")


def glob_regex(glob: str) -> str:
    """A Java and Python regex for a glob over lower-case paths: ``**`` crosses slashes (and takes one after it), ``*`` and ``?`` do not."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob.lower())
    meaning = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(p) or re.sub(r"([\\^$+?.()|\[\]{}*])", r"\\\1", p) for p in parts if p) + r"\z"


def index_terms(column: Column) -> Column:
    """Terms of the text index: runs of ``[a-z0-9_]`` in lower case, at most 39 characters."""
    return F.filter(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9_]+)"), 1), lambda t: F.length(t) <= C.BM25_TOKEN)
