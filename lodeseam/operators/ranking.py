"""From ranked arms to hits: fusion, boosts, source bonuses, reranking, quotas, snippets and text. All of it Column expressions and windows.

Every function takes ``by``, the columns that tell queries apart (none for a single search).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeseam import constants as C
from lodeseam.errors import RerankError
from lodeseam.functions.text import iso_date, path_prefix, query_tokens, rstrip, text_or


def over(by: list[str] | None, order: list[Column]):
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)


def union_arms(arms: list[tuple[str, DataFrame]], by: list[str] | None = None) -> DataFrame:
    """Arms as one table ``(by..., arm_idx, arm, rank, id)``; the position in the list is the arm's order."""
    parts = [df.select(*(by or []), F.lit(i).alias("arm_idx"), F.lit(name).alias("arm"), "rank", "id") for i, (name, df) in enumerate(arms)]
    return reduce(DataFrame.unionByName, parts)


def rrf(arms: DataFrame, constant: int = C.RANK_CONSTANT, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """``(by..., id, score, arms, first)``: reciprocal ranks added up, the names of the arms, and where an id was seen first."""
    return arms.groupBy(*(by or []), "id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), digits).alias("score"),
        F.array_sort(F.collect_set("arm")).alias("arms"),
        F.min(F.struct("arm_idx", "rank")).alias("first"),
    )


def lexical_boost(tokens: Column, path: Column, text: Column, prefix: Column | None = None) -> Column:
    """Path and text boosts for each token (repeats count again) and the path prefix boost."""
    path, text = F.lower(text_or(path)), F.lower(text_or(text))
    boost = F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.when(F.contains(path, t), C.PATH_BOOST).otherwise(0.0) + F.when(F.contains(text, t), C.TEXT_BOOST).otherwise(0.0))
    return boost if prefix is None else boost + F.when(F.startswith(path, prefix), C.PREFIX_BOOST).otherwise(0.0)


def source_bonus(source: Column, requested: Column) -> Column:
    asked = F.when(F.array_contains(requested, source), C.ASKED_BONUS).otherwise(C.UNASKED_MALUS)
    return F.when(source == "code", C.CODE_BONUS).when(source.isin("history", "conversation"), asked).otherwise(0.0)


def kind_nudge(kind: Column) -> Column:
    return F.when(kind == "test", C.TEST_MALUS).otherwise(0.0)


def route(query: Column) -> Column:
    """The sources that a query asks for."""
    cue = lambda p: query.rlike("(?i)" + p)
    causal = cue(C.CAUSAL_CUES)
    return F.array_compact(F.array(F.lit("code"), F.lit("docs"), F.when(causal | cue(C.HISTORY_CUES), "history"), F.when(causal | cue(C.CONVERSATION_CUES), "conversation")))


def rerank_document(source: Column, path: Column, text: Column, sha: Column, committed_at: Column, author: Column, ts: Column, role: Column) -> Column:
    return (
        F.when(source == "history", F.concat(F.lit("[commit "), F.substring(text_or(sha), 1, 7), F.lit(" "), F.coalesce(iso_date(committed_at), F.lit("")), F.lit(" "), text_or(author), F.lit("]\n"), text_or(text)))
        .when(source == "conversation", F.concat(F.lit("[conversation "), F.coalesce(iso_date(ts), F.lit("")), F.lit(" "), text_or(role), F.lit("]\n"), text_or(text)))
        .otherwise(F.concat(text_or(path), F.lit("\n\n"), text_or(text)))
    )


class Reranker(Protocol):
    """Scores documents for a query; a null document is not to be scored, a null score says that scoring failed."""

    enabled: bool

    def score(self, query: Column, document: Column) -> Column: ...


class LexicalReranker:
    """Offline: the share of the query's tokens that the document contains."""

    enabled = True

    def score(self, query: Column, document: Column) -> Column:
        tokens, low = query_tokens(query), F.lower(document)
        found = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
        return F.round(F.when(F.size(tokens) > 0, F.coalesce(found, F.lit(0)) / F.size(tokens)).otherwise(0.0), 9)


class NoReranker:
    enabled = False

    def score(self, query: Column, document: Column) -> Column:
        return F.lit(0.0)


class ScoringReranker:
    """Scores by a function of a query and documents, as a provider's client is. Should it fail, answer for fewer documents or take longer than ``timeout_s``, there are
    no scores (nulls). Null documents are not sent."""

    enabled = True

    def __init__(self, function: Callable[[str, list[str]], list[float]], timeout_s: float = C.RERANK_TIMEOUT_S):
        self.function, self.timeout_s = function, timeout_s

    def scores(self, query: str, documents: list[str]) -> list[float] | None:
        pool = ThreadPoolExecutor(1)
        try:
            found = [float(x) for x in pool.submit(self.function, query, documents).result(self.timeout_s)]
            if len(found) != len(documents):
                raise RerankError(f"{len(found)} scores for {len(documents)} documents")
        except Exception:  # whatever a provider's client raises
            found = None
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        return found

    def score(self, query: Column, document: Column) -> Column:
        @F.pandas_udf("double")
        def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for queries, documents in batches:
                out = pd.Series(None, index=documents.index, dtype="float64")
                for q, own in documents[documents.notna()].groupby(queries):
                    if (found := self.scores(q, own.tolist())) is not None:
                        out[own.index] = found
                yield out

        return F.round(scored(query, document), 9)


def resolve_reranker(name: str, known: dict[str, Reranker | None]) -> Reranker:
    """``none``; ``auto``: the first of ``known`` that is at hand; else the named one, or none if it is not at hand."""
    if name == "auto":
        return next((r for r in known.values() if r is not None), NoReranker())
    return known.get(name) or NoReranker()


def rerank(candidates: DataFrame, reranker: Reranker, query: Column, document: Column, pool: Column | int, by: list[str] | None = None) -> DataFrame:
    """Candidates (``score``, ``bonus``, ``position``) anew: the first ``pool`` by the reranker's scores plus bonus, the others behind as they were. A single candidate stays as it is,
    and so do all of a query (``by``) for which scoring failed.

    The reranker is given the documents of the pool and nulls for others, as a condition around a Python function would not keep it from being called. ``score_kind`` tells which scale a score has.
    """
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    asked = (F.col("position") <= pool) & (F.count(F.lit(1)).over(whole) > 1)
    candidates = candidates.withColumn("_asked", asked)
    candidates = candidates.withColumn("_scored", reranker.score(query, F.when(F.col("_asked"), document)))
    failed = F.max(F.col("_asked") & F.col("_scored").isNull()).over(whole)
    candidates = candidates.withColumn("_head", F.col("_asked") & ~failed)
    head = F.col("_head")
    scored = candidates.withColumn("score_kind", F.when(head, "rerank").otherwise("fused")).withColumn("score", F.when(head, F.round(F.col("_scored") + F.col("bonus"), 9)).otherwise(F.col("score")))
    order = [F.when(head, 0).otherwise(1), F.desc("score"), F.col("position")]
    return scored.withColumn("position", F.row_number().over(over(by, order)).cast("int")).drop("_asked", "_scored", "_head")


def diversify(candidates: DataFrame, limit: int, per_file: int = C.PER_FILE, prefix: Column | None = None, quotas: dict[str, int] | None = None, by: list[str] | None = None) -> DataFrame:
    """At most ``limit`` candidates in the order of ``position``: ``per_file`` of a path, the quota of a source; with a prefix, others fill up.

    Two nested windows say the same as the loop over candidates, as a path has one source.
    """
    quotas = C.QUOTAS if quotas is None else quotas
    keys = by or []
    inside = F.lit(True) if prefix is None else F.startswith(F.lower(text_or("path")), prefix)
    quota = reduce(lambda acc, q: acc.when(F.col("_source") == q[0], q[1]), quotas.items(), F.when(F.lit(False), 0))
    rows = candidates.withColumn("_inside", inside).withColumn("_source", text_or("source", "code")).withColumn("_path", text_or("path"))
    of_path = F.row_number().over(Window.partitionBy(*keys, "_inside", "_path").orderBy("position"))
    rows = rows.withColumn("_fits", F.col("_inside") & (of_path <= per_file))
    of_source = F.row_number().over(Window.partitionBy(*keys, "_fits", "_source").orderBy("position"))
    rows = rows.withColumn("_fits", F.col("_fits") & ((quota.isNull()) | (of_source <= quota)))
    if prefix is None:
        rows = rows.where("_fits")
    place = F.row_number().over(over(keys, [F.desc("_fits"), F.col("position")]))
    return rows.withColumn("rank", place.cast("int")).where(F.col("rank") <= limit).drop("_inside", "_source", "_path", "_fits", "position")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def snippet(text: Column, tokens: Column, most: int = C.SNIPPET_CHARS) -> Column:
    """The text, or a window of ``most`` characters around the first token (in the query's order) that occurs."""

    def window(whole: Column) -> Column:
        def cut(start: Column) -> Column:
            return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(whole, start + 1, F.lit(most)), F.when(start + most < F.length(whole), "…").otherwise(""))

        # a token that was found keeps its place; later ones are not looked for
        first = let(F.lower(whole), lambda low: F.aggregate(tokens, F.lit(0), lambda at, t: F.when(at > 0, at).otherwise(F.instr(low, t))))
        return let(F.greatest(F.lit(0), F.greatest(first - 1, F.lit(0)) - F.lit(most // 3)), cut)

    return let(rstrip(text_or(text)), lambda whole: F.when(F.length(whole) <= most, whole).otherwise(window(whole)))


def location(source: Column, path: Column, start: Column, end: Column) -> Column:
    lines = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(~source.isin("history", "conversation") & (start != 0) & (end != 0), lines).otherwise(path)


def hit_blocks(hits: DataFrame) -> DataFrame:
    """``hits`` with the ``block`` of text that shows each."""
    declared = F.trim(F.concat_ws(" ", F.when(~F.col("kind").isin("code", ""), F.col("kind")), F.when(F.col("symbol") != "", F.col("symbol"))))
    tag = F.when(F.col("source") == "code", "").otherwise(F.concat(F.lit("["), F.col("source"), F.lit("] ")))
    label = F.when(declared != "", F.concat(F.lit("  "), declared)).otherwise("")
    arms = F.concat(F.lit(" ["), F.array_join("arms", "+"), F.lit("; "), F.format_string("%.4f", F.col("score")), F.lit("]\n"))
    return hits.withColumn("block", F.concat(F.lit("\n"), F.col("rank").cast("string"), F.lit(". "), tag, location(F.col("source"), F.col("path"), F.col("start_line"), F.col("end_line")), label, arms, F.col("snippet")))


def within_budget(blocks: DataFrame, header_chars: int, most: int = C.OUTPUT_CHARS, by: list[str] | None = None) -> DataFrame:
    """The blocks that fit, in order, behind a header of ``header_chars``: the running length only grows, so a filter ends where a loop would."""
    used = F.sum(F.length("block")).over(over(by, [F.col("rank")]).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("used", (used + header_chars).cast("long")).where(F.col("used") <= most)


def prefix_of(value: str | None) -> Column | None:
    return path_prefix(F.lit(value)) if value and value.strip() else None
