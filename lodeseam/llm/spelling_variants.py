"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' fifth powers (modulo a prime, so that no word is too long for a long). One letter added, removed or exchanged changes the
key by that letter's power or by the difference of two: two words are candidates if they have the same key after one letter is taken from one of them (added or removed) or from both (exchanged). So each word
gives a row for itself and one for each letter that it may lose, and an equality join of these rows finds every exchange value without listing the pairs of letters.
Words with the same letters in another order have the same keys, and one such class may be large. Therefore a row also carries the order of one half of its letters: of two words that differ
by one edit, the first halves or the last halves are equal, so each row stands once with either half and joins on key and half. What joins is verified by the distance itself.

Each word then takes as its form the most frequent near word, if that is frequent enough, and forms are followed to the last by doubling the steps: occurrences at least double from a word to its
form, so chains are short.

Scale: texts are read in slices and counted before anything is shuffled; a row per word and letter is joined, with halves against hot classes; a word has a bounded
number of near words (a word of length l has at most 90 (2 l + 1), which are counted by partial sums and never gathered); each round of doubling is a join of one row per word, and its number is the logarithm of the longest chain.

Cases: a null or empty text has no words; a null ``doc_id`` is written as an empty string where occurrences are distorted by it; repeated rows count again; ties between forms go to the smallest in code-point order; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import durable, table

#: Least code points and occurrences of a word, and the least ratio of a form's occurrences to the word's.
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
#: One of so many (document, run) pairs is distorted by op11.
DISTORTED = 97
#: Keys are sums modulo this prime.
PRIME = (1 << 61) - 1
#: Bytes of a text that are searched at a time, and distinct words that a task counts before it passes them on.
SLICE_BYTES, TASK_WORDS = 1 << 20, 200_000
#: Runs of ASCII letters and of U+00C0 to U+00FF as UTF-8, after bytes.lower(), which lowers A to Z only; a byte that ends any run.
RUN, BREAK = re.compile(rb"(?:[a-z]+|(?:\xc3[\x80-\xbf])+)+"), re.compile(rb"[^a-z\x80-\xff]")


def runs(text: str) -> Counter[bytes]:
    """Occurrences of each lower-cased run of letters, searched in slices that end between runs."""
    data, found, at = text.encode("utf-8", "surrogatepass").lower(), Counter(), 0
    while at < len(data):
        end = BREAK.search(data, at + SLICE_BYTES)
        stop = end.start() if end else len(data)
        found.update(RUN.findall(data, at, stop))
        at = stop
    return found


def distorted(run: bytes, before: int, every: int) -> str:
    """The run, without one code point if ``every`` divides the checksum of document and run; ``before``: the checksum up to the run."""
    word, h = run.decode(), zlib.crc32(run, before)
    if every and h % every == 0:
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    return word


def word_counts(docs: DataFrame, every: int = 0, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of the texts' words; ``every`` other than 0 distorts one of so many pairs of document and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in runs(text.as_py() or "").items():
                    if len(found) >= least_length and len(word := distorted(found, before, every)) >= least_length:
                        counts[word] += n
                if len(counts) >= TASK_WORDS:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    each = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def _rows(words: DataFrame) -> DataFrame:
    """A row for each word, letter that it may lose (none: the empty string) and half: the joined hash of key, length and half, and what verifies it."""
    letters = F.split("word", "")
    words = words.withColumn("letters", letters).withColumn("key", F.aggregate("letters", F.lit(0).cast("long"), lambda s, c: (s + _power(c)) % F.lit(PRIME)))
    own = F.array(F.struct(F.lit("").alias("letter"), F.col("key").alias("key"), F.length("word").alias("length")))
    less = F.transform(F.array_distinct("letters"), lambda c: F.struct(c.alias("letter"), F.pmod(F.col("key") - _power(c), F.lit(PRIME)).alias("key"), (F.length("word") - 1).alias("length")))
    taken = words.select("word", "n", F.explode(F.concat(own, less)).alias("t")).select("word", "n", "t.*")
    half = F.floor(F.col("length") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(True).alias("first"), F.col("word").substr(F.lit(1), half).alias("letters")),
        F.struct(F.lit(False).alias("first"), F.expr("right(word, length - cast(floor(length / 2) AS int))").alias("letters")),
    )
    return taken.select("word", "n", "letter", half.alias("half"), F.explode(sides).alias("side"), "key", "length").select(
        F.xxhash64("key", "length", "side.first", "side.letters").alias("k"), "word", "n", "letter", "half", F.col("side.first").alias("first")
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """``(a, b, a_n, b_n)`` with ``a < b``: each pair of ``words`` (``word`` distinct, ``n``) that differs by exactly one inserted, deleted or replaced code point, once."""
    a, b = _rows(words).alias("a"), _rows(words).alias("b")
    apart = (F.col("a.word") < F.col("b.word")) & (F.col("a.letter") != F.col("b.letter"))
    # a pair with both halves equal (a letter put in at the middle) joins by the first
    once = F.col("a.first") | F.expr("substr(a.word, 1, a.half) <> substr(b.word, 1, b.half)")
    close = F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1
    found = a.join(b, (F.col("a.k") == F.col("b.k")) & apart & once & close)
    return found.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"))


def with_roots(forms: DataFrame, max_rounds: int = 20) -> DataFrame:
    """``(word, root)`` for ``forms`` (``word``, ``form``, no cycles): the last word on the way from form to form. A round doubles the steps."""
    at = durable(forms.select("word", F.col("form").alias("root")))
    for _ in range(max_rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = durable(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise RuntimeError("forms do not end")


def group_variants(words: DataFrame, least_ratio: int = LEAST_RATIO) -> DataFrame:
    """``words`` (``word`` distinct, ``n``) as ``(word, form, root, n, n_near, form_n)``."""
    words = durable(words.select("word", "n"))
    pairs, none = near_pairs(words), F.lit(None)
    best = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    each = (
        pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
        .unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
        .groupBy("word").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(best).alias("best"))
    )
    takes = -F.col("best.less") >= least_ratio * F.col("n")
    near = durable(each.select("word", "n_near", F.when(takes, F.col("best.near")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")))
    roots = with_roots(near.where("form IS NOT NULL"))
    known = near.join(roots, "word", "left").unionByName(words.select("word", F.lit(0).cast("long").alias("n_near"), none.cast("string").alias("form"), none.cast("long").alias("form_n"), none.cast("string").alias("root")).join(near.select("word"), "word", "left_anti"))
    return words.join(known, "word").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(word_counts(table(spark, sf_dir, "documents"), DISTORTED))


#: Checksums byte by byte with a table made from the polynomial; near words by the strings that are left when one code point goes.
OP11_SQL = """
WITH RECURSIVE bits(i, v, k) AS (
  SELECT i::UBIGINT, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents)
), counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run
), steps(doc_id, run, n, bytes, step, crc) AS (
  SELECT doc_id, run, n, bytes, 0, 4294967295::UBIGINT FROM counted
  UNION ALL
  SELECT doc_id, run, n, bytes, step + 1, xor(crc >> 8, t[(xor(crc, ('0x' || substr(bytes, 2 * step + 1, 2))::UBIGINT) & 255)::BIGINT + 1])
  FROM steps, crc_table WHERE 2 * step < length(bytes)
), hashed AS (
  SELECT run, n, xor(crc, 4294967295::UBIGINT) AS h FROM steps WHERE 2 * step = length(bytes)
), made AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), rests AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near
), forms AS (
  SELECT word, n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM ranked WHERE k = 1
), ways(word, last) AS (
  SELECT word, word FROM words
  UNION ALL SELECT w.word, f.form FROM ways w JOIN forms f ON w.last = f.word WHERE f.form IS NOT NULL
), roots AS (
  SELECT w.word, w.last AS root FROM ways w LEFT JOIN forms f ON w.last = f.word WHERE f.form IS NULL
)
SELECT w.word, f.form, r.root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w JOIN roots r ON w.word = r.word LEFT JOIN forms f ON w.word = f.word
"""
