"""Toxicity by a weighted finite-state pattern grammar.

Transducers are composed: a lexicon turns words into classes with weights (insult, threat, target, negation, reported speech), a scope transducer marks what
stands within a negation or reported speech, and a clause transducer gives each matched clause its weight: an insult alone is a partial match of ``PARTIAL`` weight, which a target
before or after it or a second insult in the same clause completes; a threat needs a target; negated or reported ones hardly count. A clause's score is the sum of word weight times arc
weight; a document's score is a logistic function of its strongest clause and of the sum over its clauses, so that partial matches count by their repetition. Neither ever lowers a score:
both coefficients are at least ``LEAST_COEFFICIENT``, and the fit is drawn towards ``DEFAULT`` where the labels say nothing.

What is learned, from labelled rows that are not held out: the insult lexicon (words and word beginnings that stand in many *different contexts* of toxic
documents and hardly in clean ones; contexts, unlike documents, do not count copies again) and the logistic function. Both see at most ``SAMPLE_TOXIC + SAMPLE_CLEAN`` labelled documents, those
with the smallest hashes of their ids, and the lexicon has at most ``LEXICON`` entries and as many
that overrule a beginning. A seed list serves languages without labels.

Scale: learning is bounded by the parameters above; scoring is a map over all rows, whole texts, with the lexicon broadcast (bounded).

Cases: null and empty texts get the score of no match; without labels, the seed list and a default function serve; labels that are null or conflict
for an id are passed over; repeated rows are scored alike; a null id is not held out; other columns play no part.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm.common import durable, table

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
LEXICON = 4_000
THRESHOLD = 0.7
#: Word beginnings that may be entries.
STEMS = (4, 5, 6, 7, 8)
#: Evidence for an entry: different contexts in toxic documents, deviations from chance, and its share of contexts, as if either label had as many.
LEAST_CONTEXTS, LEAST_DEVIATION, LEAST_SHARE = 3, 3.5, 0.9
#: Contexts from which on a longer entry overrules the beginnings that it has.
OVERRULES = 5
SEED_WEIGHT = 4.0
#: Share of an insult's weight that counts without a target or a second insult; what a target behind it adds for an insult and for a threat.
PARTIAL, COMPLETES, THREATENS = 0.5, 2.0, 6.0
LEAST_COEFFICIENT = 0.5

SEEDS = {
    "insult": "idiot idiots moron morons stupid scum loser losers trash clown worthless pathetic disgusting imbecile cretin trottel dummkopf abschaum idiota idiotas basura tonto imbécil crétin ordure abruti",
    "threat": "kill hurt destroy beat punish crush attack töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your he she they him her them people du dich ihr euch sie tu vous toi ils elles tú usted ustedes ellos",
    "negation": "not no never nobody nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún",
    "report": "said says saying told claimed claims wrote quoted quote reported alleged sagte sagt behauptete schrieb dit disait affirme écrit dijo dice afirmó escribió",
}
CLASSES = ("other", "insult", "threat", "target", "negation", "report", "end")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n]")
_ENDS = frozenset(".!?;\n")


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, input) -> (state, output, weight)``; an input without an arc keeps the state and passes through with weight 1."""

    start: int
    arcs: dict[tuple[int, str], tuple[int, str, float]]
    states: int

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, then: Transducer, alphabet: tuple[str, ...]) -> Transducer:
        """One transducer that feeds this one's outputs to ``then``; weights multiply."""
        arcs = {}
        for a in range(self.states):
            for symbol in alphabet:
                a2, out, w = self.step(a, symbol)
                for b in range(then.states):
                    b2, out2, w2 = then.step(b, out)
                    arcs[a * then.states + b, symbol] = (a2 * then.states + b2, out2, w * w2)
        return Transducer(self.start * then.states + then.start, arcs, self.states * then.states)


def scope() -> Transducer:
    """States: 0 plain, 1 to 3 words left in the scope of a negation, 4 reported speech up to the clause's end."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for state in range(5):
        after = max(0, state - 1) if state < 4 else 4
        for symbol in ("other", "target"):
            arcs[state, symbol] = (after, symbol, 1.0)
        for symbol in ("insult", "threat"):
            arcs[state, symbol] = (after, symbol if state == 0 else "denied" if state < 4 else "told", 1.0)
        arcs[state, "negation"] = (3 if state < 4 else 4, "other", 1.0)
        arcs[state, "report"] = (4, "other", 1.0)
        arcs[state, "end"] = (0, "end", 1.0)
    return Transducer(0, arcs, 5)


def clause() -> Transducer:
    """States: 0 nothing yet, 1 target seen, 2 insult alone, 3 threat alone, 4 complete. Outputs ``hit`` with the weight of the match, else ``none``."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    for state in range(5):
        arcs[state, "other"] = (state, "none", 0.0)
        arcs[state, "target"] = (state or 1, "none", 0.0)
        arcs[state, "insult"] = (2, "hit", PARTIAL) if state == 0 else (4, "hit", 1.0)
        arcs[state, "threat"] = (3, "hit", 0.1) if state in (0, 3) else (4, "hit", 1.0)
        arcs[state, "denied"] = (state, "hit", 0.05)
        arcs[state, "told"] = (state, "hit", 0.1)
        arcs[state, "end"] = (0, "end", 0.0)
    arcs[2, "target"] = (4, "hit", COMPLETES)
    arcs[3, "target"] = (4, "hit", THREATENS)
    return Transducer(0, arcs, 5)


GRAMMAR = scope().compose(clause(), CLASSES)


@dataclass
class Lexicon:
    """Words and word beginnings with class and weight; remembers a bounded number of words."""

    learned: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    remembered: int = 300_000

    def __post_init__(self) -> None:
        self.given = {w: (c, SEED_WEIGHT if c == "insult" else 3.0 if c == "threat" else 1.0) for c, words in SEEDS.items() for w in words.split()}
        self.seen: dict[str, tuple[str, float]] = {}

    def look(self, word: str) -> tuple[str, float]:
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > self.remembered:
                self.seen.clear()
            found = self.seen[word] = self._look(word)
        return found

    def _look(self, word: str) -> tuple[str, float]:
        if word in _ENDS:
            return "end", 1.0
        weight = self.learned.get(word)
        if weight is None:
            weight = next((self.stems[word[:n]] for n in reversed(STEMS) if len(word) > n and word[:n] in self.stems), 0.0)
        kind, own = self.given.get(word, ("other", 1.0))
        if weight and (kind in ("other", "insult", "threat")):
            return "insult", max(weight, own if kind == "insult" else 0.0)
        return kind, own


def clause_features(text: str | None, lexicon: Lexicon) -> tuple[float, float]:
    """The score of the strongest matched clause, and the sum over all clauses."""
    tokens = _TOKEN.findall((text or "").lower())
    look = lexicon.look
    if not any(look(w)[0] in ("insult", "threat") for w in set(tokens)):
        return 0.0, 0.0
    state, best, total, now = GRAMMAR.start, 0.0, 0.0, 0.0
    for word in tokens:
        kind, weight = look(word)
        state, out, factor = GRAMMAR.arcs[state, kind]
        if out == "hit":
            now += weight * factor
        elif out == "end":
            best, total, now = max(best, now), total + now, 0.0
    return max(best, now), total + now


@dataclass(frozen=True)
class Model:
    learned: dict[str, float]
    stems: dict[str, float]
    coefficients: tuple[float, float, float]

    def score(self, features: tuple[float, float]) -> float:
        a, b, c = self.coefficients
        z = a + b * np.log1p(features[0]) + c * np.log1p(features[1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


#: Serves where nothing can be learned: an insult with a target is toxic, one alone or denied is not.
DEFAULT = (-4.0, 3.0, 1.0)


def held_out(key: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3) == 1


def training_sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> tuple[DataFrame, dict[int, float]]:
    """``(text, y)`` of at most ``toxic + clean`` labelled documents that are not held out, and how many labelled rows each of a class stands for."""
    own = labels.select(F.col("doc_id").cast("long").alias("_ls_id"), F.col("toxic").cast("int").alias("y")).where("_ls_id IS NOT NULL AND y IN (0, 1)")
    own = own.where(~held_out("_ls_id")).groupBy("_ls_id").agg(F.min("y").alias("y"), F.max("y").alias("_ls_y")).where("y = _ls_y").drop("_ls_y")
    counts = {r.y: r["count"] for r in own.groupBy("y").count().collect()}
    order = F.xxhash64("_ls_id")
    picked = own.where("y = 1").orderBy(order, "_ls_id").limit(toxic).unionByName(own.where("y = 0").orderBy(order, "_ls_id").limit(clean))
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_ls_id"))  # bounded: toxic + clean rows
    weights = {y: max(1.0, counts.get(y, 0) / n) for y, n in ((1, toxic), (0, clean))}
    return joined.groupBy("_ls_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("text", "y"), weights


def contexts(sample: DataFrame) -> DataFrame:
    """``(word, toxic, clean)``: the numbers of different contexts (the words before and after) of each word in documents of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 500):
                rows: set[tuple[str, int, int]] = set()
                for r in batch.slice(b, 500).to_pylist():
                    words = ["", *(w for w in _TOKEN.findall((r["text"] or "").lower()) if w not in _ENDS), ""]
                    rows.update((w, zlib.crc32(f"{p} {n}".encode()), r["y"]) for p, w, n in zip(words, words[1:], words[2:], strict=False) if len(w) > 2)
                columns = list(zip(*rows, strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["word", "context", "y"])

    own = sample.mapInArrow(run, "word string, context long, y int").groupBy("word", "context").agg(F.max("y").alias("most"), F.min("y").alias("least"))
    return own.groupBy("word").agg(F.sum(F.when(F.col("most") == 1, 1).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("least") == 0, 1).otherwise(0)).alias("clean"))


def entries(words: DataFrame, limit: int = LEXICON) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with their weights (log odds), the clearest ``limit``."""
    words = words.select("word", "toxic", "clean", F.lit(0).alias("stem"))
    starts = words.select(F.explode(F.array(*[F.when(F.length("word") > n, F.struct(F.substring("word", 1, n).alias("word"), F.lit(n).alias("stem"))) for n in STEMS])).alias("s"), "toxic", "clean")
    stems = starts.where("s IS NOT NULL").groupBy("s.word", "s.stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).select("word", "toxic", "clean", "stem")
    both = words.unionByName(stems)
    total = words.agg(F.sum("toxic"), F.sum("clean")).first()
    a, b = (float(x or 0) for x in total)
    odds = F.log((F.col("toxic") + 0.5) / (a + 1)) - F.log((F.col("clean") + 0.5) / (b + 1))
    deviation = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    share = (F.col("toxic") / (a + 1)) / (F.col("toxic") / (a + 1) + F.col("clean") / (b + 1))
    both = durable(both.withColumn("odds", odds).withColumn("deviation", deviation).withColumn("share", share))
    kept = both.where((F.col("toxic") >= LEAST_CONTEXTS) & (F.col("deviation") >= LEAST_DEVIATION) & (F.col("share") >= LEAST_SHARE))
    rows = kept.orderBy(F.desc("deviation"), "word", "stem").limit(limit).collect()  # bounded by ``limit``, as are those that overrule
    begun = [r.word for r in rows if r.stem]
    under = [F.substring("word", 1, n).isin([w for w in begun if len(w) == n]) for n in STEMS if any(len(w) == n for w in begun)]
    if under:
        longer = both.where(F.col("toxic") + F.col("clean") >= OVERRULES).where(reduce(operator.or_, under))
        rows += longer.orderBy(F.desc(F.col("toxic") + F.col("clean")), "word", "stem").limit(limit).collect()
    return {r.word: max(0.0, r.odds) for r in rows if not r.stem}, {r.word: max(0.0, r.odds) for r in rows if r.stem}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1, rounds: int = 100) -> tuple[float, ...]:
    """Weighted logistic regression by Newton's steps, drawn towards ``DEFAULT``; coefficients other than the constant stay at ``LEAST_COEFFICIENT`` or more."""
    x = np.column_stack([np.ones(len(x)), np.log1p(x)])
    beta = goal = np.array(DEFAULT)
    penalty = np.array([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty * (beta - goal)
        held = (np.arange(len(beta)) > 0) & (beta <= LEAST_COEFFICIENT) & (gradient < 0)  # at their bound, and drawn below it
        free = np.flatnonzero(~held)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.zeros(len(beta))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], gradient[free])
        after = beta + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
        after[1:] = np.maximum(after[1:], LEAST_COEFFICIENT)
        done, beta = np.abs(after - beta).max() < 1e-8, after
        if done:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    sample, weights = training_sample(docs, labels, toxic, clean)
    sample = durable(sample)
    learned, stems = entries(durable(contexts(sample)))
    shared = sample.sparkSession.sparkContext.broadcast((learned, stems))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for b in batches:
            found = [clause_features(t.as_py(), lexicon) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), b.column("y")], ["best", "total", "y"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(run, "best double, total double, y int").collect()], float).reshape(-1, 3)  # bounded by the sample
    y = rows[:, 2]
    if min((y == 0).sum(), (y == 1).sum()) < 5 or not rows[:, 0].any():
        return Model(learned, stems, DEFAULT)
    return Model(learned, stems, fit_logistic(rows[:, :2], y, np.where(y == 1, weights[1], weights[0])))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``; a map over the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value.learned, shared.value.stems)
        for b in batches:
            scores = [shared.value.score(clause_features(t.as_py(), lexicon)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; a map, so that repeated ids or null ids need no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value.learned, shared.value.stems)
        for b in batches:
            yield b.filter(pa.array([shared.value.score(clause_features(t.as_py(), lexicon)) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
