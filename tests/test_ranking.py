"""Fusion, routing, quotas, snippets and text, against the plain loops they stand for."""

import random

from pyspark.sql import functions as F

from lodeseam.functions import text as T
from lodeseam.operators import ranking, retrieval
from lodeseam.queries.search import ROUTED


def arm(spark, ids):
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(ids)], "rank int, id string")


def test_an_id_in_both_arms_is_first(spark):
    fused = ranking.rrf(ranking.union_arms([("semantic", arm(spark, "abc")), ("text", arm(spark, "bd"))])).collect()
    best = max(fused, key=lambda r: r.score)
    assert best.id == "b" and best.arms == ["semantic", "text"] and abs(best.score - (1 / 62 + 1 / 61)) < 1e-9
    many = {r.id: r.score for r in ranking.rrf(ranking.union_arms([("a", arm(spark, "x")), ("a", arm(spark, "x"))])).collect()}
    assert abs(many["x"] - 2 / 61) < 1e-9


def test_boosts(spark):
    df = spark.createDataFrame([("src/auth/x.ts", "the Token the"), ("lib/y.ts", None)], "path string, text string")
    got = [r.b for r in df.select(ranking.lexical_boost(T.query_tokens(F.lit("auth token token")), F.col("path"), F.col("text"), F.lit("src")).alias("b")).collect()]
    assert abs(got[0] - (0.02 + 0.01 + 0.002 * 2)) < 1e-12 and got[1] == 0


def test_routing(spark):
    df = spark.createDataFrame([(r,) for r in ROUTED], "q string")
    got = dict(df.select("q", ranking.route(F.col("q")).alias("s")).collect())
    assert [len(got[r]) for r in ROUTED] == [2, 3, 3, 4, 3, 4, 3, 2] and got[ROUTED[1]][2] == "history" and got[ROUTED[2]][2] == "conversation"


def test_bonus_order(spark):
    df = spark.createDataFrame([("code",), ("docs",), ("history",), ("conversation",), (None,)], "s string")
    got = [round(r.b, 3) for r in df.select(ranking.source_bonus(F.col("s"), F.array(F.lit("code"), F.lit("history"))).alias("b")).collect()]
    assert got == [0.03, 0, 0.02, -0.06, 0]


def greedy(rows, limit, per_file, prefix, quotas):
    """The loop over candidates."""
    out, by_path, by_source = [], {}, {}
    for r in rows:
        if prefix and not r[1].lower().startswith(prefix):
            continue
        if r[2] in quotas and by_source.get(r[2], 0) >= quotas[r[2]] or by_path.get(r[1], 0) >= per_file:
            continue
        by_path[r[1]], by_source[r[2]] = by_path.get(r[1], 0) + 1, by_source.get(r[2], 0) + 1
        out.append(r)
        if len(out) == limit:
            return out
    if prefix:
        out += [r for r in rows if r not in out][: limit - len(out)]
    return out


def test_diversify_is_the_loop(spark):
    rng = random.Random(3)
    sources = ["code", "docs", "history", "conversation"]
    rows, want = [], {}
    for case in range(120):
        own = [(f"{case}-{i}", p := f"{s}/{rng.randrange(4)}", s, i, case) for i in range(rng.randint(1, 30)) for s in [rng.choice(sources)]]
        rows += own
        want[case] = own
    df = spark.createDataFrame(rows, "id string, path string, source string, position int, case int")
    for limit, per_file, prefix in ((8, 3, None), (25, 1, None), (6, 2, "docs"), (10, 3, "code/1")):
        got = {}
        for r in ranking.diversify(df, limit, per_file, ranking.prefix_of(prefix), by=["case"]).collect():
            got.setdefault(r.case, []).append((r["rank"], r.id))
        for case, own in want.items():
            assert [i for _, i in sorted(got.get(case, []))] == [r[0] for r in greedy(own, limit, per_file, prefix, {"history": 2, "conversation": 2, "docs": 3})]


def test_snippets(spark):
    text = "x" * 100 + " needle " + "y" * 100 + "   \n"
    cut = lambda q, t=text, n=60: spark.range(1).select(ranking.snippet(F.lit(t), T.query_tokens(F.lit(q)), n).alias("v")).first().v
    assert cut("needle") == "…" + text[81:141] + "…" and cut("nothing") == text[:60] + "…" and cut("a", "short \n") == "short"
    assert cut("absent yyyy needle") == "…" + text[88:148] + "…"  # the first token of the query that occurs, not of the text


def test_rerank_keeps_the_tail(spark):
    df = spark.createDataFrame([("a", 0.5, 0.0, 1, "x"), ("b", 0.4, 0.03, 2, "q"), ("c", 0.3, 0.0, 3, "q q")], "id string, score double, bonus double, position int, text string")
    got = ranking.rerank(df, ranking.LexicalReranker(), F.lit("qq"), F.lit("a qq"), 2).orderBy("position").collect()
    assert [(r.id, r.score_kind) for r in got] == [("b", "rerank"), ("a", "rerank"), ("c", "fused")] and got[2].score == 0.3


def test_a_provider_gets_the_pool_and_a_failure_keeps_the_order(spark):
    rows = [(q, f"{q}{k}", 1.0 / k, 0.03 * (k % 2), k, f"text {k}") for q in ("one", "bad", "many") for k in range(1, 2 if q == "one" else 101)]
    df = spark.createDataFrame(rows, "qid string, id string, score double, bonus double, position int, text string")

    def provider(query, documents):
        if query == "bad":
            raise ConnectionError("down")
        return [len(documents) + int(d.split()[1]) for d in documents]

    got = {q: [] for q in ("one", "bad", "many")}
    for r in ranking.rerank(df, ranking.ScoringReranker(provider), F.col("qid"), F.col("text"), 32, ["qid"]).orderBy("position").collect():
        got[r.qid].append(r)
    assert [(r.score, r.score_kind) for r in got["one"]] == [(1.0, "fused")]
    assert [r.id for r in got["bad"]] == [f"bad{k}" for k in range(1, 101)] and {r.score_kind for r in got["bad"]} == {"fused"}
    assert [r.id for r in got["many"]] == [f"many{k}" for k in [*range(32, 0, -1), *range(33, 101)]] and got["many"][0].score == 64.0
    assert sum(r.score_kind == "rerank" for r in got["many"]) == 32


def test_rerank_documents(spark):
    df = spark.createDataFrame([("history", "p", "t", "abcdefghij", 86400, "Ann", 0, ""), ("conversation", "p", "t", None, None, None, 86400, "turn"), ("code", "p", "t", None, None, None, None, None)], "source string, path string, text string, sha string, committed_at long, author string, ts long, role string")
    got = [r.d for r in df.select(ranking.rerank_document(*[F.col(c) for c in df.columns]).alias("d")).collect()]
    assert got == ["[commit abcdefg 1970-01-02 Ann]\nt", "[conversation 1970-01-02 turn]\nt", "p\n\nt"]


def test_blocks_end_at_the_budget(spark):
    rows = [(i + 1, "docs" if i else "code", "test" if i == 1 else "code", "Sym" if i else "", "p", 3, 9, 0.5, ["a", "b"], "s" * 50) for i in range(5)]
    hits = spark.createDataFrame(rows, "rank int, source string, kind string, symbol string, path string, start_line int, end_line int, score double, arms array<string>, snippet string")
    blocks = [r.block for r in ranking.hit_blocks(hits).orderBy("rank").collect()]
    assert blocks[0] == "\n1. p:3-9 [a+b; 0.5000]\n" + "s" * 50 and blocks[1] == "\n2. [docs] p:3-9  test Sym [a+b; 0.5000]\n" + "s" * 50
    assert ranking.within_budget(ranking.hit_blocks(hits), 10, 10 + len(blocks[0]) + len(blocks[1])).count() == 2


def test_bm25_by_hand(spark):
    rows = spark.createDataFrame([("a", "cat dog"), ("b", "cat cat bird"), ("c", None)], "id string, text string")
    index = retrieval.TextIndex.build(rows)
    got = index.topk(spark.createDataFrame([(0, "Cat"), (1, "none")], "qid int, query string"), 5).collect()
    assert [(r.qid, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, "b", 1), (0, "a", 2)]


def test_batches_of_queries_give_whole_results(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", 1)
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 2)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None)], "qid int, qvec array<float>")
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [2.0]), ("g", []), ("h", [None, 1.0])], "id string, vector array<float>")
    got = [(r.qid, r.id, round(r.distance, 4), r["rank"]) for r in retrieval.vector_topk_batch(rows, queries, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, "a", 0.0, 1), (1, "b", 0.0, 2), (2, "c", 0.2929, 1), (2, "a", 1.0, 2), (3, "f", 0.0, 1)]
