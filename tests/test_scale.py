"""Steps whose cost or result once depended on the size of a table."""

import random

from pyspark.sql import functions as F

from lodeseam import constants as C
from lodeseam import engine
from lodeseam.config import Settings
from lodeseam.functions import text as T
from lodeseam.operators import retrieval
from lodeseam.operators.block_index import BlockIndex
from lodeseam.queries import QUERIES

from . import oracle


def test_commits_of_a_table_larger_than_the_feed(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_COMMITS", 20)
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id").collect())
    got = sorted(r.committed_at - 1_700_000_000 for r in QUERIES["engine_commits"](spark, str(oracle.DATA)).collect())
    assert len(ids) * 2 // 5 > 20 and got == ids[-20:]


def _rows(spark, n=300):
    rng = random.Random(4)
    words = [f"w{min(int(rng.expovariate(0.02)), 400)}" for _ in range(n * 30)]
    found = [(f"r{i:04}", " ".join(words[i * 30 : i * 30 + rng.randint(0, 30)]), "code") for i in range(n)]
    return spark.createDataFrame(found + [("none", None, "docs"), ("odd", "Éa_1 K " + "x" * 40 + " W3, w3", "docs")], "id string, text string, source string").repartition(3)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "RUN_ROWS", 40)
    rows = _rows(spark)
    found = retrieval.postings(rows, kept=["source"])
    kept = rows.collect()
    want = sorted((t, r.id, n, sum(retrieval.terms_of(r.text or "").values()), r.source) for r in kept for t, n in retrieval.terms_of(r.text or "").items())
    assert sorted(map(tuple, found.collect())) == want and ("k", "odd", 1, 4, "docs") in want
    assert "groupBy" not in _plan(found) and _plan(found).count("Exchange") == _plan(rows).count("Exchange")
    index = rows.select("id", F.size(T.index_terms(F.coalesce("text", F.lit("")))).alias("length"))
    assert sorted(map(tuple, retrieval.lengths(rows).collect())) == sorted(map(tuple, index.collect()))


def test_a_table_of_queries_shuffles_its_best_rows_only(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PRODUCTS", 50)
    monkeypatch.setattr(retrieval, "BATCH_ROWS", 64)
    rows = _rows(spark)
    rows = rows.unionByName(rows.where("id < 'r0050'").withColumn("id", F.concat(F.lit("copy"), "id")))
    rng = random.Random(9)
    asked = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 9)))) for i in range(40)] + [(90, None), (91, "nothing"), (92, "w1 w1 w2")], "qid int, query string")
    index = retrieval.TextIndex.build(rows)
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    want = key(retrieval.ranked(index.scores(retrieval.query_terms(asked)), [F.desc("score"), F.col("id")], 7, ["qid"]))
    found = index.topk(asked, 7)
    assert key(found) == want and len({q for q, *_ in want}) > 30
    assert "MapInArrow" in _plan(found) and "Join" not in _plan(found)


def test_blocks_answer_a_table_of_queries_from_lines_dealt_by_block(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieval, "RUN_ROWS", 50)  # runs end within blocks
    rows = _rows(spark)
    index = retrieval.TextIndex.build(rows)
    blocks = BlockIndex.build(index, rows, str(tmp_path), ("source",))
    assert not (tmp_path / "places").exists()
    rng = random.Random(9)
    asked = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(1, 9)))) for i in range(30)] + [(90, None), (91, "nothing")], "qid int, query string")
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    found = blocks.topk(asked, 6)
    assert key(found) == key(retrieval.ranked(index.scores(retrieval.query_terms(asked)), [F.desc("score"), F.col("id")], 6, ["qid"]))
    assert "hashpartitioning(block" in _plan(found) and "MapInArrow" in _plan(found)
    share = lambda: {r.qid: (r.blocks, r.opened) for r in blocks.opened(asked, 6).collect()}
    many = share()
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 1_000)
    assert share() == many


def test_a_reconcile_reads_on_all_cores_in_a_bounded_number_of_writes(spark, monkeypatch, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    for i in range(9):
        (root / "src" / f"f{i}.ts").write_text(f"export const v{i} = {i}\n")
    dealt, read = [], engine.read_contents
    monkeypatch.setattr(engine, "read_contents", lambda found: dealt.append(found.rdd.getNumPartitions()) or read(found))
    monkeypatch.setattr(engine, "WRITE_FILES", 1)
    own = engine.Engine(spark, str(root), str(tmp_path / "index"), Settings(dimensions=8))
    assert own.index_all()["changed"] == 9 and own.store.rows().count() == 9
    assert dealt == [spark.sparkContext.defaultParallelism] and len(own.store.state().segments) <= engine.MOST_WRITES < 9
