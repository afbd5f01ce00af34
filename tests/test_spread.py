"""Tables whose file is one row group, and steps that once shuffled all words."""

import random

from pyspark.sql import functions as F

from lodeseam.operators import evaluation, retrieval
from lodeseam.queries import corpus
from lodeseam.sources import files


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _one_group(spark, folder, n=400):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    found = [(i, f"Text {i} " + " ".join(rng.choice(words) for _ in range(40)), i % 7) for i in range(n)]
    where = f"{folder}/documents.parquet"
    spark.createDataFrame(found, "doc_id long, text string, n_chars int").coalesce(1).write.parquet(where)
    return where


def test_one_row_group_is_dealt_whatever_its_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "PART_BYTES", 2_000)  # as if the file were large
    df = spark.read.parquet(_one_group(spark, tmp_path))
    dealt = files.spread(df)
    n = dealt.rdd.getNumPartitions()
    assert n == files.parts_for(df) > 2 * spark.sparkContext.defaultParallelism and sorted(dealt.collect()) == sorted(df.collect())
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400 / 4
    assert "RoundRobin" not in _plan(dealt)
    dealt.write.parquet(f"{tmp_path}/even")
    even = spark.read.parquet(f"{tmp_path}/even")
    monkeypatch.setattr(files, "PART_BYTES", 32 << 20)
    assert files.spread(even) is even  # its files spread it already
    assert files.spread(df.limit(0)).count() == 0


def test_judgements_shuffle_no_words(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["el", "la", "ñd", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["", None, "a" * 30, "  ", "tail el la"]
    docs = spark.createDataFrame([(f"d{i}", t, i) for i, t in enumerate(texts)], "id string, text string, n int").repartition(3)
    asked = [(1, "el la ñd x"), (2, "l la ñd x e"), (3, "x el"), (4, "aaa"), (5, " "), (6, ""), (7, None), (8, "l la x x"), (8, "tail"), (9, "a" * 20), (10, "la el la"), (11, "  ")]
    passages = spark.createDataFrame(asked, "qid long, passage string")
    found = evaluation.passage_judgements(docs, passages)
    want = sorted((q, f"d{i}", i) for q, p in asked if p for i, t in enumerate(texts) if t is not None and p in t)
    assert sorted((r.qid, r.did, r.n) for r in found.collect()) == want and len({q for q, *_ in want}) >= 8
    assert "Join" not in _plan(found) and "Exchange" not in _plan(found).replace(_plan(docs), "").split("MapInArrow")[0]


def test_terms_are_counted_over_bytes(spark):
    texts = ["", None, "Éa_1 K " + "x" * 40 + " W3, w3", "a" * 39, "a" * 40, "end", "start", "ñ", "İstanbul"]
    assert retrieval.terms_in(texts).tolist() == [sum(retrieval.terms_of(t or "").values()) for t in texts]
    assert retrieval.terms_in([]).tolist() == []


def test_the_kept_index_joins_texts_in_parts_by_their_bytes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "PART_BYTES", 10_000)
    got = []
    monkeypatch.setattr(corpus.IndexStore, "commit", lambda self, rows: got.append(rows))
    monkeypatch.setattr(corpus, "_PREPARED", {})
    from tests import oracle

    corpus.prepared(spark, str(oracle.DATA))
    assert got[0].rdd.getNumPartitions() > 8 and "SortMergeJoin" not in _plan(got[0])


def test_texts_without_an_index_are_not_made_postings_for_a_table_of_queries(spark, monkeypatch):
    rng = random.Random(8)
    rows = spark.createDataFrame([(f"r{i}", " ".join(f"W{rng.randrange(30)}" for _ in range(rng.randint(0, 20)))) for i in range(90)] + [("none", None)], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} nothing") for i in range(20)], "qid int, query string")
    want = retrieval.ranked(retrieval.TextIndex.build(rows).scores(retrieval.query_terms(asked)), [F.desc("score"), F.col("id")], 5, ["qid"])
    key = lambda df: sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())
    want = key(want)
    monkeypatch.setattr(retrieval, "run_of", lambda texts: 1 / 0)  # what makes postings
    assert key(retrieval.search_text(rows, asked, 5)) == want and len(want) > 50


def test_the_report_deals_its_documents_once(spark, monkeypatch, tmp_path):
    from jobs import quality_report

    where = _one_group(spark, tmp_path)
    asked = spark.read.parquet(where).where("doc_id % 20 = 0").select(F.col("doc_id").alias("item_id"), "text")
    asked.write.parquet(f"{tmp_path}/questions")
    kept = []
    search = retrieval.search_text
    monkeypatch.setattr(retrieval, "search_text", lambda docs, *rest: kept.append((docs, docs.storageLevel.useDisk)) or search(docs, *rest))
    done = quality_report.run(spark, where, f"{tmp_path}/questions", f"{tmp_path}/out", "a")
    assert done["documents"] == 400 and done["recall"] == 1.0
    assert [used for _, used in kept] == [True] and not kept[0][0].storageLevel.useDisk
