"""The text index in blocks against the index that scores every posting."""

import random

import pytest
from pyspark.sql import functions as F

from lodeseam.operators import block_index, retrieval
from lodeseam.operators.block_index import BlockIndex
from lodeseam.store import IndexStore

ROWS = "id string, text string, source string, path string"


def corpus(spark, n=600, seed=5):
    """Rows of ten themes, each with words of its own and words that all share."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        theme = i % 10
        own = [f"t{theme}w{min(int(rng.expovariate(0.25)), 30)}" for _ in range(rng.randint(2, 40))]
        out.append((f"r{i}", " ".join(own + rng.choices(["the", "of", "and", "common"], k=rng.randint(0, 9))), "code" if i % 3 else "docs", f"theme{theme}/f{i % 4}"))
    odd = [("none", None), ("empty", ""), ("same1", "the the t1w1"), ("same2", "the the t1w1"), ("long", "t2w2 the " * 20_000), ("stop", "the")]
    return spark.createDataFrame(out + [(i, t, "docs", "odd") for i, t in odd], ROWS)


QUERIES = [(1, "t1w1 t1w3 the"), (2, "the of"), (3, "t2w2 t3w0 t9w1 common"), (4, "nothing-here"), (5, None), (6, "t4w2 T4W1"), (7, "the the the t7w0"), (8, "")]


def asked(spark, queries=QUERIES):
    return spark.createDataFrame(queries, "qid int, query string")


def key(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


def built(spark, rows, folder, kept=("source",)):
    figures = retrieval.lengths(rows).agg(F.count("id").alias("n"), F.avg("length").alias("mean")).first()
    index = retrieval.TextIndex(retrieval.postings(rows, kept=kept), figures.n, figures.mean or 0.0)
    return index, BlockIndex.build(index, rows, str(folder), ("path",))


@pytest.mark.parametrize("k", [1, 7, 10_000])
@pytest.mark.parametrize("bits", [0, 3])
def test_blocks_give_what_all_postings_give(spark, monkeypatch, tmp_path, k, bits):
    monkeypatch.setattr(block_index, "BITS", bits)
    index, blocks = built(spark, corpus(spark), tmp_path)
    want = key(index.topk(asked(spark), k))
    assert key(blocks.topk(asked(spark), k)) == want and {q for q, *_ in want} == {1, 2, 3, 6, 7}
    monkeypatch.setattr(block_index, "LISTED", 3)
    monkeypatch.setattr(retrieval, "FILTER_TERMS", 2)
    assert key(blocks.topk(asked(spark), k)) == want


def test_filters_act_before_the_floor(spark, tmp_path):
    index, blocks = built(spark, corpus(spark), tmp_path)
    docs = F.col("source") == "docs"
    scores = index.scores(retrieval.query_terms(asked(spark)), where=docs)
    assert key(blocks.topk(asked(spark), 6, docs)) == key(retrieval.ranked(scores, [F.desc("score"), F.col("id")], 6, ["qid"]))
    assert blocks.topk(asked(spark), 6, F.lit(False)).count() == 0


def test_lines_are_bounds_and_hold_each_posting_once(spark, tmp_path):
    index, blocks = built(spark, corpus(spark), tmp_path)
    each = blocks.lines.select("term", "block", "size", "most", "least", F.inline("rows"))
    assert each.where("tf > most OR length < least").count() == 0
    assert sorted(map(tuple, each.select("term", "id", "tf", "length").collect())) == sorted(map(tuple, index.postings.select("term", "id", "tf", "length").collect()))
    assert blocks.lines.where("size <> size(rows)").count() == 0 and each.groupBy("block").agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0] <= 1 << block_index.BITS


def test_search_opens_few_blocks_and_none_that_it_may_not_miss(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(block_index, "BITS", 2)
    index, blocks = built(spark, corpus(spark, 2000), tmp_path)
    rows = {r.qid: r for r in blocks.opened(asked(spark), 5).collect()}
    place = {r.id: r.block for r in blocks.lines.select("block", F.inline("rows")).collect()}
    terms = {q: set(retrieval.terms_of(text or "")) for q, text in QUERIES}
    for q, r in rows.items():
        assert r.blocks == blocks.lines.where(F.col("term").isin(terms[q])).select("block").distinct().count()
        assert r.opened >= len({place[i] for at, _, i, _ in key(index.topk(asked(spark), 5)) if at == q})
    assert rows[1].opened < rows[1].blocks / 4 and rows[3].opened < rows[3].blocks / 2


def test_bounds_are_read_without_the_rows(spark, tmp_path):
    _, blocks = built(spark, corpus(spark), tmp_path)
    own, known = blocks._asked(asked(spark, QUERIES[:1]))
    plan = blocks._bounds(own, known)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan.replace("IsNotNull(term), ", "") and "rows:" not in plan


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], ROWS)
    _, blocks = built(spark, rows, tmp_path)
    assert blocks.topk(asked(spark), 5).count() == blocks.opened(asked(spark), 5).count() == 0


def test_store_keeps_blocks_of_a_state_and_writes_them_anew_after_a_change(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "ns", "root")
    assert store.block_index("text") is None
    rows = corpus(spark, 120).withColumn("path_text", F.translate("path", "/", " "))
    store.commit(rows)
    same = lambda column: key(store.block_index(column).topk(asked(spark), 9)) == key(store.text_index(column).topk(asked(spark), 9))
    assert same("text") and same("path_text")
    kept = sorted((tmp_path / "ns/blocks/text").rglob("*.parquet"))
    assert same("text") and sorted((tmp_path / "ns/blocks/text").rglob("*.parquet")) == kept
    for i in range(3):
        store.write(rows.where(f"id = 'r{i}'").withColumn("text", F.lit("t1w1 t1w3")), rows.where(f"id = 'r{i + 50}'").select("id"))
        assert same("text")
    folders = [p.name for p in (tmp_path / "ns/blocks/text").iterdir() if p.is_dir()]
    assert len(folders) == 2
