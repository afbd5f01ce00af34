"""Queries over the evaluation operators. Relevant to a benchmark item are the documents that hold a passage of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseam.operators import evaluation
from lodeseam.queries.corpus import ROWS, bm25_sql, prepared, query, table, work_folder
from lodeseam.sources.files import spread

def _qrels(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("id"), "text", "n_chars")
    return evaluation.passage_judgements(docs, _items(spark, sf_dir)).select("qid", "did", F.when(F.col("n_chars") % 2 == 0, 2).otherwise(1).alias("grade"))


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.substring("text", 20, 60).alias("passage")).where(F.length("passage") == 60)


def _run(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return prepared(spark, sf_dir).text_index("text").topk(asked, 100).select("qid", F.col("id").alias("did"), "rank", "score")


EVAL_SQL = f"""WITH {ROWS}, {bm25_sql('run', '(SELECT item_id AS qid, text AS query FROM benchmark)', 100)},
qrels AS (SELECT item_id AS qid, doc_id::VARCHAR AS did, CASE WHEN n_chars % 2 = 0 THEN 2 ELSE 1 END AS grade FROM benchmark b JOIN documents d ON length(substring(b.text, 20, 60)) = 60 AND contains(d.text, substring(b.text, 20, 60))),
ideal AS (SELECT qid, sum(CASE WHEN r <= 10 THEN (2 ** grade - 1) / log2(r + 1) ELSE 0 END) AS idcg, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, did) AS r FROM qrels) GROUP BY qid),
hits AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) AS found, min(CASE WHEN rank <= 10 THEN rank END) AS first, min(rank) AS any_first FROM (SELECT run.qid, rank, grade FROM run JOIN qrels ON run.qid = qrels.qid AND run.id = qrels.did) GROUP BY qid),
figures AS (SELECT i.qid, coalesce(dcg, 0) / idcg AS ndcg, coalesce(found, 0) / relevant AS recall, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS success, coalesce(1.0 / first, 0)::DOUBLE AS mrr, any_first FROM ideal i LEFT JOIN hits h ON i.qid = h.qid)"""


def _figure(name):
    def f(spark, sf_dir):
        return evaluation.per_query(_run(spark, sf_dir), _qrels(spark, sf_dir)).select("qid", F.round(name, 5).alias(name))

    f.__name__ = f"eval_{name}"
    return query(f"{EVAL_SQL} SELECT qid, round({name}, 5)::DOUBLE AS {name} FROM figures")(f)


eval_ndcg, eval_recall, eval_mrr = _figure("ndcg"), _figure("recall"), _figure("mrr")


@query(f"{EVAL_SQL} SELECT qid, success::INT AS success FROM figures")
def eval_success(spark, sf_dir):
    return evaluation.per_query(_run(spark, sf_dir), _qrels(spark, sf_dir)).select("qid", "success")


@query(f"{EVAL_SQL} SELECT count(*) AS queries, round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(success), 5) AS success, round(avg(mrr), 5) AS mrr FROM figures")
def eval_macro(spark, sf_dir):
    return evaluation.macro(evaluation.per_query(_run(spark, sf_dir), _qrels(spark, sf_dir)))


@query(f"{EVAL_SQL} SELECT {', '.join(f'round(avg(CASE WHEN any_first <= {k} THEN 1.0::DOUBLE ELSE 0 END), 5) AS success_at_{k}' for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::DOUBLE / any_first, 0)), 5) AS mrr, round(avg(CASE WHEN any_first <= 10 THEN 1.0::DOUBLE / log2(any_first + 1) ELSE 0 END), 5) AS ndcg FROM figures")
def eval_success_at(spark, sf_dir):
    return evaluation.success_at(_run(spark, sf_dir), _qrels(spark, sf_dir))


@query("SELECT event_type, len(v) AS n, " + ", ".join(f"round(v[least(len(v) - 1, len(v) * {p} // 100) + 1], 6) AS p{p}" for p in (50, 95, 99)) + " FROM (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM events GROUP BY event_type)")
def latency_percentiles(spark, sf_dir):
    found = evaluation.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("SELECT event_type, count(*) AS items, epoch(max(ts)) - epoch(min(ts)) AS seconds, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second FROM events GROUP BY event_type")
def throughput_scorecard(spark, sf_dir):
    return evaluation.throughput(table(spark, sf_dir, "events"), ["event_type"])


@query(f"WITH {ROWS}, {bm25_sql('run', '(SELECT item_id AS qid, text AS query FROM benchmark)', 100)} SELECT qid || ' Q0 ' || id || ' ' || rank || ' ' || round(score::DECIMAL(18, 9), 6)::DECIMAL(18, 6)::VARCHAR || ' lodeseam' AS value FROM run")
def trec_run_file(spark, sf_dir):
    return evaluation.trec_run(_run(spark, sf_dir))


@query("""WITH q AS (SELECT doc_id % 50 AS n, count(*) AS judgements FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
SELECT 'q' || lpad(n::VARCHAR, 3, '0') AS qid, 'Ask ' || n AS text, judgements FROM q WHERE n % 7 <> 0 QUALIFY row_number() OVER (ORDER BY n) <= 20""")
def judged_queries(spark, sf_dir):
    """Evaluation tables as they are published (JSON lines), read, and the first judged queries."""
    from lodeseam.sources.evaluation import evaluation_tables

    folder = work_folder(spark)
    n = F.concat(F.lit("q"), F.lpad((F.col("doc_id") % 50).cast("string"), 3, "0"))
    docs = table(spark, sf_dir, "documents")
    docs.where("doc_id % 3 = 0").select(n.alias("query-id"), F.concat(F.lit("d"), F.col("doc_id")).alias("corpus-id")).write.json(f"{folder}/qrels")
    docs.select(n.alias("_id"), F.concat(F.lit("Ask "), (F.col("doc_id") % 50).cast("string")).alias("text")).where("cast(substring(_id, 2) AS int) % 7 <> 0").distinct().write.json(f"{folder}/queries")
    docs.select(F.concat(F.lit("d"), F.col("doc_id")).alias("_id"), "text").write.json(f"{folder}/corpus")
    read = evaluation_tables(spark, folder)
    known = read.qrels.join(read.queries, "qid", "left_semi")
    asked = evaluation.judged(read.queries, known, 20)
    return asked.join(known.groupBy("qid").agg(F.count(F.lit(1)).alias("judgements")), "qid").select("qid", "text", "judgements")
