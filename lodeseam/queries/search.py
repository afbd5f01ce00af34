"""Queries over the retrieval, fusion and ranking operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodeseam import constants as C
from lodeseam.functions import text as T
from lodeseam.operators import ann, filters, ranking, retrieval, vector_index
from lodeseam.queries.corpus import QUERY, QUERY_VECTORS, ROWS, SECOND_QUERY, bm25_sql, literal, prepared, query, query_vector, rows, semantic_sql, table, tokens_sql, with_vectors
from lodeseam.sources.files import shared_folder, spread

WIDE = 48
LIVE = "source IN ('code', 'docs')"
ONE = f"(SELECT 0 AS qid, {literal(QUERY)} AS query)"


@query(f"WITH {ROWS}, {semantic_sql('near', QUERY_VECTORS[0], 20)} SELECT id, round(distance, 6) AS distance, rank::INT AS rank FROM near")
def vector_topk_cosine(spark, sf_dir):
    near = retrieval.vector_topk(with_vectors(spark, sf_dir), query_vector(spark, sf_dir, QUERY_VECTORS[0]), 20)
    return near.select("id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {ROWS}, {semantic_sql('near', QUERY_VECTORS[0], 20, LIVE + " AND language = 'en'")} SELECT id, round(distance, 6) AS distance, rank::INT AS rank FROM near")
def vector_topk_filtered(spark, sf_dir):
    live = with_vectors(spark, sf_dir).where(filters.compile_filter(filters.search_filter(["code", "docs"], " EN ")))
    return retrieval.vector_topk(live, query_vector(spark, sf_dir, QUERY_VECTORS[0]), 20).select("id", F.round("distance", 6).alias("distance"), "rank")


@query("""
WITH n AS (SELECT q.vec_id AS qid, e.vec_id::VARCHAR AS id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 25 = 0)
SELECT qid, id, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM n) WHERE rank <= 10""")
def batch_vector_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    near = retrieval.vector_topk_batch(vectors.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")), asked, 10)
    return near.select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {ROWS} SELECT id, n_chars, rank::INT AS rank FROM (SELECT id, n_chars, row_number() OVER (ORDER BY n_chars DESC, id) AS rank FROM rows) WHERE rank <= 20")
def vector_topk_by_attribute(spark, sf_dir):
    return retrieval.attribute_topk(rows(spark, sf_dir), "n_chars", 20).select("id", "n_chars", "rank")


def _one(spark, text=QUERY, qid=0):
    return spark.range(1).select(F.lit(qid).alias("qid"), F.lit(text).alias("query"))


@query(f"WITH {ROWS}, {bm25_sql('hit', ONE, 40)} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hit")
def bm25_text_topk(spark, sf_dir):
    return prepared(spark, sf_dir).text_index("text").topk(_one(spark), 40).select("id", F.round("score", 6).alias("score"), "rank")


PATH_TEXT_SQL = r"trim(regexp_replace(url, '[/_.\-]+', ' ', 'g'))"
PATH_QUERY = "blog example org en page feed"
BLOCK_PATH = "docs en The_f7 ts"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(f"WITH p AS (SELECT page_id::VARCHAR AS id, {PATH_TEXT_SQL} AS path_text FROM pages), {bm25_sql('hit', f'(SELECT 0 AS qid, {literal(PATH_QUERY)} AS query)', C.PATH_CANDIDATES, 'p', 'path_text')} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hit")
def bm25_path_topk(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), T.path_text(F.col("url")).alias("path_text"))
    return retrieval.search_text(pages, _one(spark, PATH_QUERY), C.PATH_CANDIDATES, "path_text").select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ROWS}, {bm25_sql('hit', '(SELECT item_id AS qid, text AS query FROM benchmark)', 10)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM hit")
def bm25_batch_queries(spark, sf_dir):
    return prepared(spark, sf_dir).text_index("text").topk(_items(spark, sf_dir), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ROWS}, {bm25_sql('hit', '(SELECT item_id AS qid, text AS query FROM benchmark)', 10)} SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM hit")
def bm25_block_queries(spark, sf_dir):
    """The questions of the benchmark by the index in blocks, which opens those that can hold a hit."""
    return prepared(spark, sf_dir).block_index("text").topk(_items(spark, sf_dir), 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ROWS}, {bm25_sql('hit', f'(SELECT 0 AS qid, {literal(QUERY)} AS query)', 40, where=LIVE)} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hit")
def bm25_block_filtered(spark, sf_dir):
    """One question by the index in blocks, of two sources only."""
    live = filters.compile_filter(filters.search_filter(["code", "docs"]))
    return prepared(spark, sf_dir).block_index("text").topk(_one(spark), 40, live).select("id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ROWS}, {bm25_sql('hit', f'(SELECT 0 AS qid, {literal(BLOCK_PATH)} AS query)', C.PATH_CANDIDATES, 'rows', 'path_text')} SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hit")
def bm25_block_paths(spark, sf_dir):
    """A question over path texts by the index in blocks."""
    return prepared(spark, sf_dir).block_index("path_text").topk(_one(spark, BLOCK_PATH), C.PATH_CANDIDATES).select("id", F.round("score", 6).alias("score"), "rank")


@query()
def bm25_block_share(spark, sf_dir):
    """For the questions of the benchmark: how many blocks hold one of their terms, and how many their search opens."""
    return prepared(spark, sf_dir).block_index("text").opened(_items(spark, sf_dir), 10)


def _arms(spark, sf_dir, text, vec_id, k=WIDE):
    store = prepared(spark, sf_dir)
    live = store.rows().where(filters.compile_filter(filters.search_filter(["code", "docs"])))
    near = retrieval.vector_topk(live, query_vector(spark, sf_dir, vec_id), k)
    scores = store.text_index("text").scores(retrieval.asked_terms(spark, [(0, text)]), list(retrieval.terms_of(text))).join(live.select("id"), "id", "left_semi")
    return near, retrieval.ranked(scores, [F.desc("score"), F.col("id")], k)


def _arms_sql(suffix, text, vec_id):
    asked = f"(SELECT 0 AS qid, {literal(text)} AS query)"
    return f"{semantic_sql('s' + suffix, vec_id, WIDE, LIVE)}, {bm25_sql('t' + suffix, asked, WIDE, where=LIVE)}"


RRF_SQL = "fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, array_to_string(list_sort(list_distinct(list(arm))), '+') AS arms, min(arm_idx * 1000 + rank) AS first FROM arms GROUP BY id)"
TWO_ARMS = "arms AS (SELECT 0 AS arm_idx, 'semantic' AS arm, rank, id FROM s0 UNION ALL SELECT 1, 'text', rank, id FROM t0)"


@query(f"WITH {ROWS}, {_arms_sql('0', QUERY, QUERY_VECTORS[0])}, {TWO_ARMS}, {RRF_SQL} SELECT id, round(score, 6) AS score, arms, row_number() OVER (ORDER BY score DESC, first)::INT AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    near, text = _arms(spark, sf_dir, QUERY, QUERY_VECTORS[0])
    fused = ranking.rrf(ranking.union_arms([("semantic", near), ("text", text)]))
    place = F.row_number().over(ranking.over(None, [F.desc("score"), F.col("first")]))
    return fused.select("id", F.round("score", 6).alias("score"), F.array_join("arms", "+").alias("arms"), place.cast("int").alias("rank"))


@query(
    f"""WITH {ROWS}, {_arms_sql('0', QUERY, QUERY_VECTORS[0])}, {_arms_sql('1', SECOND_QUERY, QUERY_VECTORS[1])},
arms AS (SELECT 0 AS arm_idx, 'semantic' AS arm, rank, id FROM s0 UNION ALL SELECT 1, 'text', rank, id FROM t0 UNION ALL SELECT 2, 'semantic', rank, id FROM s1 UNION ALL SELECT 3, 'text', rank, id FROM t1), {RRF_SQL}
SELECT id, round(score, 6) AS score, arms, row_number() OVER (ORDER BY score DESC, first)::INT AS rank FROM fused"""
)
def rrf_multi_facet(spark, sf_dir):
    arms = []
    for text, vec_id in ((QUERY, QUERY_VECTORS[0]), (SECOND_QUERY, QUERY_VECTORS[1])):
        near, words = _arms(spark, sf_dir, text, vec_id)
        arms += [("semantic", near), ("text", words)]
    fused = ranking.rrf(ranking.union_arms(arms))
    place = F.row_number().over(ranking.over(None, [F.desc("score"), F.col("first")]))
    return fused.select("id", F.round("score", 6).alias("score"), F.array_join("arms", "+").alias("arms"), place.cast("int").alias("rank"))


def _boost_sql(tokens, path="path", text="text", prefix=None):
    parts = f"list_sum(list_transform({tokens}, lambda t: (CASE WHEN contains(lower({path}), t) THEN 0.01 ELSE 0 END)::DOUBLE + (CASE WHEN contains(lower(coalesce({text}, '')), t) THEN 0.002 ELSE 0 END)::DOUBLE))"
    return f"coalesce({parts}, 0)" + (f" + CASE WHEN starts_with(lower({path}), {literal(prefix)}) THEN 0.02::DOUBLE ELSE 0 END" if prefix else "")


@query(f"WITH {ROWS} SELECT id, round({_boost_sql(tokens_sql(literal(QUERY)), prefix='code/en')}, 6) AS boost FROM rows")
def lexical_boosts(spark, sf_dir):
    boost = ranking.lexical_boost(T.query_tokens(F.lit(QUERY)), F.col("path"), F.col("text"), ranking.prefix_of(" ./Code/en/ "))
    return rows(spark, sf_dir).select("id", F.round(boost, 6).alias("boost"))


BONUS_SQL = "(CASE source WHEN 'code' THEN 0.03 WHEN 'history' THEN 0.02 WHEN 'conversation' THEN -0.06 ELSE 0 END)::DOUBLE"
NUDGE_SQL = "(CASE kind WHEN 'test' THEN -0.01 ELSE 0 END)::DOUBLE"


@query(f"WITH {ROWS} SELECT id, source, kind, round(1.0::DOUBLE / (60 + doc_id) + {BONUS_SQL} + {NUDGE_SQL}, 6) AS score FROM rows")
def source_kind_rescore(spark, sf_dir):
    asked = F.array(F.lit("code"), F.lit("docs"), F.lit("history"))
    score = F.lit(1.0) / (60 + F.col("doc_id")) + ranking.source_bonus(F.col("source"), asked) + ranking.kind_nudge(F.col("kind"))
    return rows(spark, sf_dir).select("id", "source", "kind", F.round(score, 6).alias("score"))


ROUTED = ("how does login work", "When was the cache introduced?", "what did we decide about retries", "why did we change the parser", "Who wrote this", "why is it slow", "our decision on naming", "history offline")


@query(
    f"""WITH q AS (SELECT text AS query FROM benchmark UNION ALL SELECT unnest([{', '.join(literal(r) for r in ROUTED)}])),
c AS (SELECT query, regexp_matches(query, {literal('(?i)' + C.CAUSAL_CUES)}) AS causal, regexp_matches(query, {literal('(?i)' + C.HISTORY_CUES)}) AS history, regexp_matches(query, {literal('(?i)' + C.CONVERSATION_CUES)}) AS conversation FROM q)
SELECT query, 'code,docs' || CASE WHEN causal OR history THEN ',history' ELSE '' END || CASE WHEN causal OR conversation THEN ',conversation' ELSE '' END AS sources FROM c"""
)
def source_routing(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("text").alias("query")).unionByName(spark.createDataFrame([(r,) for r in ROUTED], "query string"))
    return asked.select("query", F.array_join(ranking.route(F.col("query")), ",").alias("sources"))


TREE = ["And", [["source", "In", ["code", "docs"]], ["Or", [["language", "Eq", "fr"], ["path", "Glob", "code/**/*1?.ts"], ["And", [["n_chars", "Gte", 9000], ["kind", "NotEq", "test"]]]]]]]


@query(f"WITH {ROWS} SELECT id, path, kind, n_chars FROM rows WHERE {LIVE} AND (language = 'fr' OR regexp_matches(lower(path), '^code/.*[^/]*1[^/]\\.ts$') OR (n_chars >= 9000 AND kind <> 'test'))")
def filter_ast(spark, sf_dir):
    return rows(spark, sf_dir).where(filters.compile_filter(TREE)).select("id", "path", "kind", "n_chars")


PAGE_SQL = "p AS (SELECT page_id::VARCHAR AS id, regexp_replace(url, '^https?://', '') AS path, row_number() OVER (ORDER BY length(html) DESC, page_id) AS position FROM pages)"


def _pages(spark, sf_dir):
    """The 200 longest pages as candidates: the pool that a prefix filters after retrieval."""
    sized = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("size"))
    best = retrieval.ranked(sized, [F.desc("size"), F.col("page_id")], 200, name="position")
    return best.select(F.col("page_id").cast("string").alias("id"), F.regexp_replace("url", "^https?://", "").alias("path"), "position", F.lit("code").alias("source"))


@query(f"WITH {PAGE_SQL} SELECT id, path, row_number() OVER (ORDER BY position)::INT AS rank FROM p WHERE position <= 200 AND starts_with(lower(path), 'blog.') ORDER BY position LIMIT 5")
def path_prefix_filter(spark, sf_dir):
    found = ranking.diversify(_pages(spark, sf_dir), 5, 100, ranking.prefix_of(" ./BLOG./"), {})
    return found.where(F.startswith(F.lower("path"), F.lit("blog."))).select("id", "path", "rank")


@query(f"WITH {PAGE_SQL} SELECT id, path, rank::INT AS rank FROM (SELECT id, path, row_number() OVER (ORDER BY CASE WHEN starts_with(lower(path), 'm.ther') THEN 0 ELSE 1 END, position) AS rank FROM p WHERE position <= 200) WHERE rank <= 20")
def path_prefix_backfill(spark, sf_dir):
    return ranking.diversify(_pages(spark, sf_dir), 20, 100, ranking.prefix_of("M.ther/"), {}).select("id", "path", "rank")


CANDIDATES_SQL = f"""cand AS (
  SELECT f.id, r.path, r.text, r.source, r.kind, r.language, r.symbol, r.start_line, r.end_line, f.arms, {BONUS_SQL} AS bonus, round(f.score + {_boost_sql(tokens_sql(literal(QUERY)), 'r.path', 'r.text')} + {BONUS_SQL} + {NUDGE_SQL}, 9) AS score, f.first
  FROM fused f JOIN rows r USING (id)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) AS position FROM cand)"""


def _candidates(spark, sf_dir):
    """Fused arms with boosts and bonuses, in order."""
    near, text = _arms(spark, sf_dir, QUERY, QUERY_VECTORS[0])
    fused = ranking.rrf(ranking.union_arms([("semantic", near), ("text", text)]))
    both = prepared(spark, sf_dir).rows().drop("vector").join(F.broadcast(fused), "id")  # the arms' candidates
    asked = F.array(F.lit("code"), F.lit("docs"), F.lit("history"))
    bonus = ranking.source_bonus(F.col("source"), asked)
    score = F.col("score") + ranking.lexical_boost(T.query_tokens(F.lit(QUERY)), F.col("path"), F.col("text")) + bonus + ranking.kind_nudge(F.col("kind"))
    scored = both.withColumn("bonus", bonus).withColumn("score", F.round(score, 9))
    place = F.row_number().over(ranking.over(None, [F.desc("score"), F.col("first")]))
    return scored.withColumn("position", place.cast("int"))


POOL = C.LIMIT * C.POOL_MULTIPLIER
FUSED_SQL = f"WITH {ROWS}, {_arms_sql('0', QUERY, QUERY_VECTORS[0])}, {TWO_ARMS}, {RRF_SQL}, {CANDIDATES_SQL}"
RERANK_SQL = f"""pool AS (
  SELECT * EXCLUDE (score, position), position AS old, CASE WHEN position <= {POOL} THEN round(round(len(list_filter({tokens_sql(literal(QUERY))}, lambda t: contains(lower(path || chr(10) || chr(10) || coalesce(text, '')), t))) / len({tokens_sql(literal(QUERY))}), 9) + bonus, 9) ELSE score END AS score,
    CASE WHEN position <= {POOL} THEN 'rerank' ELSE 'fused' END AS score_kind FROM placed),
reranked AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN old <= {POOL} THEN 0 ELSE 1 END, score DESC, old) AS position FROM pool)"""


def _reranked_by(spark, sf_dir, reranker):
    return ranking.rerank(_candidates(spark, sf_dir), reranker, F.lit(QUERY), _document(), POOL)


def _reranked(spark, sf_dir):
    return _reranked_by(spark, sf_dir, ranking.LexicalReranker())


def _document():
    return ranking.rerank_document(*[F.col(c) for c in ("source", "path", "text", "sha", "committed_at", "author", "ts", "role")])


DATE_SQL = "CASE WHEN {0} > 0 THEN strftime(make_timestamp({0}::BIGINT * 1000000), '%Y-%m-%d') ELSE '' END"
DOCUMENT_SQL = f"""CASE source WHEN 'history' THEN '[commit ' || substring(sha, 1, 7) || ' ' || {DATE_SQL.format('committed_at')} || ' ' || author || ']' || chr(10) || text
  WHEN 'conversation' THEN '[conversation ' || {DATE_SQL.format('ts')} || ' ' || role || ']' || chr(10) || text ELSE path || chr(10) || chr(10) || text END"""


@query(f"WITH {ROWS} SELECT id, md5({DOCUMENT_SQL}) AS document_md5 FROM rows")
def rerank_documents(spark, sf_dir):
    """What a reranker reads of rows of every source."""
    return rows(spark, sf_dir).select("id", F.md5(_document()).alias("document_md5"))


def _failing(query_text, documents):
    raise ConnectionError("no reranker there")


@query(f"{FUSED_SQL} SELECT id, round(score, 6) AS score, 'fused' AS score_kind, position::INT AS position FROM placed")
def rerank_failure(spark, sf_dir):
    """A reranker that fails leaves the fused order and its scores."""
    return _reranked_by(spark, sf_dir, ranking.ScoringReranker(_failing)).select("id", F.round("score", 6).alias("score"), "score_kind", "position")


def _counted(query_text, documents):
    return [float(len(documents))] * len(documents)


@query(f"{FUSED_SQL} SELECT least({POOL}, count(*) OVER ())::DOUBLE AS sent, id FROM placed QUALIFY position <= {POOL}")
def rerank_sent(spark, sf_dir):
    """How many documents a provider is sent at once: the pool, of all candidates."""
    found = _reranked_by(spark, sf_dir, ranking.ScoringReranker(_counted)).where("score_kind = 'rerank'")
    return found.select(F.round(F.col("score") - F.col("bonus"), 6).alias("sent"), "id")


@query(f"{FUSED_SQL} SELECT id, round(score, 6) AS score, 'fused' AS score_kind, position::INT AS position FROM placed WHERE position = 1")
def rerank_single(spark, sf_dir):
    """A single candidate is not reranked."""
    one = _candidates(spark, sf_dir).where("position = 1")
    return ranking.rerank(one, ranking.LexicalReranker(), F.lit(QUERY), _document(), POOL).select("id", F.round("score", 6).alias("score"), "score_kind", "position")


def _letters(query_text, documents):
    return [len(d) % 97 / 97 for d in documents]


@query(
    f"""{FUSED_SQL}, p AS (SELECT c.id, position AS old, CASE WHEN position <= {POOL} THEN round(round((length(c.path || chr(10) || chr(10) || coalesce(c.text, '')) % 97) / 97.0::DOUBLE, 9) + bonus, 9) ELSE score END AS score FROM placed c)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY CASE WHEN old <= {POOL} THEN 0 ELSE 1 END, p.score DESC, old)::INT AS position FROM p"""
)
def rerank_by_function(spark, sf_dir):
    """A reranker that is a Python function, as a provider's client is."""
    return _reranked_by(spark, sf_dir, ranking.ScoringReranker(_letters)).select("id", F.round("score", 6).alias("score"), "position")


@query(f"{FUSED_SQL}, {RERANK_SQL} SELECT id, round(score, 6) AS score, score_kind, position::INT AS position FROM reranked")
def rerank_pool_merge(spark, sf_dir):
    return _reranked(spark, sf_dir).select("id", F.round("score", 6).alias("score"), "score_kind", "position")


def _diverse_sql(source, limit, per_file=3):
    return f"""dv1 AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY position) AS of_path FROM {source}),
dv2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS of_source FROM dv1 WHERE of_path <= {per_file}),
diverse AS (SELECT *, row_number() OVER (ORDER BY position) AS rank FROM dv2 WHERE of_source <= CASE source WHEN 'history' THEN 2 WHEN 'conversation' THEN 2 WHEN 'docs' THEN 3 ELSE 1000000000 END QUALIFY rank <= {limit})"""


@query(f"WITH {ROWS}, o AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, id) AS position FROM rows QUALIFY position <= 150), {_diverse_sql('o', 25)} SELECT id, path, source, rank::INT AS rank FROM diverse")
def diversify_topk(spark, sf_dir):
    best = retrieval.ranked(rows(spark, sf_dir).select("id", "path", "source", "n_chars"), [F.desc("n_chars"), F.col("id")], 150, name="position")
    return ranking.diversify(best, 25).select("id", "path", "source", "rank")


def _snippet_sql(text, most):
    whole = rf"regexp_replace(coalesce({text}, ''), '[ \t\n\r\f\v]+\z', '')"
    return f"""sn AS (SELECT *, {whole} AS whole FROM {{src}}),
sp AS (SELECT *, coalesce(list_filter(list_transform({tokens_sql(literal(QUERY))}, lambda t: instr(lower(whole), t)), lambda x: x > 0)[1] - 1, 0) AS hit FROM sn),
ss AS (SELECT *, greatest(0, hit - {most // 3}) AS start FROM sp),
snip AS (SELECT *, CASE WHEN length(whole) <= {most} THEN whole ELSE (CASE WHEN start > 0 THEN '…' ELSE '' END) || substring(whole, start::BIGINT + 1, {most}) || (CASE WHEN start + {most} < length(whole) THEN '…' ELSE '' END) END AS snippet FROM ss)"""


@query(f"WITH {ROWS}, {_snippet_sql('text', 400).format(src='rows')} SELECT id, md5(snippet) AS snippet_md5, length(snippet)::INT AS snippet_chars FROM snip")
def snippet_window(spark, sf_dir):
    found = spread(rows(spark, sf_dir)).select("id", ranking.snippet(F.col("text"), T.query_tokens(F.lit(QUERY)), 400).alias("snippet"))
    return found.select("id", F.md5("snippet").alias("snippet_md5"), F.length("snippet").alias("snippet_chars"))


HEADER = C.RESULT_HEAD.format(f'"{QUERY}"')
PLACE_SQL = "path || CASE WHEN source NOT IN ('history', 'conversation') AND start_line <> 0 AND end_line <> 0 THEN ':' || start_line || '-' || end_line ELSE '' END"
DECLARED_SQL = "trim(CASE WHEN kind NOT IN ('code', '') THEN kind ELSE '' END || ' ' || symbol)"
BLOCK_SQL = f"""chr(10) || rank::VARCHAR || '. ' || CASE WHEN source = 'code' THEN '' ELSE '[' || source || '] ' END || {PLACE_SQL} || CASE WHEN {DECLARED_SQL} <> '' THEN '  ' || {DECLARED_SQL} ELSE '' END || ' [' || arms || '; ' || printf('%.4f', score) || ']' || chr(10) || snippet"""


def _hits(diverse, most):
    return diverse.withColumn("snippet", ranking.snippet(F.col("text"), T.query_tokens(F.lit(QUERY)), most))


@query(
    f"""WITH {ROWS}, o AS (SELECT *, 'text' AS arms, round(n_chars / 1000.0::DOUBLE, 4) AS score, row_number() OVER (ORDER BY n_chars DESC, id) AS rank FROM rows QUALIFY rank <= 25), {_snippet_sql('text', 1600).format(src='o')},
b AS (SELECT id, rank, {BLOCK_SQL} AS block FROM snip), u AS (SELECT *, {len(HEADER)} + sum(length(block)) OVER (ORDER BY rank) AS used FROM b)
SELECT id, rank::INT AS rank, md5(block) AS block_md5, used::BIGINT AS used FROM u WHERE used <= 24000"""
)
def format_hits_budget(spark, sf_dir):
    best = retrieval.ranked(rows(spark, sf_dir), [F.desc("n_chars"), F.col("id")], 25)
    hits = _hits(best.withColumn("arms", F.array(F.lit("text"))).withColumn("score", F.round(F.col("n_chars") / 1000.0, 4)), C.SNIPPET_CHARS)
    return ranking.within_budget(ranking.hit_blocks(hits), len(HEADER)).select("id", "rank", F.md5("block").alias("block_md5"), "used")


@query(
    f"""{FUSED_SQL}, {RERANK_SQL}, {_diverse_sql('reranked', 8)}, {_snippet_sql('text', 1600).format(src='diverse')}
SELECT id, source, path, language, kind, round(score, 6) AS score, arms, rank::INT AS rank, md5(snippet) AS snippet_md5 FROM snip"""
)
def hybrid_search_e2e(spark, sf_dir):
    hits = _hits(ranking.diversify(_reranked(spark, sf_dir), C.LIMIT), C.SNIPPET_CHARS)
    return hits.select("id", "source", "path", "language", "kind", F.round("score", 6).alias("score"), F.array_join("arms", "+").alias("arms"), "rank", F.md5("snippet").alias("snippet_md5"))


#: Rows of a cell on average.
CELL_ROWS = 60


def _index(spark, sf_dir):
    """A vector index in files over the embeddings, the vectors, and the questions: those whose id 25 divides."""
    vectors = spread(table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")))
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dimensions")).first()
    index = vector_index.VectorIndex.build(vectors, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", size.dimensions or 1, max(1, size.n // CELL_ROWS))
    asked = vectors.where(F.col("id").cast("long") % 25 == 0).select(F.col("id").cast("long").alias("qid"), F.col("vector").alias("qvec"))
    return index, vectors, asked


@query("""
WITH n AS (SELECT q.vec_id AS qid, e.vec_id::VARCHAR AS id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
  FROM embeddings q CROSS JOIN embeddings e WHERE q.vec_id % 25 = 0)
SELECT qid, id, round(distance, 6) AS distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM n) WHERE rank <= 10""")
def ann_by_cells(spark, sf_dir):
    """The ten nearest of the vectors whose id 25 divides, by the index in files and the bounds of its codes."""
    index, _, asked = _index(spark, sf_dir)
    return index.exact(asked, 10).select("qid", "id", F.round("distance", 6).alias("distance"), "rank")


@query()
def ann_recall(spark, sf_dir):
    """For the vectors whose id 25 divides: the share of the exact ten nearest that the approximate search of the index finds, and the share of the vectors' bytes that it reads."""
    index, vectors, asked = _index(spark, sf_dir)
    found = ann.recall(index.search(asked, 10), retrieval.vector_topk_batch(vectors, asked, 10))
    return found.join(index.read_share(asked, 10), "qid").select("qid", F.round("recall", 4).alias("recall_at_10"), F.round("share", 4).alias("read_share"))
