"""Queries over the product as it is used: the engine, its index, its feeds, its streams and its command line, over trees, repositories and sessions made of the test tables."""

from __future__ import annotations

import contextlib
import io
import json
import os
import subprocess

import numpy as np
from pyspark.sql import functions as F

from lodeseam import cli, config
from lodeseam import constants as C
from lodeseam.config import Indexing, Settings
from lodeseam.engine import Engine, semantic_search
from lodeseam.functions import scalar
from lodeseam.functions import text as T
from lodeseam.operators import chunking, embedding, ranking
from lodeseam.plans.search import SearchOptions, run_search
from lodeseam.queries.corpus import QUERY, QUERY_VECTORS, ROWS, SECOND_QUERY, bm25_sql, literal, prepared, query, query_vector, rows, semantic_sql, table, tokens_sql, with_vectors, work_folder, write_files
from lodeseam.queries.ingest import PAIR_SQL, SOLID_SQL, redact_sql, _symbol_sql
from lodeseam.queries.search import BONUS_SQL, DOCUMENT_SQL, NUDGE_SQL, RRF_SQL, _boost_sql, _diverse_sql, _snippet_sql
from lodeseam.sources import git
from lodeseam.sources.files import spread
from lodeseam.store import IndexStore
from lodeseam.streaming.watch import watch_commits, watch_tree


class TableEmbedder:
    """Gives each known text the vector of a row of the test table."""

    name = "table"

    def __init__(self, known: dict[str, list[float]]):
        self.known, self.dimensions = known, len(next(iter(known.values())))

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.known[t] for t in texts], np.float32)


# searches over the kept index

ROUTED = "why did we change the thing onth"


def _search_sql(facets, sources, limit, asked, prefix=None, pool=C.POOL_MULTIPLIER):
    """CTEs up to ``hits``: the whole search for ``facets`` (text, vec_id) over ``sources``."""
    live = f"source IN ({', '.join(literal(s) for s in sources)})"
    k = max(40, limit * 6)
    label = " / ".join(f for f, _ in facets)
    parts, arms = [f"WITH {ROWS}"], []
    for i, (text, vec_id) in enumerate(facets):
        one = f"(SELECT 0 AS qid, {literal(text)} AS query)"
        parts += [semantic_sql(f"s{i}", vec_id, k, live), bm25_sql(f"t{i}", one, k, where=live), bm25_sql(f"p{i}", one, 40, text="path_text", where=live)]
        arms += [(f"s{i}", "semantic"), (f"t{i}", "text"), (f"p{i}", "path")]
    parts.append("arms AS (" + " UNION ALL ".join(f"SELECT {j} AS arm_idx, '{name}' AS arm, rank, id FROM {cte}" for j, (cte, name) in enumerate(arms)) + ")")
    parts.append(RRF_SQL)
    tokens = tokens_sql(literal(label))
    bonus = BONUS_SQL if asked else BONUS_SQL.replace("0.02", "-0.06")
    conv = "WHEN 'conversation' THEN 0.02" if asked else "WHEN 'conversation' THEN -0.06"
    bonus = bonus.replace("WHEN 'conversation' THEN -0.06", conv)
    parts.append(f"""cand AS (SELECT f.id, r.* EXCLUDE (id), f.arms, {bonus} AS bonus, round(f.score + {_boost_sql(tokens, 'r.path', 'r.text', prefix)} + {bonus} + {NUDGE_SQL}, 9) AS score, f.first FROM fused f JOIN rows r USING (id)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, first) AS old FROM cand),
pool AS (SELECT * EXCLUDE (score), CASE WHEN old <= {limit * pool} THEN round(round(len(list_filter({tokens}, lambda t: contains(lower({DOCUMENT_SQL.replace(' || text', " || coalesce(text, '')")}), t))) / len({tokens}), 9) + bonus, 9) ELSE score END AS score FROM placed),
reranked AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN old <= {limit * pool} THEN 0 ELSE 1 END, score DESC, old) AS position FROM pool)""")
    parts.append(_diverse_sql("reranked", limit))
    parts.append(_snippet_sql("text", C.SNIPPET_CHARS).format(src="diverse").replace(tokens_sql(literal(QUERY)), tokens))
    return ", ".join(parts)


HIT_SQL = "SELECT id, source, path, language, kind, symbol, start_line, end_line, round(score, 6) AS score, arms, rank::INT AS rank, md5(snippet) AS snippet_md5 FROM snip"
FACETS = ((QUERY, QUERY_VECTORS[0]), (SECOND_QUERY, QUERY_VECTORS[1]))


def _hits(spark, sf_dir, facets, options):
    known = {text: query_vector(spark, sf_dir, v) for text, v in facets}
    result = run_search(spark, prepared(spark, sf_dir), TableEmbedder(known), ranking.LexicalReranker(), [t for t, _ in facets], "hybrid", options)
    return result.hits.select("id", "source", "path", "language", "kind", "symbol", "start_line", "end_line", F.round("score", 6).alias("score"), F.array_join("arms", "+").alias("arms"), "rank", F.md5("snippet").alias("snippet_md5"))


@query(f"{_search_sql(FACETS, ('code', 'docs'), 8, False)} {HIT_SQL}")
def engine_search(spark, sf_dir):
    """Two facets, three arms each, through the planner, over the kept index."""
    return _hits(spark, sf_dir, FACETS, SearchOptions())


@query(f"{_search_sql(((ROUTED, QUERY_VECTORS[0]),), ('code', 'docs', 'history', 'conversation'), 15, True)} {HIT_SQL}")
def engine_search_routed(spark, sf_dir):
    """A question that asks for history and conversations, too."""
    return _hits(spark, sf_dir, ((ROUTED, QUERY_VECTORS[0]),), SearchOptions(limit=15.7))


HEAD = C.RESULT_HEAD.format(json.dumps(ROUTED))
TEXT_BLOCK_SQL = """rank::VARCHAR || '. ' || CASE WHEN source = 'code' THEN '' ELSE '[' || source || '] ' END || path || CASE WHEN source NOT IN ('history', 'conversation') AND start_line <> 0 AND end_line <> 0 THEN ':' || start_line || '-' || end_line ELSE '' END
  || CASE WHEN trim(CASE WHEN kind <> 'code' THEN kind ELSE '' END || ' ' || symbol) <> '' THEN '  ' || trim(CASE WHEN kind <> 'code' THEN kind ELSE '' END || ' ' || symbol) ELSE '' END || ' [' || arms || '; ' || printf('%.4f', score) || ']' || chr(10) || snippet"""


@query(
    f"""{_search_sql(((ROUTED, QUERY_VECTORS[0]),), ('code', 'docs', 'history', 'conversation'), 25, True)},
bl AS (SELECT rank, {TEXT_BLOCK_SQL} AS block FROM snip), us AS (SELECT *, {len(HEAD)} + sum(length(block) + 1) OVER (ORDER BY rank) AS used FROM bl)
SELECT md5({literal(HEAD)} || string_agg(chr(10) || chr(10) || block, '' ORDER BY rank)) AS text_md5, count(*) AS shown FROM us WHERE used <= {C.OUTPUT_CHARS}"""
)
def tool_search(spark, sf_dir):
    """The text that the search tool answers with, within its budget; inputs that make no sense are dropped."""
    engine = Engine(spark, "/none", "/none", Settings(), TableEmbedder({ROUTED: query_vector(spark, sf_dir, QUERY_VECTORS[0])}))
    engine.store = prepared(spark, sf_dir)
    text = semantic_search(engine, queries=[ROUTED, 7, " "], mode="nonsense", source=["nowhere"], limit=99)
    return spark.createDataFrame([(text,)], "text string").select(F.md5("text").alias("text_md5"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+\. )(?=\S+/The_f|\[)"), 1)).cast("long").alias("shown"))


# trees of files

EMBED = Settings(dimensions=64)
WHOLE_SQL = f"strlen(content) BETWEEN 1 AND {C.MAX_FILE_BYTES}"


def _tree(spark, sf_dir, where="TRUE", content="text", mtime=1_700_000_000):
    d = F.col("doc_id")
    folder = F.when(d % 9 == 0, "docs/").when(d % 23 == 0, "node_modules/lib/").when(d % 29 == 0, "src/.hidden/").otherwise("src/")
    name = F.concat(folder, F.lit("f"), d.cast("string"), F.when(d % 9 == 0, ".md").when(d % 31 == 0, ".exe").otherwise(".ts"))
    return spread(table(spark, sf_dir, "documents").where(where)).select(name.alias("path"), F.expr(content).alias("content"), F.lit(mtime).alias("mtime_s"))


FILES_SQL = "files AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'docs/' ELSE 'src/' END || 'f' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.md' ELSE '.ts' END AS path FROM documents WHERE doc_id % 9 = 0 OR (doc_id % 23 <> 0 AND doc_id % 29 <> 0 AND doc_id % 31 <> 0))"


def _indexed(store):
    """Files with hash and size, and whether the rows of the index are the chunks of the manifest."""
    files = store.manifest()
    per = store.rows().groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    both = files.join(per, "path", "full")
    return both.select("path", "file_hash", "size", F.sort_array("chunk_ids").eqNullSafe(F.coalesce("ids", F.array().cast("array<string>"))).alias("consistent"))


@query(
    f"""WITH {FILES_SQL}, now AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'new ' || text ELSE text END AS content FROM files WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0)
SELECT path, sha256(content) AS file_hash, strlen(content)::BIGINT AS size, TRUE AS consistent FROM now WHERE {WHOLE_SQL}"""
)
def engine_reindex(spark, sf_dir):
    """A tree is indexed, changed (new, rewritten, touched, removed and binary files) and indexed again."""
    folder = work_folder(spark)
    root = f"{folder}/tree"
    write_files(_tree(spark, sf_dir, "doc_id % 5 <> 0"), root)
    engine = Engine(spark, root, f"{folder}/index", EMBED)
    engine.index_all()
    write_files(_tree(spark, sf_dir, "doc_id % 5 = 0"), root)
    write_files(_tree(spark, sf_dir, "doc_id % 7 = 0", "concat('new ', text)", 1_700_000_100), root)
    write_files(_tree(spark, sf_dir, "doc_id % 17 = 0 AND doc_id % 7 <> 0", "text", 1_700_000_200), root)
    write_files(_tree(spark, sf_dir, "doc_id % 13 = 0", "concat('b', char(0), text)", 1_700_000_300), root)
    gone = [r.path for r in _tree(spark, sf_dir, "doc_id % 11 = 0").select("path").toLocalIterator()]
    for path in gone:
        os.remove(f"{root}/{path}")
    engine.index_all()
    return _indexed(engine.store)


@query(f"WITH {FILES_SQL}, now AS (SELECT path, text AS content FROM files) SELECT path, sha256(content) AS file_hash, strlen(content)::BIGINT AS size, TRUE AS consistent FROM now WHERE {WHOLE_SQL}")
def engine_watch(spark, sf_dir):
    """An empty index follows a feed of changes of a tree, batch by batch; a second run of the stream goes on where the first one ended."""
    folder = work_folder(spark)
    root, feed = f"{folder}/tree", f"{folder}/feed"
    paths = F.concat(F.lit("{\"path\":\""), "path", F.lit("\",\"deleted\":false,\"at_ms\":1}"))
    engine = Engine(spark, root, f"{folder}/index", EMBED)
    for part in ("doc_id % 3 = 1", "doc_id % 3 = 2", "doc_id % 3 = 0"):
        files = _tree(spark, sf_dir, part)
        write_files(files, root)
        files.select(paths).coalesce(1).write.mode("append").text(feed)
        watch_tree(engine, feed, f"{folder}/checkpoint", once=True).awaitTermination()
    return _indexed(engine.store)


@query(f"WITH {FILES_SQL}, now AS (SELECT path, text AS content FROM files) SELECT count(*) AS files, 5 AS hits, TRUE AS same FROM now WHERE {WHOLE_SQL}")
def cli_status(spark, sf_dir):
    """The command line indexes a tree, tells its state as JSON, and prints the hits of a search as JSON: those of the engine."""
    folder = work_folder(spark)
    write_files(_tree(spark, sf_dir, "true"), f"{folder}/tree")
    base = ["--root", f"{folder}/tree", "--base", f"{folder}/index"]
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        cli.main([*base, "index"], spark)
        cli.main([*base, "status"], spark)
    status = json.loads(shown.getvalue().strip().splitlines()[-1])
    asked = QUERY.split()
    with contextlib.redirect_stdout(io.StringIO()) as printed:
        cli.main([*base, "search", *asked, "--limit", "5", "--json"], spark)
    hits = json.loads(printed.getvalue())
    engine = Engine(spark, f"{folder}/tree", f"{folder}/index", config.load(f"{folder}/tree"))
    same = hits == [json.loads(json.dumps(r.asDict(recursive=True))) for r in engine.hybrid(" ".join(asked), limit=5).rows()]
    return spark.createDataFrame([(status["files"], len(hits), same)], "files long, hits int, same boolean")


TS_SQL = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(
    rf"""WITH RECURSIVE d AS (SELECT doc_id, 'src/d' || doc_id || '.ts' AS path, {TS_SQL} AS text FROM documents WHERE trim({TS_SQL}, ' ' || chr(9) || chr(10) || chr(12) || chr(11)) <> ''),
l AS (SELECT doc_id, path, line, line_no, {SOLID_SQL} AS w, length(line) > 0 AND substring(line, 1, 1) NOT IN (' ', chr(9), '}}', ']', ')') AS starts FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d)),
s AS (SELECT *, coalesce(max(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen,
  min(CASE WHEN starts THEN line_no END) OVER (PARTITION BY doc_id) AS first_start, min(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS first_text FROM l),
b AS (SELECT *, sum(CASE WHEN starts OR line_no = 1 AND coalesce(first_text < first_start, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s),
k AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, block) AS size FROM b WHERE block > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, line_no = min(line_no) OVER (PARTITION BY doc_id, block) AS head FROM k WHERE size > 0),
f(doc_id, pos, piece, acc, cutting, opened) AS (SELECT doc_id, pos, 0, CASE WHEN size > {C.MAX_CHARS} THEN w ELSE size END, size > {C.MAX_CHARS}, size < {C.TARGET_CHARS} FROM n WHERE pos = 1
  UNION ALL SELECT n.doc_id, n.pos,
    CASE WHEN n.head AND NOT (n.size <= {C.MAX_CHARS} AND f.opened AND f.acc + n.size <= {C.MAX_CHARS}) OR NOT n.head AND f.cutting AND f.acc > 0 AND f.acc + n.w > {C.MAX_CHARS} THEN f.piece + 1 ELSE f.piece END,
    CASE WHEN n.head THEN CASE WHEN n.size > {C.MAX_CHARS} THEN n.w WHEN f.opened AND f.acc + n.size <= {C.MAX_CHARS} THEN f.acc + n.size ELSE n.size END
      WHEN f.cutting THEN CASE WHEN f.acc > 0 AND f.acc + n.w > {C.MAX_CHARS} THEN n.w ELSE f.acc + n.w END ELSE f.acc END,
    CASE WHEN n.head THEN n.size > {C.MAX_CHARS} ELSE f.cutting END,
    CASE WHEN n.head THEN n.size <= {C.MAX_CHARS} AND CASE WHEN f.opened AND f.acc + n.size <= {C.MAX_CHARS} THEN f.acc + n.size ELSE n.size END < {C.TARGET_CHARS} ELSE f.opened END
  FROM f JOIN n ON n.doc_id = f.doc_id AND n.pos = f.pos + 1),
p AS (SELECT n.path, f.piece, min(n.line_no)::INT AS start_line, max(n.line_no)::INT AS end_line, sum(n.w) AS solid, regexp_replace(string_agg(n.line, chr(10) ORDER BY n.line_no), '[ \t\n\r\f\v]+\z', '') AS raw FROM f JOIN n ON n.doc_id = f.doc_id AND n.pos = f.pos GROUP BY n.path, n.doc_id, f.piece),
c AS (SELECT *, {_symbol_sql("array_to_string(string_split(raw, chr(10))[1:4], chr(10))")} AS symbol FROM p WHERE solid > 0)
SELECT substring(sha256(path || chr(10) || symbol || chr(10) || raw), 1, 40) AS id, path, 'code' AS kind, 'typescript' AS language, symbol, start_line, end_line, length(raw)::INT AS raw_chars
FROM c QUALIFY row_number() OVER (PARTITION BY path, substring(sha256(path || chr(10) || symbol || chr(10) || raw), 1, 40) ORDER BY start_line) = 1"""
)
def chunk_greedy_merge(spark, sf_dir):
    """All chunks of the documents as source files, by the registered table function."""
    chunking.register(spark)
    spread(table(spark, sf_dir, "documents")).selectExpr("concat('src/d', doc_id, '.ts') AS path", "text", "sha2(text, 256) AS file_hash").createOrReplaceTempView("chunk_files")
    return spark.sql("SELECT c.id, c.path, c.kind, c.language, c.symbol, c.start_line, c.end_line, length(c.raw_text) AS raw_chars FROM chunk_files f, LATERAL chunk_source(f.path, f.text, f.file_hash) c")


#: Characters of a text that one file of ``chunk_headers`` holds: few enough for one chunk.
PIECE = 300
HEAD_LINES = f"'import alpha' || chr(10) || chr(10) || '  use beta;' || chr(10) || 'class C' || doc_id || ' {{' || chr(10) || replace(substring(coalesce(text, ''), cast({PIECE} * piece + 1 AS int), {PIECE}), chr(10), ' ')"
LAST_PIECE = f"cast(floor(greatest(length(coalesce(text, '')) - 1, 0) / {PIECE}.0) AS int)"


@query(
    rf"""WITH f AS (SELECT *, 'lib/x' || doc_id || '_' || piece || '.py' AS path FROM (SELECT *, unnest(range(0, {LAST_PIECE} + 1)) AS piece FROM documents))
SELECT doc_id, path, 'C' || doc_id AS symbol, md5('// ' || path || chr(10) || '// code C' || doc_id || chr(10) || 'import alpha' || chr(10) || 'use beta;' || chr(10)
  || regexp_replace({HEAD_LINES}, '[ \t\n\r\f\v]+\z', '')) AS embed_md5 FROM f"""
)
def chunk_headers(spark, sf_dir):
    """What is embedded of a chunk: path, kind and symbol, the file's imports, the text. Each text is spread over as many files as it has runs of ``PIECE`` characters."""
    pieces = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", F.explode(F.expr(f"sequence(0, {LAST_PIECE})")).alias("piece"))
    files = pieces.select("doc_id", F.expr("concat('lib/x', doc_id, '_', piece, '.py')").alias("path"), F.expr(HEAD_LINES.replace("chr(10)", "char(10)")).alias("text"), F.lit("h").alias("file_hash"))
    doc = F.regexp_extract("path", r"^lib/x(-?\d+)_", 1).cast("long").alias("doc_id")  # a file's path names its document
    return chunking.chunks(files.select("path", "text", "file_hash")).select(doc, "path", "symbol", F.md5("embed_text").alias("embed_md5"))


# commits


def _repository(spark, sf_dir, root, where):
    """One commit per document, by git's import stream; documents in the order of their ids."""
    os.makedirs(root, exist_ok=True)
    subprocess.run(["git", "-C", root, "init", "-q", "-b", "main"], check=True)
    docs = table(spark, sf_dir, "documents").where(where).select("doc_id", "lang", F.col("n_chars").cast("long").alias("n")).orderBy("doc_id")
    importer = subprocess.Popen(["git", "-C", root, "fast-import", "--quiet", "--force"], stdin=subprocess.PIPE)
    told = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "-q", "refs/heads/main"], capture_output=True, check=False).returncode == 0
    for r in docs.toLocalIterator():
        message = f"Change {r.doc_id}\n\nBody of {r.lang} with {r.n}\n".encode()
        content = f"const x = {r.doc_id}\n".encode()
        parent = b"from refs/heads/main^0\n" if told else b""
        told = False  # later commits follow the branch
        importer.stdin.write(b"commit refs/heads/main\n" + f"committer {r.lang} <a@b> {1_700_000_000 + r.doc_id} +0000\ndata {len(message)}\n".encode() + message + parent)
        importer.stdin.write(f"M 644 inline src/f{r.doc_id % 40}.ts\ndata {len(content)}\n".encode() + content)
    importer.stdin.close()
    if importer.wait():
        raise RuntimeError("git could not import the commits")
    subprocess.run(["git", "-C", root, "reset", "-q", "--hard"], check=True)


COMMIT_SQL = f"c AS (SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY doc_id DESC) <= {C.MAX_COMMITS})"


@query(
    f"""WITH {COMMIT_SQL} SELECT lang AS author, 1700000000 + doc_id AS committed_at, md5('Change ' || doc_id || chr(10) || 'Body of ' || lang || ' with ' || n_chars || chr(10) || 'Files: src/f' || (doc_id % 40) || '.ts') AS text_md5, 'Change ' || doc_id || ' src/f' || (doc_id % 40) || '.ts' AS path_text, 'history' AS source FROM c"""
)
def engine_commits(spark, sf_dir):
    """The newest commits of a repository in the index: the first ones in one run, the others in the next, from the cursor on."""
    folder = work_folder(spark)
    root = f"{folder}/repo"
    engine = Engine(spark, root, f"{folder}/index", EMBED)
    newest = sorted(r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").orderBy(F.desc("doc_id")).limit(C.MAX_COMMITS).collect())  # the limit is the feature
    split = len(newest) * 3 // 5  # of those that are taken, so that both runs have commits whatever the size of the table
    for own in filter(None, (newest[:split], newest[split:])):
        part = f"doc_id BETWEEN {own[0]} AND {own[-1]}"
        _repository(spark, sf_dir, root, part)
        watch_commits(engine, f"{root}/.git/logs", f"{folder}/checkpoint", once=True).awaitTermination()
        engine.index_commits()
    return engine.store.rows().where("source = 'history'").select("author", "committed_at", F.md5("text").alias("text_md5"), "path_text", "source")


@query("SELECT doc_id FROM documents WHERE doc_id % 40 = 7 QUALIFY row_number() OVER (ORDER BY doc_id DESC) <= 30")
def engine_file_history(spark, sf_dir):
    """The commits that the history of one file shows."""
    root = f"{work_folder(spark)}/repo"
    _repository(spark, sf_dir, root, "TRUE")
    text = git.file_history(root, " @./src/f7.ts", limit=99, most=1_000_000)
    found = spark.createDataFrame([(text,)], "text string")
    return found.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^Change (\d+)$"), 1)).alias("n")).select(F.col("n").cast("long").alias("doc_id"))


# sessions

@query(
    f"""WITH kept AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) QUALIFY row_number() OVER (ORDER BY conv_id DESC) <= {C.MAX_SESSIONS}), {PAIR_SQL.replace('FROM conversations', "FROM (SELECT conv_id, turn, role, regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS text FROM conversations)").replace("$'", chr(92) + "z'")}
SELECT 'conv:' || substring(sha256(session_id || chr(10) || index || chr(10) || "user"), 1, 40) AS id, 'session:' || substring(session_id, 1, 8) || '#' || index AS path,
  md5({redact_sql("'User: ' || \"user\" || chr(10) || chr(10) || 'Assistant: ' || assistant")}) AS text_md5, 1704067200 + session_id::BIGINT AS ts
FROM pairs WHERE session_id::BIGINT IN (SELECT conv_id FROM kept) AND session_id::BIGINT % 6 <> 0"""
)
def engine_sessions(spark, sf_dir):
    """The newest session files of this root (others are elsewhere), as rows of the index."""
    folder = work_folder(spark)
    root = f"{folder}/tree"
    talk = table(spark, sf_dir, "conversations")
    content = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", content.alias("content")).alias("message")))
    where = F.when(F.col("conv_id") % 6 == 0, "/elsewhere").otherwise(root)
    stamp = F.date_format(F.timestamp_seconds(1_704_067_200 + F.col("conv_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), where.alias("cwd"), stamp.alias("timestamp")))
    lines = talk.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("all"))  # a conversation's turns make one file
    text = F.concat(head, F.lit("\n{broken\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    write_files(lines.select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), text.alias("content"), (1_704_067_200 + F.col("conv_id")).alias("mtime_s")), f"{folder}/sessions")
    os.makedirs(root, exist_ok=True)
    engine = Engine(spark, root, f"{folder}/index", Settings(dimensions=64, indexing=Indexing(conversations=True)))
    engine.index_conversations(f"{folder}/sessions", 1_800_000_000_000)
    return engine.store.rows().select("id", "path", F.md5("text").alias("text_md5"), "ts")


# the store

@query(
    f"""WITH {ROWS}, a AS (SELECT id, path, text FROM rows WHERE doc_id % 2 = 0), b AS (SELECT id, path, 'second ' || id AS text FROM rows WHERE doc_id % 5 = 0),
u AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT * FROM b),
v AS (SELECT * FROM u WHERE id::BIGINT % 7 <> 0 AND path NOT IN ('code/en/The_f2.ts', 'code/fr/The_f4.ts') AND path <> 'code/en/The_f0.ts' AND NOT coalesce(id::BIGINT % 10 = 8, FALSE))
SELECT id, md5(text) AS text_md5 FROM v UNION ALL SELECT 'replaced', md5('by one row') UNION ALL SELECT 'meta', md5('7') UNION ALL SELECT 'cached', md5(count(*)::VARCHAR) FROM embeddings WHERE embedding IS NOT NULL"""
)
def store_writes(spark, sf_dir):
    """Every kind of write to an index, one after the other, in segments that are merged in between; another namespace is cleared."""
    folder = work_folder(spark)
    store, other = IndexStore(spark, folder, "own"), IndexStore(spark, folder, "other")
    base = rows(spark, sf_dir).drop("doc_id", "n_chars")
    number = F.col("id").cast("long")
    store.upsert(base.where(number % 2 == 0))
    other.upsert(base.where(number % 3 == 0))
    store.upsert(base.where(number % 5 == 0).withColumn("text", F.concat(F.lit("second "), "id")))
    store.delete_ids(base.where(number % 7 == 0).select("id"))
    store.merge()
    store.delete_files(["code/en/The_f2.ts", "code/fr/The_f4.ts"])
    one = base.limit(1).withColumn("id", F.lit("replaced")).withColumn("text", F.lit("by one row")).withColumn("path", F.lit("code/en/The_f0.ts")).withColumn("source", F.lit("code"))
    store.replace_file("code/en/The_f0.ts", one)
    store.delete_by_filter(["source", "Eq", "history"])
    store.set_meta(seen="7")
    other.clear()
    store.warm()
    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.sha2(F.col("vec_id").cast("string"), 256).alias("key"), F.col("embedding").alias("vector"))
    store.remember(vectors.where("substring(key, 1, 1) < '9'"))
    store.remember(vectors)
    facts = [("meta", store.state().meta["seen"]), ("cached", str(store.cache().select("key").count()))]
    if other.rows().count() or other.state().version:
        facts.append(("other", "is left"))
    return store.query().select("id", "text").unionByName(spark.createDataFrame(facts, "id string, text string")).select("id", F.md5("text").alias("text_md5"))


@query("""WITH m AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE sha256(text) END AS file_hash, n_chars::BIGINT AS size FROM documents WHERE doc_id % 5 <> 0)
SELECT path, file_hash, size FROM m UNION ALL SELECT 'entry of f1', file_hash, size FROM m WHERE path = 'f1' UNION ALL SELECT 'entry of f5', NULL, NULL UNION ALL SELECT 'cursor', 'abc', NULL UNION ALL SELECT 'known', NULL, count(*) FROM m""")
def manifest_table(spark, sf_dir):
    """Entries of a manifest recorded, replaced and forgotten, and what it tells of single paths and cursors."""
    store = IndexStore(spark, work_folder(spark), "own", "/root")
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")
    entries = table(spark, sf_dir, "documents").select("doc_id", path, F.sha2("text", 256).alias("file_hash"), F.array().cast("array<string>").alias("chunk_ids"), F.col("n_chars").cast("long").alias("size"), F.lit(1.0).alias("mtime_ms"))
    store.record(entries)
    store.record(entries.where("doc_id % 3 = 0").withColumn("file_hash", F.lit("new")))
    store.forget(entries.where("doc_id % 5 = 0"))
    store.set_meta(cursor="abc")
    again = IndexStore(spark, store.folder.rsplit("/", 1)[0], "own", "/root")
    one, none = again.entry("f1"), again.entry("f5")
    facts = [("entry of f1", one["file_hash"], one["size"]), ("entry of f5", none and none["file_hash"], none and none["size"]), ("cursor", again.meta("cursor"), None), ("known", None, again.known_paths().count())]
    return again.manifest().select("path", "file_hash", "size").unionByName(spark.createDataFrame(facts, "path string, file_hash string, size long"))


@query(
    f"""WITH {ROWS}, r AS (SELECT * FROM rows WHERE doc_id % 3 <> 0 UNION ALL SELECT * REPLACE (text || ' onth onth' AS text) FROM rows WHERE doc_id % 3 = 0), {bm25_sql('hit', f'(SELECT 0 AS qid, {literal(QUERY)} AS query)', 40, source='r')}
SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hit"""
)
def segmented_text_topk(spark, sf_dir):
    """The text arm over an index of several segments, one of which replaced rows of an earlier one."""
    store = IndexStore(spark, work_folder(spark), "rows")
    base = spread(rows(spark, sf_dir))
    store.upsert(base)
    store.upsert(base.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" onth onth"))))
    asked = spark.range(1).select(F.lit(0).alias("qid"), F.lit(QUERY).alias("query"))
    return store.text_index("text").topk(asked, 40).select("id", F.round("score", 6).alias("score"), "rank")


# embedding inputs and providers

@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '\w+|[^\w\s]|\s+') AS tokens FROM documents)
SELECT doc_id, least(len(tokens), 200)::INT AS tokens, len(tokens) > 200 AS truncated, md5(array_to_string(tokens[1:200], '')) AS text_md5 FROM t""")
def embed_inputs(spark, sf_dir):
    """Embedding inputs cut to 200 tokens of the offline tokenizer."""

    @F.udf("tokens int, truncated boolean, text string", useArrow=True)
    def prepared_input(text):
        found = scalar.prepare_input(text or "", 200)
        return found.tokens, found.truncated, found.text

    made = table(spark, sf_dir, "documents").select("doc_id", prepared_input("text").alias("p"))
    return made.select("doc_id", "p.tokens", "p.truncated", F.md5("p.text").alias("text_md5"))


def _post(texts):
    """A provider that answers out of order."""
    return {"data": [{"index": i, "embedding": [float(len(t)), float(t.count("e"))]} for i, t in reversed(list(enumerate(texts)))]}


@query("""SELECT doc_id, piece::INT AS piece, length(t)::DOUBLE AS length, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS es
FROM (SELECT doc_id, piece, substring(text, piece * 1000 + 1, 1000) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 999) // 1000))) AS piece FROM documents WHERE text IS NOT NULL))""")
def provider_vectors(spark, sf_dir):
    """Vectors of whole texts, in pieces that requests take, by a provider's client, put in order."""
    last = F.greatest(F.lit(0), F.floor((F.length("text") - 1) / 1000).cast("int"))
    pieces = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    own = pieces.select("doc_id", "piece", F.expr("substring(text, piece * 1000 + 1, 1000)").alias("text"))
    made = embedding.embed(own, embedding.ProviderEmbedder(_post, 2))
    return made.select("doc_id", "piece", F.col("vector")[0].cast("double").alias("length"), F.col("vector")[1].cast("double").alias("es"))


# what the driver works out

def _facts(folder):
    """(name, value) of each driver-side function, over inputs that show its rules."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/settings.env", "w", encoding="utf-8") as f:
        f.write("# note\nLODESEAM_NAMESPACE_PREFIX = 'mine'\nlower=no\nA_B=\"q\"\nC=\n")
    with open(f"{folder}/settings.json", "w", encoding="utf-8") as f:
        json.dump({"indexing": {"exclude_dirs": [" Mine ", "dist"]}}, f)
    merged = config.load("/r", home=folder)
    error = lambda **e: scalar.provider_status({"error": e})
    return [
        ("line_range", str([scalar.line_range(x) for x in ("10-20", "3:9", "5, 8", "7", "2", "x", None)])),
        ("clamp_limit", str([scalar.clamp_limit(x) for x in (None, 0, 3.9, 99, float("inf"), -5)])),
        ("candidates", str([scalar.candidate_count(x) for x in (1, 8, 25)])),
        ("facets", str([scalar.facets([" a ", "", "b", "a"], 3), len(scalar.facets([str(i) for i in range(30)], 3)), len(scalar.facets([str(i) for i in range(30)], 1))])),
        ("retryable", str([s for s in (200, 400, 404, 408, 409, 425, 429, 500, 503) if scalar.retryable(s)])),
        ("provider_status", str([error(code=429), error(code="503"), error(code=True), error(message="HTTP 502 from there"), error(message="none"), scalar.provider_status({}), scalar.provider_status("x")])),
        ("request_sizes", str([scalar.request_sizes([1] * 5, 2, 100), scalar.request_sizes([60, 60, 10], 9, 100), scalar.request_sizes([500, 1], 9, 100)])),
        ("slug", str([config.slug(x) for x in ("/a/My Repo!", "/", "/x/--")])),
        ("read_env", str(sorted(config.read_env(f"{folder}/settings.env").items()))),
        ("read_json", str([config.read_json(f"{folder}/settings.json"), config.read_json(f"{folder}/none.json")])),
        ("merged", str([merged.namespace_prefix, "mine" in merged.indexing.exclude_dirs, merged.indexing.exclude_dirs.count("dist")])),
        ("reranker", str([type(ranking.resolve_reranker(n, {"first": None, "lexical": ranking.LexicalReranker()})).__name__ for n in ("none", "auto", "first", "lexical", "other")])),
        ("namespace", str([len({Settings().namespace("/a"), Settings().namespace("/b"), Settings(dimensions=8).namespace("/a"), Settings(reranker="none").namespace("/a")}), Settings().namespace("/a/Repo").rsplit("_", 1)[0]])),
    ]


FACTS = (
    ("line_range", "[(10, 20), (3, 9), (5, 8), (2, 12), (1, 7), None, None]"),
    ("clamp_limit", "[8, 1, 3, 25, 1, 1]"),
    ("candidates", "[40, 48, 150]"),
    ("facets", "[['a', 'b'], 5, 16]"),
    ("retryable", "[408, 409, 425, 429, 500, 503]"),
    ("provider_status", "[429, 503, None, 502, None, None, None]"),
    ("request_sizes", "[[2, 2, 1], [1, 2], [1, 1]]"),
    ("slug", "['my-repo', 'repo', 'repo']"),
    ("read_env", "[('A_B', 'q'), ('C', ''), ('LODESEAM_NAMESPACE_PREFIX', 'mine')]"),
    ("read_json", "[{'indexing': {'exclude_dirs': [' Mine ', 'dist']}}, None]"),
    ("merged", "['mine', True, 1]"),
    ("reranker", "['NoReranker', 'LexicalReranker', 'NoReranker', 'LexicalReranker', 'NoReranker']"),
    ("namespace", "[3, 'lodeseam_v3_repo']"),
)


@query(" UNION ALL ".join(f"SELECT {literal(n)} AS name, {literal(v)} AS value" for n, v in FACTS))
def driver_functions(spark, sf_dir):
    return spark.createDataFrame(_facts(work_folder(spark)), "name string, value string")
