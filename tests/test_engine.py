"""From a tree of files to hits: gates, differences, feeds, searches, streams."""

import json
import os
import subprocess
import time

import pytest

from lodeseam.cli import main
from lodeseam.config import Indexing, Settings
from lodeseam.engine import Engine, semantic_search
from lodeseam.errors import EmbedError
from lodeseam.functions.scalar import bpe_tokens, prepare_input
from lodeseam.operators import changes, evaluation, feeds
from lodeseam.operators.embedding import ProviderEmbedder
from lodeseam.operators.ranking import ScoringReranker
from lodeseam.plans.search import SearchOptions
from lodeseam.sources import git
from lodeseam.store import IndexStore
from lodeseam.streaming.watch import watch_commits, watch_tree

FILES = {
    "src/auth/session.ts": "export function createSession(user) {\n  return signToken(user)\n}\n",
    "src/util/csv.ts": "export function parseCsv(text) {\n  return text.split(',')\n}\n",
    "src/util/retry.ts": "export async function retry(times) {\n  await sleep(times)\n}\n",
    "docs/guide.md": "# Sessions\nHow login sessions and tokens work.\n# Retry\nBackoff rules.\n",
    "node_modules/junk/index.ts": "export const junk = 1\n",
    "bin.ts": "a\x00b",
}


@pytest.fixture
def root(tmp_path):
    for path, text in FILES.items():
        full = tmp_path / "repo" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(text)
    return tmp_path / "repo"


def engine(spark, root, **more):
    return Engine(spark, str(root), str(root.parent / "index"), Settings(dimensions=64, **more))


def paths(result):
    return [r.path for r in result.hits.orderBy("rank").collect()]


def test_index_search_change_delete(spark, root):
    e = engine(spark, root)
    assert e.search("anything").hits.count() == 0
    assert e.index_all() == {"changed": 4, "refreshed": 0, "deleted": 0}
    stats = e.stats().first()
    assert stats.files == 4 and stats.chunks == 5
    assert paths(e.hybrid("create session token"))[0] == "src/auth/session.ts"
    assert paths(e.semantic("parse csv text"))[0] == "src/util/csv.ts"
    assert e.index_all() == {"changed": 0, "refreshed": 0, "deleted": 0}

    os.utime(root / "src/util/csv.ts", (1, 1))
    assert e.index_all() == {"changed": 0, "refreshed": 1, "deleted": 0}
    (root / "src/util/csv.ts").write_text("\n\nexport function readTable(text) {\n  return text.split(';')\n}\n")
    (root / "src/util/retry.ts").unlink()
    assert e.index_all() == {"changed": 1, "refreshed": 0, "deleted": 1}
    rows = {r.path: r for r in e.store.rows().where("path = 'src/util/csv.ts'").collect()}
    assert rows["src/util/csv.ts"].symbol == "readTable" and e.stats().first().files == 3
    assert "src/util/retry.ts" not in paths(e.hybrid("retry sleep", limit=25))

    (root / "src/util/csv.ts").write_text("a\x00")
    assert e.reindex_paths(["src/util/csv.ts", "../outside.ts", "docs/none.md"]) == {"changed": 0, "refreshed": 0, "deleted": 1}
    (root / "new.py").write_text("def fresh():\n    pass\n")
    assert e.reindex_paths(["new.py"])["changed"] == 1 and paths(e.hybrid("fresh"))[0] == "new.py"
    assert paths(e.hybrid("fresh", language="python")) == ["new.py"] and set(paths(e.hybrid("sessions", source=("docs",)))) == {"docs/guide.md"}
    prefixed = paths(e.hybrid("session", path_prefix="./DOCS/", limit=2))
    assert prefixed[0] == "docs/guide.md" and paths(e.hybrid("session", path_prefix="docs", push_prefix=True)) == ["docs/guide.md"] * 2
    timed = e.hybrid("session")
    assert timed.took_ms is None and timed.rows() == timed.rows() and timed.took_ms > 0 and timed.reranked
    text = semantic_search(e, queries=["create session", "login"], limit=99, source=["code", "nonsense"])
    assert text.startswith('Results for "create session / login"') and "1. src/auth/session.ts:1-" in text
    assert semantic_search(e, query="  ").startswith("No indexed results")
    assert "hybrid, reranked; " in semantic_search(e, query="session", trailer=True).rsplit("\n", 1)[1] and "[0 hits: none; hybrid; " in semantic_search(e, query=" ", trailer=True)
    e.clear()
    assert e.store.state().version == 0


def test_broken_or_foreign_pointers_count_as_empty(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "n", "/a")
    row = [("1", "code", [1.0, 0.0], "text one", "p one", "p", "ts", "code")]
    schema = "id string, source string, vector array<float>, text string, path_text string, path string, language string, kind string"
    store.commit(spark.createDataFrame(row, schema))
    assert store.rows().count() == 1 and IndexStore(spark, str(tmp_path), "n", "/b").rows().count() == 0
    store.upsert(spark.createDataFrame([("1", "docs", [0.0, 1.0], "text two", "q", "q", "ts", "docs"), ("2", "code", [0.0, 1.0], "x", "r", "r", "ts", "code")], schema))
    assert sorted((r.id, r.text) for r in store.query().collect()) == [("1", "text two"), ("2", "x")]
    store.delete_files(["r"])
    store.replace_file("q", spark.createDataFrame([("9", "code", [0.0, 1.0], "new", "q", "q", "ts", "code")], schema))
    assert [r.id for r in store.query(["source", "Eq", "code"]).collect()] == ["9"]
    store.delete_ids(spark.createDataFrame([("9",)], "id string"))
    assert store.query().count() == 0
    (tmp_path / "n" / "CURRENT").write_text("{broken")
    assert store.state().version == 0


def test_segments_are_merged_and_old_ones_go(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "n")
    schema = "id string, source string, text string, path_text string, path string"
    for i in range(12):
        store.write(spark.createDataFrame([(f"{i % 5}", "code", f"alpha beta{i}", "p", f"f{i}")], schema), entries=spark.createDataFrame([(f"f{i % 3}", f"h{i}", [str(i)], i, 1.0)], "path string, file_hash string, chunk_ids array<string>, size long, mtime_ms double"))
    assert sorted((r.id, r.text) for r in store.rows().collect()) == [("0", "alpha beta10"), ("1", "alpha beta11"), ("2", "alpha beta7"), ("3", "alpha beta8"), ("4", "alpha beta9")]
    state = store.state()
    assert len(state.segments) < 5 and state.figures == {"rows": 5, "text": 10, "path_text": 5}
    assert store.entry("f1")["file_hash"] == "h10" and store.entry("none") is None and sorted(r.path for r in store.known_paths().collect()) == ["f0", "f1", "f2"]
    index = store.text_index("text")
    assert {r.term: r.n for r in index.postings.groupBy("term").count().withColumnRenamed("count", "n").collect()}["alpha"] == 5 and index.n == 5 and index.mean == 2.0
    store.merge()
    store.merge()
    assert len([p for p in (tmp_path / "n").iterdir() if p.name.startswith("s")]) == 2  # the segment, and the one that it replaced
    store.write(spark.createDataFrame([(f"x{i}", "docs", "gamma", "p", "g") for i in range(60)], schema))
    store.merge()
    store.write(spark.createDataFrame([("1", "code", "delta", "p", "g")], schema))
    store.delete_ids(spark.createDataFrame([("x0",), ("2",)], "id string"))
    first = store.state().segments[0]
    merged = store.merge()  # the small ones only
    assert merged.segments[0] == first and len(merged.segments) == 2 and merged.figures["rows"] == 63 == store.rows().count()
    assert {r.id for r in store.rows().where("text = 'delta' OR source = 'code'").collect()} == {"0", "1", "3", "4"}


def test_the_tree_itself_is_watched(spark, root, tmp_path):
    e = engine(spark, root)
    e.index_all()
    query = watch_tree(e, None, str(tmp_path / "checkpoint"))
    try:
        query.processAllAvailable()
        (root / "src/late.ts").write_text("export const late = 1\n")
        (root / "node_modules/junk/index.ts").write_text("export const other = 1\n")
        (root / "src/util/csv.ts").unlink()
        for _ in range(60):
            time.sleep(0.5)
            files = {r.path for r in e.store.manifest().collect()}
            if files == {"docs/guide.md", "src/auth/session.ts", "src/late.ts", "src/util/retry.ts"}:
                break
        assert files == {"docs/guide.md", "src/auth/session.ts", "src/late.ts", "src/util/retry.ts"}
    finally:
        query.stop()
    assert e.index_all() == {"changed": 0, "refreshed": 0, "deleted": 0} and spark.streams.active == []


def test_watching_stops_without_a_trace(spark, root, tmp_path):
    e = engine(spark, root)
    for i in range(20):
        query = watch_tree(e, None, str(tmp_path / f"checkpoint{i}"))
        assert query.isActive
        query.stop()
        assert not query.isActive and spark.streams.active == []


def test_a_reconcile_in_several_writes(spark, root, monkeypatch):
    monkeypatch.setattr("lodeseam.engine.WRITE_FILES", 1)
    monkeypatch.setattr("lodeseam.engine.READ_BYTES", 10)
    e = engine(spark, root)
    assert e.index_all()["changed"] == 4 and e.stats().first().chunks == 5 and e.store.rows().count() == 5
    assert e.index_all() == {"changed": 0, "refreshed": 0, "deleted": 0}


def test_settings_of_a_trusted_root(spark, root):
    (root / ".lodeseam.json").write_text(json.dumps({"dimensions": 32}))
    assert Engine(spark, str(root), str(root.parent / "i")).embedder.dimensions == 256
    assert Engine(spark, str(root), str(root.parent / "i"), trusted=True).embedder.dimensions == 32


def test_provider_embedder():
    sleeps = {"n": 0}

    def post(texts):
        sleeps["n"] += 1
        if sleeps["n"] == 1:
            return {"error": {"code": 429}}
        return {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(texts)))]}

    assert ProviderEmbedder(post, 2, wait_s=0).embed(["a", "b"]).tolist() == [[0.0, 1.0], [1.0, 1.0]] and sleeps["n"] == 2
    for answer in ({"error": {"code": 400}}, {"data": [{"index": 0, "embedding": [1.0, 2.0]}]}, {"data": [{"index": 0, "embedding": [1.0]}, {"index": 1, "embedding": [1.0]}]}, {}):
        with pytest.raises(EmbedError):
            ProviderEmbedder(lambda texts, a=answer: a, 2, wait_s=0).embed(["a", "b"])

    def down(texts):
        raise ConnectionError("down")

    with pytest.raises(EmbedError):
        ProviderEmbedder(down, 2, wait_s=0).embed(["a"])


def test_scoring_reranker_never_fails():
    slow = ScoringReranker(lambda q, d: time.sleep(0.5) or [1.0] * len(d), timeout_s=0.05)
    assert slow.scores("q", ["a", "b"]) is None
    assert ScoringReranker(lambda q, d: [1.0]).scores("q", ["a", "b"]) is None
    assert ScoringReranker(lambda q, d: [len(x) for x in d]).scores("q", ["a", "bb"]) == [1.0, 2.0]


def test_sessions_with_broken_bytes_and_times(spark, tmp_path):
    from lodeseam.sources.sessions import session_files

    for name, data, at in (("a [1].jsonl", b'{"id": 1}\n\xff\xfe broken \xc3', 1_700_000_000), ("b.jsonl", "späť".encode(), 1_700_000_100), ("c.txt", b"x", 1_700_000_200)):
        (tmp_path / name).write_bytes(data)
        os.utime(tmp_path / name, (at, at))
    read = lambda **options: {r.file.rsplit("/", 1)[1]: r.content for r in session_files(spark, str(tmp_path), **options).collect()}
    assert read()["a [1].jsonl"].startswith('{"id": 1}\n\ufffd') and read()["b.jsonl"] == "späť" and len(read()) == 2
    assert list(read(since_ms=1_700_000_000_000)) == ["b.jsonl"] == list(read(most=1)) and read(since_ms=1_700_000_100_000) == {}


def test_cut_git_output_is_read_by_halves_or_an_error(tmp_path, monkeypatch):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for k in range(7):
        (tmp_path / f"f{k}").write_text("x")
        run("add", ".")
        run("commit", "-qm", f"commit {k} " + "w" * 200)
    reader = git.LogReader({"path": str(tmp_path)})
    logs = lambda: "\n".join(log for part in reader.partitions() for (log,) in reader.read(part))
    whole = logs()
    monkeypatch.setattr(git, "MOST_OUTPUT", 900)
    assert git.git(str(tmp_path), "log")[1] is False
    assert [x.split("\x1f")[3] for x in logs().split("\x1e")[1:]] == [x.split("\x1f")[3] for x in whole.split("\x1e")[1:]]
    monkeypatch.setattr(git, "MOST_OUTPUT", 50)
    with pytest.raises(RuntimeError):
        logs()


def test_inputs_cut_by_a_public_vocabulary():
    tokenizers = pytest.importorskip("public_tokenizers")
    tokens = bpe_tokens(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    import tiktoken  # noqa: F401

    cut = prepare_input("one two three four five", 3, tokens)
    assert (cut.text, cut.tokens, cut.truncated) == ("one two three", 3, True)
    assert prepare_input("\U0001f600" * 20, 7, tokens).text in {"\U0001f600" * n for n in range(8)} and not prepare_input("x", 3, tokens).truncated


def commit(root, message):
    env = {**os.environ, "GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "a@x"}
    subprocess.run(["git", "-C", str(root), "add", "-A"], check=True, env=env)
    subprocess.run(["git", "-C", str(root), "commit", "-qm", message], check=True, env=env)


def test_commits_and_history(spark, root, tmp_path):
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    commit(root, "Add session signing\n\nbecause cookies were unsafe")
    e = engine(spark, root)
    assert e.sync()["commits"] == 1 and e.index_commits() == 0
    (root / "src/util/csv.ts").write_text("export function parseCsv(t) {\n  return t\n}\n")
    commit(root, "Simplify the csv parser")
    assert e.index_commits() == 1
    rows = sorted((r.path_text, r.author, r.kind) for r in e.store.rows().where("source = 'history'").collect())
    assert rows[1] == ("Simplify the csv parser src/util/csv.ts", "Ann", "commit")
    assert "history" in {r.source for r in e.hybrid("why did we change the csv parser").hits.collect()}
    assert "Simplify the csv parser" in e.file_history("@src/util/csv.ts", limit=1) and "lines 1-2" in e.file_history("src/util/csv.ts", "1-2")
    subprocess.run(["git", "-C", str(root), "checkout", "-q", "--orphan", "other"], check=True)
    commit(root, "Rewritten")
    assert e.index_commits() == 1 and e.store.rows().where("source = 'history'").count() == 1
    assert git.file_history(str(tmp_path), "x").startswith("This folder is in no") and e.file_history("none.ts").startswith("No history")
    query = watch_commits(e, str(root / ".git" / "logs"), str(tmp_path / "ck"), once=True)
    query.awaitTermination()


def test_conversations(spark, root, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    entry = lambda role, content: json.dumps({"type": "message", "message": {"role": role, "content": content}})
    lines = [json.dumps({"id": "s-1", "cwd": str(root), "timestamp": "2024-01-02T00:00:00Z"}), entry("user", "first question"), entry("user", [{"type": "text", "text": "how to store token = abc"}, {"type": "image"}]), "{broken", entry("toolResult", "x"),
             entry("assistant", [{"type": "text", "text": "Use the vault for it."}]), entry("assistant", "not paired at all"), entry("user", "short"), entry("assistant", "long enough answer")]
    (folder / "a.jsonl").write_text("\n".join(lines))
    (folder / "b.jsonl").write_text(json.dumps({"id": "s-2", "cwd": "/elsewhere"}) + "\n" + entry("user", "another question") + "\n" + entry("assistant", "another answer"))
    on = engine(spark, root, indexing=Indexing(conversations=True))
    assert on.index_conversations(str(folder), int(time.time() * 1000) + 5000) == 1
    (row,) = on.store.rows().collect()
    assert row.path == "session:s-1#0" and row.text == "User: how to store [redacted]\n\nAssistant: Use the vault for it." and row.ts == 1704153600 and "abc" not in row.path_text
    assert on.index_conversations(str(folder), 1) == 0
    off = Engine(spark, str(root), str(root.parent / "index"), Settings(dimensions=64))
    assert off.index_conversations(str(folder), 1) == 0 and off.store.rows().count() == 0


def test_pairing_of_the_last_answer(spark):
    rows = [("s", i, r, t * 10) for i, (r, t) in enumerate([("user", "q"), ("assistant", ""), ("assistant", "a"), ("assistant", "b"), ("user", "r"), ("system", "z"), ("assistant", "c")])]
    df = spark.createDataFrame(rows, "session_id string, turn int, role string, text string")
    assert [(r["index"], r.user[0], r.assistant[0]) for r in feeds.pair_turns(df).collect()] == [(0, "r", "c")]
    assert sorted((r["index"], r.user[0], r.assistant[0]) for r in feeds.pair_turns(df, last_answer=True).collect()) == [(0, "q", "b"), (1, "r", "c")]


def test_commit_records(spark):
    files = "\n".join(f"f{i}" for i in [*range(45), 1])
    log = "\x1eabc \x1fAnn\x1f12\x1fSubject\x1fBody\nmore\x1f" + files + "\x1e\x1fx\x1f1\x1fs\x1fb\x1f\x1eshort\x1fx\x1e \n"
    (r,) = feeds.parse_commits(spark.createDataFrame([(log,)], "log string")).collect()
    assert (r.sha, r.committed_at, r.body, len(r.paths)) == ("abc", 12, "Body\nmore", 40)
    assert feeds.commit_rows(feeds.parse_commits(spark.createDataFrame([("\x1ea\x1fb\x1fx\x1fs\x1f\x1f",)], "log string"))).first().text == "s"


def test_watching_equals_a_full_index(spark, root, tmp_path):
    e = engine(spark, root)
    e.index_all()
    (root / "src/late.ts").write_text("export const late = 1\n")
    (root / "src/util/csv.ts").unlink()
    feed = tmp_path / "feed"
    feed.mkdir()
    for i, p in enumerate(["src/late.ts", "src/util/csv.ts", "node_modules/junk/index.ts", "src/late.ts"]):
        (feed / f"{i}.json").write_text(json.dumps({"path": p, "deleted": False, "at_ms": i}))
    for _ in range(2):
        query = watch_tree(e, str(feed), str(tmp_path / "checkpoint"), once=True)
        query.awaitTermination()
    files = sorted(r.path for r in e.store.manifest().collect())
    assert files == ["docs/guide.md", "src/auth/session.ts", "src/late.ts", "src/util/retry.ts"] and spark.streams.active == []
    assert e.index_all() == {"changed": 0, "refreshed": 0, "deleted": 0}


def test_command_line(spark, root, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(root.parent))
    base = ["--root", str(root), "--base", str(root.parent / "cli")]
    assert main([*base, "index"], spark) == 0
    assert main([*base, "search", "create", "session", "--json", "--limit", "1"], spark) == 0
    out = capsys.readouterr().out
    assert '"path": "src/auth/session.ts"' in out
    assert main([*base, "clear"], spark) == 2 and main([*base, "status"], spark) == 0 and main([*base, "config"], spark) == 0 and main([*base, "clear", "--force"], spark) == 0


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("r", "z", 1), ("s", "y", 0)], "qid string, did string, grade int")
    run = spark.createDataFrame([("q", "x", 1, 0.9), ("q", "b", 2, 0.8), ("t", "a", 1, 1.0)], "qid string, did string, rank int, score double")
    got = {r.qid: r for r in evaluation.per_query(run, qrels).collect()}
    assert abs(got["q"].ndcg - (1 / 1.584962500721156) / (3 + 1 / 1.584962500721156)) < 1e-9 and got["q"].recall == 0.5 and got["q"].mrr == 0.5 and got["q"].success == 1
    assert (got["r"].ndcg, got["r"].mrr, got["s"].recall) == (0, 0, 0) and set(got) == {"q", "r", "s"}
    assert evaluation.success_at(run, qrels).first().success_at_3 == 0.33333
    assert evaluation.trec_run(run).orderBy("value").first().value == "q Q0 b 2 0.800000 lodeseam"
    values = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0), ("b", None)], "k string, v double")
    assert {r.k: (r.p50, r.p95) for r in evaluation.percentiles(values, "v", ["k"]).collect()} == {"a": (5.0, 9.0), "b": (1.0, 1.0)}
    import random

    rng = random.Random(1)
    rows = [(k, round(rng.gauss(0, 1), 3 if k == "b" else 9)) for k, n in (("a", 60_000), ("b", 40_001), ("c", 7)) for _ in range(n)]
    found = {r.k: (r.n, r.p50, r.p95, r.p99) for r in evaluation.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    for key in "abc":
        own = sorted(v for k, v in rows if k == key)
        assert found[key] == (len(own), *(own[min(len(own) - 1, len(own) * p // 100)] for p in (50, 95, 99)))


def test_cache_split(spark):
    texts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "id string, text string")
    import hashlib

    cache = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(), [1.0, 2.0]), (hashlib.sha256(b"b").hexdigest(), [1.0])], "key string, vector array<float>")
    hits, misses = changes.split_cached(texts, cache, 2)
    assert [r.id for r in hits.collect()] == ["1"] and [r.text for r in misses.collect()] == ["b"]
    assert SearchOptions().rerank
