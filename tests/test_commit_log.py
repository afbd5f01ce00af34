"""Commit logs hold any message: nulls, blanks and the log's own separators."""

import subprocess

from lodeseam.operators import feeds
from lodeseam.queries import ORACLES, QUERIES
from lodeseam.sources import git

from . import oracle

ODD = ("plain text", None, "", " \n\t ", "a\x1fb c", "a\x1eb c", "\x1f" * 6, "\x1e", "\x10 \x10r \x10dr\x10", " " * 45 + "late", "\x1e\x1f" * 900 + " z")


def test_commit_rows_of_odd_documents_equal_the_sql(spark, monkeypatch, tmp_path):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(ODD) for lang in [(" en ", None, "\tde")[i % 3]]]
    rows += [(r[0] + 10_000_000, r[1], "en", "s", r[4]) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(oracle, "DATA", tmp_path)
    monkeypatch.setattr(oracle, "TABLES", [])
    oracle.compare(spark, QUERIES["commit_rows"], ORACLES["commit_rows"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')"))


def test_messages_with_separators_stay_whole(spark, tmp_path):
    run = lambda *a, **b: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=b", *a], check=True, **b)
    run("init", "-q")
    bodies = ["one\x1ftwo\x1ethree", "\x10r\x10", ""]
    for i, body in enumerate(bodies):
        (tmp_path / f"f{i}.ts").write_text(str(i))
        run("add", ".")
        run("commit", "-q", "-F", "-", input=f"S\x1f{i}\n\n{body}\n".encode())
    got = sorted((r.subject, r.body, tuple(r.paths), len(r.sha)) for r in feeds.parse_commits(git.log(spark, str(tmp_path))).collect())
    assert got == [(f"S\x1f{i}", body, (f"f{i}.ts",), 40) for i, body in enumerate(bodies)]
