"""The jobs over growing input, run again, with odd rows, and from the command line's options."""

import json
import logging

import pytest

from jobs import common, embedding_worklist, queries, quality_report
from lodeseam.constants import MAX_CHARS

from . import oracle

DOCS = "doc_id long, text string, n_chars long, source string"


def put(spark, folder, rows, name="documents"):
    frame = spark.createDataFrame([(i, t, len(t or ""), "s") for i, t in rows], DOCS)
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def listed(spark, folder):
    return sorted((r.key, r.text, r.n_chars, r.shard) for r in embedding_worklist.read_output(spark, f"{folder}/output").collect())


def work(spark, folder, **more):
    return embedding_worklist.run(spark, f"{folder}/documents.parquet", f"{folder}/output", f"{folder}/checkpoint", **more)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def long_text(k):
    return "\n".join(f"line {k} {i} " + "x" * 90 for i in range(200))


def test_worklist_takes_only_what_is_new(spark, folder):
    put(spark, folder, [(1, "first text"), (2, "first text"), (3, None), (4, " \n\t"), (5, long_text(5)), (None, "no id")])
    first = work(spark, folder, state_partitions=3)
    before = listed(spark, folder)
    assert first == {"batches": 1, "read": 6, "written": len(before)} and len(before) > 5
    assert [t for _, t, _, _ in before].count("first text") == 1 and all(s == f"x{k[0]}" and n == len(t) for k, t, n, s in before)
    assert work(spark, folder, state_partitions=3) == {"batches": 0, "read": 0, "written": 0} and listed(spark, folder) == before
    put(spark, folder, [(1, "first text"), (6, "no id"), (7, long_text(5)), (8, "new text password=hunter2hunter2")])
    second = work(spark, folder, state_partitions=3)
    after = listed(spark, folder)
    assert second["read"] == 4 and second["written"] == 1 == len(after) - len(before) and set(before) < set(after)
    (new,) = set(after) - set(before)
    assert "hunter2" not in new[1] and "[redacted]" in new[1]


def test_worklist_in_parts_equals_one_run(spark, folder):
    rows = [(k, f"text {k % 7}\n" + "y" * (MAX_CHARS if k % 3 else 5)) for k in range(40)]
    for part in range(4):
        put(spark, f"{folder}/parts", rows[part * 10 : part * 10 + 10])
        work(spark, f"{folder}/parts", max_files_per_trigger=1)
    put(spark, f"{folder}/whole", rows)
    work(spark, f"{folder}/whole")
    assert listed(spark, f"{folder}/parts") == listed(spark, f"{folder}/whole")


def test_worklist_goes_on_after_a_failed_run(spark, folder, monkeypatch):
    put(spark, folder, [(1, "good")])
    work(spark, folder)
    put(spark, folder, [(2, "later")])
    chunks = embedding_worklist.chunks
    from lodeseam.operators import chunking

    monkeypatch.setattr(embedding_worklist, "chunks", lambda files: chunking.chunks(files.selectExpr("path", "concat(text, raise_error(path)) AS text", "file_hash")))
    with pytest.raises(Exception, match="src/d2"):
        work(spark, folder)
    monkeypatch.setattr(embedding_worklist, "chunks", chunks)
    assert [t for _, t, _, _ in listed(spark, folder)] == ["good"]
    work(spark, folder)
    assert sorted(t for _, t, _, _ in listed(spark, folder)) == ["good", "later"]


def test_jobs_restore_settings_and_stop_streams(spark, folder):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions", "spark.sql.streaming.numRecentProgressUpdates")
    before = [spark.conf.get(n) for n in names]
    put(spark, folder, [(1, "text")])
    work(spark, folder, state_partitions="5")
    assert [spark.conf.get(n) for n in names] == before and not spark.streams.active


def report(spark, folder, label):
    return quality_report.run(spark, f"{folder}/documents.parquet", f"{folder}/questions.parquet", f"{folder}/output", label, "50")


def figures(spark, folder, label):
    return {(r.qid, r.metric): r.value for r in quality_report.read_output(spark, f"{folder}/output").where(f"run = '{label}'").collect()}


def test_report_by_label(spark, folder, caplog):
    passage = [f"question {k} asks for {'w' * k} and for words that stand in a document of its own and nowhere else {k}" for k in range(4)]
    spark.createDataFrame(list(enumerate(passage)) + [(9, None), (10, "short")], "item_id long, text string").write.parquet(f"{folder}/questions.parquet")
    put(spark, folder, [(1, passage[0]), (2, f"before {passage[1]} after"), (3, None), (4, ""), (5, "nothing of that kind"), (6, passage[1])])
    with caplog.at_level(logging.INFO, "jobs"):
        done = report(spark, folder, "one")
    assert "read 6 documents and 6 questions" in caplog.text and done["success"] == 1.0
    one = figures(spark, folder, "one")
    assert {q for q, _ in one} == {0, 1} and one[0, "mrr"] == 1.0 and len(one) == 8
    assert report(spark, folder, "one") == done and figures(spark, folder, "one") == one
    put(spark, folder, [(7, passage[2])])
    report(spark, folder, "two")
    assert figures(spark, folder, "one") == one and {q for q, _ in figures(spark, folder, "two")} == {0, 1, 2}


def test_report_without_answers_and_documents(spark, folder):
    spark.createDataFrame([(1, "a question that is long enough " * 4)], "item_id long, text string").write.parquet(f"{folder}/questions.parquet")
    put(spark, folder, [])
    done = report(spark, folder, "none")
    assert done == {"documents": 0, "questions": 1, "lines": 0} and figures(spark, folder, "none") == {}


def test_options(tmp_path, monkeypatch):
    from pyspark.sql import SparkSession

    seen = {}

    class Session:
        def stop(self):
            seen["stopped"] = True

    monkeypatch.setattr(SparkSession.Builder, "getOrCreate", lambda self: Session())
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"documents": "a", "output": "b", "label": "c"}))
    common.main(lambda spark, **options: seen.update(options) or {}, "quality_report", quality_report.OPTIONS, ["--config", str(file), "--output", "d"])
    assert seen == {"documents": "a", "output": "d", "label": "c", "stopped": True}
    for job in (embedding_worklist, quality_report):
        assert set(json.loads((oracle.Path(common.__file__).parent / f"{job.__name__.rpartition('.')[2]}.json").read_text())) == set(job.OPTIONS)
    file.write_text(json.dumps({"wrong": 1}))
    with pytest.raises(SystemExit):
        common.main(lambda spark: {}, "quality_report", quality_report.OPTIONS, ["--config", str(file)])


@pytest.mark.skipif(not oracle.DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_its_sql(spark, name):
    oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name])
