"""The pipeline against its operators' brute-force versions, stage by stage."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from lodeseam.llm import line_dedup

from . import helpers
from .test_rows import jaccard
from .test_substring import brute


def corpus(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(2, 7)))
    common = [word() for _ in range(500)]
    text = lambda n: " ".join(rng.choice(common) for _ in range(n))
    passage = text(30)
    rows, labels = [], []
    for i in range(240):
        body = [text(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            body.insert(0, "Read more on our site")
        if i % 7 == 0:
            body.append(passage)
        if i % 5 == 0:
            body.append(text(4) + " idiot " + text(3))
        if i % 11 == 0 and rows:
            body = [rows[-1][1]]
        rows.append((i, "\n".join(body), f"src{i % 4}"))
        if i % 2 == 0:
            labels.append((i, 1, int("idiot" in rows[-1][1])))
    docs = helpers.docs(spark, rows + [(900, None, "src0"), (901, "", "src1"), (902, "word " * 4000, None)])
    helpers.save(docs, folder)
    helpers.save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")
    return docs


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "line_dedup":
            assert line_dedup.MIN_PAGES == 2
        out[name] = (by_id(docs) if "piece" not in docs.columns else None, stage(spark, docs, str(tmp_path)).cache())
        docs = out[name][1]
        assert name == "best_fit_packing" or docs.columns == columns

    before, after = out["toxicity"][0], by_id(out["toxicity"][1])
    assert set(after) == {i for i, r in before.items() if "idiot" not in (r.text or "")}

    before, after = out["line_dedup"][0], by_id(out["line_dedup"][1])
    total = Counter(r.source for r in before.values())
    pages = Counter((r.source, x) for r in before.values() for x in set((r.text or "").split("\n")))
    for i, r in before.items():
        lines = (r.text or "").split("\n")
        keep = [x for x in (r.text or "").split("\n") if not x or not (pages[r.source, x] >= 2 and pages[r.source, x] > 0.05 * total[r.source])]
        keep = keep if any(keep) else lines
        assert after[i].text == (None if r.text is None else "\n".join(keep)) and after[i].n_chars == (None if r.text is None else len("\n".join(keep)))
    assert any("Read more" in (r.text or "") for r in before.values()) and not any("Read more" in (r.text or "") for r in after.values())

    before, after = out["simhash_near_dedup"][0], by_id(out["simhash_near_dedup"][1])
    ids = sorted(before)
    near = {i: min([j for j in ids if j < i and jaccard(before[i].text, before[j].text) >= 0.9], default=None) for i in ids}
    assert set(ids) - set(after) <= {i for i in ids if any(j < i and jaccard(before[i].text, before[j].text) >= 0.6 for j in ids)}  # clean ones stay
    assert sum(n is not None and i not in after for i, n in near.items()) >= 0.9 * sum(n is not None for n in near.values()) > 10

    before, after = out["substring_dedup"][0], by_id(out["substring_dedup"][1])
    ids = sorted(before)
    for i, (kept, gone, _) in zip(ids, brute([(i, before[i].text) for i in ids], 20), strict=True):
        assert after[i].text == (kept.decode() if gone else before[i].text)

    before, pieces = out["best_fit_packing"][0], out["best_fit_packing"][1].collect()
    assert {r.doc_id for r in pieces} == set(before)
    spans = defaultdict(list)
    for r in pieces:
        spans[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 1024 and sorted(s)[0][0] == 0 for s in spans.values())


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)


def test_line_dedup_with_many_digests(spark, monkeypatch):
    rows = [(i, f"menu\nbody {i}", "a" if i % 3 else None) for i in range(60)]
    want = sorted(map(tuple, line_dedup.drop_boilerplate_lines(helpers.docs(spark, rows)).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_DIGESTS", 0)
    assert sorted(map(tuple, line_dedup.drop_boilerplate_lines(helpers.docs(spark, rows)).collect())) == want and all("menu" not in r[1] for r in want)


def test_near_dedup_stage_at_its_similarity(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for i in range(60):  # pairs from 0.6 to 0.95
        own = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(own)
        for k in rng.sample(range(200), rng.randint(1, 7)):
            copy[k] = "changed"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(copy))]
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            want.add(2 * i + 1)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, helpers.docs(spark, rows), "").collect()}
    assert {i for i, _ in rows} - kept == want and 20 < len(want) < 50


def test_stages_take_clashing_columns_nulls_and_repeated_rows(spark, tmp_path):
    helpers.save(spark.createDataFrame([(1, 1, 0), (None, 1, 1), (6, 0, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = helpers.wide(helpers.odd(spark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns, name
    texts = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert [i for i, _ in texts] == [0, 1, 4, 5, 6, 8, 9]  # one of the blank ones, one of the three that are the same
    pieces = corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 4, 5, 6, 8, 9}
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
