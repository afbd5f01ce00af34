"""Substring dedup against brute force over all windows."""

import hashlib
import random

import numpy as np
import pytest

from lodeseam.llm import substring_dedup as sub

from . import helpers


def brute(rows, k):
    """Kept words and number removed per row of (doc_id, text), in order."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    order = lambda i, p: (rows[i][0] is not None, rows[i][0] or 0, p)
    for i, w in enumerate(words):
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, order(i, p)), order(i, p))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < order(i, p):
                gone.update(range(p, p + k))
        out.append((b" ".join(x for j, x in enumerate(w) if j not in gone), len(gone), len(w)))
    return out


def corpus(seed, n=60, vocabulary=4000):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(rng.randint(5, 90))] for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            own = list(rng.choice(passages)) if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.3 and own:
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[rng.randrange(len(own)) :]
            parts += own
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    return texts + texts[:3] + ["a " * 100, "a " * 90, "b a " * 60]


def test_windows_and_paths():
    texts = [t.encode() for t in corpus(3)]
    x = sub.Windows(texts)
    assert x.counts.tolist() == [len(t.split()) for t in texts]
    seen = {}
    for h, w in zip(x.words.tolist(), [w for t in texts for w in t.split()], strict=True):
        assert seen.setdefault(h, w) == w
    paths = x.paths()
    covered = set()
    for t, p, n in zip(paths["text"].tolist(), paths["p"].tolist(), paths["n"].tolist(), strict=True):
        covered |= {(t, p + i) for i in range(n)}
    assert covered == {(i, p) for i, c in enumerate(x.counts.tolist()) for p in range(c - sub.WINDOW + 1)} and paths["n"].sum() == len(covered)
    by = {}
    for t, p, n, mz, c in zip(*(paths[k].tolist() for k in ("text", "p", "n", "mz", "c")), strict=True):
        own = tuple(texts[t].split()[p : p + n + sub.WINDOW - 1])
        assert by.setdefault((mz, c), own) == own
    alone = sub.Windows(texts[5:6]).paths()
    assert set(zip(alone["mz"].tolist(), alone["c"].tolist(), strict=True)) <= set(zip(paths["mz"].tolist(), paths["c"].tolist(), strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = list(enumerate(corpus(seed)))
    random.Random(seed).shuffle(rows)
    folder = helpers.save(helpers.wide(helpers.docs(spark, rows)), tmp_path)
    got = {r.doc_id: r for r in sub.op5_substring_dedup(spark, folder).collect()}
    assert len(got) == len(rows)
    for (i, _), (kept, gone, n) in zip(rows, brute(rows, 20), strict=True):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_runs_of_paths_are_compacted(spark):
    rng = random.Random(5)
    long = [f"u{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(long)), (2, "x " + " ".join(long)), (3, " ".join(long[:200] + ["other"] + long[200:]))]
    seen = sub._occurrences(sub._keyed(helpers.docs(spark, rows)).select("_ls_did", "_ls_th", "text"), 20, 5)
    first = sub.F.struct(sub.F.col("_ls_did").alias("did"), "p", sub.F.col("_ls_th").alias("th"))
    paths = seen.groupBy("mz", "c").agg(sub.F.min(first).alias("first"), sub.F.first("n").alias("n"), sub.F.count(sub.F.lit(1)).alias("times"), sub.F.min("next").alias("low"), sub.F.max("next").alias("high")).where("times > 1")
    runs = sub.compacted(paths).collect()
    assert paths.count() > 30 and len(runs) <= 6 and all(r.first.did == 1 for r in runs)  # before, over and behind the break
    assert sum(r.windows for r in runs) == paths.agg(sub.F.sum("n")).first()[0]
    spans = sub.merged_spans(sub.repeated_spans(sub._keyed(helpers.docs(spark, rows)))).where("_ls_did = 2").collect()
    assert [(r.start, r.end, r.s_did, r.s_start) for r in spans] == [(1, 401, 1, 0)]


def test_spans_of_other_words_stay(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40)))]
    keyed = sub._keyed(helpers.docs(spark, rows))
    wrong = spark.createDataFrame([(2, 0, 0, 30, 1, 0, 0)], "_ls_did long, _ls_th long, start long, end long, s_did long, s_th long, s_start long")
    (span,) = sub.source_digests(keyed, wrong).collect()
    assert sub._kept(rows[1][1].encode().split(), [span.asDict()]) == (rows[1][1].encode().split(), 0)
    assert sub._kept(rows[0][1].encode().split(), [span.asDict()])[1] == 30


def test_texts_of_the_general_form_and_small_parameters(spark, monkeypatch):
    monkeypatch.setattr(sub, "BROADCAST_IDS", 2)  # the way of many ids
    rows = [(1, "x a b c d e f g"), (2, "a b c d e f g y"), (3, "q\ta  b"), (4, None)]
    out = {r.doc_id: r.text for r in sub.drop_repeated_spans(helpers.wide(helpers.docs(spark, rows)), k=4, m=2).collect()}
    assert out == {1: "x a b c d e f g", 2: "y", 3: "q\ta  b", 4: None}


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(40))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None), (4, ""), (5, " "), (6, "word " * 25_000), (7, "same id " + long), (7, "other text of the same id"), (8, "é " + " é" * 50)]
    docs = helpers.wide(helpers.docs(spark, rows))
    out = sub.drop_repeated_spans(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    want = sorted((i or 0, kept.decode() if gone else t or "") for (i, t), (kept, gone, _) in zip(rows, brute(rows, 20), strict=True))
    assert got == want
    assert sub.drop_repeated_spans(helpers.docs(spark, [])).count() == 0


def test_minimizer_windows_of_any_width():
    words = [f"v{i}".encode() for i in range(50)]
    for k, m in ((2, 1), (7, 3), (20, 20)):
        p = sub.Windows([b" ".join(words)], k, m).paths()
        assert p["n"].sum() == 50 - k + 1 and np.all(p["n"] <= k - m + 1)
