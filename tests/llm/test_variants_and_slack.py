"""Spelling variants against brute force, and packing by least slack against its rules."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from lodeseam.llm import slack_packing, spelling_variants
from lodeseam.llm.queries import QUERIES

from .helpers import docs, odd, save, wide


def near(a, b):
    """Whether exactly one code point is put in, taken out or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(counts):
    out = {}
    form = {}
    for w, n in counts.items():
        others = [(-counts[o], o) for o in counts if o != w and near(w, o)]
        best = min(others, default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
        out[w] = (n, len(others))
    root = {}
    for w in counts:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n, k, counts[form[w]] if form[w] else None) for w, (n, k) in out.items()}


def result(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    letters = list("aabcdé")
    words = {"".join(rng.choice(letters, rng.integers(5, 8))): int(rng.integers(3, 90)) for _ in range(400)}
    words |= {"abcde": 100, "abcd": 300, "xabcde": 40, "abcdex": 40, "abxcde": 10, "aaaaa": 7, "aaaaaa": 7, "àbcde": 3, "edcba": 9, "z" * 3000: 4, "z" * 3001: 8}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_variants.group_variants(frame).collect()
    assert len(got) == len(words) and {tuple(r) for r in got} == grouped(words)


def test_words_of_every_odd_text(spark, tmp_path):
    frame = wide(odd(spark).unionByName(docs(spark, [(k, "Étage étage lettre lettres LETTRE x1étagé\U0001f600letter") for k in range(20, 420)])))
    counts = Counter()
    for r in frame.collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        run = ""
        for c in [*text, " "]:
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    counts[run] += 1
                run = ""
    want = grouped({w: n for w, n in counts.items() if n >= 3})
    assert want and result(QUERIES["op11_spelling_variants"](spark, save(frame, tmp_path))) == want


def test_runs_across_slices(monkeypatch):
    text = "Alpha béta, gamma " * 50 + "x" * 300
    whole = spelling_variants.runs(text)
    monkeypatch.setattr(spelling_variants, "SLICE_BYTES", 7)
    assert spelling_variants.runs(text) == whole and whole[b"x" * 300] == 1 and whole["béta".encode()] == 50


def test_variants_of_no_documents(spark, tmp_path):
    folder = save(docs(spark, []), tmp_path)
    assert QUERIES["op11_spelling_variants"](spark, folder).collect() == [] == QUERIES["op12_slack_packing"](spark, folder).collect()


@pytest.mark.parametrize(("seed", "capacity", "n"), [(1, 16, 60), (2, 33, 200), (3, 2048, 500), (4, 7, 1), (5, 64, 2)])
def test_plan_places_everything(seed, capacity, n):
    counts = np.bincount(np.random.default_rng(seed).integers(1, capacity + 1, n), minlength=capacity + 1)
    parts, sequences = defaultdict(list), defaultdict(list)
    for lot in slack_packing.plan(counts, capacity):
        for k in range(lot.count):
            parts[lot.size, lot.first + k].append((lot.start, lot.length))
            sequences[lot.sequence + k].append((lot.offset, lot.length))
    assert len(parts) == n and all(whole(p) == size for (size, _), p in parts.items())
    filled = [whole(p) for p in sequences.values()]
    assert all(f == capacity or f & (f - 1) == 0 for f in filled) and sum(f < capacity for f in filled) < capacity.bit_length()


def whole(parts):
    """The length that the parts make, without gaps."""
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


def test_plan_of_many_documents_has_few_lots():
    counts = np.bincount(np.random.default_rng(0).integers(1, 513, 5000), minlength=513)
    few, many = (slack_packing.plan(counts * k, 512) for k in (1, 10**6))
    assert len(many) < 4 * len(few) and sum(lot.length * lot.count for lot in many) == int((counts * np.arange(513)).sum()) * 10**6


def test_closest_is_closest():
    rng = np.random.default_rng(7)
    for _ in range(200):
        counts = {int(s): int(rng.integers(1, 4)) for s in rng.integers(1, 30, 4)}
        most = int(rng.integers(0, 60))
        sums = {0}
        for s, n in counts.items():
            sums = {a + s * k for a in sums for k in range(n + 1)}
        used = slack_packing.closest(counts, most)
        assert all(counts[s] >= n for s, n in used.items()) and sum(s * n for s, n in used.items()) == max(x for x in sums if x <= most)


@pytest.mark.parametrize("table", ["odd", "even"])
def test_packing_of_documents(spark, tmp_path, table):
    from tokenizers import Tokenizer

    rows = odd(spark) if table == "odd" else docs(spark, [(k, "same words here again " * 400) for k in range(30)] + [(k, f"a <|endoftext|> b {k}") for k in range(30, 60)])
    got = QUERIES["op12_slack_packing"](spark, save(wide(rows), tmp_path)).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, parts = Counter(), Counter()
    for r in rows.collect():
        ids = np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id, hashlib.md5(ids.tobytes()).hexdigest()] += 1
        for p in {(g.start, g.length, g.ids_crc32) for g in got if g.doc_id == r.doc_id and g.doc_tokens == len(ids)}:
            assert zlib.crc32(ids[p[0] : p[0] + p[1]].tobytes()) == p[2]
        parts[r.doc_id, len(ids)] += len(ids)
    have = Counter()
    for g in got:
        have[g.doc_id, g.doc_tokens] += g.length
    assert have == parts
    sequences = defaultdict(list)
    for g in got:
        sequences[g.sequence_id].append((g.offset, g.length))
    filled = [whole(p) for p in sequences.values()]
    assert all(f == 2048 or f & (f - 1) == 0 and f < 2048 for f in filled)
    assert any(g.length < min(2048, g.doc_tokens - g.start) for g in got)  # something was cut, so its checksums were made anew
