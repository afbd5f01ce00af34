"""Line dedup, sharding, byte-level BPE, packing and SimHash against brute force, and on odd rows."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodeseam.llm import byte_bpe, line_dedup, packing, sharding, simhash_dedup
from lodeseam.llm.common import connected_components, gapless_numbers

from . import helpers

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.tiktoken")


def some_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "läuft", "alpha", "Beta,", "x1", "don't", "  ", "\n", "日本", "🙂"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_line_dedup_counts_by_host(spark):
    rows = [(i, f"menu \nbody {i}\n\nend {i}", "a") for i in range(20)] + [(100 + i, f"menu\nother {i}" if i == 0 else f"other {i}", "b") for i in range(30)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate_lines(helpers.docs(spark, rows), min_pages=3).collect()}
    assert out[3].text == "body 3\n\nend 3" and (out[3].n_lines, out[3].n_dropped) == (4, 1)
    assert out[100].text == "menu\nother 0"  # rare on its own host


def test_line_dedup_of_small_hosts_goes_by_the_ratio(spark):
    rows = [(k, f"own {k}\nshared" if k < 2 else f"own {k}", "small") for k in range(12)] + [(k, f"own {k}\nshared" if k < 102 else f"own {k}", "large") for k in range(100, 140)]
    out = {r.doc_id: r.text for r in line_dedup.drop_boilerplate_lines(helpers.docs(spark, rows)).collect()}
    assert out[0] == "own 0" and out[5] == "own 5"  # 2 of 12; a line of one document does not repeat
    assert line_dedup.drop_boilerplate_lines(helpers.docs(spark, [(k, "copy\nof all") for k in range(3)])).where("n_dropped = 0").count() == 3
    assert out[100] == "own 100\nshared"  # 2 of 40 are not more than a twentieth


def test_line_dedup_odd_rows(spark):
    out = line_dedup.drop_boilerplate_lines(helpers.wide(helpers.odd(spark)), ratio=0.1, min_pages=3).collect()
    assert len(out) == 11
    texts = {r.doc_id: r.text for r in out}
    assert texts[1] is None and texts[2] == "" and texts[6] == "same text here" and texts[9] == "a\r\nb\r\n\n"
    assert line_dedup.drop_boilerplate_lines(helpers.docs(spark, [])).count() == 0


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 7, -1, -(1 << 63), (1 << 63) - 1, *[random.Random(5).getrandbits(63) for _ in range(300)]]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 31):
        got = sharding.assign_shards(df, "k", n).collect()
        assert all((r.shard, r.grown_shard) == (jump(r.k, n), jump(r.k, n + 1)) for r in got)
        assert all(r.grown_shard in (r.shard, n) for r in got)


def test_sharding_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(some_texts(300))]
    folder = helpers.save(helpers.docs(spark, rows).unionByName(helpers.odd(spark)), tmp_path)
    got = sharding.op10_jump_shards(spark, folder).collect()
    assert len(got) == 311
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.shard == jump(r.doc_id or 0, 8) and r.grown_shard == jump(r.doc_id or 0, 9)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = dict(rows)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got if r.doc_id is not None and r.doc_id > 20)


def test_gapless_numbers_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id % 40) AS g", "1 AS x")
    got = Counter()
    for g, n in gapless_numbers(df, ["g"], "num", rows_per_block=100).select("g", "num").collect():
        got[g, n] += 1
    per = Counter(g for g, _ in got)
    assert set(got.values()) == {1} and all({n for h, n in got if h == g} == set(range(c)) for g, c in per.items())


def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_rank_encoder_and_comes_back(spark, tmp_path):
    known = reference()
    texts = [*some_texts(200), "", "a" * 5000, "\u0000\u0001", "<|endoftext|> x", "  \n\t  tail ", "▁meta▁", "é́" * 40]
    folder = helpers.save(helpers.docs(spark, list(enumerate(texts)) + [(9999, None)]), tmp_path)
    for r in byte_bpe.op8_byte_bpe(spark, folder).collect():
        text = texts[r.doc_id] if r.doc_id != 9999 else ""
        ids = known.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_round_trip_in_its_general_form(spark):
    df = helpers.odd(spark)
    ids = byte_bpe.encode_documents(helpers.wide(df), VOCABULARY, P.PATTERN)
    back = sorted(bytes(r["bytes"]) for r in byte_bpe.decode_documents(ids, VOCABULARY).collect())
    assert back == sorted((r.text or "").encode() for r in df.collect())


def test_bpe_forgets_and_stays_right():
    model = byte_bpe.serialise_model(byte_bpe.read_ranks(VOCABULARY))
    coder, known = byte_bpe.Coder(model, P.PATTERN, remembered=5), reference()
    for t in some_texts(100, seed=3):
        n, shown, back = coder.digests(t)
        assert shown.decode() == " ".join(map(str, known.encode_ordinary(t))) and back == t.encode() and n == len(known.encode_ordinary(t))
        assert coder.encode(t) == known.encode_ordinary(t)


def test_packing_query(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [*some_texts(150), "", "word " * 3000, None, *["the same one"] * 100, "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>\n"]
    folder = helpers.save(helpers.wide(helpers.docs(spark, list(enumerate(texts)))), tmp_path)
    got = packing.op4_best_fit_packing(spark, folder).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    by, placed = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        placed[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for i, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert len(by) == len(texts)
    for spans in placed.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert len(placed) <= -(-sum(map(len, ids.values())) // 1024) + 1


def test_pack_replaces_clashing_columns(spark):
    rows = spark.createDataFrame([(i, 1 + i % 7, "own", 5, 1) for i in range(40)], "id long, length long, sequence_id string, offset long, n int")
    out = packing.pack(rows, capacity=8)
    assert out.columns == ["id", "length", "n", "sequence_id", "offset"] and out.count() == 40
    assert packing.pack(rows.limit(0), capacity=8).count() == 0


@pytest.mark.parametrize("limit", [50, 10_000])
def test_plan_places_each_rank_once(limit):
    counts = np.bincount(np.random.default_rng(1).integers(1, 65, 900), minlength=65)
    rows = packing.plan(counts, 64, limit)
    seen = defaultdict(set)
    for size, r in rows.items():
        assert (np.diff(r[:, 0]) > 0).all() and r[0, 0] == 0
        for rank in range(counts[size]):
            at = np.searchsorted(r[:, 0], rank, "right") - 1
            spot = {(r[at, 1] + rank - r[at, 0], r[at, 2] + k) for k in range(size)}
            assert not spot & seen["all"] and r[at, 2] + size <= 64
            seen["all"] |= spot
    assert set(rows) == set(np.flatnonzero(counts))


def brute_simhash(text, words=3):
    import xxhash

    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    bits = 0
    for k in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(p, 42) >> k & 1 for p in parts) > len(parts):
            bits |= 1 << k
    return bits


def brute_components(values, distance):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_query(spark, tmp_path):
    rng = random.Random(2)
    base = some_texts(40, seed=7)
    texts = base + [t + " extra" * rng.randint(0, 2) for t in base * 3] + ["", None, " ", "one", "ONE", "two words"]
    folder = helpers.save(helpers.wide(helpers.docs(spark, list(enumerate(texts)))), tmp_path)
    got = {r.doc_id: r for r in simhash_dedup.op9_simhash_near_dedup(spark, folder).collect()}
    prints = [brute_simhash(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints, 2)


@pytest.mark.parametrize("small", [2, 24])
@pytest.mark.parametrize("distance", [1, 2])
def test_links_connect_what_brute_force_connects(spark, small, distance):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for _ in range(rng.randint(0, 4)):
                y ^= 1 << rng.randrange(64)
            values.add(y)
    values = sorted(values)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_dedup.fingerprint_links(nodes, distance, small).collect()]
    at = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert (a ^ b).bit_count() <= distance
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == brute_components(values, distance)


def test_simhash_odd_rows(spark):
    odd = helpers.wide(helpers.odd(spark))
    groups = simhash_dedup.near_duplicate_groups(odd).collect()
    assert len(groups) == 11 and {r.component_id for r in groups if r.doc_id in (1, 2, 3)} == {1}
    kept = simhash_dedup.drop_near_duplicates(odd, simhash_dedup.near_duplicate_groups(odd))
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 1), (True, 4), (True, 5), (True, 6), (True, 8), (True, 9)]
    rows = [(1, "some text of five words here"), (1, "quite another text than that one"), (2, "some text of five words here"), (None, "some text of five words here"), (None, "only without an id, this text"), (None, "only without an id, this text")]
    for groups in (simhash_dedup.near_duplicate_groups, simhash_dedup.similar_groups):  # texts that share an id are two documents, rows without one are documents
        docs = helpers.wide(helpers.docs(spark, rows))
        assert sorted((r.doc_id or 0, r.text) for r in simhash_dedup.drop_near_duplicates(docs, groups(docs)).collect()) == [(0, rows[4][1]), (1, rows[1][1]), (1, rows[0][1])]
    assert simhash_dedup.near_duplicate_groups(helpers.docs(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 180)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in root)


def jaccard(a, b, words=5):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if any(sets) else 1.0


def family(seed, edits, n=12, size=300):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(size)] = f"x{rng.randrange(3000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("small", [3, 24])
def test_similar_groups_find_near_copies_and_no_others(spark, small):
    texts = [t for seed in range(8) for t in family(seed, 3)] + [t for seed in range(20, 26) for t in family(seed, 60, 2)] + ["", None, "short", "SHORT"]
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(helpers.wide(helpers.docs(spark, list(enumerate(texts)))), small=small).collect()}
    assert len(got) == len(texts) and got[96 + 12] == got[96 + 13] == 108 and got[110] == got[111] == 110
    near = [(f * 12, f * 12 + k) for f in range(8) for k in range(1, 12) if jaccard(texts[f * 12], texts[f * 12 + k]) >= 0.85]
    assert len(near) > 80 and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    assert all(got[96 + i] == 96 + i for i in range(12))  # of similarity under 0.3
    assert all(c // 12 == i // 12 for i, c in got.items() if i < 96)
    assert simhash_dedup.similar_groups(helpers.docs(spark, [])).count() == 0
    assert simhash_dedup.differing_bits(1.0, 640) == 0 and 90 < simhash_dedup.differing_bits(0.8, 640) < 105


@pytest.mark.parametrize("small", [2, 8])
def test_similar_groups_are_the_components_at_the_stated_similarity(spark, small):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts = []
    for seed in range(4):  # crowded families whose copies differ in up to a quarter of the shingles, around the limit
        own = base[: 30 * seed] + [f"v{seed}_{k}" for k in range(120 - 30 * seed)]
        for _ in range(30):
            copy = list(own)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(120)] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    texts += [" ".join(base[k : k + 25]) for k in range(0, 90, 2)]  # 19 of 23 shingles are shared: chains
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash_dedup.similar_groups(helpers.docs(spark, list(enumerate(texts))), small=small).collect()}
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert 10 < len(set(got.values())) < len(texts) - 60


def test_packing_takes_added_tokens_as_the_file_does(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y", "<|endoftext |> <|ENDOFTEXT|>", "plain " * 1500 + "<|endoftext|>" * 40]
    got = packing.pieces(helpers.docs(spark, list(enumerate(texts))), P.path("byte_bpe_50k.json")).collect()
    ids = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert 50256 in ids[0] and {i: sum(r.length for r in got if r.doc_id == i) for i in range(5)} == dict(enumerate(map(len, ids)))
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in got)
