"""The near-dedup stage of the pipeline takes candidates from SimHash fingerprints."""

import random

import corpus_pipeline
from lodeseam.llm import simhash_dedup

from . import helpers


def test_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for i in range(20):
        own = [f"w{rng.randrange(5000)}" for _ in range(400)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, "more"]))]
    found, near = [], simhash_dedup._near_prints
    monkeypatch.setattr(simhash_dedup, "_near_prints", lambda nodes: found.append(near(nodes)) or found[-1])
    # without prefixes only fingerprints give candidates
    monkeypatch.setattr(simhash_dedup, "_prefix", lambda shingles, *_: shingles[:0])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, helpers.docs(spark, rows), "").collect()}
    assert len(found) == 1 and found[0].count() >= 10 and {i for i, _ in rows if i % 2 == 0} <= kept and len(kept) <= 30
