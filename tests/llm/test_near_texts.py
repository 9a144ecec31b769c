"""Near duplicates of the pipeline against the true likeness of all pairs."""

import random

import numpy as np
from tests.llm.conftest import brute_components

import corpus_pipeline
from redtide.llm import likeness


def runs_of(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, base, changes):
    words = list(base)
    for k in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_near_texts_against_the_likeness_of_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for group in range(25):
        base = [f"w{group}x{k}" for k in range(rng.randrange(60, 500))]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(1, 1 + len(base) // 25))) for k in range(8)]
    sets = {d: runs_of(t) for d, t in rows}
    linked = [(a, b) for a in sets for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    near = [(a, b) for a in sets for b in range(a) if 0.6 < jaccard(sets[a], sets[b]) < 0.8]
    assert len(linked) > 50 and len(near) > 50
    want = {d for d, root in brute_components(sets, linked).items() if d == root}
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r.doc_id for r in got.collect()} == want


def test_keys_find_likeness_at_the_bound():
    rng = np.random.default_rng(8)
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(2))
        assert likeness.likeness(a.tobytes(), b.tobytes()) == 0.8 and set(likeness.band_keys(a)) & set(likeness.band_keys(b))


def test_null_and_repeated_ids_lose_no_text(spark):
    text = lambda name: " ".join(f"{name}{k}" for k in range(40))
    rows = [(None, text("a"), "x"), (None, text("b"), "x"), (7, text("c"), "x"), (7, text("d"), "x"), (7, text("d"), "x"), (8, text("d"), "y")]
    rows += [(9, text("e"), "x"), (5, text("e"), None), (None, text("e"), "x"), (10, None, "x"), (11, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()]
    want = [rows[0], rows[1], rows[2], rows[3], rows[7], rows[9]]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_fingerprints_propose_on_their_own(spark, monkeypatch):
    """Without any key, texts alike at most 3 bits apart are still found, and those apart or unlike are not."""
    monkeypatch.setattr(likeness, "band_keys", lambda runs: [])
    rng = random.Random(11)
    rows = []
    for group in range(8):
        base = [f"w{group}x{k}" for k in range(800)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join([*base[:-1], "other"])), (len(rows) + 2, edited(rng, base, 60))]
    sets = {d: likeness.run_set(t, 5) for d, t in rows}
    prints = {d: likeness.fingerprint_of(s) for d, s in sets.items()}
    near = [(a, b) for a in sets for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    linked = [(a, b) for a, b in near if likeness.likeness(sets[a].tobytes(), sets[b].tobytes()) >= 0.8]
    want = {d for d, root in brute_components(sets, linked).items() if d == root}
    got = corpus_pipeline.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert {r.doc_id for r in got.collect()} == want and 8 <= len(linked)
