"""Near duplicates, lines, repeated substrings and fingerprints against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tests.llm.conftest import AWKWARD, brute_components

from redtide.llm import lines, simhash, substrings, suffixes, syncmers
from redtide.llm.components import components
from redtide.llm.sketch import Sketch, merged
from redtide.llm.shared import map_rows


def words_of(text):
    return regex.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def brute_simhash(features):
    hashes = [xxhash.xxh64_intdigest(f, 42) for f in features]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles(text, k):
    words = words_of(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).decode())
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    want = brute_components({x for e in edges for x in e}, edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert {x: found.get(x, x) for x in want} == want


@pytest.mark.parametrize("shingle,most,tile", [(3, 3, 8192), (3, 3, 4), (5, 7, 16)])
def test_near_duplicates_against_all_pairs(spark, docs, texts, monkeypatch, shingle, most, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    prints = {d: brute_simhash(shingles(t, shingle)) for d, t in texts.items()}
    ids = sorted(prints)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= most]
    want = brute_components(ids, linked)
    got = simhash.near_duplicates(docs, shingle=shingle, most=most).withColumn("hex", simhash.as_hex(F.col("fp"))).collect()
    assert {r.doc_id: (r.hex, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in ids}


def test_dense_clusters_and_hot_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 32)
    rng = np.random.default_rng(5)
    points = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    for centre in list(points)[:3]:
        for _ in range(150):
            x = centre
            for b in rng.integers(0, 63, rng.integers(1, 6)):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    arr = np.array(points, np.uint64)
    linked = [(points[i], points[j]) for i in range(len(points)) for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 3)]
    want = brute_components(points, linked)
    df = spark.createDataFrame([(p, 1) for p in points], "fp bigint, n_shingles bigint")
    found = {r.node.fp: r.root.fp for r in components(simhash.links(df, 3), "a", "b").collect()}
    assert {p: found.get(p, p) for p in points} == want


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    empty = {r.component_id for r in rows if r.doc_id in (1, 2, 3, 9)}
    assert empty == {1} and all(r.fp == 0 for r in rows if r.doc_id in (1, 2, 3, 9))
    assert simhash.near_duplicates(nothing).count() == 0


def test_sketch_never_undercounts(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 5000)
    values[:800] = values[800:1600]
    df = spark.createDataFrame([(int(v),) for v in values], "v bigint").repartition(5)

    def count(batches):
        sketch = Sketch(16)
        for (some,) in batches:
            sketch.add(np.asarray(some, np.uint64))
        yield list(zip(*sketch.rows()))

    found = merged(map_rows(df, count, "lane int, stripe int, counts binary"), 16)
    twice = np.array([v for v, n in Counter(values.tolist()).items() if n > 1], np.uint64)
    assert found(twice).all()
    assert found(np.array([v for v, n in Counter(values.tolist()).items() if n == 1], np.uint64)).mean() < 0.1


def brute_words(rows, window):
    split = [words_of(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [35, 9])
def test_repeated_words_against_brute_force(docs, awkward, nothing, window):
    for table in (docs, awkward):
        got = substrings.remove_repeats(table, window).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(rows_of(table), window)
    assert substrings.remove_repeats(nothing, window).count() == 0


@pytest.mark.parametrize("length,group", [(400, 16_384), (400, 3), (60, 5)])
def test_repeated_bytes_against_brute_force(docs, awkward, nothing, length, group):
    for table in (docs.where("length(text) < 20000"), awkward.where("text is null or length(text) < 2000")):
        got = suffixes.remove_repeats(table, length, min(32, length // 2), group).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows_of(table), length)
    assert suffixes.remove_repeats(nothing).count() == 0


def edit_distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[-1] + 1))
        before = now
    return before[-1]


def brute_lines(rows):
    """Per row: (id, n_lines, n_dropped, kept text)."""
    places, prints = defaultdict(list), {}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            words = [w for w in regex.split(r"[^\p{L}\p{N}]+", line.lower()) if w]
            if len(words) >= lines.LEAST_WORDS:
                key = " ".join(words)
                places[key].append((doc, i))
                long = [w for w in words if len(w.encode()) >= lines.LONG_WORD]
                prints[key] = brute_simhash(w.encode() for w in long or words)
                order[key] = signed(xxhash.xxh64_intdigest(key.encode(), 42))
    by_print = defaultdict(list)
    for key, fp in prints.items():
        by_print[fp].append(key)
    centre = {fp: min(keys, key=order.get) for fp, keys in by_print.items()}
    some = [(k, centre[fp]) for fp, keys in by_print.items() for k in keys if k != centre[fp]]
    fps = sorted(centre)
    some += [(centre[a], centre[b]) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= lines.MOST_BITS]
    pieces = lambda a, b: [(a[k : k + lines.PIECE], b[k : k + lines.PIECE]) for k in range(0, max(len(a), len(b)), lines.PIECE)]
    near = [(a, b) for a, b in some if sum(edit_distance(x, y, lines.PIECE) for x, y in pieces(a, b)) <= int(max(len(a), len(b)) * 0.2 + 1e-9)]
    group = brute_components(list(prints), near)
    first = {}
    for key, at in places.items():
        first[group[key]] = min([first.get(group[key], (1 << 62, 0)), *at])
    gone = {p for key, at in places.items() for p in at if p != first[group[key]]}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        out.append((doc, len(own), sum((doc, i) in gone for i in range(len(own))), "\n".join(x for i, x in enumerate(own) if (doc, i) not in gone)))
    return out, len(near)


def test_lines_against_brute_force(spark, docs):
    base = rows_of(docs.where("length(text) < 6000"))
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    made = [(10_000 + k, " ".join(words * 8 + [f"tail{k}"] * (k % 2)) + "\nshort line") for k in range(6)]
    rows = base + made
    want, n_near = brute_lines(rows)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == Counter(want)
    assert n_near > 0


def test_lines_of_awkward_rows(awkward, nothing):
    got = lines.dedup_lines(awkward).collect()
    assert len(got) == len(AWKWARD)
    twice = next(r for r in got if r.doc_id == 14)
    assert (twice.n_lines, twice.n_dropped, twice.kept) == (3, 1, "the line that is there twice in this text\nlast")
    assert lines.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("n", [1, 2, 63, 64, 26_383, 26_384])
def test_line_simhash_of_any_length(spark, n):
    text = " ".join(str(k) for k in range(n))
    df = spark.createDataFrame([(text,)], "t string").withColumn("f", lines.feature_hashes(lines.words_of(F.col("t"))))
    long = [w for w in text.split() if len(w) >= lines.LONG_WORD] or text.split()
    assert df.select(lines.simhash(F.col("f")).alias("fp")).first().fp % (1 << 64) == brute_simhash(w.encode() for w in long)


def brute_anchors(text):
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in words_of(text)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chained(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little"), seed)
        return seed

    if len(hashes) < syncmers.K:
        return {chained(hashes) & syncmers.LOW} if hashes else set()
    inner = [signed(chained(hashes[i : i + syncmers.S])) for i in range(len(hashes) - syncmers.S + 1)]
    n, out = syncmers.K - syncmers.S + 1, set()
    for i in range(len(inner) - n + 1):
        if min(inner[i : i + n]) in (inner[i], inner[i + n - 1]):
            out.add(chained(hashes[i : i + syncmers.K]) & syncmers.LOW)
    return out


def test_fingerprints_against_brute_force(spark, docs, awkward, nothing, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_A_BUCKET", 16)
    rows = sorted(rows_of(docs))
    got = {r.doc_id: r for r in syncmers.edited_likeness(docs).collect()}
    sketch = lambda text: sorted(brute_anchors(text))[: syncmers.SKETCH]
    as_text = lambda s: "".join(f"{h:08x}" for h in s)

    def likeness(a, b):
        both = sorted({*a, *b})[: syncmers.SKETCH]
        return len({*both} & {*a} & {*b}) / len(both) if both else 1.0

    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert (r.n_chars, r.edited) == (len(text), edited)
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(sketch(text)), as_text(sketch(edited)))
        assert r.near_edited == pytest.approx(likeness(sketch(text), sketch(edited)))
        assert r.near_next == pytest.approx(likeness(sketch(text), sketch(following)))
    assert len(syncmers.edited_likeness(awkward).collect()) == len(AWKWARD)
    assert syncmers.edited_likeness(nothing).count() == 0


def test_shared_passages_show_as_one_shift(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"a b c {passage} d e"), (2, f"x {passage} y z"), (3, "nothing of the kind in here at all")]
    found = syncmers.anchors(spark.createDataFrame(rows, "doc_id bigint, text string"))
    runs = syncmers.shared_runs(found, found).where("a_id < b_id").collect()
    assert [(r.a_id, r.b_id, r.shift) for r in runs] == [(1, 2, -2)] and runs[0].n_anchors > 10
