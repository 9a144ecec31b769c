"""Ball-tree search, whitening and the line field against brute force."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import LONG

from redtide.llm import balltree, classifier, queries, whitening

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- ranked search


def brute_terms(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]


def brute_ranking(docs, items, top=20):
    counts = [(d, Counter(brute_terms(t))) for d, t in docs]
    sizes = [c.total() for _, c in counts]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, c), n in zip(counts, sizes):
            if n:
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                score = 0
                for t in brute_terms(text):
                    if c[t]:
                        w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                if score > 0:
                    scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return out


def keyed(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def test_ranking_against_brute_force(spark, awkward):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, "one end Same ROW"), (2, None), (3, ""), (4, "ß é 日本語 ÄÖÜ äÖÜ"), (5, LONG[:5000]), (5, "same id"), (6, "nowhere-to-be found"), (None, "the line that"), (7, "a a a last last"), (7, "a a a last last")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("rank", F.lit("clash"))
    for size in (balltree.QUERY_TEXT, 40):
        found = [tuple(r) for r in balltree.ranked_search(awkward, table, query_text=size).collect()]
        assert keyed(found) == keyed(brute_ranking(docs, dict.fromkeys(items)))


def test_ranking_of_the_tables_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = [tuple(r) for r in queries.QUERIES["op11_ranked_search"](spark, SF).collect()]
    assert sorted(found) == sorted(brute_ranking(docs, items))


def test_empty_tables_have_no_ranking(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert balltree.ranked_search(nothing, items).collect() == []
    assert balltree.ranked_search(awkward, items.limit(0)).collect() == []


def random_block(rng, rows, columns):
    cols = [np.sort(rng.choice(columns, rng.integers(1, 30), replace=False)) for _ in range(rows)]
    return cols, [rng.integers(1, 10**10, len(c)) for c in cols]


@pytest.mark.parametrize("rows", [1, 2, 15, 200])
def test_bounds_hold_for_every_row_of_a_ball(rows):
    rng = np.random.default_rng(rows)
    cols, values = random_block(rng, rows, 300)
    tree = balltree.Tree(cols, values, rng.integers(0, balltree.GROUPS, 300), leaf_rows=4)
    dense = np.zeros((rows, 300), np.int64)
    for k, (c, v) in enumerate(zip(cols, values)):
        dense[k, c] = v
    for _ in range(20):
        q = np.sort(rng.choice(len(tree.columns), min(len(tree.columns), 9), replace=False))
        counts = rng.integers(1, 4, len(q))
        bounds = tree.bounds([(q, counts)])[:, 0]
        exact = dense[:, tree.columns[q]] @ counts
        for (low, high), bound in zip(tree.ranges, bounds):
            assert exact[tree.order[low:high]].max() <= bound


def test_search_is_exact_and_leaves_subtrees_out():
    """Rows in tight clusters of their own terms: most balls can't hold one of the best."""
    rng = np.random.default_rng(7)
    cols, values = [], []
    for k in range(640):
        mine = 10 * (k % 64) + np.sort(rng.choice(10, 8, replace=False))
        cols.append(mine)
        values.append(rng.integers(9 * 10**8, 10**9, 8))
    ids = list(range(640))
    query = (np.arange(70, 78), np.ones(8, np.int64))
    exact = sorted(((-sum(v for c, v in zip(cs, vs) if 70 <= c < 78), i) for i, (cs, vs) in enumerate(zip(cols, values))))[:5]
    tree = balltree.Tree(cols, values, np.zeros(640, np.int64))
    best = balltree.Best(5)
    best.ids = ids
    local = (np.searchsorted(tree.columns, query[0]), query[1])
    scored = tree.search(local, tree.bounds([local])[:, 0], best)
    assert sorted((-score, ident) for score, _, _, ident in best.heap) == exact
    assert scored < sum(k is None for k in tree.kids) / 4


# ---------------------------------------------------------------- whitening


def brute_whitening(vectors, weights, k):
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    w = np.array(weights, float)
    n, sums = int(w.sum()), (x * np.array(weights)[:, None]).sum(0)
    d = x - sums / n
    values, axes = np.linalg.eigh((d * w[:, None]).T @ d / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x], d @ axes / np.sqrt(values), values / (d * d * w[:, None]).sum() * n


def close_but_for_signs(found, wanted):
    for a, b in zip(np.transpose(found), np.transpose(wanted)):
        assert np.allclose(a, b, atol=1e-9) or np.allclose(a, -b, atol=1e-9)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_against_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    distinct = rng.normal(size=(60, 5)) * [5, 4, 3, 2, 1]
    copies = [200, *[1 + k % 3 for k in range(59)]]  # one vector has most rows
    rows = [(i, list(map(float, v))) for i, v in enumerate(v for v, c in zip(distinct, copies) for _ in range(c))]
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [float("nan"), 1.0, 1.0, 1.0, 1.0]), (904, [float("inf")] * 5), (905, [1.0, 2.0])]
    odd += [(None, rows[7][1]), (8, rows[8][1])]  # a null id and a repeated row count
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(5)
    table = table.withColumns({c: F.lit(c) for c in ("digest", "key", "count", "component", "n", "_one")})
    got = whitening.whiten(table, components=3, weights=weights).collect()
    real = [(i, v) for i, v in rows + odd[-2:]]
    singles = [np.float32(v).astype(float) for _, v in real]
    if weights == "counts":
        n, deviation, wanted, explained = brute_whitening(singles, [1] * len(singles), 3)
    else:
        keys = [tuple(np.floor(1024 * v)) for v in singles]
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        order = sorted(set(first.values()))
        n, dev, white, explained = brute_whitening([singles[i] for i in order], [1] * len(order), 3)
        where = {keys[i]: at for at, i in enumerate(order)}
        deviation, wanted = [dev[where[k]] for k in keys], np.array([white[where[k]] for k in keys])
    assert len(got) == 3 * len(real)
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    found = [[by_id[i, k][0].whitened for k in (1, 2, 3)] for i, _ in real]
    close_but_for_signs(found, wanted)
    assert len(by_id[8, 1]) == 2 and {r.n for r in got} == {n}
    assert all(int(by_id[i, 1][0].deviation) == d for (i, _), d in zip(real, deviation))
    assert all(abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-9 for r in got)


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[2**40, -(2**41)], [3, 5]])
    n, sums = 10**9 + 7, [12345678901234567890 % 10**18, -(10**17) - 3]
    assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [None, []]])
def test_vectors_without_variance_give_no_rows(spark, vectors):
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    assert whitening.whiten(table).collect() == []


def test_a_flat_dimension_is_left_out(spark):
    table = spark.createDataFrame([(k, [float(k), 7.0]) for k in range(9)], "`an id` bigint, `a vector` array<double>")
    got = whitening.whiten(table, "an id", "a vector").collect()
    assert len(got) == 9 and {r.component for r in got} == {1}


def test_whitening_of_the_table(spark, sf):
    got = queries.QUERIES["op13_embedding_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, deviation, wanted, explained = brute_whitening([vectors[i] for i in ids], [1] * len(ids), 8)
    by = {(r.vec_id, r.component): r for r in got}
    close_but_for_signs([[by[i, k].whitened for k in range(1, 9)] for i in ids], wanted)
    assert [by[i, 1].deviation for i in ids] == deviation and by[ids[0], 1].n == n


# ---------------------------------------------------------------- line field


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    lengths = np.array([1, 4, 2, 6, 3])
    gain, moves = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2))
    ends = np.cumsum(lengths)
    for some, places in classifier.chain_batches(lengths):
        there = places >= 0
        on, pairs = classifier.forward_backward(np.where(there, gain[places], 0), there, moves)
        for row, chain in enumerate(some):
            g = gain[ends[chain] - lengths[chain] : ends[chain]]
            labellings = list(itertools.product((0, 1), repeat=len(g)))
            p = np.array([math.exp(sum(v for v, y in zip(g, ys) if y) + sum(moves[a, b] for a, b in zip(ys, ys[1:]))) for ys in labellings])
            p /= p.sum()
            for k in range(len(g)):
                assert on[row, k] == pytest.approx(sum(q for q, ys in zip(p, labellings) if ys[k]))
                for a, b in itertools.product((0, 1), repeat=2):
                    if k:
                        want = sum(q for q, ys in zip(p, labellings) if ys[k - 1] == a and ys[k] == b)
                        assert pairs[row, k - 1, a, b] == pytest.approx(want)


def test_features_look_at_both_neighbours():
    x, sizes = classifier.features("One line.\n\nA B C!!")
    own = 1 + len(classifier.OWN) + 1
    assert x.shape == (3, classifier.WIDTH) and list(sizes) == [10, 1, 8]
    assert (x[1, own : 2 * own - 1] == x[0, 1:own]).all() and (x[1, 2 * own - 1 :] == x[2, 1:own]).all()
    assert not x[0, own : 2 * own - 1].any() and not x[2, 2 * own - 1 :].any()


def test_scores_of_held_out_documents(spark, sf):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op12_quality_classifier"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


def test_labels_of_the_held_out_fold_change_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = classifier.fit_on(docs, labels), classifier.fit_on(docs, turned)
    assert (one.weights == other.weights).all() and one.slope == other.slope


def test_scores_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(4, 1), (10, 1), (13, 0), (12, 0), (12, 1), (7, None), (None, 0)], "doc_id bigint, quality int")
    model = classifier.fit_on(awkward.withColumn("score", F.lit("clash")), labels)
    got = classifier.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    empty = [r.score for r in got if r.doc_id in (1, 2, 3)]
    assert len(set(empty)) == 1
    assert classifier.score(nothing, model).collect() == []
    for labels in (labels.limit(0), labels.where("quality = 1")):
        plain = classifier.score(awkward, classifier.fit_on(awkward, labels)).collect()
        assert len({r.score for r in plain}) == 1 and plain[0].score >= 0.5


def test_a_batch_of_documents_scores_like_each_alone():
    rng = np.random.default_rng(9)
    model = classifier.Model(rng.normal(size=classifier.WIDTH), rng.normal(size=(2, 2)), 1.5, -0.2)
    made = [classifier.features(t) for t in ["", "a\nb\nc", LONG, "x | y\n\n\nz!!", "\n".join(f"line {k}" for k in range(300))]]
    lengths = np.array([len(s) for _, s in made])
    together = model.scores(np.vstack([x for x, _ in made]), np.concatenate([s for _, s in made]), lengths)
    for (x, sizes), want in zip(made, together):
        assert model.scores(x, sizes, np.array([len(sizes)]))[0] == pytest.approx(want)
