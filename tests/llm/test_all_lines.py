"""Lines of any length and script take part in line dedup."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import brute_components
from tests.llm.test_duplicates import edit_distance

from redtide.llm import components, lines, quality
from redtide.llm.shared import map_rows


def kept(spark, rows):
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r.doc_id: r.kept for r in got}


def test_short_lines_and_lines_without_spaces(spark):
    chinese = "这是一个没有空格的很长的句子每个文档里都有它所以应该只留下一次"
    rows = [(1, f"All rights reserved\n{chinese}\n---"), (2, f"all rights reserved!\nmore of it\n{chinese}\n---"), (3, "Top\n\nown line here"), (4, "top\n\nlast")]
    assert kept(spark, rows) == {1: rows[0][1], 2: "more of it\n---", 3: rows[2][1], 4: "\nlast"}


def test_words_put_in_front_of_long_lines(spark):
    base = " ".join(f"word{k}" for k in range(250))
    front = "a few odd bits put in at the very top of it "
    assert len(base) > 4 * lines.PIECE
    assert kept(spark, [(1, base), (2, front + base)]) == {1: base, 2: ""}
    pairs = [(base, front + base, True), (base, base[::-1], False), (base[:392], "x" * 43 + base[:392], True), (base[:392], "x" * 99 + base[:392], False)]
    df = spark.createDataFrame(pairs, "a string, b string, near boolean")
    assert df.where(lines.edit_similarity(F.col("a"), F.col("b")) == F.col("near")).count() == len(pairs)


@pytest.mark.parametrize("most", [lines.MOST_PAIRS, 0])
def test_no_link_of_equal_and_near_fingerprints_is_lost(spark, monkeypatch, most):
    """Lines unlike the representative of their fingerprint are linked with each other and with near fingerprints."""
    monkeypatch.setattr(lines, "MOST_PAIRS", most)
    rng, texts = random.Random(5), set()
    short = ["a", "of", "in", "the", "to", "be", "on", "it", "is", "as", "by", "up"]
    for group in range(10):
        long = [f"word{group}x{k}" for k in range(3)] * 4
        for _ in range(3):  # lines of one fingerprint, or nearly so, in distant forms
            form = rng.sample(long, 12) + rng.choices(short, k=20)
            texts |= {" ".join(form[: len(form) - k]) for k in range(3)} | {" ".join([*form, form[0]])}
    docs = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id bigint, text string")
    table = lines.line_table(docs)
    rows = {(r.h, r.g): r for r in table.collect()}
    near = [(a, b) for a in rows for b in rows if a < b and ((rows[a].fp ^ rows[b].fp) & ((1 << 64) - 1)).bit_count() <= lines.MOST_BITS]
    alike = [(a, b) for a, b in near if edit_distance(rows[a].line, rows[b].line, most := int(max(len(rows[a].line), len(rows[b].line)) * 0.2 + 1e-9)) <= most]
    want = brute_components(list(rows), alike)
    got = brute_components(list(rows), [(tuple(r.a), tuple(r.b)) for r in lines.fuzzy_links(table).collect()])
    assert len(near) > len(alike) > 50 and want == got


def test_a_settled_forest_takes_no_round(spark, monkeypatch):
    """Links found earlier go in as a forest; only new ones may cost rounds, each of which leaves files behind."""
    rounds = []
    monkeypatch.setattr(components, "checkpointed", lambda df: rounds.append(df) or df.localCheckpoint())
    forest = spark.createDataFrame([(k, k % 5) for k in range(5, 60)], "a bigint, b bigint")
    found = {r.node: r.root for r in components.components(forest, "a", "b").collect()}
    assert found == {k: k % 5 for k in range(5, 60)} and len(rounds) == 1
    more = forest.union(spark.createDataFrame([(9, 6), (7, 7)], "a bigint, b bigint"))
    found = {r.node: r.root for r in components.components(more, "a", "b").collect()}
    assert found == {4: 1, **{k: k % 5 if k % 5 < 4 else 1 for k in range(5, 60)}}


def test_tasks_hold_few_rows_of_a_batch_as_objects(spark):
    sizes = lambda batches: ((ids, [len(ids)] * len(ids)) for (ids,) in batches)
    got = map_rows(spark.range(0, 1000, 1, 1), sizes, "id bigint, n int", quality.AT_ONCE).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and max(r.n for r in got) <= quality.AT_ONCE < 1000


def test_counters_of_every_width_give_the_majority(spark):
    rng = random.Random(11)
    few = [[rng.getrandbits(64) for _ in range(n)] for n in (0, 1, 2, 7, 8, 14, 15, 16, 17, 62, 63, 64, 65, 254, 255, 256, 300)]
    few += [[x] * n for n in (15, 63, 255) for x in (0, (1 << 64) - 1, 1 << 63)]
    signed = [(k, [h - (1 << 64) if h >> 63 else h for h in hashes]) for k, hashes in enumerate(few)]
    df = spark.createDataFrame(signed, "k int, hashes array<bigint>")
    got = {r.k: r.fp % (1 << 64) for r in df.select("k", lines.simhash(F.col("hashes")).alias("fp")).collect()}
    assert got == {k: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) for k, hashes in enumerate(few)}


def test_distance_is_taken_where_lines_differ(spark):
    """The same distance without the words both lines start and end with, also if they repeat or one line holds the other."""
    rng, some = random.Random(3), [("a", "a"), ("a", "b"), ("a a a", "a a"), ("a b a", "a"), ("x ", "x"), ("a  b", "a b"), ("b a", "a"), ("", "a")]
    for _ in range(60):
        words = rng.choices(["a", "bb", "ccc", "dd"], k=rng.randrange(1, 12))
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randrange(2)] = rng.choices(["a", "bb", "e"], k=rng.randrange(3))
        some.append((" ".join(words), " ".join(other) or "a"))
    df = spark.createDataFrame(some, "a string, b string")
    for r in df.select("a", "b", lines.differing(F.col("a"), F.col("b")).alias("e"), lines.edit_similarity(F.col("a"), F.col("b")).alias("near")).collect():
        distance = edit_distance(r.a, r.b, 1000)
        assert edit_distance(r.e.x, r.e.y, 1000) == distance
        assert r.near == (distance <= int(max(len(r.a), len(r.b)) * 0.2 + 1e-9))
    long = " ".join(f"word{k}" for k in range(4000))
    front = spark.createDataFrame([(long, "put in front " + long)], "a string, b string").select(lines.differing(F.col("a"), F.col("b")).alias("e")).first().e
    assert (front.x, front.y) == ("", "put in front ")
