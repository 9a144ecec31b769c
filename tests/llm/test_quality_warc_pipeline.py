"""Quality rules, WARC archives, the pipeline and the registered queries."""

import gzip
import io
import random
from collections import Counter

import numpy as np
import pytest
import regex
from tests.llm.conftest import AWKWARD, LONG

import __spark_entry__ as entry
import corpus_pipeline
from redtide.llm import quality, queries, simhash, warc


def brute_counts(text):
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            marked |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_base_counts_against_brute_force(texts):
    for text in [*texts.values(), *(t for _, t in AWKWARD), "a b c d e a b c d e a b c d e x", "x\nx\n \n \n#\n#"]:
        assert quality.base_counts(text) == brute_counts(text)


def test_decoding_finds_the_best_labels():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7):
        field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, 3))
        gain = x @ field.weights

        def score(labels):
            return sum(g for g, y in zip(gain, labels) if y) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))

        every = [tuple(k >> i & 1 for i in range(n)) for k in range(1 << n)]
        assert score(field.decode(x)) == pytest.approx(max(map(score, every)))


def test_verdicts_on_held_out_labels(spark, sf, docs):
    """Trained on one half of the labels, judged on the other."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = quality.fit_on(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs, field).join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").collect()
    passing = [r for r in held if not r.base_failed]
    assert sum(r.kept == (r.quality == 1) for r in passing) >= 0.97 * len(passing)


def test_quality_of_awkward_rows(awkward, nothing):
    field = quality.fit([], [])
    got = quality.judge(awkward, field, extra=("kept_too",) if "kept_too" in awkward.columns else ()).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.judge(nothing, field).count() == 0


def archive(records):
    return b"".join(gzip.compress(r, 6) for r in records)


def found(data):
    return list(warc.salvage(warc.Source(io.BytesIO(data))))


def test_salvage_recovers_all_undamaged_records():
    rng = random.Random(7)
    records = [warc.record_bytes(k, f"http://x/{k}", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), None) for k in range(30)]
    members = [gzip.compress(r, 6) for r in records]
    places = np.cumsum([0, *map(len, members)])
    for trial in range(40):
        data, hurt = bytearray(b"".join(members)), set()
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(30)
            # the member's own bytes: not the six unused ones of its head
            data[rng.randrange(places[k] + 10, places[k + 1])] ^= 1 << rng.randrange(8)
            hurt.add(k)
        got = found(bytes(data))
        ids = {int(x[3]["warc-record-id"].strip("<>").rsplit(":", 1)[1]) for x in got if x[0] == "record"}
        assert ids >= set(range(30)) - hurt
        covered = sorted((x[1], x[1] + x[2]) for x in got)
        assert covered[0][0] == 0 and covered[-1][1] == len(data)
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    cut = found(b"".join(members)[:-5])
    assert len([x for x in cut if x[0] == "record"]) == 29 and cut[-1][0] == "gap"
    assert found(b"") == [] and found(b"nothing here")[0][:3] == ("gap", 0, 12)


def test_salvage_of_plain_archives():
    records = [warc.record_bytes(k, None, b"payload %d" % k, None) for k in range(4)]
    data = records[0] + records[1].replace(b"payload 1", b"pAyload 1") + b"noise" + records[2] + records[3]
    got = found(data)
    assert [x[0] for x in got] == ["record", "gap", "record", "record"]
    assert got[1][1:3] == (len(records[0]), len(records[1]) + 5)


def test_archives_of_pages(spark, sf):
    rows = [(k, f"http://h/{k}?é x", f"<p>{k % 5}</p>") for k in range(40)] + [(50, None, None), (51, "u", ""), (None, "u", "<p>0</p>"), (60, "u", LONG), (7, "again", "<p>2</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    largest = {}
    for k, _, h in rows:
        if k is not None:
            largest[h or ""] = max(largest.get(h or "", k), k)
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        top = largest.get(h or "")
        refers = top if k is not None and k < top else None
        want.append((k, len(data), warc.digest_of(data), "response" if refers is None else "revisit", refers))
    got = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(want)
    assert warc.round_trip(pages.limit(0)).count() == 0
    longer = warc.round_trip(pages, least_bytes=100).where("record_type = 'revisit'").count()
    assert longer == 0


def test_pipeline_stages_keep_the_columns(spark, sf, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        if name != "packing":
            assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
            from redtide.session import written

            after = written(after)
            bad = after.where("n_chars <> char_length(text)").count()
            assert bad == 0
        else:
            assert after.agg({"length": "sum"}).first()[0] >= before.count()
        before = after
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0


def test_pipeline_against_the_stages_on_their_own(spark, sf, docs):
    field = quality.fit_on(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(docs, field).where("kept").collect()}
    first = corpus_pipeline.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in first.collect()} == kept
    unique = corpus_pipeline.simhash_near_dedup(spark, first, sf)
    classes = {r.component_id for r in simhash.near_duplicates(first, shingle=5, most=7, least_ratio=0.8).collect()}
    assert {r.doc_id for r in unique.collect()} == classes
    done = corpus_pipeline.substring_dedup(spark, unique, sf)
    assert {r.doc_id for r in done.collect()} == classes


def test_stages_carry_columns_with_clashing_names(spark, sf, awkward):
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, awkward, sf)
        assert out.columns == awkward.columns
        for r in out.collect():
            assert r["kept"] == "value of kept" and r["extra_0"] == "value of extra_0"


def test_registered_queries(spark, sf):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14)) and "pipeline" in entry.queries()
    n_docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in names:
        df = queries.QUERIES[name](spark, sf)
        assert len(set(df.columns)) == len(df.columns)
        if name not in ("op1_packing", "op9_warc", "op11_ranked_search", "op13_embedding_whitening"):  # not a row a document
            assert df.count() == n_docs, name


def test_warc_oracle(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(queries.ORACLES["op9_warc"]).fetchall()
    got = queries.QUERIES["op9_warc"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_native_operators_run_no_python(spark, sf):
    for name in ("op4_line_dedup", "op6_document_fingerprints"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Pandas" not in plan and "Python" not in plan


