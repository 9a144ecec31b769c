"""WARC records whose headers are longer than one step of the reader."""

import gzip
import io

import pytest

from redtide.llm import warc


def found(data):
    return list(warc.salvage(warc.Source(io.BytesIO(data))))


@pytest.mark.parametrize("n", [7_200, 200_000, *range(7_244, 7_252)])
def test_long_urls_are_read_back(n):
    records = [warc.record_bytes(k, "http://h/" + "語" * n + "x" * k, b"payload %d" % k, None) for k in range(3)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records))):
        got = found(data)
        assert [x[0] for x in got] == ["record"] * 3 and [x[4][-9:] for x in got] == [b"payload %d" % k for k in range(3)]
    assert found(records[0][: len(records[0]) // 2])[0][0] == "gap"


def test_round_trip_of_long_urls(spark):
    rows = [(1, "u" + "語" * 9_000, "<p>1</p>"), (2, "short", "<p>1</p>"), (3, "é" * 100_000, "<p>2</p>")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.kind, r.page_id, r.record_type) for r in got) == [("record", 1, "revisit"), ("record", 2, "response"), ("record", 3, "response")]
