import base64
import hashlib

import pytest

from flowsieve.llm import warc
from flowsieve.session import written

PAGES = [
    (5, "http://www.b.com/x#top", "<p>same</p>"),
    (3, "https://a.org:8080/?q=1", "<p>same</p>"),
    (9, "http://www.b.com/x", "<p>same</p>"),
    (3, "http://a.org/again", "<p>same</p>"),
    (4, "http://c.net/%20a\n%0Ab", "ünï \r\n\r\n WARC/1.1"),
    (6, None, None),
    (7, "", ""),
    (None, "http://d.net", "<p>same</p>"),
    (8, "no url at all", "x" * 300_000),
    (10, "http://[broken", "y"),
]


def expected(pages):
    rows = []
    for page_id, url, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == payload and p is not None]
        first = min(same, default=None)
        revisit = page_id is not None and page_id > first
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = "revisit" if revisit else "response"
        rows.append((page_id, url, len(payload), digest, kind, first if revisit else None, None if revisit else payload))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def index(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return written(warc.build_index(warc.write_archives(pages), block_lines=2), "test-index")


def rows(df):
    return sorted(
        [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()], key=repr
    )


def test_round_trip(index):
    assert rows(warc.read_archives(index)) == expected(PAGES)


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = warc.read_archives(warc.build_index(warc.write_archives(pages, min_revisit_bytes=12)))
    assert {r.record_type for r in found.collect()} == {"response"}


@pytest.mark.parametrize("slice_rows", [1, 100])
def test_look_up_by_url(spark, index, slice_rows):
    urls = ["http://b.com/x", "http://a.org/again", "http://nowhere.com", "http://b.com/x"]
    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    found = rows(warc.look_up(index, asked, slice_rows))
    assert [r[0] for r in sorted(found, key=lambda r: r[0])] == [3, 5, 9]


@pytest.mark.parametrize("slice_rows", [1, 100])
def test_every_record_is_found_by_its_url(spark, index, slice_rows):
    asked = spark.createDataFrame([(u,) for _, u, _ in PAGES], "url string")
    assert rows(warc.look_up(index, asked, slice_rows)) == expected(PAGES)


def test_a_third_of_the_pages_have_one_url(spark):
    pages = [(i, "http://hot.com/" if i % 3 == 0 else f"http://h{i}.com/", f"page {i}") for i in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = written(warc.build_index(warc.write_archives(df), block_lines=20), "test-index")
    assert rows(warc.look_up(found, df.select("url"))) == expected(pages)
    assert len(warc.look_up(found, df.filter("page_id = 0").select("url")).collect()) == 200


def test_reading_is_spread_by_bytes(index, monkeypatch):
    total = sum(r.bytes for r in index.collect())
    monkeypatch.setattr(warc, "READ_BYTES", total // 4)
    assert warc.read_archives(index).rdd.getNumPartitions() >= 4


def test_addresses_have_a_scheme(spark):
    assert warc.full_address(spark, "/tmp/some where/x") == "file:///tmp/some where/x"
    assert warc.full_address(spark, "file:///tmp/x") == "file:///tmp/x"


def test_keys():
    assert warc.url_key("http://www.a.com/b?c#d") == "com,a)/b?c"
    assert warc.url_key(None) == ")"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.build_index(warc.write_archives(pages))).count() == 0
