import base64
import hashlib

import pytest

from orrery.llm import warc
from orrery.llm.common import Scratch

PAGES = [(5, "http://A.b.org/c d\n?q#f", "same"), (2, "https://a.b.org/x", "same"), (3, None, None), (4, "", ""), (9, "nohost", "é"), (None, "http://q.com", "same"), (11, "http://z.net:80/", "x" * 70_000), (5, "http://A.b.org/c d\n?q#f", "same")]


@pytest.fixture()
def written(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, file string").repartition(3)
    folder = Scratch(spark, "test").base
    return pages, folder, warc.write_index(warc.write_archives(pages, f"{folder}/a"), f"{folder}/i")


def test_round_trip_through_archives_and_index(written):
    pages, folder, index = written
    rows = warc.fetch(warc.look_up(pages, index, f"{folder}/i"), f"{folder}/a").collect()
    assert len(rows) == len(PAGES)
    first = {"same": 2, "": 3}
    for r in rows:
        html = next(h for p, _, h in PAGES if p == r.page_id) or ""
        assert r.payload_bytes == len(html.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        expected = first.get(html) if first.get(html) not in (None, r.page_id) else None
        assert r.refers_to == expected and r.record_type == ("revisit" if expected else "response")
        assert r.payload == (None if expected else html.encode())


def test_look_up_of_some_and_of_unknown_urls(spark, written):
    _, folder, index = written
    some = spark.createDataFrame([("https://a.b.org/x",), ("http://nowhere.example/",)], "url string")
    assert [r.page_id for r in warc.look_up(some, index, f"{folder}/i").collect()] == [2]


def test_small_blocks_and_repeated_keys(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.org/", str(k)) for k in range(60)], "page_id long, url string, html string")
    folder = Scratch(spark, "test").base
    index = warc.write_index(warc.write_archives(pages, f"{folder}/a"), f"{folder}/i")
    assert warc.look_up(pages, index, f"{folder}/i").count() == 60


def test_one_url_of_most_pages_and_long_payloads(spark):
    rows = [(k, "http://hot.org/", f"{k % 50} ") for k in range(13_000)] + [(13_000 + k, f"http://h{k}.org/", "long" * 1_000_000) for k in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = Scratch(spark, "test").base
    index = warc.write_index(warc.write_archives(pages, f"{folder}/a"), f"{folder}/i", 4)
    assert index.where("first_key <= 'org,hot)/' and last_key >= 'org,hot)/'").count() > 1
    found = warc.fetch(warc.look_up(pages, index, f"{folder}/i"), f"{folder}/a", payloads=False)
    assert found.select("page_id").distinct().count() == found.count() == len(rows)
    assert {r.payload_bytes for r in found.where("page_id >= 13000").collect()} == {4_000_000}


def test_empty_table_and_threshold(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = Scratch(spark, "test").base
    index = warc.write_index(warc.write_archives(pages.limit(0), f"{folder}/a"), f"{folder}/i")
    assert warc.look_up(pages, index, f"{folder}/i").count() == 0
    captures = warc.write_archives(pages, f"{folder}/b", min_bytes=1)
    assert {r.page_id for r in captures.where("record_type = 'response'").collect()} == {2, 3, 4, 9, 11}


def test_keys_and_damage():
    assert warc.url_key("http://User@A.b.org:8/p?x") == "org,b,a:8)/p?x" and warc.url_key(None) == ""
    data = warc.record(1, "http://a/", b"abc", warc.payload_digest(b"abc"), None)
    assert warc.parse(data)["payload"] == b"abc"
    ids = {warc.record(p, None, b"", "x", None).split(b"WARC-Record-ID: ")[1].split(b"\r")[0] for p in (1, 1, None, None)}
    assert len(ids) == 4
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"abc", b"abd"))
