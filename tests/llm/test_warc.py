import hashlib
import zlib

import pytest
from compare import connection, difference

from trajloom.llm import warc
from trajloom.llm.queries import ORACLES, QUERIES


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert difference(QUERIES["op9_warc"](spark, sf), connection(sf), ORACLES["op9_warc"]) is None


@pytest.fixture(scope="module")
def pages(spark):
    long, short = "<p>" + "same payload " * 30, "tiny"
    rows = [(5, "http://www.Example.org/a?b=1#c", long), (3, "https://example.org:443/a?b=1", long), (9, None, long), (9, None, long), (7, "", short), (8, "http://x.org:8080", short)]
    rows += [(None, "http://x.org/none", long), (1, "http://é.example/ü\r\nx: y", None), (2, "http://é.example/ü", ""), (4, "http://a.org/", "z" * 3_000_000), (6, "http://a.org/", "ä" * 50), (10, "ftp://u@a.org", "ä" * 50)]
    rows += [(100 + i, "http://hot.example/page", f"body {i} " * 20) for i in range(50)]
    return spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, offset long").repartition(4)


def expected(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        if page_id is not None and len(data) >= 100:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        own = first.get(data)
        repeats = own is not None and own != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if repeats else "response", own if repeats else None))
    return sorted(out, key=repr)


def test_odd_pages(spark, folder, pages):
    rows = QUERIES["op9_warc"](spark, folder(pages=pages)).collect()
    assert sorted(map(tuple, rows), key=repr) == expected(pages.collect())


def test_no_pages(spark, folder, pages):
    assert QUERIES["op9_warc"](spark, folder(pages=pages.limit(0))).collect() == []


def test_lookup_of_one_url(spark, pages, monkeypatch):
    index = warc.write_index(warc.write_archives(pages), lines=7)  # a hot URL over many blocks
    found = warc.lookup(index, "http://HOT.example/page")
    assert sorted(r[0] for r in found) == list(range(100, 150))
    assert sorted(r[0] for r in warc.lookup(index, "http://example.org/a?b=1")) == [3, 5]
    assert warc.lookup(index, "http://nowhere.example/") == []
    # All archives are plain WARC: members one after the other.
    for row in index.sparkSession.createDataFrame([(r["index"],) for r in index.collect()], "index string").collect():
        file = warc.IndexFile(row["index"])
        keys = [line[0] for i in range(len(file.directory)) for line in file.block(i)]
        assert keys == sorted(keys) and file.keys == [keys[i] for i in range(0, len(keys), 7)]
        file.close()


def test_url_keys():
    for url, key in (
        ("http://www.Example.com/A/b?c=D#e", "com,example)/A/b?c=D"), ("https://m.x.co.uk:444", "uk,co,x,m:444)/"), ("http://x.org:80/", "org,x)/"),
        (None, "-"), ("", "-"), ("http://u:p@h.net/p", "net,h)/p"), ("http://[::1]:8/x", "[::1]:8)/x"), ("x.org?q", "org,x)/?q"), ("nonsense here", "nonsense here)/"),
    ):
        assert warc.url_key(url) == key


def test_records():
    digest = hashlib.sha256(b"abc").hexdigest()
    packed = warc.record_bytes(4, "http://x/", b"abc", 3, digest, None)
    assert warc.record_row(packed) == (4, 3, digest, "response", None)
    assert warc.record_row(warc.record_bytes(5, "http://x/", b"abc", 3, digest, 4)) == (5, 3, digest, "revisit", 4)
    plain = bytearray(zlib.decompress(packed, 31))
    plain[plain.index(b"abc")] ^= 1
    packer = zlib.compressobj(wbits=31)
    with pytest.raises(ValueError):
        warc.record_row(packer.compress(bytes(plain)) + packer.flush())
