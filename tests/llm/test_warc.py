import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from arborstream.llm import warc

PAGES = "page_id long, url string, html string, record_type int, first string"


def pages():
    long = "<p>é " + "x" * 1500
    rows = [(i, f"http://a.b/{i}", f"<p>{i}" + "y" * (i * 97 % 3000)) for i in range(40)]
    rows += [(100, "http://c/", long), (101, "http://d/\nx", long), (103, None, long), (104, "http://e/", "tiny"), (105, "http://e/", "tiny"), (106, "u", None), (107, "u", ""), (1, "again", rows[1][2])]
    rows += [(200, "http://big/", "z" * 3_000_000), (None, "http://n/", "<p>null id")]
    return [(*r, 1, "f") for r in rows]


def test_round_trip(spark):
    rows = pages()
    got = warc.archive_and_read(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    top = {}
    for i, b in payloads:
        if len(b) >= 1000 and i is not None:
            top[b] = max(i, top.get(b, i))
    want = []
    for i, b in payloads:
        again = b in top and i != top[b]
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_filters_and_payloads(spark, tmp_path, monkeypatch):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    warc.records(spark.createDataFrame(pages(), PAGES)).write.format("warc").mode("append").save(path)
    all_rows = spark.read.format("warc").load(path)
    assert all_rows.count() == len(pages())
    assert all_rows.where("record_type = 'revisit'").count() == 2
    assert all_rows.where("record_id in ('urn:page:1', 'urn:page:2')").count() == 3
    row = all_rows.where("record_id = 'urn:page:100'").first()
    assert row.refers_to == "urn:page:103" and row.payload is None and row.payload_length == 1506
    big = all_rows.where("record_id = 'urn:page:200'").first()
    assert bytes(big.payload) == b"z" * 3_000_000
    # pushed down: the reader itself leaves the rest out
    reader = warc.WarcReader(all_rows.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 5)]))
    assert len(rest) == 1
    decoded = []
    old = zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: Count(old(*a), decoded))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in rows} == {"revisit"}
    assert sum(decoded) < 1_500_000  # three million bytes of one payload were stepped over


class Count:
    def __init__(self, inner, log):
        self.inner, self.log = inner, log

    def decompress(self, *a):
        out = self.inner.decompress(*a)
        self.log.append(len(out))
        return out

    def __getattr__(self, name):
        return getattr(self.inner, name)


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


@pytest.mark.parametrize("kind", ["plain", "gzip", "own"])
def test_foreign_archives(kind):
    records = [warc.record_bytes("response", f"urn:x:{i}", f"http://h/{i}", hashlib.sha1(b"p" * i).hexdigest(), b"p" * i) for i in (0, 5, 70_000, 3)]
    pack = {"plain": lambda r: r, "gzip": gzip.compress, "own": warc.member}[kind]
    data = b"".join(map(pack, records))
    for every in (True, False):
        seen = []
        for fields, block in warc.Members(Source(data)):
            seen.append((fields["warc-record-id"], len(block()) if every else int(fields["content-length"])))
        assert seen == [(f"<urn:x:{i}>", i) for i in (0, 5, 70_000, 3)]
    if kind != "plain":
        assert gzip.decompress(data) == b"".join(records)


def test_digest_forms():
    h = hashlib.sha1(b"x").hexdigest()
    assert warc.digest_hex(warc.digest_field(h)) == h == warc.digest_hex("sha1:" + h.upper())
    assert warc.digest_hex("md5:00") is None and F
