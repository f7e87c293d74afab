"""WARC: round trips, revisits, predicates that headers decide, blocks that are passed over, files of others, odd tables."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from quillframe.llm import warc


def plain(rows):
    """page_id, bytes, digest, type, refers_to as the rule says."""
    data = [(k, (t or "").encode()) for k, _, t in rows]
    out = []
    for k, body in data:
        same = [j for j, other in data if other == body and j is not None]
        first = min(same, default=None) if len(body) >= 100 else None
        again = first is not None and (k is None or k > first)
        out.append((k, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


LONG = "<html>é " + "x" * 300
ROWS = [(5, "http://a.org/", LONG), (3, "http://a.org/b c\r\nWARC-Type: fake", LONG), (9, None, LONG), (None, "u", LONG), (None, None, None), (1, "http://b.org/", ""), (2, "", "x" * 99), (4, "é.org", "x" * 99), (6, "x", "y" * 100), (7, "x", "y" * 100), (7, "x", "y" * 100), (-8, "x", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 9), (10, "big", "z\n" * 400_000), (11, "big", "z\n" * 400_000), (12, "z", "\x00\r\n\r\n" * 60)]


@pytest.fixture(scope="module")
def pages(spark):
    warc.register(spark)
    return spark.createDataFrame([(*r, "a", "b") for r in ROWS], "page_id long, url string, html string, record_type string, payload string").repartition(3)


@pytest.mark.parametrize("compression, file_bytes", [("gzip", "300"), ("none", "268435456")])
def test_archives_read_back(spark, pages, tmp_path, compression, file_bytes):
    path = f"file://{tmp_path}/archive"
    got = warc.digests(pages, path, compression=compression, file_bytes=file_bytes, date="2024-01-01T00:00:00Z").collect()
    assert sorted(map(tuple, got), key=repr) == plain(ROWS)
    read = warc.records(spark, path)
    assert read.columns == spark.read.format("warc").load(path).columns == [x.split(" ")[0] for x in warc.SCHEMA.split(", ")]
    one = read.filter("record_id = '<urn:page:10>'").first()
    assert bytes(one.payload).decode() == ROWS[12][2] and one.date == "2024-01-01T00:00:00Z" and one.headers["content-type"] == one.content_type == "application/http;msgtype=response"
    urls = {r.record_id: r.target_uri for r in read.select("target_uri", "record_id").collect()}
    assert urls["<urn:page:3>"] == "http://a.org/b%20c%0D%0AWARC-Type:%20fake" and urls["<urn:page:9>"] is None and urls["<urn:page:4>"] == "é.org"
    # a second write adds, an overwrite replaces; nothing hidden stays
    warc.archive(pages.limit(1), path, compression=compression)
    assert read.count() == len(ROWS) + 1
    spark.createDataFrame([("resource", b"abc")], "record_type string, payload binary").write.format("warc").mode("overwrite").save(path)
    rest = spark.read.format("warc").load(path).collect()
    assert [(r.record_type, bytes(r.payload), r.payload_length) for r in rest] == [("resource", b"abc", 3)]
    assert all(x.name.startswith("part-") for x in (tmp_path / "archive").iterdir())


FILTERS = ["record_type = 'revisit'", "record_type in ('revisit', 'x')", "not record_type = 'revisit'", "target_uri like 'http://a%'", "target_uri like '%x'", "target_uri like '%.org%'", "target_uri is null", "target_uri is not null and not target_uri like 'http%'", "refers_to <=> null", "content_length > 1000", "content_length <= 1000 and record_type = 'response'", "record_type = 'response' or target_uri = 'x'", "headers['warc-type'] = 'revisit'", "payload_length = 100"]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_predicates_decide_alike_wherever_they_run(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/archive"
    warc.archive(pages, path, compression=compression)
    kept, again = spark.read.format("warc").load(path).cache(), warc.records(spark, path)
    for condition in FILTERS:
        fresh = again.filter(condition)
        key = lambda df: sorted(map(tuple, df.select("record_id", "record_type", "payload_length", F.sha2("payload", 256)).collect()))
        assert key(fresh) == key(kept.filter(condition)), condition
        assert again.count() == len(ROWS)  # a later query on the same DataFrame doesn't inherit filters
    kept.unpersist()
    plan = lambda c: again.filter(c)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan("record_type = 'revisit'") and "Filter (" in plan("payload_length = 100")


def test_unknown_is_not_true():
    test = warc.predicate(D.Not(D.EqualTo(("target_uri",), "x")))
    assert test({}) is None and test({"warc-target-uri": "y"}) is True and test({"warc-target-uri": "x"}) is False
    assert warc.predicate(D.EqualTo(("payload_length",), 3)) is None and warc.predicate(D.Not(D.EqualTo(("headers", "x"), 3))) is None


class Counting(io.BytesIO):
    """How many bytes are read."""

    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out

    def readline(self, n=-1):
        out = super().readline(n)
        self.got += len(out)
        return out


def test_blocks_that_nobody_wants_are_passed_over():
    import random

    noise = random.Random(1).randbytes(400_000)
    rows = [{"record_type": kind, "payload": noise} for kind in ("response", "revisit", "response", "metadata")]
    data = [warc.record(r, "2024-01-01T00:00:00Z") for r in rows]
    test = warc.predicate(D.EqualTo(("record_type",), "metadata"))
    every, some = warc._Skipping(["payload"], []), warc._Skipping(["payload"], [test])
    heads = warc._Skipping(["record_type", "headers"], [])
    for make, size in ((lambda own, f: warc._sequential(f, own, "x"), 0), (lambda own, f: warc._members(f, len(f.getvalue()), own, "x"), 1)):
        whole = b"".join(warc.member(d, 3) if size else d for d in data)
        counts = []
        for own in (every, some, heads):
            file = Counting(whole)
            found = list(make(own, file))
            counts.append((len(found), file.got))
        assert [n for n, _ in counts] == [4, 1, 4]
        assert counts[0][1] > 1_150_000 and counts[1][1] < 480_000 and counts[2][1] < 70_000


def test_files_that_others_wrote(spark, tmp_path):
    warc.register(spark)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Note: first\r\n  second\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    page = b"WARC/1.0\nwarc-type: response\nWARC-Target-URI: http://x/\nContent-Length: %d\n\n%s\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nbody\r\n\r\nmore"
    page = page % (len(body), body)
    (tmp_path / "a").mkdir()
    (tmp_path / "a/plain.warc").write_bytes(info + page)
    (tmp_path / "a/members.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))
    (tmp_path / "a/one.warc.gz").write_bytes(gzip.compress(info + page))
    (tmp_path / "a/_hidden.warc").write_bytes(b"not an archive")
    read = warc.records(spark, f"file://{tmp_path}/a")
    rows = read.collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"body\r\n\r\nmore"] * 3 + [b"hello"] * 3
    assert {r.headers.get("warc-note") for r in rows} == {None, "first second"}
    assert read.filter("record_type = 'response'").select("target_uri").distinct().collect()[0][0] == "http://x/"
    assert spark.read.format("warc").option("partition_bytes", 1).load(f"file://{tmp_path}/a").rdd.getNumPartitions() == 3


@pytest.mark.parametrize("data, name", [(b"<html>", "a.warc"), (b"WARC/1.1\r\nWARC-Type: x\r\n", "a.warc"), (b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", "a.warc"), (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", "a.warc"), (warc.member(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 3)[:-9], "a.warc.gz")])
def test_broken_files_are_errors(spark, tmp_path, data, name):
    warc.register(spark)
    (tmp_path / name).write_bytes(data)
    with pytest.raises(Exception, match=name):
        spark.read.format("warc").load(f"file://{tmp_path}/{name}").collect()


def test_an_empty_table_makes_an_empty_archive(spark, pages):
    assert warc.digests(pages.limit(0)).collect() == []
