import base64
import gzip
import hashlib
import io
import zlib

import pytest

from quarry.llm import files, warc
from quarry.llm.warc import ArchiveError, archive, broken_revisits, read_records, record, round_trip


def brute(rows, least=0):
    top = {}
    for i, html in rows:
        if i is not None:
            top[html or ""] = max(top.get(html or "", i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        first = top.get(html or "")
        revisit = len(data) >= least and first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x", "<p>same</p>"), (2, "http://a/y\r\nX: y", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "http://é/ü", "<p>é 日本\r\n\r\nWARC/1.1</p>"), (6, "u", "<p>same</p>"), (6, "u", "<p>same</p>"), (None, "u", "<p>same</p>"), (None, "u", "alone"), (7, "u", "z" * 300_000)]


def run(df, **options):
    return sorted(map(tuple, round_trip(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"least_bytes": 12}, {"least_bytes": 1}])
def test_odd_rows(spark, options):
    pages = spark.createDataFrame([(*r, "k", 1) for r in ROWS], "page_id long, url string, html string, key string, id long").repartition(3)
    assert run(pages, **options) == brute([(i, h) for i, _, h in ROWS], options.get("least_bytes", 0))
    assert run(pages.limit(0)) == []


def test_whole_table_and_hot_payload(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert run(pages) == brute([(r.page_id, r.html) for r in pages.collect()])
    hot = spark.range(900).selectExpr("id AS page_id", "'http://h' AS url", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('p', id) END AS html")
    assert run(hot) == brute([(r.page_id, r.html) for r in hot.collect()])


def test_archives_are_gzip_members_in_sequence(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://h/", f"text {i} " * 2000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = archive(pages, folder=f"file://{tmp_path}", roll=3000).collect()
    assert len(manifest) > 1 and sum(m.n_records for m in manifest) == 40
    data = files.read_bytes(manifest[0].uri)
    assert len(data) == manifest[0].n_bytes and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert len(list(read_records(io.BytesIO(data)))) == manifest[0].n_records


class Dripping(io.BytesIO):
    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else n)


def test_reading_bit_by_bit():
    data = b"".join(record(i, "http://h/", b"x" * i * 100) for i in range(5)) + record(9, None, b"x", refers_to=3)
    for stream in (io.BytesIO(data), Dripping(data)):
        found = list(read_records(stream, keep=True))
        assert [r.name("warc-record-id") for r in found] == ["0", "1", "2", "3", "4", "9"]
        assert found[-1].name("warc-refers-to") == "3" and found[-1].payload == b"" and found[4].payload == b"x" * 400 and found[4].n_payload == 400


def test_a_large_record_is_framed_while_it_is_inflated():
    """Its payload never stands in memory as a whole."""
    import tracemalloc

    data = record(1, "u" * 300_000, b"y" * 60_000_000)
    assert len(data) < 400_000
    tracemalloc.start()
    [found] = read_records(io.BytesIO(data))
    assert found.n_payload == 60_000_000 and found.payload is None and tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_revisits_are_those_of_their_responses(spark):
    rows = [("1", 3, "A", "response", None), ("2", 3, "A", "revisit", "1"), ("3", 3, "B", "revisit", "1"), ("4", 4, "A", "revisit", "1"), ("5", 3, "A", "revisit", "9")]
    records = spark.createDataFrame(rows, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    assert sorted(r.id for r in broken_revisits(records).collect()) == ["3", "4", "5"]
    assert broken_revisits(round_trip(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).withColumnRenamed("page_id", "id")).count() == 0


def pack(content):
    z = zlib.compressobj(wbits=31)
    return z.compress(content) + z.flush()


@pytest.mark.parametrize(
    "data",
    [
        record(1, "u", b"abc")[:-5], pack(b"no header"), pack(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"),
        pack(zlib.decompress(record(1, "u", b"abc"), 31).replace(b"abc", b"abd")),
    ],
)
def test_broken_archives(data):
    with pytest.raises(ArchiveError):
        list(read_records(io.BytesIO(data)))


def test_revisits_hold_no_payload():
    whole, revisit = record(1, "u", b"payload" * 50), record(2, "u", b"payload" * 50, refers_to=1)
    assert b"payload" * 50 in zlib.decompress(whole, 31) and b"payloadpayload" not in zlib.decompress(revisit, 31)
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
