"""WARC archives: a gzip member a record, written by tasks and read one record after another."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import files
from quarry.llm.common import column, hot_keys, materialise, partitions, qualified, scratch_path, send_back

#: Compressed bytes after which a task begins another archive; bytes read at a time.
ROLL, CHUNK = 64 << 20, 1 << 16
END = b"\r\n\r\n"
#: Bytes that a header may have.
MOST_HEADER = 256 << 20
_NAME = "<urn:page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks the format or whose digests don't match."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(head.encode("utf-8", "surrogatepass") + block + END) + packer.flush()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """The gzip member of a response, or of a revisit of another page's response.

    A revisit has the response's HTTP headers, with the full payload's length, and no payload.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("Content-Type", "application/http;msgtype=response")]
    headers += [("WARC-Record-ID", _NAME.format(quote(str(page_id), safe="")))] if page_id is not None else []
    headers += [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~"))] if url else []
    headers += [("WARC-Refers-To", _NAME.format(quote(str(refers_to), safe=""))), ("WARC-Profile", _PROFILE)] if refers_to is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")]
    return _member(headers, block)


@dataclass
class Record:
    """A record's headers, those of its HTTP message, what the payload's length and digest are, and the payload if it was kept."""

    headers: dict[str, str]
    http: dict[str, str]
    n_payload: int
    payload_digest: str
    payload: bytes | None = field(default=None, repr=False)

    def name(self, header: str) -> str | None:
        value = self.headers.get(header)
        return None if value is None else unquote(value[len("<urn:page:") : -1])


def members(stream, chunk: int = CHUNK) -> Iterator[Iterator[bytes]]:
    """The stream's gzip members, each as pieces that are inflated as bytes arrive; a member must be read before the next."""
    rest = b""

    def pieces(data: bytes) -> Iterator[bytes]:
        nonlocal rest
        unpacker = zlib.decompressobj(31)
        while True:
            piece = unpacker.decompress(data, chunk)
            if piece:
                yield piece
            if unpacker.eof:
                rest = unpacker.unused_data
                return
            data = unpacker.unconsumed_tail or stream.read(chunk)
            if not data:
                raise ArchiveError("the last member is cut off")

    while data := rest or stream.read(chunk):
        rest = b""
        yield pieces(data)


def _fields(head: bytes, errors: str) -> dict[str, str]:
    lines = (line.partition(":") for line in head.decode("utf-8", errors).split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in lines}


class _Head:
    """Bytes up to an empty line, and what came behind it."""

    def __init__(self, most: int):
        self.data, self.done, self.most = b"", False, most

    def feed(self, piece: bytes) -> bytes:
        if self.done:
            return piece
        self.data += piece
        head, found, rest = self.data.partition(END)
        if not found and len(self.data) > self.most:
            raise ArchiveError(f"a header of more than {self.most} bytes")
        if found:
            self.data, self.done = head, True
        return rest


def read_record(pieces: Iterator[bytes], keep: bool = False) -> Record:
    """One record, framed by its content length while its member is inflated, digests checked.

    Only headers stand in memory, and the payload if it is to be kept.
    """
    warc, http = _Head(MOST_HEADER), _Head(MOST_HEADER)
    headers: dict[str, str] = {}
    block, payload, kept = hashlib.sha1(), hashlib.sha1(), []
    left, n_payload, tail = 0, 0, b""
    for piece in pieces:
        was_done = warc.done
        rest = warc.feed(piece)
        if not warc.done:
            continue
        if not was_done:
            if not warc.data.startswith(b"WARC/1."):
                break
            headers = _fields(warc.data, "surrogatepass")
            left = int(headers["content-length"])
        own, rest = rest[:left], rest[left:]
        left -= len(own)
        tail += rest
        if len(tail) > len(END):
            raise ArchiveError("a block of more bytes than its content length")
        block.update(own)
        body = http.feed(own)
        payload.update(body)
        n_payload += len(body)
        if keep:
            kept.append(body)
    if not headers:
        raise ArchiveError("a member without a record's header")
    if left or tail != END:
        raise ArchiveError(f"a block that lacks {left} bytes of its content length")
    as_text = lambda d: f"sha1:{base64.b32encode(d.digest()).decode()}"
    if headers.get("warc-block-digest") != as_text(block):
        raise ArchiveError("a block digest doesn't match")
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != as_text(payload):
        raise ArchiveError("a payload digest doesn't match")
    return Record(headers, _fields(http.data, "replace"), n_payload, as_text(payload), b"".join(kept) if keep else None)


def read_records(stream, keep: bool = False, chunk: int = CHUNK) -> Iterator[Record]:
    """Records in order."""
    for pieces in members(stream, chunk):
        yield read_record(pieces, keep)
        for _ in pieces:  # to the member's end
            pass


def _write(folder: str, roll: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(at, 64).columns)))
        row = next(rows, None)
        while row is not None:
            n = size = 0
            with files.create(folder, "pages", ".warc.gz") as (uri, stream):
                while row is not None and size < roll:
                    page_id, url, html, refers_to = row
                    data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                    stream.write(data)
                    n, size, row = n + 1, size + len(data), next(rows, None)
            yield pa.RecordBatch.from_pylist([{"uri": uri, "n_records": n, "n_bytes": size}])

    return run


def _read(kind: str) -> Callable:
    schema = pa.schema([("id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                with files.open_stream(uri) as stream:
                    for r in read_records(stream):
                        rows.append({"id": r.name("warc-record-id"), "payload_bytes": int(r.http["content-length"]), "payload_digest": r.headers["warc-payload-digest"].removeprefix("sha1:"), "record_type": r.headers["warc-type"], "refers_to": r.name("warc-refers-to")})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def mark_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Rows id, url, html and refers_to: of equal payloads of at least least_bytes, the row with the largest id is the response."""
    html = F.coalesce(column(html_col), F.lit(""))
    url = column("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(column(id_col).alias("id"), url.alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("key"))
    long = rows.where(F.octet_length("html") >= least_bytes)
    tops = materialise(long.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("n")), "payloads")
    hot = hot_keys(tops.select("key", "n"), tops.agg(F.sum("n")).first()[0] or 0, max(8, partitions(pages.sparkSession)))
    both = send_back(long, "key", tops.select("key", "top"), hot)
    if least_bytes > 0:
        both = both.unionByName(rows.where(F.octet_length("html") < least_bytes).withColumn("top", F.col("id")))
    return both.select("id", "url", "html", F.when(F.col("id").isNull() | (F.col("id") != F.col("top")), F.col("top")).alias("refers_to"))


def archive(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes a record a row of pages; returns the manifest: uri, n_records, n_bytes."""
    spark = pages.sparkSession
    folder = qualified(spark, folder) if folder else scratch_path(spark, "warc")
    return materialise(mark_revisits(pages, id_col, html_col, least_bytes).mapInArrow(_write(folder, roll), "uri string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rows of the archives: id, payload_bytes, payload_digest, record_type, refers_to."""
    out = manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(_read(id_type), "id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def broken_revisits(records: DataFrame) -> DataFrame:
    """Revisits among the rows of read_archives() whose response is missing or has another digest or length."""
    said = F.struct("payload_digest", "payload_bytes")
    responses = records.where("record_type = 'response' AND id IS NOT NULL").groupBy("id").agg(F.min(said).alias("low"), F.max(said).alias("high"))
    revisits = records.where("record_type = 'revisit'").withColumnRenamed("id", "revisit_id")
    known = revisits.select(F.col("refers_to").alias("id")).distinct().join(responses, "id", "left")
    met = send_back(revisits.withColumn("id", F.col("refers_to")), "id", known)
    return met.where(F.col("low").isNull() | (F.col("low") != said) | (F.col("high") != said)).select(F.col("revisit_id").alias("id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes archives and reads them: id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload. Of rows with equal payloads, that with the largest id
    is the response and the others revisit it; repeated rows of the largest id are all
    responses; rows without an id revisit the largest id, or are responses if no row of the
    payload has one. An empty table writes no archive and gives an empty result. The
    url goes into the header where there is one; other columns are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return read_archives(archive(pages, id_col, html_col, least_bytes, folder), kind).withColumnRenamed("id", id_col)
