"""Parsers, previews, paths, merges."""

import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import catalog, merge
from quarry.plugins import FileParser, HashEmbedder, ModelRegistry, WordWeights
from quarry.sources import images, pdf
from quarry.sources.parsers import PARTS, ParserRegistry
from quarry.sources.preview import preview

CMAP = b"""/CIDInit /ProcSet findresource begin
1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar
<0001> <4F60>
<0002> <597D>
endbfchar
2 beginbfrange
<0010> <0012> <0041>
<0020> <0021> [<0078> <0079007A>]
endbfrange
endcmap"""


def make_pdf(content, cmap=CMAP, packed=True):
    def stream(data):
        body = zlib.compress(data) if packed else data
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), b" /Filter /FlateDecode" if packed else b"", body)

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", stream(content), b"<< /Type /Font /ToUnicode 6 0 R >>", stream(cmap), b"<< /Type /Font >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    content = b"BT /F1 12 Tf 1 0 0 1 50 700 Tm <00010002> Tj T* [<0010> -20 <00110012>] TJ 0 -14 Td <00200021> ' /F2 9 Tf (Pl\\141in \\(x\\)) Tj ET"
    assert pdf.extract_text(make_pdf(content, packed=packed)) == "你好\nABC \nxyzPlain (x)"


def test_pdf_that_cannot_be_read():
    for data in (b"", b"%PDF-1.4 broken", make_pdf(b"BT ET"), b"1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj"):
        assert pdf.extract_text(data) == ""


@pytest.mark.parametrize(
    ("data", "size"),
    [
        (b"\x89PNG\r\n\x1a\n" + bytes(8) + (3).to_bytes(4, "big") + (5).to_bytes(4, "big"), (3, 5)), (b"GIF89a\x03\x00\x05\x00", (3, 5)),
        (b"BM" + bytes(16) + (3).to_bytes(4, "little") + (-5).to_bytes(4, "little", signed=True), (3, 5)), (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x03\x03", (3, 5)),
        (b"RIFF....WEBPVP8X" + bytes(8) + b"\x02\x00\x00\x04\x00\x00", (3, 5)), (b"nothing", None), (b"\x89PNG\r\n\x1a\n", None), (b"", None),
    ],
)
def test_image_sizes(data, size):
    assert images.dimensions(data) == size


def test_registry(spark):
    class Upper(FileParser):
        extensions = ("txt",)

        def parts(self, path, name, ext, extracted):
            return F.array(F.struct(F.lit("text").alias("kind"), F.upper(extracted.cast("string")).alias("text"))).cast(PARTS)

    rows = [("/d/a.txt", b"abc"), ("/d/b.MP3", b""), ("/d/c.mp4", b""), ("/x/y/z.pdf", b"junk"), ("/d/e.gif", b"junk"), ("/d/f.nope", b""), ("/d/g.md", b"# A heading that is long enough to be kept\n\nAnd \xff a body that follows it here.")]
    files = spark.createDataFrame(rows, "path string, content binary")
    registry = ParserRegistry()
    registry.register(Upper())
    got = {r.path: [(p.kind, p.text) for p in r.parts] for r in registry.parse(files).collect()}
    assert got["/d/a.txt"] == [("text", "ABC")]
    assert got["/d/b.MP3"] == [("audio_transcript", "Audio (mp3): b.MP3")]
    assert got["/d/c.mp4"] == [("video_keyframe", "Video file: c.mp4")]
    assert got["/x/y/z.pdf"] == [("text", "z y x")]
    assert got["/d/e.gif"] == [("image", "Image file: e.gif")]
    assert len(got["/d/g.md"]) == 1 and "�" in got["/d/g.md"][0][1]
    assert "/d/f.nope" not in got


def test_preview_of_long_content_has_no_line_breaks(spark):
    import base64

    data = bytes(range(256)) * 20
    got = {r.path: r.data for r in preview(spark.createDataFrame([("/a.pdf", data), ("/b.png", data)], "path string, content binary")).collect()}
    assert got == {"/a.pdf": base64.b64encode(data).decode(), "/b.png": "data:image/png;base64," + base64.b64encode(data).decode()}


def test_previews(spark):
    rows = [("/a.txt", b"x" * 13_000), ("/b.png", b"123"), ("/c.PDF", b"123"), ("/d.wav", b"123"), ("/e.mp4", b"123"), ("/f.png", bytes((6 << 20) + 1)), ("/g.heic", b"1")]
    got = {r.path: r for r in preview(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["/a.txt"].type, len(got["/a.txt"].text)) == ("text", 12_000)
    assert (got["/b.png"].type, got["/b.png"].data) == ("image", "data:image/png;base64,MTIz")
    assert (got["/c.PDF"].type, got["/c.PDF"].data, got["/c.PDF"].ext) == ("pdf", "MTIz", "pdf")
    assert got["/d.wav"].data == "data:audio/wav;base64,MTIz" and got["/g.heic"].data.startswith("data:image/jpeg")
    assert (got["/e.mp4"].type, got["/e.mp4"].size) == ("binary", 3)
    assert (got["/f.png"].type, got["/f.png"].data) == ("image_large", None)


def test_paths(spark):
    rows = [("a/b.TXT", "txt", "text", True), ("a/.env", "", "unknown", False), ("x.tar.gz", "gz", "unknown", False), ("q.sql", "sql", "unknown", True), ("i.svg", "svg", "image", False), ("v.webm", "webm", "video", True), ("noext", "", "unknown", False)]
    df = spark.createDataFrame([r[:1] for r in rows], "p string")
    ext = paths.extension(F.col("p"))
    assert [(r.p, r.e, r.t, r.s) for r in df.select("p", ext.alias("e"), paths.file_type(ext).alias("t"), F.coalesce(paths.is_supported(F.col("p")), F.lit(False)).alias("s")).collect()] == rows
    config = paths.IgnoreConfig()
    ignored = [("a/b.txt", False, False), (".git/x.txt", True, True), ("a/build/x.txt", True, True), (".dot.txt", False, True), ("tmp", False, True), ("a/b/../c", True, True)]
    df = spark.createDataFrame([r[:1] for r in ignored], "p string")
    assert [tuple(r) for r in df.select("p", config.ignored_dir(F.col("p")), config.ignored_path(F.col("p"))).collect()] == ignored
    assert len(config.names) == 54 and config.allow("tmp").with_extra("mine").skips("mine") and not paths.IgnoreConfig.empty().skips("tmp")


def test_merges(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "path string, content_hash string")
    assert {r.path: r.change for r in merge.diff(new, old).collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new"}
    assert {r.path: r.change for r in merge.diff(new.where("path <> 'a'"), old, full_sync=True).collect()} == {"a": "deleted", "b": "changed", "c": "unchanged", "d": "new"}
    merged = merge.upsert(old, new, ["path"])
    assert sorted((r.path, r.content_hash or "") for r in merged.collect()) == [("a", "1"), ("b", "2"), ("c", ""), ("d", "1")]
    again = merge.upsert(merged, new, ["path"])
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))


def test_prefix_counts_are_exact(spark):
    files = spark.createDataFrame([("/a_b/x",), ("/aXb/x",), ("/A_B/x",), ("/a_b2/x",)], "path string")
    assert catalog.count_in_dir(files, "/a_b/").first().n_files == 1


def test_embedders(spark):
    model = WordWeights("w")
    texts = ["", "abc", "Hello hello world", "é日本" * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", model.embed(F.col("t")).alias("e"), model.sparse(F.col("t")).alias("s")).orderBy("i").collect()
    for text, r in zip(texts, rows):
        assert len(r.e) == model.dim and list(r.e) == pytest.approx(model.embed_query(text), abs=1e-6)
        assert r.s == pytest.approx(model.sparse_query(text), abs=1e-5)
    registry = ModelRegistry()
    registry.register("h", HashEmbedder)
    assert registry.get("h") is registry.get("h") and registry.ids() == ["h"]
