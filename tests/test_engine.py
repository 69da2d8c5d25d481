"""The engine end to end: indexing, incremental changes, search, catalogue, command line."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.cli import parser, run
from quarry.engine import Engine, Options
from quarry.errors import ConcurrentChange, FileNotIndexed, ModelNotLoaded, UnsupportedFileType
from quarry.functions.paths import IgnoreConfig
from quarry.plugins import HashEmbedder
from quarry.schema import SearchMode, SearchQuery
from quarry.sources.scan import list_folder

TEXTS = {
    "clay.md": "Clay pots keep water cool through the hottest afternoon.",
    "heron.txt": "A heron stood in the shallows and waited for trout.",
    "bowls.txt": "Potters glaze clay bowls and fire them overnight in kilns.",
    "sub/trains.txt": "Trains cross the long viaduct twice on every weekday.",
    "letters.txt": "a b c d e f g h i j k l m n o p q r s t",
    "bricks.txt": "bricks and mortar " * 400,
    "code.py": "def function_with_a_long_name(argument):\n    return argument + argument + argument\n",
    "node_modules/skip.txt": "This file lies in a folder that nobody wants to index.",
    ".hidden/skip.txt": "This file lies in a hidden folder that nobody wants.",
    "unknown.zzz": "No parser is registered for this extension at all.",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in TEXTS.items():
        path = tmp_path / "files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path / "files"


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "index"))


def names(df):
    return [r.file_record.path.rpartition("/")[2] for r in df.collect()]


def test_index_search_change_and_remove(spark, engine, folder):
    first = engine.index_directory(str(folder)).first()
    assert first.new_files == 7 and first.files_by_type == {"text": 7}
    stats = engine.stats().first()
    assert stats.total_files == 7 and stats.files_by_type == {"text": 7} and stats.index_size_bytes > 5000
    assert engine.store.table("chunks").where("content LIKE 'a b c%'").count() == 0  # below the quality bar
    bricks = engine.store.table("files").where("path LIKE '%bricks.txt'").first().id
    assert engine.store.table("chunks").where(F.col("file_id") == bricks).count() >= 3

    # an unchanged folder changes nothing
    assert engine.index_directory(str(folder)).first().new_files == 0
    assert names(engine.keyword("clay bowls fire"))[0] == "bowls.txt"
    for mode in SearchMode:
        rows = engine.search(SearchQuery("heron stood", mode=mode)).collect()
        assert rows and all(r.match_type == mode.value for r in rows)
        assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert names(engine.search("heron shallows", limit=1, mode=SearchMode.KEYWORD)) == ["heron.txt"]
    assert engine.search("   ").count() == 0 and engine.search("heron", limit=0).count() == 0
    assert engine.search("clay pots", file_types=("pdf",)).count() == 0
    page = names(engine.search("clay", limit=3, mode=SearchMode.KEYWORD))
    assert names(engine.search("clay", limit=1, offset=1, mode=SearchMode.KEYWORD)) == page[1:2]

    # a file that shrinks leaves no chunk behind
    (folder / "bricks.txt").write_text("Now this file is short, but still long enough to be kept.")
    again = engine.index_directory(str(folder)).first()
    assert again.new_files == 1 and engine.store.table("chunks").where(F.col("file_id") == bricks).count() == 1
    (folder / "bricks.txt").write_text("tiny")
    engine.index_file(str(folder / "bricks.txt"))
    assert engine.store.table("chunks").where(F.col("file_id") == bricks).count() == 0
    assert engine.store.table("files").where(F.col("id") == bricks).count() == 1

    # removal takes all that hangs on a file
    path = engine.store.table("files").where("path LIKE '%bowls.txt'").first().path
    assert engine.remove_path(path) and not engine.remove_path(path)
    assert "bowls.txt" not in names(engine.keyword("clay bowls"))
    with pytest.raises(FileNotIndexed):
        engine.remove_file("no such id")
    chunk_ids = engine.store.table("chunks").select("chunk_id")
    assert engine.store.table("embeddings").join(chunk_ids, "chunk_id", "left_anti").count() == 0

    # vanished files go with full_sync alone
    (folder / "heron.txt").unlink()
    assert engine.index_directory(str(folder)).first().removed_files == 0
    assert engine.index_directory(str(folder), full_sync=True).first().removed_files == 1
    assert engine.count_in_dir(engine.store.table("files").first().path.rpartition("/")[0]) >= 1
    assert [r.path for r in engine.list_files(2, 1).collect()] == [r.path for r in engine.list_files(3).collect()][1:]
    engine.clear()
    assert engine.stats().first().total_files == 0


def test_another_model_indexes_anew(engine, folder):
    engine.index_directory(str(folder))
    engine.switch_model("words")
    assert engine.index_directory(str(folder)).first().new_files == 7
    assert engine.store.table("sparse").count() == engine.store.table("chunks").count()
    rows = engine.search(SearchQuery("trains viaduct", mode=SearchMode.KEYWORD)).collect()
    assert [r.file_record.path.rpartition("/")[2] for r in rows] == ["trains.txt"] and 0 < rows[0].score < 1
    with pytest.raises(ModelNotLoaded):
        engine.switch_model("absent")
    engine.record_model("words", "/models/words", "1")
    engine.record_model("words", "/models/other", "2")
    assert [(r.model_id, r.local_path) for r in engine.list_models().collect()] == [("words", "/models/other")]


def test_type_filter_before_or_after_the_limit(spark, tmp_path, folder):
    (folder / "picture.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    engine = Engine(spark, Options(str(tmp_path / "index")))
    engine.index_directory(str(folder))
    assert engine.store.table("chunks").where("kind = 'image'").first().content == "Image: picture.png (640×480 pixels)"
    found = engine.search(SearchQuery("heron", ("image",), limit=1, mode=SearchMode.VECTOR)).count()
    engine.options.pushdown_types = True
    assert engine.search(SearchQuery("heron", ("image",), limit=1, mode=SearchMode.VECTOR)).count() == 1 >= found


def test_images_have_a_model_of_their_own(spark, tmp_path, folder):
    (folder / "cat.png").write_bytes(b"not really an image")
    engine = Engine(spark, Options(str(tmp_path / "index"), image_model="pictures"))
    engine.models.register("pictures", lambda: HashEmbedder("pictures", 64))
    engine.index_directory(str(folder))
    assert {r.model_id: r.dim for r in engine.store.table("embeddings").select("model_id", "dim").distinct().collect()} == {"hash": 384, "pictures": 64}
    rows = engine.search(SearchQuery("Image file: cat.png", mode=SearchMode.VECTOR)).collect()
    assert rows[0].file_record.path.endswith("cat.png") and rows[0].score == pytest.approx(1.0, abs=1e-6)


def test_an_index_stands_for_the_scan(spark, tmp_path, folder):
    engine = Engine(spark, Options(str(tmp_path / "index"), scale="cosine"))
    engine.index_directory(str(folder))
    assert engine.vector_index() is None  # few vectors
    query = SearchQuery(TEXTS["heron.txt"], limit=3, mode=SearchMode.VECTOR)
    exact = names(engine.search(query))
    engine.options.ann = "force"
    index = engine.vector_index()
    assert index is not None and engine.vector_index() is index
    assert names(engine.search(query))[0] == exact[0] == "heron.txt"
    engine.remove_path(engine.store.table("files").where("path LIKE '%heron.txt'").first().path)
    assert engine.vector_index() is not index and "heron.txt" not in names(engine.search(query))


def test_old_versions_stay_readable_until_pruned(engine, folder):
    engine.index_directory(str(folder))
    before = engine.store.table("files")
    engine.clear()
    assert before.count() == 7 and engine.store.table("files").count() == 0
    assert len(engine.store.versions()) == 2


def test_a_change_rewrites_its_buckets_alone(engine, folder):
    engine.index_directory(str(folder))
    before = engine.store.current()
    (folder / "heron.txt").write_text("The heron has flown away over the reeds this morning.")
    engine.index_directory(str(folder))
    after = engine.store.current()
    for name in ("files", "chunks", "embeddings"):
        changed = {b for b in before[name].keys() | after[name].keys() if before[name].get(b) != after[name].get(b)}
        assert len(changed) == 1 < len(before[name])
    assert names(engine.keyword("heron"))[0] == "heron.txt" and engine.store.table("files").count() == 7


def test_removals_come_in_one_write(engine, folder):
    engine.index_directory(str(folder))
    paths = [r.path for r in engine.list_files(3).collect()]
    n = len(engine.store.versions())
    assert engine.remove_paths([*paths, "/no/such"]) == 3 and engine.remove_paths(["/no/such"]) == 0
    assert engine.store.table("files").count() == 4 and len(engine.store.versions()) == n + 1


def test_of_two_writers_one_fails(engine, folder):
    engine.index_directory(str(folder))
    n = engine.store.versions()[-1] + 1
    engine.store._claim(n)  # another writer has begun
    with pytest.raises(ConcurrentChange):
        engine.clear()
    assert engine.store.table("files").count() == 7
    engine.store._fs.delete(engine.store._path(engine.store._version(n) + ".claim"), False)
    engine.clear()
    assert engine.store.table("files").count() == 0


def test_old_versions_go_with_their_folders(engine, folder, tmp_path):
    for i in range(6):
        (folder / "heron.txt").write_text(f"Morning number {i}: the heron stands in the shallows again.")
        engine.index_directory(str(folder))
    named = {f for v in engine.store.versions() for folders in engine.store._read_json(engine.store._version(v)).values() for f in folders.values()}
    left = {str(p.relative_to(tmp_path / "index")) for p in (tmp_path / "index" / "data").glob("*/bucket=*")}
    assert left == named and len(engine.store.versions()) == 3 and engine.keyword("heron").count() == 1


def test_unsupported_and_ignored(spark, engine, folder):
    with pytest.raises(UnsupportedFileType):
        engine.index_file(str(folder / "unknown.zzz"))
    listed = list_folder(spark, str(folder))
    assert len(listed) == 7 and not any("skip" in p for p in listed)
    every = list_folder(spark, str(folder), IgnoreConfig().allow("node_modules"))
    assert len(every) == 8


def test_command_line(spark, tmp_path, folder):
    said = []

    def call(*args):
        said.clear()
        run(parser().parse_args(["--root", str(tmp_path / "index"), *args]), spark, said.append)
        return said

    assert json.loads(call("index", str(folder))[0])["new_files"] == 7
    assert "[hybrid]" in call("search", "waited for trout", "-l", "1", "-m", "nonsense")[0]
    assert "heron.txt" in call("search", "waited for trout", "-l", "1", "-m", "keyword")[0]
    [row] = json.loads(call("search", "waited for trout", "-l", "1", "-m", "keyword", "--json")[0])
    assert row["match_type"] == "keyword" and row["chunk_index"] == 0
    assert json.loads(call("stats")[0])["total_files"] == 7
    assert json.loads(call("preview", str(folder / "clay.md"))[0])["text"] == TEXTS["clay.md"]
    assert call("--strict", "search", "waited for trout!", "-m", "keyword") == []
    assert "heron.txt" in call("--ann", "force", "--scale", "cosine", "search", "waited for trout", "-l", "1", "-m", "keyword")[0]
    assert call("models") == ["in use: hash of hash, words"]
    assert call("models", "--use", "words")[0].startswith("in use: words") and call("models")[0].startswith("in use: words")
    assert call("--model", "hash", "models")[0].startswith("in use: hash")
    with pytest.raises(ModelNotLoaded):
        call("models", "--use", "nobody")
    first = call("list", "-l", "2")[0]
    assert len(said) == 2
    call("remove", first.split()[0])
    assert json.loads(call("stats")[0])["total_files"] == 6
    call("clear")
    assert json.loads(call("stats")[0])["total_files"] == 0


def test_keyword_index_follows_the_files(spark, engine, folder):
    from quarry.operators import keyword, postings

    def same():
        tables = engine.store.tables()
        for q in ("clay", "every weekday", "heron OR kilns"):
            a, b = ({r.chunk_id: pytest.approx(r.bm25) for r in f.collect()} for f in (postings.bm25(tables["postings"], q), keyword.bm25(tables["chunks"], q)))
            assert a == b
        return tables["postings"].where(F.col("term") == postings.WHOLE).count()

    engine.index_directory(str(folder))
    n = same()
    assert n == engine.store.table("chunks").count()
    (folder / "heron.txt").write_text("Two kilns and one heron, every weekday without a single pause.")
    (folder / "bowls.txt").unlink()
    engine.index_directory(str(folder), full_sync=True)
    assert same() == n - 1
    assert sorted(names(engine.keyword("kilns"))) == ["heron.txt"]
    # a query with an index reads no text before its best rows are known
    assert "PushedFilters: [In(term" in postings.bm25(engine.store.table("postings"), "clay pots")._sc._jvm.PythonSQLUtils.explainString(postings.bm25(engine.store.table("postings"), "clay pots")._jdf.queryExecution(), "formatted")


def test_store_without_a_keyword_index(spark, engine, folder, monkeypatch):
    """A store that was filled before there was an index is searched by scans and stays so."""
    monkeypatch.setattr(Engine, "has_postings", lambda self: False)
    engine.index_directory(str(folder))
    monkeypatch.undo()
    assert not engine.has_postings()
    assert names(engine.keyword("clay bowls fire"))[0] == "bowls.txt"
    (folder / "new.txt").write_text("A kiln for bowls of clay that nobody has fired before today.")
    engine.index_directory(str(folder))
    assert not engine.has_postings() and "new.txt" in names(engine.keyword("clay bowls"))
