import pytest

#: Texts that every operator must bear: null, empty, blank, ties, repeats, strange characters, a very long one.
TEXTS = [None, "", " \n\t ", "Hello World", "hello world", "HELLO WORLD", "The quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", "é ß 日本語 \u00a0x", "a" * 5000, "word " * 20000, "tab\tand\nline", "▁ <|endoftext|> x", "-" * 2000 + "\n" + "#" * 1001, "deadbeef" * 3 + " "]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with clashing extra columns, a repeated row and a row without an id."""
    rows = [(i, t, "en", f"src{i % 3}", 1, "x", i, "own") for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "Hello World", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, n long, row string").repartition(3).cache()


#: Names and types of columns that nobody expects.
STRANGE = "`a.b` string, `my col` int, `m` map<string,int>, `__gone` string, `__salt` long, `row` struct<`x.y`:int>, `digest` string, `content` binary, `node` long, `gone` long, `label` string, `t` string, `a``b` int, `evidence` string, `key` string"


@pytest.fixture(scope="session")
def strange_docs(spark):
    """Rows with such columns beside the usual ones."""
    rows = [(i, t, "en", f"http://h{i % 3}.com/", "x", 1, {"k": i}, "y", 2, (3,), "d", b"c", 4, 5, "l", "t", 6, "e", "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, source string, " + STRANGE).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
