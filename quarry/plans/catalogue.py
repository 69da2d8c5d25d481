"""Registered queries of the engine and, where DuckDB can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import cut, paths
from quarry.functions import text as tf
from quarry.functions import vectors as V
from quarry.operators import catalog, fusion, ingest, keyword, merge, postings, sparse, vector
from quarry.operators.search import search
from quarry.plugins import Code, HashEmbedder
from quarry.schema import SearchMode, SearchQuery
from quarry.sources.preview import preview
from quarry.streaming.watch import debounce, latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The keyword query of the examples, its LIKE fallback, and the tokens of the sparse query.
KEYWORDS, SHORT, TOKENS = "heed tion", "zu", {11603: 1.0, 11102: 0.5, 10002: 0.25}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _query_vector(embeddings: DataFrame) -> list[float]:
    row = embeddings.where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a path made of source, language and id; the type by an extension that goes with the language."""
    docs = read(spark, sf_dir, "documents")
    ext = F.element_at(F.create_map(*[F.lit(x) for p in (("en", "txt"), ("de", "md"), ("fr", "pdf"), ("es", "PNG")) for x in p]), F.col("lang"))
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce(ext, F.lit("xyz")))
    return docs.select("doc_id", "text", "n_chars", path.alias("path"))


_SQL_FILES = "SELECT doc_id, text, n_chars, '/' || source || '/' || lang || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'txt' WHEN 'de' THEN 'md' WHEN 'fr' THEN 'pdf' WHEN 'es' THEN 'PNG' ELSE 'xyz' END AS path FROM documents"
_SQL_TYPE = "CASE lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'png' THEN 'image' ELSE 'unknown' END"
_SQL_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_SQL_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


# --- vectors ---------------------------------------------------------------


@query(f"SELECT vec_id, label, round(({_SQL_COS} + 1) / 2, 6) AS score FROM embeddings e, {_SQL_Q} ORDER BY ({_SQL_COS} + 1) / 2 DESC, vec_id LIMIT 10")
def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return vector.top_k(emb, _query_vector(emb), 10, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, label, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM (SELECT vec_id, label, ({_SQL_COS} + 1) / 2 AS score FROM embeddings e, {_SQL_Q})) WHERE rank <= 3")
def vector_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return vector.top_k_by_group(emb, _query_vector(emb), 3, "label", "vec_id").select("vec_id", "label", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""
WITH t AS (SELECT vec_id, {_SQL_COS} AS score FROM embeddings e, {_SQL_Q} ORDER BY score DESC, vec_id LIMIT 60),
     n AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS i, max(score) OVER () AS top FROM t)
SELECT vec_id, round(least(greatest(score, -1), 1), 6) AS score FROM n WHERE (top >= 0.45 AND score >= 0.45 AND i <= 20) OR (top < 0.45 AND i <= 5)
""")
def vector_score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    return vector.vector_search(emb, _query_vector(emb), 20, "vec_id", scale="cosine").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(({_SQL_COS} + 1) / 2, 6) AS score FROM embeddings e, {_SQL_Q} WHERE vec_id % 3 <> 1 ORDER BY ({_SQL_COS} + 1) / 2 DESC, vec_id LIMIT 15")
def vector_dim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors is cut to half its dimension: the query's dimension alone is searched."""
    emb = read(spark, sf_dir, "embeddings")
    mixed = emb.withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    return vector.top_k(mixed, _query_vector(emb), 15, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(least(greatest(1 - least(greatest(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) / 2, 0), 2), 0), 1), 5) AS cosine FROM embeddings e, {_SQL_Q}")
def vector_l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of unit vectors from their distances."""
    emb = read(spark, sf_dir, "embeddings")
    own, other = F.col("embedding"), V.literal(_query_vector(emb))
    squares = F.aggregate(F.zip_with(own, other, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return emb.select("vec_id", F.round(V.from_distance(F.sqrt(squares)), 5).alias("cosine"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS squared,
       round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-9), 5) AS first
FROM embeddings
""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    n = V.norm(F.col("embedding"))
    return emb.select("vec_id", F.round(n * n, 5).alias("squared"), F.round(V.l2_normalize(F.col("embedding"))[0], 5).alias("first"))


@query(f"""
SELECT vec_id, round(({_SQL_COS} + 1) / 2, 5) AS shifted, round(least(greatest({_SQL_COS}, -1), 1), 5) AS cosine, round(least(greatest({_SQL_COS}, 0), 1), 5) AS clamped
FROM embeddings e, {_SQL_Q}
""")
def vector_score_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read(spark, sf_dir, "embeddings")
    cos = V.dot(F.col("embedding"), V.literal(_query_vector(emb)))
    return emb.select("vec_id", *[F.round(V.score(cos, s), 5).alias(s) for s in V.SCALES])


@query()
def vector_ann_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries as vector_batch_topk, over an inverted file."""
    emb = read(spark, sf_dir, "embeddings")
    asked = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector.InvertedFile.build(emb, len(_query_vector(emb)), key="vec_id")
    return index.search_batch(asked, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
     s AS (SELECT query_id, vec_id, """ + _SQL_COS + """ AS score FROM embeddings e, q)
SELECT query_id, vec_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""")
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    emb = read(spark, sf_dir, "embeddings")
    asked = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.batch_top_k(emb, asked, 10, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- keywords --------------------------------------------------------------

_SQL_BM25 = """
WITH t AS (SELECT doc_id, lang, lower(coalesce(text, '')) AS s FROM documents),
     f AS (SELECT doc_id, lang, greatest(length(s) - 2, 0) AS d,
                  CASE WHEN contains(s, 'heed') THEN len(list_filter(range(1, length(s) - 2), lambda i: substring(s, i, 4) = 'heed')) ELSE 0 END AS f0,
                  CASE WHEN contains(s, 'tion') THEN len(list_filter(range(1, length(s) - 2), lambda i: substring(s, i, 4) = 'tion')) ELSE 0 END AS f1 FROM t),
     c AS (SELECT count(*) AS n, avg(d) AS a, sum((f0 > 0)::INT) AS n0, sum((f1 > 0)::INT) AS n1 FROM f),
     i AS (SELECT *, CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 THEN ln((n - n0 + 0.5) / (n0 + 0.5)) ELSE 1e-6 END AS i0,
                  CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) > 0 THEN ln((n - n1 + 0.5) / (n1 + 0.5)) ELSE 1e-6 END AS i1 FROM c),
     b AS (SELECT doc_id, lang, -(i0 * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / a)) + i1 * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / a))) AS bm25 FROM f, i WHERE f0 > 0 AND f1 > 0),
     k AS (SELECT doc_id, lang, bm25, greatest(-bm25, 0) / (greatest(-bm25, 0) + 10) AS score FROM b)
"""


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content"))


@query(_SQL_BM25 + "SELECT doc_id, round(bm25, 6) AS bm25 FROM k")
def keyword_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.bm25(_contents(spark, sf_dir), KEYWORDS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query(_SQL_BM25 + "SELECT doc_id, round(score, 6) AS score FROM k ORDER BY bm25, doc_id LIMIT 20")
def keyword_score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(_contents(spark, sf_dir), KEYWORDS, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("SELECT doc_id, round(1.0::DOUBLE / 11, 6) AS score FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%zu%' ORDER BY doc_id LIMIT 20")
def keyword_short_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(_contents(spark, sf_dir), SHORT, 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents)
SELECT doc_id FROM t WHERE (contains(s, 'heit') AND contains(s, 'der')) OR (contains(s, 'mente') AND NOT contains(s, 'que'))
""")
def keyword_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.bm25(_contents(spark, sf_dir), "heit AND der OR mente NOT que").select("doc_id")


@query(_SQL_BM25 + "SELECT doc_id, round(bm25, 6) AS bm25 FROM k")
def keyword_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_bm25 from an index of all documents, made first."""
    index = postings.build(_contents(spark, sf_dir), "doc_id")
    return postings.bm25(index, KEYWORDS, "doc_id").select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("""
WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents),
     g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(s) - 1, 1)), lambda i: substring(s, i, 3))) AS run FROM t)
SELECT doc_id, count(*) AS n_places, count(DISTINCT run) AS n_runs FROM g GROUP BY 1
""")
def keyword_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and distinct runs that the index holds of each document."""
    index = postings.build(_contents(spark, sf_dir), "doc_id").where(F.col("term") != postings.WHOLE)
    return index.groupBy("doc_id").agg(F.sum(F.size("places")).alias("n_places"), F.count("*").alias("n_runs"))


@query("SELECT doc_id, substring(coalesce(text, ''), 1, 2000) AS snippet, substring(coalesce(text, ''), 1, 120) AS preview FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", tf.snippet(content).alias("snippet"), tf.preview_line(content).alias("preview"))


@query(_SQL_BM25 + "SELECT doc_id, round(bm25, 6) AS bm25 FROM k")
def keyword_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyword_bm25 with marks around the words and a word that is too short to count."""
    return keyword.bm25(_contents(spark, sf_dir), ' "heed":*  of(tion)^ - ').select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def keyword_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(_contents(spark, sf_dir), " \t ", 20, "doc_id").select("doc_id", "score")


# --- sparse weights --------------------------------------------------------

_SQL_TOKENS = """
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: x <> '')) AS word FROM documents),
     t AS (SELECT doc_id, (ascii(word) * 100 + length(word))::INTEGER AS token_id, count(*)::DOUBLE AS weight FROM w GROUP BY ALL)
"""


def _token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token_id, weight): words by first letter and length, with their counts."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", -1), lambda w: w != "")).alias("word"))
    return words.groupBy("doc_id", (F.ascii("word") * 100 + F.char_length("word")).alias("token_id")).agg(F.count("*").cast("double").alias("weight"))


_SQL_SPARSE = _SQL_TOKENS + ", r AS (SELECT doc_id, sum(weight * CASE token_id WHEN 11603 THEN 1.0 WHEN 11102 THEN 0.5 ELSE 0.25 END) AS raw FROM t WHERE token_id IN (11603, 11102, 10002) GROUP BY 1)"


@query(_SQL_SPARSE + " SELECT doc_id, round(raw, 6) AS raw, round(raw / (raw + 1), 6) AS score FROM r WHERE raw > 0 ORDER BY r.raw DESC, doc_id LIMIT 20")
def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = sparse.search_postings(_token_weights(spark, sf_dir), TOKENS, 20, "doc_id")
    return best.select("doc_id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"))


@query(_SQL_TOKENS + "SELECT doc_id, count(*) AS n_tokens, max(weight) AS largest, sum(weight) AS total FROM t GROUP BY 1")
def sparse_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = sparse.max_pool(_token_weights(spark, sf_dir), "doc_id")
    return pooled.select("doc_id", F.size("weights").cast("long").alias("n_tokens"), F.array_max(F.map_values("weights")).alias("largest"), F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x).alias("total"))


# --- fusion ----------------------------------------------------------------

_SQL_ARMS = _SQL_BM25 + f""",
     v AS (SELECT vec_id AS doc_id, ({_SQL_COS} + 1) / 2 AS score FROM embeddings e, {_SQL_Q} ORDER BY score DESC, vec_id LIMIT 30),
     kw AS (SELECT doc_id, score FROM k ORDER BY bm25, doc_id LIMIT 30),
     arms AS (SELECT doc_id, score / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM v UNION ALL SELECT doc_id, score / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM kw),
     fused AS (SELECT doc_id, least(greatest(sum(part) / (2.0 / 61), 0), 1) AS score FROM arms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
"""


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    emb = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = vector.top_k(emb, _query_vector(emb.withColumnRenamed("doc_id", "vec_id")), 30, "doc_id")
    return near.select("doc_id", "score"), keyword.keyword_search(_contents(spark, sf_dir), KEYWORDS, 30, "doc_id").select("doc_id", "score")


@query(_SQL_ARMS + "SELECT doc_id, round(score, 6) AS score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(*_arms(spark, sf_dir), 10, key="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query(_SQL_ARMS + "SELECT f.doc_id, round(f.score, 6) AS score, d.lang, substring(coalesce(d.text, ''), 1, 2000) AS snippet, 'hybrid' AS match_type FROM fused f JOIN documents d USING (doc_id)")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.hybrid(*_arms(spark, sf_dir), 10, key="doc_id")  # ten rows
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", tf.snippet(F.coalesce("text", F.lit(""))).alias("snippet"))
    return docs.join(F.broadcast(fused), "doc_id").select("doc_id", F.round("score", 6).alias("score"), "lang", "snippet", "match_type")


@query(_SQL_ARMS + "SELECT f.doc_id, round(f.score, 6) AS score FROM fused f JOIN documents d USING (doc_id) WHERE d.lang IN ('en', 'de')")
def hybrid_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.rrf(*_arms(spark, sf_dir), 10, key="doc_id")
    kinds = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return kinds.join(F.broadcast(fused), "doc_id").where(F.col("lang").isin("en", "de")).select("doc_id", F.round("score", 6).alias("score"))


@query(_SQL_ARMS + """,
     img AS (SELECT doc_id, score FROM kw WHERE score >= 0.25 ORDER BY score DESC, doc_id LIMIT 8),
     every AS (SELECT doc_id, score FROM fused UNION ALL SELECT doc_id, score FROM img WHERE doc_id NOT IN (SELECT doc_id FROM fused))
SELECT doc_id, round(score, 6) AS score FROM every ORDER BY every.score DESC, doc_id LIMIT 12
""")
def multimodal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    near, words = _arms(spark, sf_dir)
    fused = fusion.rrf(near, words, 10, key="doc_id")
    return fusion.merge_images(fused, words, 12, "hybrid", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


# --- search modes over tables of an engine ---------------------------------

_SQL_NEAR = f"""
     v0 AS (SELECT vec_id AS doc_id, ({_SQL_COS} + 1) / 2 AS score FROM embeddings e, {_SQL_Q} ORDER BY score DESC, vec_id LIMIT 30),
     v AS (SELECT v0.* FROM v0 JOIN documents USING (doc_id)),
"""
_SQL_FUSED = """
     arms AS (SELECT doc_id, score / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) AS part FROM v UNION ALL SELECT doc_id, score / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM kw),
     fused AS (SELECT doc_id, least(greatest(sum(part) / (2.0 / 61), 0), 1) AS score FROM arms GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
"""
_SQL_HITS = f"""
     p AS (SELECT doc_id, path, text, {_SQL_TYPE} AS file_type FROM ({_SQL_FILES}))
SELECT doc_id, path, file_type, round(score, 6) AS score, substring(text, 1, 2000) AS snippet, '%s' AS match_type FROM fused JOIN p USING (doc_id)
"""


class _Asked(HashEmbedder):
    """A model whose answer to any query is given."""

    def __init__(self, vector: list[float], weights: dict[int, float] | None = None):
        super().__init__("asked", len(vector))
        self.vector, self.weights = vector, weights

    def embed_query(self, text: str) -> list[float]:
        return self.vector

    def sparse_query(self, text: str) -> dict[int, float] | None:
        return self.weights


def _engine_search(spark: SparkSession, sf_dir: str, weights: dict[int, float] | None = None, **asked) -> DataFrame:
    """Ten rows of a search; documents are files of one chunk each, embeddings those of their chunks."""
    docs, emb = _files(spark, sf_dir), read(spark, sf_dir, "embeddings")
    never = F.lit(None).cast("timestamp")
    tables = {
        "files": docs.select(F.col("doc_id").alias("id"), "path", paths.file_type(paths.extension(F.col("path"))).alias("file_type"), F.col("n_chars").alias("size"), never.alias("modified_at"), never.alias("indexed_at"), F.lit("").alias("content_hash")),
        "chunks": docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content")),
        "embeddings": emb.select(F.col("vec_id").alias("chunk_id"), F.lit("asked").alias("model_id"), "embedding"),
    }
    if weights is not None:
        tables["sparse"] = sparse.max_pool(_token_weights(spark, sf_dir), "doc_id").withColumnRenamed("doc_id", "chunk_id")
    found = search(spark, tables, SearchQuery(KEYWORDS, limit=10, **asked), _Asked(_query_vector(emb), weights))
    return found.select(F.col("file_record.id").alias("doc_id"), "file_record.path", "file_record.file_type", F.round("score", 6).alias("score"), "snippet", "match_type")


_SQL_HYBRID = _SQL_BM25 + "," + _SQL_NEAR + "kw AS (SELECT doc_id, score FROM k ORDER BY bm25, doc_id LIMIT 30)," + _SQL_FUSED + _SQL_HITS % "hybrid"


@query(_SQL_HYBRID)
def engine_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_search(spark, sf_dir)


@query(_SQL_HYBRID + " WHERE file_type IN ('text', 'image')")
def engine_hybrid_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types are filtered after the limit."""
    return _engine_search(spark, sf_dir, file_types=("text", "image"))


@query(_SQL_BM25 + ", fused AS (SELECT doc_id, score FROM k ORDER BY bm25, doc_id LIMIT 10)," + _SQL_HITS % "keyword")
def engine_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_search(spark, sf_dir, mode=SearchMode.KEYWORD)


@query("WITH" + _SQL_NEAR + "n AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS i, max(score) OVER () AS top FROM v0), fused AS (SELECT doc_id, score FROM n WHERE (top >= 0.45 AND score >= 0.45 AND i <= 10) OR (top < 0.45 AND i <= 5))," + _SQL_HITS % "vector")
def engine_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_search(spark, sf_dir, mode=SearchMode.VECTOR)


@query(_SQL_SPARSE + "," + _SQL_NEAR + "kw AS (SELECT doc_id, raw / (raw + 1) AS score FROM r WHERE raw > 0 ORDER BY r.raw DESC, doc_id LIMIT 30)," + _SQL_FUSED + _SQL_HITS % "hybrid")
def engine_sparse_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model with a sparse head: its weights stand for keywords."""
    return _engine_search(spark, sf_dir, TOKENS)


# --- chunks ----------------------------------------------------------------


@query(r"""
WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n{2,}'), lambda p: trim(p, e' \t\n\r\f\v')), lambda p: p <> '') AS blocks FROM documents)
SELECT doc_id, greatest(len(blocks), 1)::INTEGER AS n_blocks, md5(coalesce(array_to_string(blocks, '|'), '')) AS blocks_md5 FROM b
""")
def split_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tf.blank_line_blocks(F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", blocks.alias("b")).select("doc_id", F.size("b").alias("n_blocks"), F.md5(F.array_join("b", "|")).alias("blocks_md5"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s, rtrim(coalesce(text, ''), e' \t\n\r\f\v') AS bare FROM documents),
     n AS (SELECT doc_id, bare, len(regexp_extract_all(s || ' ', '[.?!]\s')) + len(regexp_extract_all(s, '[。？！]')) AS ends FROM t)
SELECT doc_id, greatest(ends + (bare <> '' AND NOT regexp_matches(bare, '[.?!。？！]$'))::INT, 1)::INTEGER AS n_sentences FROM n
""")
def sentence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tf.sentences(F.coalesce("text", F.lit("")))).alias("n_sentences"))


def _chunk_summary(docs: DataFrame, chunks) -> DataFrame:
    cut = docs.select("doc_id", chunks.alias("chunks"))
    lengths = F.transform("chunks", F.char_length)
    return cut.select("doc_id", F.size("chunks").alias("n_chunks"), F.aggregate(lengths, F.lit(0), lambda a, n: a + n).alias("n_chars"), F.array_max(lengths).alias("longest"), F.md5(F.array_join("chunks", "\x00")).alias("chunks_md5"))


@query()
def chunk_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _chunk_summary(docs, tf.chunk(F.coalesce("text", F.lit("")), cut.prose, overlap=False))


@query()
def chunk_with_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return _chunk_summary(docs, tf.keep_quality(tf.chunk(F.coalesce("text", F.lit("")))))


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n# "))
    return _chunk_summary(docs, tf.chunk(F.col("text"), cut.markdown, overlap=False))


@query(r"""
SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[\p{L}\p{Nl}0-9]){2,}'), lambda x: length(x))), 0)::INTEGER AS word_chars,
       length(trim(coalesce(text, ''), e' \n\t\r')) >= 30 AND coalesce(list_sum(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[\p{L}\p{Nl}0-9]){2,}'), lambda x: length(x))), 0) >= 30 AS quality
FROM documents
""")
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", tf.word_chars(text).alias("word_chars"), tf.is_quality(text).alias("quality"))


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
     n AS (SELECT *, CASE WHEN strlen(s) <= 1500 THEN 0 ELSE greatest(ceil((length(s) - 1500) / 1350.0), 0)::INTEGER END AS last FROM t)
SELECT doc_id, last + 1 AS n_windows, CASE WHEN strlen(s) <= 1500 THEN s ELSE substring(s, last * 1350 + 1, 1500) END AS last_window FROM n
""")
def pdf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", tf.pdf_windows(F.coalesce("text", F.lit(""))).alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_windows"), F.element_at("w", -1).alias("last_window"))


@query()
def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"\. ", ";\n\n"))
    return _chunk_summary(docs, tf.chunk(F.col("text"), Code().split, overlap=False))


@query()
def chunk_by_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document by the strategy of its file's extension, filtered for quality."""
    files = _files(spark, sf_dir).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n## "))
    return _chunk_summary(files, tf.keep_quality(tf.chunk_by_extension(F.col("text"), paths.extension(F.col("path")))))


@query("""
SELECT doc_id, ceil(length(coalesce(text, '')) / 700.0)::INTEGER AS n_parts,
       CASE WHEN coalesce(text, '') = '' THEN NULL ELSE substring(text, ((length(text) - 1) // 700 * 700 + 1)::INT, 700) END AS last_part
FROM documents
""")
def split_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", tf.raw_parts(F.coalesce("text", F.lit("")), 700).alias("p"))
    return docs.select("doc_id", F.size("p").alias("n_parts"), F.try_element_at("p", F.lit(-1)).alias("last_part"))


@query(r"""
SELECT doc_id, true AS whole, length(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[\t\n\v\f\r ]+'), lambda w: w <> ''), ' '))::INTEGER AS n_chars FROM documents
""")
def split_at_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of at most 400 characters hold all words, in order, and so do their joined lengths."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_join(F.filter(F.split(text, r"[\t\n\x0B\f\r ]+", -1), lambda w: w != ""), " ")
    docs = read(spark, sf_dir, "documents").select("doc_id", words.alias("words"), F.array_join(tf.word_parts(text, 400), " ").alias("joined"))
    return docs.select("doc_id", (F.col("words") == F.col("joined")).alias("whole"), F.char_length("joined").alias("n_chars"))


@query(f"SELECT doc_id, doc_id || ' ' || lang || ' ' || source AS fallback FROM (SELECT d.doc_id, d.lang, d.source FROM documents d JOIN ({_SQL_FILES}) USING (doc_id))")
def pdf_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", tf.pdf_fallback(F.col("path")).alias("fallback"))


@query(r"""
WITH b AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n+'), lambda p: trim(p, e' \t\n\r\f\v')), lambda p: p <> '')) AS block FROM documents),
     q AS (SELECT doc_id, block, coalesce(list_sum(list_transform(regexp_extract_all(block, '(?:[\p{L}\p{Nl}0-9]){2,}'), lambda x: length(x))), 0) AS n FROM b)
SELECT doc_id, count(*) FILTER (length(block) >= 30 AND n >= 30) AS n_kept, coalesce(sum(length(block)) FILTER (length(block) >= 30 AND n >= 30), 0)::BIGINT AS n_chars FROM q GROUP BY 1
""")
def filter_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that pass the quality bar, of documents that have any line."""
    lines = tf.blank_line_blocks(F.regexp_replace(F.coalesce("text", F.lit("")), "\n+", "\n\n"))
    docs = read(spark, sf_dir, "documents").select("doc_id", lines.alias("lines")).where("lines[0] <> ''").select("doc_id", tf.keep_quality(F.col("lines")).alias("kept"))
    return docs.select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.aggregate(F.transform("kept", F.char_length), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_chars"))


@query()
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = HashEmbedder()
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(model.embed(F.col("text")), lambda x: F.round(x, 4)).alias("embedding"))


# --- files and changes -----------------------------------------------------


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"))


@query(f"SELECT doc_id, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext, {_SQL_TYPE} AS file_type FROM ({_SQL_FILES})")
def file_type_from_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = paths.extension(F.col("path"))
    return _files(spark, sf_dir).select("doc_id", ext.alias("ext"), paths.file_type(ext).alias("file_type"))


@query(f"SELECT doc_id, {_SQL_TYPE} <> 'unknown' AS supported FROM ({_SQL_FILES})")
def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", paths.is_supported(F.col("path")).alias("supported"))


@query(f"""
WITH f AS (SELECT path, coalesce(text, '') AS s, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS ext, {_SQL_TYPE} AS kind FROM ({_SQL_FILES}) WHERE path IS NOT NULL)
SELECT path, CASE kind WHEN 'unknown' THEN 'binary' ELSE kind END AS type, ext, strlen(s)::BIGINT AS size, CASE kind WHEN 'text' THEN substring(s, 1, 12000) END AS text,
       md5(CASE kind WHEN 'pdf' THEN base64(encode(s)) WHEN 'image' THEN 'data:image/png;base64,' || base64(encode(s)) END) AS data_md5 FROM f
""")
def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).where("path IS NOT NULL").select("path", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return preview(files).withColumn("data_md5", F.md5("data")).drop("data")


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ("src", ".git", "node_modules", "docs", "build", "a.b"))), (F.length("url") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))


@query("""
WITH t AS (SELECT page_id, ['src', '.git', 'node_modules', 'docs', 'build', 'a.b'][length(url) % 6 + 1] AS folder FROM pages)
SELECT page_id, folder IN ('.git', 'node_modules', 'build') AS ignored FROM t
""")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_paths(spark, sf_dir).select("page_id", paths.IgnoreConfig().ignored_dir(F.col("path")).alias("ignored"))


@query("""
WITH t AS (SELECT page_id, ['src', '.git', 'node_modules', 'docs', 'build', 'a.b'][length(url) % 6 + 1] AS folder FROM pages)
SELECT page_id, folder IN ('.git', 'build', 'docs') AS ignored, folder = '.git' AS ignored_by_none FROM t
""")
def ignore_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of events under a configuration with one name more and one less, and under the empty one."""
    own = paths.IgnoreConfig().with_extra("docs").allow("node_modules")
    return _page_paths(spark, sf_dir).select("page_id", own.ignored_path(F.col("path")).alias("ignored"), paths.IgnoreConfig.empty().ignored_path(F.col("path")).alias("ignored_by_none"))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A scan of all documents but German ones, and what an older scan knew: no Spanish ones, French ones with other text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    new = docs.where("lang IS DISTINCT FROM 'de'").select("doc_id", digest(F.col("text")).alias("content_hash"))
    old = docs.where("lang IS DISTINCT FROM 'es'").select("doc_id", digest(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return new, old


@query("SELECT doc_id, CASE lang WHEN 'es' THEN 'new' WHEN 'fr' THEN 'changed' WHEN 'de' THEN 'deleted' ELSE 'unchanged' END AS change FROM documents")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.diff(*_versions(spark, sf_dir), key="doc_id", full_sync=True)


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = _versions(spark, sf_dir)
    return merge.upsert(old, new, ["doc_id"])


@query("SELECT CASE lang WHEN 'fr' THEN 'pdf' ELSE 'image' END AS file_type, count(*) AS n_files FROM documents WHERE lang IN ('fr', 'es') AND source IS NOT NULL GROUP BY 1")
def changed_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run would index, by type: French files have changed, Spanish ones are new; hashes are salted with the model."""
    scanned = _files(spark, sf_dir).select("path", paths.file_type(paths.extension(F.col("path"))).alias("file_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    known = scanned.where("file_type <> 'image'").select("path", F.sha2(F.concat("content_hash", F.when(F.col("file_type") == "pdf", "other").otherwise("asked")), 256).alias("content_hash"))
    return catalog.files_by_type(ingest.changed_files(scanned, known, "asked"))


@query("""
WITH c AS (SELECT doc_id, lang, unnest(range(0, ceil(length(text) / 700.0)::BIGINT)) AS i, text FROM documents),
     n AS (SELECT least(700, length(text) - i * 700) AS n FROM c WHERE lang IS DISTINCT FROM 'fr' OR i = 0)
SELECT 'files' AS name, count(*) AS n, sum(n_chars)::BIGINT AS total FROM documents
UNION ALL SELECT 'chunks', count(*), sum(n)::BIGINT FROM n UNION ALL SELECT 'embeddings', count(*), sum(n)::BIGINT FROM n
""")
def replace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, chunks and what hangs on them after French documents have shrunk to their first part."""
    docs = read(spark, sf_dir, "documents")

    def tables(rows: DataFrame, parts) -> dict[str, DataFrame]:
        cut = rows.select("doc_id", F.posexplode(parts).alias("i", "content"))
        chunks = cut.select(F.concat_ws(":", "doc_id", "i").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.char_length("content").cast("long").alias("total"))
        return {"files": rows.select(F.col("doc_id").alias("id"), F.col("n_chars").cast("long").alias("total")), "chunks": chunks, "embeddings": chunks.select("chunk_id", "total")}

    parts = tf.raw_parts(F.coalesce("text", F.lit("")), 700)
    shrunk = docs.where("lang = 'fr'")
    after = merge.replace_files(tables(docs, parts), tables(shrunk, F.slice(parts, 1, 1)), shrunk.select(F.col("doc_id").alias("file_id")))
    sums = [rows.agg(F.count("*").alias("n"), F.sum("total").alias("total")).select(F.lit(name).alias("name"), "n", "total") for name, rows in after.items()]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as files, their orders as chunks, the orders' lines as what hangs on chunks."""
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    chunks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("file_id"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_quantity")
    return {"files": files, "chunks": chunks, "embeddings": lines}


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM gone))
SELECT 'files' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT * FROM gone)
UNION ALL SELECT 'chunks', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT * FROM o)
UNION ALL SELECT 'embeddings', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT * FROM o)
""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _tables(spark, sf_dir)
    gone = tables["files"].where("c_mktsegment = 'BUILDING'").select(F.col("id").alias("file_id"))
    out = None
    for name, rows in merge.delete_files(tables, gone).items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"SELECT file_type, count(*) AS n_files FROM (SELECT {_SQL_TYPE} AS file_type FROM ({_SQL_FILES})) GROUP BY 1")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.files_by_type(_files(spark, sf_dir).select(paths.file_type(paths.extension(F.col("path"))).alias("file_type")))


@query("SELECT count(*) AS total_files, count(*) AS total_chunks, sum(strlen(coalesce(text, '')))::BIGINT AS index_size_bytes FROM documents")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select(paths.file_type(paths.extension(F.col("path"))).alias("file_type"))
    return catalog.stats(files, _contents(spark, sf_dir)).select("total_files", "total_chunks", F.col("index_size_bytes").cast("long").alias("index_size_bytes"))


@query(f"SELECT id, path FROM (SELECT doc_id::VARCHAR AS id, path, n_chars FROM ({_SQL_FILES})) ORDER BY n_chars DESC, id LIMIT 20 OFFSET 40")
def list_files_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "path", F.col("n_chars").alias("indexed_at"))
    return catalog.list_files(files, 20, 40).select("id", "path")


@query(f"SELECT count(*) AS n_files FROM ({_SQL_FILES}) WHERE starts_with(path, '/src1/')")
def prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_in_dir(_files(spark, sf_dir), "/src1/")


@query(f"SELECT doc_id, path FROM ({_SQL_FILES}) WHERE path = '/src3/fr/3.pdf'")
def get_file_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.get_file(_files(spark, sf_dir), path="/src3/fr/3.pdf").select("doc_id", "path")


@query("SELECT conv_id, turn, role, substring(coalesce(text, ''), 1, 120) AS preview FROM conversations WHERE conv_id = 1 ORDER BY turn")
def chunks_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), "conv_id", F.col("turn").alias("chunk_index"), "role", tf.preview_line(F.coalesce("text", F.lit(""))).alias("preview"))
    return catalog.chunks_of(turns, "1").select("conv_id", F.col("chunk_index").alias("turn"), "role", "preview")


@query("SELECT e.vec_id AS doc_id, len(e.embedding)::INTEGER AS dim, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def embeddings_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with what their chunks, documents here, say of themselves."""
    emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("dim"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    return catalog.with_chunks(emb, docs).select(F.col("chunk_id").alias("doc_id"), "dim", "lang", "source")


@query("SELECT e.vec_id AS doc_id, d.lang FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 3 <> 1")
def embeddings_of_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of 64 numbers alone, where a third has 32."""
    emb = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    return catalog.with_chunks(emb, docs, 64).select(F.col("chunk_id").alias("doc_id"), "lang")


# --- events ----------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("op"), "ts")


@query("""
WITH e AS (SELECT user_id::VARCHAR AS path, event_type AS op, ts FROM events),
     g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY path ORDER BY ts, op) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS starts FROM e),
     s AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY ts, op ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(op, (ts, op)) AS op, count(*) AS n_events FROM s GROUP BY path, burst
""")
def debounce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a gap of an hour: events of a user are that far apart."""
    out = debounce(_events(spark, sf_dir), "1 hour")
    return out.select("path", F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "op", "n_events")


@query("SELECT user_id::VARCHAR AS path, arg_max(event_type, (ts, event_type)) AS op, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1")
def latest_event_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_events(spark, sf_dir)).select("path", "op", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
