"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.decontaminate import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.language import identify_languages
from quarry.llm.licenses import BASE_PHRASES, scan_licenses
from quarry.llm.near_dedup import Rule, near_dedup
from quarry.llm.pieces import encode_pieces
from quarry.llm.secrets import BASE, scan_secrets
from quarry.llm.token_files import token_corpus
from quarry.llm.urls import RULES, filter_urls
from quarry.llm.warc import round_trip


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digests=True)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents")).drop("expressions")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("items", "spans")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"), Rule(shingle=3, percent=85, words="space"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_corpus(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


# what SQL can say of the operators whose method it can't: the same rows, some columns


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that a rule judges."""
    return op5_url_filter(spark, sf_dir).where("rule IS NOT NULL").select("page_id", "host", "path", "rule", "verdict")


COMPANIONS = (license_base, secret_base, url_rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if callable(f) and (name.startswith("op") or f in COMPANIONS)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

SQL_OP1 = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256
FROM t
"""

_PHRASES = " UNION ALL ".join(f"SELECT {p.split()} AS p, '{label}' AS label" for p, label in BASE_PHRASES.items())
SQL_LICENSE_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
     hits AS (SELECT r, i - 1 AS i, label FROM (SELECT r, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, ({_PHRASES})) WHERE w[i : i + len(p) - 1] = p),
     found AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found USING (r)
"""


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
    SELECT r, '{kind}' AS kind, list_sum(list_transform(gaps[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS size, length(g[i]) AS n, {least} AS least
    FROM (SELECT r, gaps, m, g, unnest(range(1, len(m) + 1)) AS i FROM
          (SELECT r, regexp_split_to_array(s, '{pattern}') AS gaps, regexp_extract_all(s, '{pattern}') AS m, regexp_extract_all(s, '{pattern}', {group}) AS g FROM d WHERE regexp_matches(s, '{pattern}')))"""


_KINDS = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {i}" for i, kind in enumerate(BASE)) + " END"
SQL_SECRET_BASE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents),
     spans AS ({" UNION ALL ".join(_sql_spans(name, k.pattern, k.group, k.least) for name, k in BASE.items())}),
     found AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)},
               string_agg(kind || ':' || a || ':' || (a + size), ',' ORDER BY a, {_KINDS}) AS joined FROM (SELECT r, kind, a::BIGINT AS a, size FROM spans WHERE n >= least) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)}, sha256(coalesce(joined, '')) AS base_sha256 FROM d LEFT JOIN found USING (r)
"""

_RULES = " UNION ALL ".join(f"SELECT '{verdict}' AS verdict, '{rule}' AS rule, '{rule.partition('/')[0]}' AS h, '/{rule.partition('/')[2]}' AS p" for verdict, rule in RULES)
SQL_URL_RULES = f"""
WITH t AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
     u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
     f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS i FROM u, ({_RULES}) WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, verdict FROM f WHERE i = 1
"""

SQL_OP6 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
     b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
     windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s
                 FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     places AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
     hits AS (SELECT r, n, i, item FROM places JOIN windows USING (n, s)),
     words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, n, i FROM hits)) GROUP BY r),
     items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

SQL_OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
     pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach AS (SELECT doc_id, doc_id AS least FROM d UNION SELECT b, least FROM reach JOIN edges ON a = doc_id AND least < b)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(least) AS component_id, doc_id = min(least) AS kept FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL_OP9 = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS s FROM pages),
     h AS (SELECT page_id, s, sha1(s) AS hex, max(page_id) OVER (PARTITION BY s) AS top FROM t),
     v AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substring(hex, (5 * k + 1)::INT, 5))::BIGINT) AS groups FROM h)
SELECT page_id, strlen(s) AS payload_bytes,
       array_to_string(flatten(list_transform(groups, lambda x: list_transform([15, 10, 5, 0], lambda b: substring('{_LETTERS}', ((x >> b) & 31)::INT + 1, 1)))), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM v
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": SQL_OP1, "op6_decontamination": SQL_OP6, "op8_near_dedup": SQL_OP8, "op9_warc": SQL_OP9,
        "license_base": SQL_LICENSE_BASE, "secret_base": SQL_SECRET_BASE, "url_rules": SQL_URL_RULES,
    }
