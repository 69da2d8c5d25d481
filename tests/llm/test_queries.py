"""The registered queries against their SQL."""

import pytest

from quarry.llm import queries

TABLES = ("documents", "pages", "benchmark")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, f"/root/testdata/{sf}")
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (sorted(str(tuple(r)) for r in rows) for rows in (got.select(*columns).collect(), want.select(", ".join(columns)).fetchall()))
    assert len(a) > 0 and a == b


def test_names():
    assert sorted(n for n in queries.queries() if n.startswith("op")) == sorted(f"op{i}_{x}" for i, x in enumerate("exact_dedup sentencepiece license_scan secret_scan url_filter decontamination language_id near_dedup warc token_files".split(), 1))
