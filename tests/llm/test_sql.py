"""Queries of this package that have SQL, against it, at the smallest scale."""

import os

import pytest

pytest.importorskip("framewright.llm")

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_divergence", "base_counts", "source_targets", "unigram_scores", "media_payloads"])
def test_query_equals_sql(spark, name):
    import duckdb

    from framewright.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got and got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
