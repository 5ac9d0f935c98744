"""Near duplicates of a whole table against SQL that compares all pairs with a shingle in common."""

import duckdb

from tickframe.llm import queries


def test_near_duplicates_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    rel = con.sql(queries.ORACLES["op8_near_duplicates"])
    got = queries.op8_near_duplicates(spark, sf_dir).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and any(not r.kept for r in got)
