import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 1
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)


def test_flagship_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    res = con.execute(entry.oracle_sql()["a11_summary"])
    want = dict(zip([d[0] for d in res.description], res.fetchall()[0]))
    assert entry.queries()["a11_summary"](spark, SF).first().asDict() == want
