"""Lines whose numbers lie half way between two integers, against DuckDB's casts."""

import datetime

import __spark_entry__ as entry


def test_proposal_errors_of_halves(spark, tmp_path):
    """F4 of round 3: 10000.5 was taken for 10001, which is an error, where the SQL's cast makes it 10000."""
    import duckdb

    day = datetime.datetime(2024, 1, 1)
    halves = [(1.5, 10000.5), (2.5, 10001.5), (3.0, 9999.5), (4.5, 22000.5), (5.0, 34000.5), (23.5, 1.0), (0.5, 2.5)]
    rows = [(i, i, i, 1, q, p, 0.0, 0.0, "N", "O", day) for i, (q, p) in enumerate(halves)]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["proposal_errors"]).fetchall()
    got = entry.queries()["proposal_errors"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
