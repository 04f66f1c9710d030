"""delivered_csv against its SQL where the file is read in many blocks, and on odd rows."""

from __future__ import annotations

import duckdb
import pytest

from hourloom.operators import results
from hourloom.plans import catalog


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def compared(spark, con, at):
    con.execute(f"create view orders as select * from '{at}/orders.parquet'")
    want = con.execute(f"select row_id, id, p::varchar from ({catalog.ORACLES['delivered_csv']}) order by all").fetchall()
    rows = catalog.QUERIES["delivered_csv"](spark, str(at)).select("row_id", "id", "p").collect()
    con.execute("create table got (row_id bigint, id bigint, p double)")
    con.executemany("insert into got values (?, ?, ?)", [tuple(r) for r in rows])
    assert con.execute("select row_id, id, p::varchar from got order by all").fetchall() == want
    return want


def test_a_file_of_many_blocks_loses_no_row(spark, tmp_path, small_blocks):
    con = duckdb.connect()
    con.execute(f"copy (select * from '/root/testdata/sf0.001/orders.parquet') to '{tmp_path}/orders.parquet' (format parquet)")
    assert len(compared(spark, con, tmp_path)) == 1500


def test_missing_dates_and_ids_ids_that_occur_twice_and_nan(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""copy (select * from (values (1::bigint, timestamp '1998-03-01', 100000.0::double), (2, null, 5000.0), (null, timestamp '1998-01-01', 7000.0), (4, timestamp '1998-02-01', 'nan'::double),
      (5, timestamp '1998-05-01', 1000.0), (5, timestamp '1998-04-01', 2000.0), (6, timestamp '1998-12-01', null), (13, timestamp '1998-06-01', 9000.0)) as v(o_orderkey, o_orderdate, o_totalprice),
      (select '1-URGENT' as o_orderpriority)) to '{tmp_path}/orders.parquet' (format parquet)""")
    assert len(compared(spark, con, tmp_path)) == 10


def test_lines_follow_the_file(spark, tmp_path, small_blocks):
    rows = spark.range(5000).selectExpr("id + 1 AS row_id", "5000 - id AS x")
    at = f"file://{tmp_path}/lines"
    results.write_csv(rows, at)
    got = results.read_csv_lines(spark, at, "x long")
    assert got.count() == 5000 and got.filter("_line + x <> 5001").isEmpty()
