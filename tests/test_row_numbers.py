import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom import registry
from gridloom.operators import windowing


def test_rows_are_numbered_alike_wherever_they_are_computed(spark):
    """More rows than a range partitioning samples, and columns beside the order that are pruned where rows are counted."""
    n = 600_011
    df = spark.range(0, n, 1, 7).select((F.col("id") * 7919 % n).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("rest"))
    out = windowing.row_index(df, "k")
    assert out.agg(F.count("*"), F.count_if(F.col("row") == F.col("k")), F.count("rest")).first() == (n, n, n)


def test_rows_are_numbered_by_several_columns_of_any_type(spark):
    rows = [(a, None if b == 3 else b / 2, dt.datetime(2020, 1, 1) + dt.timedelta(hours=c)) for a in "xyz" for b in range(8) for c in range(9)]
    df = spark.createDataFrame(rows[::-1], "a string, b double, c timestamp").repartition(5)
    found = windowing.row_index(df, "a", "b", "c").orderBy("row").collect()
    assert [r.row for r in found] == list(range(len(rows)))
    assert [(r.a, r.b, r.c) for r in found] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert windowing.row_index(df.limit(0), "a", "b").count() == 0


def test_page_totals_of_many_files_equal_sql(spark, tmp_path):
    (tmp_path / "orders.parquet").mkdir()
    for i in range(6):
        rows = f"SELECT (i * 7919 % 600011)::BIGINT AS o_orderkey, (i % 977)::DOUBLE / 4 AS o_totalprice FROM range(600011) r(i) WHERE i % 6 = {i}"
        duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/orders.parquet/{i}.parquet' (ROW_GROUP_SIZE 20000)")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = duckdb.sql(registry.SQL["w_page_totals"] + " ORDER BY 1").fetchall()
    assert [tuple(r) for r in registry.QUERIES["w_page_totals"](spark, str(tmp_path)).orderBy("page").collect()] == want


@pytest.mark.parametrize("key", ["i * 7919 % 60013", "nullif(i * 7919 % 60013, 77)"])
def test_page_totals_of_half_cents_and_a_missing_key_equal_sql(spark, tmp_path, key):
    (tmp_path / "orders.parquet").mkdir()
    con = duckdb.connect(config={"threads": 1})  # several threads add up parts of a page
    for i in range(3):
        rows = f"SELECT ({key})::BIGINT AS o_orderkey, (i * 104729 % 49900000) / 100.0::DOUBLE + 0.005 * (i % 3) AS o_totalprice FROM range(60013) r(i) WHERE i % 3 = {i}"
        con.sql(f"COPY ({rows}) TO '{tmp_path}/orders.parquet/{i}.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.sql(registry.SQL["w_page_totals"] + " ORDER BY 1").fetchall()
    assert [tuple(r) for r in registry.QUERIES["w_page_totals"](spark, str(tmp_path)).orderBy("page").collect()] == want


def test_number_text_of_large_keys_equals_sql(spark, tmp_path):
    keys = "[0, 6544, 876543, 876544, 876545, 1199999, 8123456, 9876543, 9876544, 98765432, 99876544, 987654321]"
    duckdb.sql(f"COPY (SELECT unnest({keys})::BIGINT AS p_partkey, 'x' AS p_name, 'y' AS p_brand, 7 AS p_size, 1.5::DOUBLE AS p_retailprice) TO '{tmp_path}/part.parquet'")
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = duckdb.sql(registry.SQL["f_number_text"] + " ORDER BY 1").fetchall()
    got = registry.QUERIES["f_number_text"](spark, str(tmp_path)).select("p_partkey", "million", "long", "small").orderBy("p_partkey").collect()
    assert [tuple(r) for r in got] == want
