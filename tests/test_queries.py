"""Queries against their SQL in DuckDB, on tables that the given ones don't look like."""

from collections import Counter

import duckdb

import __spark_entry__


def both(spark, folder, name, **tables):
    """The query's rows and those of its SQL, counted; tables have rows and a schema."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder)).collect()
    return Counter(map(tuple, got)), Counter(con.sql(__spark_entry__.oracle_sql()[name]).fetchall())


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_brief_gaps_where_related_links_lead_to_parts(spark, tmp_path):
    sizes = {1: 1, 2: 30, 3: 25, 4: 10, 7: 40, 8: 40, 100001: 26, 100002: 1, 100003: 50}
    part = [(k, f"n{k % 2}", "b", "t", size, 990.0 + k % 20) for k, size in sizes.items()]
    got, want = both(spark, tmp_path, "brief_gaps_in_full", part=(part, PART))
    assert got == want and {kind for kind, *_ in want} >= {"replaced-outside", "contradiction", "no-sources", "stale", "deprecated", "port-without-producer"}
