"""Queries of the set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sets import append_databases as append
from .base import Tables, query


@query("append_databases", """SELECT p_partkey % 10 AS server_id, 'parts' AS database, p_name AS relname, p_partkey AS n_live_tup, CAST(NULL AS VARCHAR) AS last_vacuum FROM part
UNION ALL SELECT s_suppkey % 10, 'suppliers', s_name, NULL, 'v' || CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT c_custkey % 10, 'customers', c_name, CAST(c_nationkey AS BIGINT), NULL FROM customer""")
def append_databases(t: Tables):
    parts = t.part.select((F.col("p_partkey") % 10).alias("server_id"), F.lit("parts").alias("database"), F.col("p_name").alias("relname"), F.col("p_partkey").alias("n_live_tup"))
    suppliers = t.supplier.select((F.col("s_suppkey") % 10).alias("server_id"), F.lit("suppliers").alias("database"), F.col("s_name").alias("relname"),
                                  F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("last_vacuum"))
    customers = t.customer.select((F.col("c_custkey") % 10).alias("server_id"), F.lit("customers").alias("database"), F.col("c_name").alias("relname"),
                                  F.col("c_nationkey").cast("bigint").alias("n_live_tup"))
    return append([parts, suppliers, customers])
