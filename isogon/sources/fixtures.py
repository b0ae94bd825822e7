"""Survey-shaped views over the star-schema test tables. They give the operators
deterministic input; what comes out has no physical meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: name: (table, select list); the same text for Spark and DuckDB.
VIEWS = {
    "survey_points": ("lineitem", [f"row_number() OVER (ORDER BY {KEY}) AS id", "(l_partkey % 100) * CAST(0.5 AS DOUBLE) AS x", "(l_suppkey % 80) * CAST(0.5 AS DOUBLE) AS y", "CAST(l_extendedprice AS DECIMAL(18,2)) AS v"]),
    "survey_track": ("events", ["user_id % 8 AS line_id", "event_id AS seq", "CAST(value AS DECIMAL(18,4)) AS v"]),
    "anomaly_grid": ("part", [
        "CAST(round((110 + (p_partkey % 60) / CAST(30 AS DOUBLE)) * 30) AS BIGINT) * 5400 + CAST(round((90 - (17 + floor(p_partkey / CAST(60 AS DOUBLE)) / 30)) * 30) AS BIGINT) AS index_ij",
        "110 + (p_partkey % 60) / CAST(30 AS DOUBLE) AS lon", "17 + floor(p_partkey / CAST(60 AS DOUBLE)) / 30 AS lat", "p_retailprice AS value"]),
    "query_points": ("supplier", ["s_suppkey AS id", "110 + s_suppkey * CAST(0.0323 AS DOUBLE) AS lon", "17 + s_suppkey * CAST(0.0071 AS DOUBLE) AS lat"]),
    "order_points": ("orders", ["o_orderkey AS id", "(o_custkey % 100) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x", "(o_orderkey % 80) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS y", "CAST(o_totalprice AS DECIMAL(18,2)) AS v"]),
    "file_catalog": ("orders", ["o_orderkey AS id", "o_orderstatus AS datatype", "o_orderpriority AS platform", "o_totalprice AS max_x", "o_orderdate AS time"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def sql(*names: str) -> str:
    """WITH clause for the oracle."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names) + " "
