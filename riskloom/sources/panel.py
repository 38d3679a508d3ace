"""A credit-account panel derived from the sales tables.

One statement serves both Spark and the SQL check, so its text is kept as a constant.  The
score is rounded to four places by ``floor``, since engines differ in how ``round`` breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BILL_SIGN = "CASE WHEN c_custkey%13=0 THEN -1 ELSE 1 END"


def _month_sums(amount: str, date: str, prefix: str) -> str:
    return ",\n    ".join(
        f"SUM(CASE WHEN (month({date})-1)%6={m} THEN CAST(round({amount}*100) AS BIGINT) ELSE 0 END) AS {prefix}{m + 1}"
        for m in range(6)
    )


def _amounts(sign: str, prefix: str, name: str) -> str:
    return ",\n  ".join(
        f"CAST({sign}coalesce({prefix}{m},0) AS DOUBLE)/CAST(100 AS DOUBLE) AS {name}{m}" for m in range(1, 7)
    )


PANEL_SQL = f"""
SELECT c_custkey AS ID,
  CAST((c_custkey%20)*25000 AS DOUBLE) AS LIMIT_BAL,
  CAST(1+c_custkey%2 AS INT) AS SEX,
  CAST(c_custkey%7 AS INT) AS EDUCATION,
  CAST(c_nationkey%4 AS INT) AS MARRIAGE,
  CAST(21+(c_custkey*7)%55 AS INT) AS AGE,
  CAST((c_custkey*3)%11-2 AS INT) AS PAY_0,
  CAST((c_custkey*5)%11-2 AS INT) AS PAY_2,
  CAST((c_custkey*7)%11-2 AS INT) AS PAY_3,
  CAST((c_custkey*13)%11-2 AS INT) AS PAY_4,
  CAST((c_custkey*17)%11-2 AS INT) AS PAY_5,
  CAST((c_custkey*19)%11-2 AS INT) AS PAY_6,
  {_amounts(f"({BILL_SIGN})*", "b", "BILL_AMT")},
  {_amounts("", "p", "PAY_AMT")},
  CASE WHEN c_acctbal<1500 THEN 1 ELSE 0 END AS default_flag,
  CAST(floor(((CAST(10000 AS DOUBLE)-c_acctbal)/CAST(22000 AS DOUBLE)
        + CAST((c_custkey*7919)%1000 AS DOUBLE)/CAST(2000 AS DOUBLE))*CAST(10000 AS DOUBLE)+CAST(0.5 AS DOUBLE)) AS DOUBLE)
        /CAST(10000 AS DOUBLE) AS score,
  CAST(c_custkey%5 AS INT) AS fold,
  CAST(((c_custkey-c_custkey%2)/2)%2 AS INT) AS period
FROM {{customer}} AS c
LEFT JOIN (SELECT o_custkey,
    {_month_sums("o_totalprice", "o_orderdate", "b")}
  FROM {{orders}} AS o GROUP BY o_custkey) b ON c_custkey=o_custkey
LEFT JOIN (SELECT o_custkey AS pk,
    {_month_sums("l_extendedprice", "l_shipdate", "p")}
  FROM {{lineitem}} AS l JOIN {{orders}} AS o ON l_orderkey=o_orderkey
  WHERE l_returnflag='A' GROUP BY o_custkey) p ON c_custkey=pk
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def credit_panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per account with the raw client columns, a label and a synthetic score."""
    tables = {name: table(spark, folder, name) for name in ("customer", "orders", "lineitem")}
    return spark.sql(PANEL_SQL, **tables)


def panel_sql() -> str:
    """The same panel over views named like the tables."""
    return PANEL_SQL.format(customer="customer", orders="orders", lineitem="lineitem")
