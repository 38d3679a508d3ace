"""Shared pieces of the registered queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.sources.panel import credit_panel, panel_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

APP = f"app AS ({panel_sql()})"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL if it has one."""
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for display, so that the order of summation does not show."""
    cols = [
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    return df.select(*cols)


def rounded_sql(doubles: Sequence[str], body: str, digits: int = 6, ctes: str = "") -> str:
    """``body`` over the panel ``app``, with the named columns rounded."""
    parts = ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in doubles)
    extra = f", {ctes}" if ctes else ""
    return f"WITH {APP}{extra} SELECT * REPLACE ({parts}) FROM ({body}) AS body" if doubles \
        else f"WITH {APP}{extra} {body}"


def number(x: float) -> str:
    """A double literal both engines read back exactly."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def numbers(xs: Sequence[float]) -> str:
    return "[" + ", ".join(number(x) for x in xs) + "]"


def quantiles_sql(values: str, shares: Sequence[float]) -> str:
    """Array of linear-interpolated quantiles of a sorted list expression."""
    h = f"((len({values})-1)*p)"
    at = f"CAST(floor({h}) AS BIGINT)"
    low, high = f"{values}[{at}+1]", f"{values}[least({at}+2, len({values}))]"
    return f"list_transform({numbers(shares)}, lambda p: {low} + ({high}-{low})*({h}-floor({h})))"


def quantile_sql(values: str, share: float) -> str:
    return f"({quantiles_sql(values, [share])})[1]"


# lineitem as a large scored table: heavy score ties, three flags, months
ITEMS = (
    "items AS (SELECT l_orderkey, l_linenumber, round(l_quantity/CAST(50 AS DOUBLE),4) AS score, "
    "CAST(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS INT) AS default_flag, l_linestatus, l_returnflag, "
    "l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"
)


def scored_items(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a scored table: label is the return flag, score follows the quantity."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / 50.0, 4).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("default_flag"), "l_linestatus", "l_returnflag",
        "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a request log: value stands for latency, errors are failed requests."""
    return table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.col("value").alias("latency_ms"), "props",
    )


def plain_time(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the SQL side has them."""
    kinds = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in kinds else F.col(c) for c in df.columns])


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a quality label; the score falls with length."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return documents.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").alias("default_flag"),
        F.round(1000.0 / (F.col("n_chars") + 1000.0), 4).alias("score"),
    )


DOCS = (
    "docs AS (SELECT d.doc_id, lang, source, quality AS default_flag, "
    "round(CAST(1000 AS DOUBLE)/(n_chars+CAST(1000 AS DOUBLE)),4) AS score "
    "FROM documents d JOIN labels l ON d.doc_id=l.doc_id)"
)

panel = credit_panel
