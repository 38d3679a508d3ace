"""Message texts and nested-to-flat projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drift_title(feature: Column) -> Column:
    return F.format_string("Data Drift Detected: %s", feature)


def drift_message(score: Column, threshold: Column) -> Column:
    return F.format_string(
        "Drift score (%.4f) exceeds threshold (%.4f). Consider retraining the model.", score, threshold
    )


def performance_title(metric: Column) -> Column:
    return F.format_string("Model Performance Degradation: %s", metric)


def performance_message(metric: Column, current: Column, degradation: Column, expected: Column) -> Column:
    return F.format_string(
        "Current %s (%.4f) is %.1f%% below expected (%.4f). Investigate immediately.",
        metric, current, degradation, expected,
    )


# fixed values: sign shown per severity
SEVERITY_SIGNS = {"info": "ℹ️", "warning": "⚠️", "error": "❌", "critical": "🚨"}
UNKNOWN_SIGN = "📢"


def _listing(title: str, entries: Column) -> Column:
    lines = F.transform(
        F.array_sort(F.map_entries(entries)),
        lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"], F.lit("\n")),
    )
    text = F.concat(F.lit(f"\n**{title}:**\n"), F.array_join(lines, ""))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, text).otherwise("")


def alert_body(
    title: Column, message: Column, severity: Column, timestamp: Column, metrics: Column, metadata: Column
) -> Column:
    """Full message of an alert row, its metric and metadata maps listed by key."""
    signs = F.create_map(*[F.lit(x) for pair in SEVERITY_SIGNS.items() for x in pair])
    sign = F.coalesce(F.try_element_at(signs, severity), F.lit(UNKNOWN_SIGN))
    return F.concat(
        sign, F.lit(" **"), title, F.lit("**\n\n"), message, F.lit("\n\n**Timestamp:** "), timestamp,
        F.lit("\n**Severity:** "), F.upper(severity), F.lit("\n"),
        _listing("Metrics", metrics), _listing("Metadata", metadata),
    )


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested struct fields as top-level columns; values that are not numbers become strings."""
    def leaves(schema: T.StructType, path: list[str]):
        for field in schema.fields:
            here = path + [field.name]
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                value = F.col(".".join(f"`{p}`" for p in here))
                plain = isinstance(field.dataType, (T.NumericType, T.BooleanType))
                text = value if isinstance(field.dataType, T.StringType) else value.cast("string")
                yield (value if plain else text).alias(separator.join(here))

    return df.select(*leaves(df.schema, []))
