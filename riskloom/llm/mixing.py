"""Mixing sources to target weights by repeating documents.

Words per source are summed, a budget is shared among the sources by weight, and each source
gets a repetition rate = target / size.  A document is emitted floor(rate) times and once more
if a hash of its id and the seed, read as a number in [0, 1), is below the fraction.

Defined results: a null text has size 0; a null source is a source of its own, ranked last; a
null id draws as the text 'null' would; rows that repeat an id draw alike; an empty table
gives an empty result; other columns stay untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spread import lookup, numbered
from riskloom.runtime import pin

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 42


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def source_targets(
    sized: DataFrame, source: str = "source", size: str = "size",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS,
) -> DataFrame:
    """One row per source: its rows, size, target and rate.

    Sources in order of their names, null last, take the weights in turn.  ``share`` times
    the total size is shared by weight; a source whose share passes ``most_repeats`` times
    its size stops there and the excess is shared among the others, until none is above.
    """
    sums = sized.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("source_size")
    )
    ranked = numbered(sums, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = pin(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most_repeats))
    budget = share * (table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:  # each turn stops more sources; it ends when none is added
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n_full, held, open_weight = table.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        rise = (budget - held) / open_weight if open_weight else level
        if rise <= level:
            break
        level = rise
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return table.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ).select("source", "n_rows", "source_size", "target", "rate")


def with_copies(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` with ``__size`` and ``__target`` of their source and ``__copies`` to emit."""
    table = targets.select(
        F.col("source").alias(source), "n_rows", F.col("source_size").alias("__size"),
        F.col("target").alias("__target"), F.col("rate").alias("__rate"),
    )
    whole = F.floor("__rate")
    more = (draw(F.col(key), seed) < F.col("__rate") - whole).cast("bigint")
    return lookup(docs, table, [source], "n_rows").withColumn("__copies", whole + more).drop("__rate")


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its source's rate and its own draw say."""
    sized = pin(docs.select("source", n_words(F.col(text)).alias("size")))
    chosen = with_copies(docs, source_targets(sized, **options))
    turns = F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).otherwise(F.array())
    return chosen.withColumn("__turn", F.explode(turns)).select(*docs.columns)


def mixing_report(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes."""
    sized = pin(docs.select("doc_id", "source", n_words(F.col(text)).alias("size")))
    return with_copies(sized, source_targets(sized, **options)).select(
        "doc_id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("size") * F.col("__copies")).alias("taken"), "source", F.col("__copies").alias("copies"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, sum(2 * source_size) OVER o AS capped, sum(w) OVER o AS weighed,
  1.5e0 * sum(source_size) OVER () AS budget, sum(w) OVER () AS weights, row_number() OVER o AS place
  FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, (budget - (capped - cap)) / CAST(weights - (weighed - w) AS DOUBLE) AS level FROM c),
stop AS (SELECT min(place) AS place FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, CASE WHEN l.place < coalesce(stop.place, l.place + 1) THEN CAST(cap AS DOUBLE)
  ELSE (SELECT level FROM l WHERE place = (SELECT place FROM stop)) * w END AS target FROM l, stop),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('42:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM k
"""
