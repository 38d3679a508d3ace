"""Fold stability and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import vocab as v
from riskloom.functions.decisions import ratio, stability_label
from riskloom.operators.classifier import classification_metrics, score_points, to_long
from riskloom.operators.ordered import quantiles, running_totals, small_side
from riskloom.runtime import pin

STABILITY_METRICS = ["recall", "precision", "f1", "auc_roc"]


def fold_metrics(
    df: DataFrame, fold: str = "fold", threshold: float = v.DECISION_THRESHOLD, score: str = "score",
    label: str = v.TARGET,
) -> DataFrame:
    """Rows (fold, recall, precision, f1, auc_roc), all folds in one job."""
    return classification_metrics(df, [threshold], score, label, [fold]).select(fold, *STABILITY_METRICS)


def fold_stability(per_fold: DataFrame, metrics: Sequence[str] = tuple(STABILITY_METRICS)) -> DataFrame:
    """Rows (metric, mean, std, cv, label) over folds, with n-1 deviation."""
    rows = to_long(per_fold, metrics).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0)
    return rows.withColumn("cv", cv).withColumn("label", stability_label(F.col("cv")))


CELLS_PER_TASK = 4_000
CHILDREN = 1_000  # blocks below a node of the tree
REPLICATES_PER_TASK = 50


def bootstrap_replicates(
    df: DataFrame, replicates: int = 1000, threshold: float = v.DECISION_THRESHOLD, seed: int = 42,
    score: str = "score", label: str = v.TARGET, cells_per_task: int = CELLS_PER_TASK, children: int = CHILDREN,
) -> DataFrame:
    """Rows (replicate, recall, precision, f1, auc_roc) of resamples of full size.

    Drawing n rows with replacement equals one multinomial draw of size n over the counts of
    the distinct (score, label) cells, and multinomials nest.  The cells, in score order, are
    cut into blocks of ``cells_per_task``; every ``children`` blocks in a row have a parent,
    and so on up to one root, in as many levels as it takes.  Each node shares its rows of a
    replicate out to its children, and each block draws its own cells for all replicates, so
    no task holds more than ``children`` nodes or ``cells_per_task`` cells and no cell is
    copied.  Counts go back up the same tree.  Draws are seeded by (seed, replicate, level,
    node), and nodes follow from the order of the cells, so neither depends on partitioning.
    An empty table has no replicates.
    """
    if cells_per_task < 1 or children < 2:
        raise ValueError("a block takes at least one cell, a node at least two children")
    points = score_points(df, score, label).withColumn("cells", F.lit(1).cast("bigint"))
    cells = pin(running_totals(points, "score", ["cells"]).select(
        F.floor(F.col("cells_below") / cells_per_task).alias("node"), "score", "pos", "neg"
    ))
    levels = [pin(cells.groupBy("node").agg(F.sum(F.col("pos") + F.col("neg")).alias("weight")))]
    parent = F.floor(F.col("node") / children)
    while levels[-1].count() > 1:
        levels.append(pin(levels[-1].groupBy(parent.alias("node")).agg(F.sum("weight").alias("weight"))))

    ids = df.sparkSession.range(replicates).select(F.col("id").alias("replicate"))
    draws = ids.crossJoin(small_side(levels[-1])).select("node", "replicate", F.col("weight").alias("draws"))
    for height in range(len(levels) - 2, -1, -1):
        draws = _share_out(levels[height].withColumn("parent", parent), draws, seed, height + 1)
    counts = _draw_blocks(cells, draws, threshold, seed)
    for _ in levels[1:]:
        counts = _fold_up(counts, parent)
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("p")
    return counts.select(
        "replicate", ratio(tp, p).alias("recall"), ratio(tp, tp + fp).alias("precision"),
        ratio(2 * tp, p + tp + fp).alias("f1"), F.try_divide("wins", p * F.col("n")).alias("auc_roc"),
    )


def _share_out(nodes: DataFrame, draws: DataFrame, seed: int, level: int) -> DataFrame:
    """Rows (node, replicate, draws): the draws of each parent shared out to its children."""
    part = F.floor(F.col("replicate") / REPLICATES_PER_TASK).alias("part")
    families = draws.groupBy(F.col("node").alias("parent"), part).agg(
        F.collect_list(F.struct("replicate", "draws")).alias("plan")  # at most REPLICATES_PER_TASK of them
    )

    def share(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("node")
        weights = pdf["weight"].to_numpy(float)
        weights = weights / weights.sum()
        parent, out = int(pdf["parent"].iloc[0]), []
        for at in pdf["plan"].iloc[0]:
            draw = np.random.default_rng([seed, int(at["replicate"]), level, parent])
            drawn = draw.multinomial(int(at["draws"]), weights)
            out.append(pd.DataFrame({"node": pdf["node"].to_numpy(), "replicate": at["replicate"], "draws": drawn}))
        return pd.concat(out)

    return nodes.join(families, "parent").groupBy("parent", "part").applyInPandas(
        share, "node bigint, replicate bigint, draws bigint"
    )


def _draw_blocks(cells: DataFrame, draws: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Counts (node, replicate, p, n, tp, fp, wins) of what each block draws for each replicate."""

    def draw_block(key, block, plan):
        import numpy as np
        import pandas as pd

        block, node = block.sort_values("score"), int(key[0])
        pos, neg = block["pos"].to_numpy(float), block["neg"].to_numpy(float)
        weights = np.concatenate([pos, neg])
        weights = weights / weights.sum()
        called = block["score"].to_numpy(float) >= threshold
        out = []
        for replicate, size in zip(plan["replicate"], plan["draws"]):
            draw = np.random.default_rng([seed, int(replicate), 0, node])
            counts = draw.multinomial(int(size), weights).astype(float)
            p, n = counts[: len(pos)], counts[len(pos):]
            below = np.cumsum(n) - n
            out.append((node, replicate, p.sum(), n.sum(), p[called].sum(), n[called].sum(), (p * (below + n / 2)).sum()))
        return pd.DataFrame(out, columns=["node", "replicate", "p", "n", "tp", "fp", "wins"])

    return cells.groupBy("node").cogroup(draws.groupBy("node")).applyInPandas(
        draw_block, "node bigint, replicate bigint, p double, n double, tp double, fp double, wins double"
    )


def _fold_up(counts: DataFrame, parent) -> DataFrame:
    """Counts of the parents; a positive also wins against the negatives of earlier siblings."""
    family = counts.withColumn("parent", parent)
    earlier = Window.partitionBy("parent", "replicate").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    chained = family.withColumn("wins", F.col("wins") + F.col("p") * F.coalesce(F.sum("n").over(earlier), F.lit(0.0)))
    return chained.groupBy(F.col("parent").alias("node"), "replicate").agg(
        *[F.sum(c).alias(c) for c in ("p", "n", "tp", "fp", "wins")]
    )


def percentile_intervals(
    replicates: DataFrame, metrics: Sequence[str] = tuple(STABILITY_METRICS), level: float = 0.95
) -> DataFrame:
    """Rows (metric, mean, low, high) from the replicate table."""
    tail = (1 - level) / 2
    ends = quantiles(replicates, metrics, [tail, 1 - tail]).select(
        F.col("feature").alias("metric"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high")
    )
    means = to_long(replicates, metrics).groupBy("metric").agg(F.avg("value").alias("mean"))
    return means.join(F.broadcast(ends), "metric").select("metric", "mean", "low", "high")


def bootstrap_intervals(df: DataFrame, replicates: int = 1000, **options) -> DataFrame:
    """95 % percentile intervals of recall, precision, F1 and AUC."""
    return percentile_intervals(pin(bootstrap_replicates(df, replicates, **options)))  # drawn once, one row each
