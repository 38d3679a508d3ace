import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordered


def lists(spark, values, partitions=4):
    rows = [(g, float(x)) for g, xs in values.items() for x in xs]
    return spark.createDataFrame(rows, "g string, v double").repartition(partitions)


@pytest.mark.parametrize("carry", [(), ("n",)])
@pytest.mark.parametrize("rows", [500, 100])  # ranges of points, and ranges of ranges
def test_bucketed_totals_equal_the_single_sort(spark, carry, rows):
    draw = np.random.default_rng(0)
    # a third of the rows share one value, and most others crowd into a narrow range
    values = np.concatenate([np.full(4000, 0.12), 0.12 + draw.random(6000) * 1e-6, draw.random(2000)])
    points = lists(spark, {"x": values, None: values[::2]}).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    one = ordered.running_totals(points, "v", ["n"], ["g"], carry=carry)
    many = ordered.running_totals(points, "v", ["n"], ["g"], carry=carry, one_task_rows=rows)
    key = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)
    assert key(one) == key(many)
    assert many.where("g = 'x'").agg(F.max("n_total")).first()[0] == len(values)


def test_totals_of_ranges_are_cut_again(spark, monkeypatch):
    levels, run = [], ordered.running_totals

    def seen(points, *rest, **options):
        levels.append(points.count())
        return run(points, *rest, **options)

    monkeypatch.setattr(ordered, "running_totals", seen)
    points = spark.range(800).select(F.col("id").alias("v"), F.lit(1).alias("n"))
    rows = ordered.running_totals(points, "v", ["n"], one_task_rows=16).collect()
    assert all(r["n_below"] == r["v"] and r["n_total"] == 800 for r in rows) and len(rows) == 800
    assert len(levels) >= 3 and levels == sorted(levels, reverse=True)


def test_many_small_groups_need_no_ranges(spark):
    points = spark.range(4000).select((F.col("id") % 800).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    rows = ordered.running_totals(points, "v", ["n"], ["g"], one_task_rows=20)
    assert rows.where("n_total = 5 and n_below = (v - g) / 800").count() == 4000
    assert sorted(rows.columns) == ["g", "n", "n_below", "n_total", "v"]


@pytest.mark.parametrize("n", [1, 2, 7, 13, 999, 9000])
def test_quantiles_equal_numpy(spark, n):
    draw = np.random.default_rng(n)
    values = {"a": draw.normal(size=n), "b": np.round(draw.exponential(size=n), 1), "c": np.full(n, 3.5)}
    shares = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.975, 1.0]
    found = ordered.quantiles(lists(spark, values), ["v"], shares, ["g"]).collect()
    assert len(found) == 3
    for row in found:
        assert row["n"] == n
        assert np.allclose(row["q"], np.quantile(values[row["g"]], shares), rtol=0, atol=1e-12)


def test_quantiles_do_not_depend_on_partitioning(spark):
    values = {"a": np.random.default_rng(5).lognormal(size=20000)}
    results = [ordered.quantiles(lists(spark, values, p), ["v"], [0.1, 0.5, 0.999]).first()["q"] for p in (1, 64)]
    assert results[0] == results[1]
    assert np.allclose(results[0], np.quantile(values["a"], [0.1, 0.5, 0.999]), atol=1e-12)


def test_quantiles_skip_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert ordered.quantiles(df, ["v"], [0.5]).first()["q"] == [2.0]


def test_approximate_quantiles_are_close(spark):
    df = lists(spark, {"a": np.arange(10000)})
    assert abs(ordered.quantiles(df, ["v"], [0.5], method="approx").first()["q"][0] - 5000) <= 5
    with pytest.raises(ValueError):
        ordered.quantiles(df, ["v"], [0.5], method="other")


def test_hot_value_is_one_point(spark):
    df = lists(spark, {"a": [1.0] * 5000 + [2.0] * 5000 + list(np.arange(5000) + 3)})
    q = ordered.quantiles(df, ["v"], [0.1, 0.4, 0.6]).first()["q"]
    assert q[0] == 1.0 and q[1] == 2.0 and q[2] == 2.0
