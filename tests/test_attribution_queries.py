"""The attribution queries explain what they say they do."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from registry.common import panel
from riskloom import vocab as v
from riskloom.operators import attribution

FOLDER = "/root/testdata/sf0.001"


def test_every_row_has_its_top_features(spark):
    found = contract.queries()["top_attributions_per_row"](spark, FOLDER)
    rows = panel(spark, FOLDER)
    per_row = found.groupBy("ID").agg(F.collect_set("position").alias("at"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per_row) == rows.count() > 100
    assert all(sorted(r["at"]) == [1, 2, 3, 4, 5] and r["n"] == 5 for r in per_row)


def test_ranking_has_the_documented_sizes(spark, monkeypatch):
    sizes, run = [], attribution.shapley

    def seen(rows, background, *rest, **options):
        sizes.append((rows.count(), background.count()))
        return run(rows, background, *rest, **options)

    monkeypatch.setattr(attribution, "shapley", seen)
    assert contract.queries()["shapley_ranking"](spark, FOLDER).count() == len(v.MODEL_FEATURES) == 36
    assert sizes == [(100, 50)]
