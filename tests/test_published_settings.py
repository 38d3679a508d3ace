"""Registered queries run with the published settings: nothing is fitted here, only what is asked for is looked at."""

import inspect

import pytest

import __spark_entry__ as contract
from riskloom.operators import resampling
from riskloom.plans import training

FOLDER = "/root/testdata/sf0.001"
ASKED = {
    "train_gradient_boosting": (training, "estimator"), "train_random_forest": (training, "estimator"),
    "feature_importance": (training, "estimator"), "batch_scoring_with_saved_model": (training, "estimator"),
    "reference_scores": (training, "estimator"), "cross_calibrated_scores": (training, "cross_calibrated_scores"),
    "parameter_search": (training, "search"), "bootstrap_intervals_order_lines": (resampling, "bootstrap_intervals"),
}


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ASKED)
def test_published_settings(spark, monkeypatch, name):
    module, function = ASKED[name]
    signature = inspect.signature(getattr(module, function))

    def asked(*given, **options):
        raise Asked(signature.bind(*given, **options).arguments)

    monkeypatch.setattr(module, function, asked)
    with pytest.raises(Asked) as caught:
        contract.queries()[name](spark, FOLDER)
    arguments = caught.value.args[0]
    assert not arguments.get("settings") and not arguments.get("fixed")
    assert not {"trials", "k"} & set(arguments)
    if function == "bootstrap_intervals":
        assert arguments["replicates"] == 1000
