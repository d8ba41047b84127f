"""Registered model queries run at the default budgets."""

import pytest
from conftest import SMALL

from riskweave.catalog import QUERIES, model_queries
from riskweave.models import detector
from riskweave.options import VELOCITY_WINDOWS, Options


class Seen(Exception):
    pass


FITS = {
    "m1_boosted_trees": "gbt",
    "m2_boosted_trees_shallow": "gbt_shallow",
    "m2_boosted_trees_deep": "gbt_deep",
    "m4_alternative_ensemble": "forest",
    "m10_calibration_report": "gbt",
    "m11_model_grid": "gbt",
    "m12_booster_comparison": "gbt",
    "m13_attribution_ranking": "gbt",
    "m14_attribution_additivity": "gbt",
    "m16_round_trip": "gbt_shallow",
    "a5_priced_calibrated_scores": "gbt",
    "e1_train_and_evaluate": "gbt",
    "e3_rolling_origin_report": "gbt",
}


@pytest.mark.parametrize("name", FITS)
def test_first_fit_has_all_rounds(spark, monkeypatch, name):
    def fit(train, model="gbt", seed=42, rounds=200, learning_rate=0.1):
        raise Seen(model, rounds, learning_rate)

    def fit_all(train, settings, seed=42):
        raise Seen(*settings[0])

    monkeypatch.setattr(detector, "fit", fit)
    monkeypatch.setattr(detector, "fit_all", fit_all)
    with pytest.raises(Seen) as seen:
        # the smallest tables have too few days for folds
        QUERIES[name](spark, SMALL.replace("sf0.001", "sf0.01") if name.startswith("e3") else SMALL)
    assert seen.value.args == (FITS[name], Options().rounds, Options().learning_rate)


def test_comparison_has_all_windows_and_resamples(spark, monkeypatch):
    def compare(tx, variants, windows, options):
        raise Seen(windows, options)

    monkeypatch.setattr(model_queries, "events_tx", lambda *a: None)
    monkeypatch.setattr(model_queries, "compare_variants", compare)
    with pytest.raises(Seen) as seen:
        QUERIES["m11_comparison_plan"](spark, SMALL)
    assert seen.value.args == (VELOCITY_WINDOWS, Options())
