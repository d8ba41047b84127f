"""Operating points priced on calibrated scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.curves import price_curve, price_scenarios, review_curve
from riskweave.options import COST_GRID, Options
from riskweave.plans.training import calibration_report
from riskweave.session import store


@dataclass(frozen=True)
class PricedPoints:
    curve: DataFrame  # expected cost per scenario and threshold
    cheapest: DataFrame  # per scenario: the cheapest threshold against full automation


def priced_points(
    tx: DataFrame,
    scenarios: Sequence[tuple],
    options: Options = Options(),
    thresholds: Sequence[float] = COST_GRID,
) -> PricedPoints:
    """Test scores on Platt's scale, swept and priced. A scenario is (name, cost of a missed
    fraud, of a false flag, of one review)."""
    scores = calibration_report(tx, options).calibrated.where(F.col("scale") == "platt")
    curve = store(review_curve(scores, thresholds), "curve")
    return PricedPoints(price_curve(curve, scenarios), price_scenarios(curve, scenarios))
