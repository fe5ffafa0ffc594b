"""Price arithmetic: the reference's self-checks as expected values, plus the rest."""

import math

import pytest
from pyspark.sql import functions as F

from scoreline.functions import odds as fo


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def test_reference_self_checks(spark):
    assert abs(one(spark, fo.american_to_implied(F.lit(-150))) - 0.60) < 1e-9
    assert abs(one(spark, fo.american_to_implied(F.lit(130))) - 0.4347826) < 1e-6
    assert abs(one(spark, fo.american_to_decimal(F.lit(130))) - 2.30) < 1e-9
    a, b = fo.american_to_implied(F.lit(-150)), fo.american_to_implied(F.lit(130))
    assert abs(one(spark, fo.devig_share(a, b) + fo.devig_share(b, a)) - 1.0) < 1e-9
    assert one(spark, fo.kelly_fraction(F.lit(0.60), F.lit(-110))) > 0
    assert one(spark, fo.kelly_fraction(F.lit(0.40), F.lit(-110))) == 0


@pytest.mark.parametrize("p,o", [(0.55, -110), (0.3, 250), (0.7, -300), (0.5, 100)])
def test_ev_edge_stake_clv(spark, p, o):
    dec = o / 100 + 1 if o > 0 else 100 / -o + 1
    imp = 100 / (o + 100) if o > 0 else -o / (-o + 100)
    b = dec - 1
    kelly = max(0.0, (b * p - (1 - p)) / b)
    assert math.isclose(one(spark, fo.edge(F.lit(p), F.lit(o))), p - imp, abs_tol=1e-12)
    assert math.isclose(one(spark, fo.expected_value(F.lit(p), F.lit(o))), p * b - (1 - p),
                        abs_tol=1e-12)
    assert math.isclose(one(spark, fo.recommended_stake(F.lit(p), F.lit(o))),
                        min(0.05, 0.25 * kelly), abs_tol=1e-12)
    assert math.isclose(one(spark, fo.clv(F.lit(o), F.lit(-120))), 120 / 220 - imp, abs_tol=1e-12)


def test_zero_price_is_null_not_error(spark):
    assert one(spark, fo.american_to_decimal(F.lit(0))) is None


@pytest.mark.parametrize("p,vig", [(0.4, 0.0), (0.6, 0.045), (0.2, 0.045), (0.99, 0.0)])
def test_prob_to_american(spark, p, vig):
    pv = min(0.98, p * (1 + vig))
    dec = 1 / pv
    want = int(round((dec - 1) * 100)) if dec >= 2.0 else int(round(-100 / (dec - 1)))
    assert one(spark, fo.prob_to_american(F.lit(p), vig)) == want


def test_elo_expectation(spark):
    assert math.isclose(one(spark, fo.elo_expected(F.lit(1560.0), F.lit(1500.0))),
                        1 / (1 + 10 ** (-60 / 400)), rel_tol=1e-14)


def test_scale_settings_bounds():
    from scoreline.session import scale_settings
    big = scale_settings(100 * 2 ** 40, 8000)
    assert big["spark.sql.shuffle.partitions"] == str(100 * 2 ** 40 // (256 << 20))
    assert big["spark.sql.files.maxPartitionBytes"] == "256m"
    small = scale_settings(40 * 2 ** 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"
