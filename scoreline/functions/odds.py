"""Price arithmetic as Spark column expressions (JVM-side, inside whole-stage codegen).

American odds ``o``: positive = profit on 100 staked, negative = stake to win 100.
Divisions use ``try_divide`` so a zero price yields null instead of an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: staking and rating constants
KELLY_FRACTION = 0.25     # fractional Kelly multiplier
MAX_STAKE_FRAC = 0.05     # cap on the stake as a share of bankroll
ELO_SCALE = 400.0         # logistic scale of the rating expectation
MAX_FAIR_PROB = 0.98      # cap on a shaded probability before converting to a price


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def american_to_decimal(o) -> Column:
    o = _c(o).cast("double")
    return F.when(o > 0, o / 100.0 + 1.0).otherwise(F.try_divide(F.lit(100.0), -o) + 1.0)


def american_to_implied(o) -> Column:
    o = _c(o).cast("double")
    return F.when(o > 0, F.try_divide(F.lit(100.0), o + 100.0)).otherwise(
        F.try_divide(-o, -o + 100.0))


def devig_share(implied_a, implied_b) -> Column:
    """Fair probability of side a in a two-way market: its implied share of the total."""
    return F.try_divide(_c(implied_a), _c(implied_a) + _c(implied_b))


def edge(p, o) -> Column:
    return _c(p) - american_to_implied(o)


def expected_value(p, o) -> Column:
    """Profit per unit staked: p * b - (1 - p), b = decimal - 1."""
    p = _c(p)
    return p * (american_to_decimal(o) - 1.0) - (1.0 - p)


def kelly_fraction(p, o) -> Column:
    p = _c(p)
    b = american_to_decimal(o) - 1.0
    return F.greatest(F.lit(0.0), F.try_divide(b * p - (1.0 - p), b))


def recommended_stake(p, o, mult: float = KELLY_FRACTION, cap: float = MAX_STAKE_FRAC) -> Column:
    return F.least(F.lit(cap), F.lit(mult) * kelly_fraction(p, o))


def clv(taken, closing) -> Column:
    """Closing-line value as a probability difference; positive = beat the close."""
    return american_to_implied(closing) - american_to_implied(taken)


def prob_to_american(p, vig: float = 0.0) -> Column:
    """Probability -> American price with a margin shaded in (half-even rounding)."""
    pv = F.least(F.lit(MAX_FAIR_PROB), _c(p) * (1.0 + vig))
    dec = F.try_divide(F.lit(1.0), pv)
    return F.when(dec >= 2.0, F.bround((dec - 1.0) * 100.0, 0)).otherwise(
        F.bround(F.try_divide(F.lit(-100.0), dec - 1.0), 0)).cast("int")


def elo_expected(a, b) -> Column:
    """Win expectation of rating a against rating b."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (_c(b) - _c(a)) / ELO_SCALE))


def fmt_pct(x, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _c(x) * 100.0)


def fmt_signed(x, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", _c(x))


_SPLIT = 134217729.0     # fixed value: 2^27 + 1, halves a double's mantissa


def round_half_even(x: Column | str, digits: int) -> Column:
    """Round to ``digits`` decimals by the exact binary value, ties to even: 0.0625 to 3 digits is
    0.062, and 0.5005 (in binary a little less) is 0.5.

    x * 10^digits is taken as a double and its exact error (both factors split in halves), so the
    fraction is compared with one half without loss; |x| up to 2^40 or so, digits up to 6."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    scale = F.lit(float(10 ** digits))
    high = x * _SPLIT - (x * _SPLIT - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    floor = F.floor(product).cast("double")
    rest = product - floor
    up = ((rest > 0.5) | ((rest == 0.5) & (error > 0))
          | ((rest == 0.5) & (error == 0) & (F.pmod(floor, F.lit(2.0)) == 1.0)))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(
        (floor + up.cast("double")) / scale)
