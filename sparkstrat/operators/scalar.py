"""Scalar arithmetic, boolean and comparison operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import RAISE, checked, guard, is_finite


def _finite(x: Column, policy: str) -> Column:
    return guard(x, ~is_finite(x), "NUMERIC_NONFINITE", policy)


def _of_finite(build):
    """An operator whose inputs must be finite."""

    def run(*inputs, policy=RAISE):
        return checked(build(*inputs), *inputs, policy=policy)

    return run


def div(a, b, policy=RAISE):
    return _finite(checked(guard(F.try_divide(a, b), b == 0, "MATH_DIVIDE_BY_ZERO", policy), a, b, policy=policy), policy)


def power(base, exponent, policy=RAISE):
    return _finite(F.pow(base, exponent), policy)


def sqrt(x, policy=RAISE):
    return guard(F.sqrt(x), x < 0, "MATH_DOMAIN_ERROR", policy)


def log(x, policy=RAISE):
    return guard(F.ln(x), x <= 0, "MATH_DOMAIN_ERROR", policy)


def exp(x, policy=RAISE):
    return _finite(F.exp(x), policy)


def clip(x, lower, upper, policy=RAISE):
    if lower > upper:
        raise ValueError("MATH_RANGE_INVALID")
    return checked(F.least(F.greatest(x, F.lit(lower)), F.lit(upper)), x, policy=policy)


def fill_nan(x, replacement=0.0, policy=RAISE):
    return guard(F.nanvl(x, F.lit(replacement)), F.abs(x) == F.lit(float("inf")), "NUMERIC_NONFINITE", policy)


def round_half_even(x, ndigits=0, policy=RAISE):
    """Half to even on the binary value, as IEEE 754 has it: 2.675 is below its tie, 0.125 is one.

    x * 10**ndigits is taken exactly, as a product and its error (Dekker's product), so that the error decides what looks like a tie."""
    if ndigits == 0:
        return checked(F.rint(x), x, policy=policy)
    if not 0 < ndigits <= 22:
        raise ValueError("MATH_ROUND_DIGITS_INVALID")  # 10**ndigits must be a double
    scale = float(10**ndigits)
    half = lambda v: 134217729.0 * v - (134217729.0 * v - v)  # noqa: E731  the upper half of the bits
    high, s_high = half(x), 134217729.0 * scale - (134217729.0 * scale - scale)
    low, s_low = x - high, scale - s_high
    product = x * scale
    error = ((high * s_high - product) + high * s_low + low * s_high) + low * s_low
    floor = F.floor(product).cast("double")
    rest = product - floor
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (floor % 2 != 0))))
    small = F.abs(product) < 4503599627370496.0  # beyond that a double has no digits to round off
    return checked(F.when(small, (floor + up.cast("double")) / scale).otherwise(x), x, policy=policy)


def between(x, lower, upper, inclusive=True, policy=RAISE, code="CMP_RANGE_INVALID"):
    inside = (x >= lower) & (x <= upper) if inclusive else (x > lower) & (x < upper)
    return guard(checked(inside, x, lower, upper, policy=policy), lower > upper, code, policy)


def outside(x, lower, upper, inclusive=True, policy=RAISE, code="CMP_RANGE_INVALID"):
    return ~between(x, lower, upper, inclusive, policy, code)


def _band(build):
    return lambda x, lower, upper, inclusive=True, policy=RAISE: build(x, lower, upper, inclusive, policy, "SIGNAL_BAND_INVALID")


def _fold(agg, empty, numbers=False):
    def run(values, allow_empty=False, policy=RAISE):
        if numbers:
            values = guard(values, F.exists(values, lambda v: ~is_finite(v.cast("double"))), "NUMERIC_NONFINITE", policy)
        found = F.when(F.size(values) == 0, F.lit(empty)).otherwise(agg(values))
        return found if allow_empty else guard(found, F.size(values) == 0, "EMPTY_INPUT", policy)

    return run


SCALAR = {
    "core.math.add": _of_finite(lambda a, b: a + b),
    "core.math.sub": _of_finite(lambda a, b: a - b),
    "core.math.mul": _of_finite(lambda a, b: a * b),
    "core.math.div": div,
    "core.math.neg": _of_finite(lambda x: F.negative(x)),
    "core.math.abs": _of_finite(lambda x: F.abs(x)),
    "core.math.pow": power,
    "core.math.sqrt": sqrt,
    "core.math.log": log,
    "core.math.exp": exp,
    "core.math.min": _fold(F.array_min, None, True),
    "core.math.max": _fold(F.array_max, None, True),
    "core.math.clip": clip,
    "core.math.floor": _of_finite(lambda x: F.floor(x)),
    "core.math.ceil": _of_finite(lambda x: F.ceil(x)),
    "core.math.round": round_half_even,
    "core.math.sign": _of_finite(lambda x: F.signum(x).cast("int")),
    "core.math.isnan": lambda x: F.isnan(x),
    "core.math.isfinite": is_finite,
    "core.math.where": lambda condition, if_true, if_false: F.when(condition, if_true).otherwise(if_false),
    "core.math.fill_nan": fill_nan,
    "core.bool.and": lambda a, b: a & b,
    "core.bool.or": lambda a, b: a | b,
    "core.bool.not": lambda x: ~x,
    "core.bool.xor": lambda a, b: a != b,
    "core.bool.any": _fold(lambda v: F.exists(v, lambda x: x), False),
    "core.bool.all": _fold(lambda v: F.forall(v, lambda x: x), True),
    "core.bool.count_true": _fold(lambda v: F.size(F.filter(v, lambda x: x)), 0),
    "core.cmp.eq": _of_finite(lambda a, b: a == b),
    "core.cmp.ne": _of_finite(lambda a, b: a != b),
    "core.cmp.gt": _of_finite(lambda a, b: a > b),
    "core.cmp.gte": _of_finite(lambda a, b: a >= b),
    "core.cmp.lt": _of_finite(lambda a, b: a < b),
    "core.cmp.lte": _of_finite(lambda a, b: a <= b),
    "core.cmp.between": between,
    "core.cmp.outside": outside,
}
SCALAR |= {f"core.logic.{k}": SCALAR[f"core.bool.{k}"] for k in ("and", "or", "not")}
SCALAR |= {f"core.compare.{k}": SCALAR[f"core.cmp.{c}"] for k, c in (("gt", "gt"), ("ge", "gte"), ("lt", "lt"), ("le", "lte"), ("eq", "eq"))}
SCALAR |= {
    "core.signal.threshold_above": lambda x, threshold=0.0, inclusive=True: x >= threshold if inclusive else x > threshold,
    "core.signal.threshold_below": lambda x, threshold=0.0, inclusive=True: x <= threshold if inclusive else x < threshold,
    "core.signal.greater_than": lambda a, b: a > b,
    "core.signal.less_than": lambda a, b: a < b,
    "core.signal.and": lambda a, b: a & b,
    "core.signal.or": lambda a, b: a | b,
    "core.signal.not": lambda x: ~x,
    "core.signal.between": _band(between),
    "core.signal.outside_band": _band(outside),
    "core.signal.breakout_up": lambda x, band: x > band,
    "core.signal.breakout_down": lambda x, band: x < band,
    "core.norm.range_position": lambda v, high, low, policy=RAISE: guard(F.try_divide(v - low, high - low), high == low, "SIGNAL_RANGE_ZERO", policy),
}
