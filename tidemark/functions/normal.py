"""Standard normal distribution as plain column arithmetic.

Spark SQL has no ``erf``.  The cumulative distribution uses the double-precision
rational form of Hart as published by West (2005), accurate to about 2e-16.
The column version contains no higher-order function, so its result may feed a
pandas UDF and stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: coefficients, highest power first
NUMERATOR = [
    3.52624965998911e-2,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
DENOMINATOR = [
    8.83883476483184e-2,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
CUT = 7.07106781186547
TAIL_SCALE = 2.506628274631
INV_SQRT_2PI = 0.3989422804014327


def _horner(coefficients: Sequence[float], x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) * F.lit(INV_SQRT_2PI)


def norm_cdf(x: Column) -> Column:
    """Pass an attribute, not a long expression: ``x`` is read many times."""
    a = F.abs(x)
    weight = F.exp(-x * x / 2.0)
    body = weight * _horner([F.lit(NUMERATOR[0]), *NUMERATOR[1:]], a) / _horner(
        [F.lit(DENOMINATOR[0]), *DENOMINATOR[1:]], a
    )
    tail = F.lit(0.65) + a
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + F.lit(k) / tail
    upper = F.when(a < CUT, body).otherwise(weight / tail / TAIL_SCALE)
    return F.when(x > 0, 1.0 - upper).otherwise(upper)


def norm_cdf_array(x: np.ndarray) -> np.ndarray:
    """The same function for Arrow batches."""
    a = np.abs(x)
    weight = np.exp(-np.square(a) / 2.0)
    inner = np.minimum(a, CUT)
    body = weight * _horner(NUMERATOR, inner) / _horner(DENOMINATOR, inner)
    tail = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        tail = a + k / tail
    upper = np.where(a < CUT, body, weight / tail / TAIL_SCALE)
    return np.where(x > 0, 1.0 - upper, upper)


def sql_norm_cdf(x: str) -> str:
    """The same expression as SQL text; ``x`` must be a column name."""

    def poly(coefficients: Sequence[float]) -> str:
        text = repr(coefficients[0]) + "::double"
        for c in coefficients[1:]:
            text = f"({text} * abs({x}) + {c!r})"
        return text

    tail = f"(abs({x}) + 0.65)"
    for k in ("4.0", "3.0", "2.0", "1.0"):
        tail = f"(abs({x}) + {k} / {tail})"
    weight = f"exp(-{x} * {x} / 2.0)"
    upper = (
        f"CASE WHEN abs({x}) < {CUT!r} THEN {weight} * {poly(NUMERATOR)} / {poly(DENOMINATOR)} "
        f"ELSE {weight} / {tail} / {TAIL_SCALE!r} END"
    )
    return f"(CASE WHEN {x} > 0 THEN 1.0 - ({upper}) ELSE ({upper}) END)"
