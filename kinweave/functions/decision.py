"""Choice of match sets from scores, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_binomial(p: Column) -> Column:
    """Chances of 0, 1, ... true labels among independent ones with chances ``p``."""
    start = F.array(F.lit(1.0))
    step = lambda d, x: F.zip_with(F.concat(d, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), d), lambda no, yes: no * (1 - x) + yes * x)
    return F.aggregate(p, start, step)


def best_k(p: Column, beta2: float = 0.25) -> Column:
    """How many of the scores, in falling order, to accept for the greatest expected F; the least such number."""

    def value(k: Column) -> Column:
        top, rest = poisson_binomial(F.slice(p, 1, k)), poisson_binomial(F.slice(p, k + 1, F.size(p)))
        each = F.transform(top, lambda x, a: F.when(a == 0, 0.0).otherwise(F.aggregate(F.transform(rest, lambda y, b: x * y * (1 + beta2) * a / (beta2 * (a + b) + k)), F.lit(0.0), lambda s, v: s + v)))
        return F.when(k == 0, F.element_at(poisson_binomial(p), 1)).otherwise(F.aggregate(each, F.lit(0.0), lambda s, v: s + v))

    values = F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.round(value(k), 12))
    return F.array_position(values, F.array_max(values)) - 1
