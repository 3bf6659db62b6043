"""Statistics as column expressions over counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: two-sided 95 % point of the normal distribution, as the tables use it.
Z95 = 1.96

# West (2005), "Better approximations to cumulative normal functions".
_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
_SWITCH = 7.07106781186547
_ROOT_2PI = 2.506628274631


def _horner(x: Column, factors: tuple[float, ...]) -> Column:
    out = F.lit(factors[0])
    for factor in factors[1:]:
        out = out * x + F.lit(factor)
    return out


def normal_tail(x: Column) -> Column:
    """P(Z > |x|) of the standard normal distribution."""
    a = F.abs(x)
    density = F.exp(-a * a / 2)
    near = density * _horner(a, _TOP) / _horner(a, _BOTTOM)
    far = a + F.lit(0.65)
    for step in (4.0, 3.0, 2.0, 1.0):
        far = a + F.lit(step) / far
    return F.when(a < _SWITCH, near).otherwise(density / far / F.lit(_ROOT_2PI))


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """STRUCT<low, high> of the Wilson score interval; null for n = 0."""
    count = n.cast("double")
    p = successes.cast("double") / F.nullif(count, F.lit(0.0))
    zz = z * z
    spread = F.try_divide(F.lit(zz), count)
    centre = (p + spread / 2) / (1 + spread)
    half = z * F.sqrt(F.try_divide(p * (1 - p), count) + spread * spread / (4 * zz)) / (1 + spread)
    return F.when(
        count > 0, F.struct((centre - half).alias("low"), (centre + half).alias("high"))
    )


def difference_interval(p1: Column, n1: Column, p2: Column, n2: Column, z: float = Z95) -> Column:
    """STRUCT<difference, low, high> of two proportions, unpooled normal interval."""
    diff = p1 - p2
    half = z * F.sqrt(F.try_divide(p1 * (1 - p1), n1) + F.try_divide(p2 * (1 - p2), n2))
    return F.struct(
        diff.alias("difference"), (diff - half).alias("low"), (diff + half).alias("high")
    )


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """STRUCT<z, p_value> of the pooled two-sided test; null when the spread is zero."""
    a, b = n1.cast("double"), n2.cast("double")
    pooled = F.try_divide(x1 + x2, a + b)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)))
    z = F.try_divide(F.try_divide(x1, a) - F.try_divide(x2, b), spread)
    return F.when(
        z.isNotNull(),
        F.struct(z.alias("z"), (2 * normal_tail(z)).alias("p_value")),
    )


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """Unbiased pass@k from n samples; null when fewer than k samples exist."""
    missed = F.lit(1.0)
    for j in range(k):
        missed = missed * F.try_divide(n - correct - j, n - j)
    return F.when(n >= k, F.when(n - correct < k, F.lit(1.0)).otherwise(1 - missed))
