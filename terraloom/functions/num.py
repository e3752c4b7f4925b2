"""Number helpers that keep IEEE meaning where SQL differs.

SQL orders NaN above all numbers and ANSI division by zero fails; the spatial
operators want NaN to fail comparisons and division by zero to give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    """A column from a column, a column name or a number."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def let(x, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c(x)), f), 1)


def finite(x) -> Column:
    """The value if it is a finite number, else null."""
    x = c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def null_if_nan(x) -> Column:
    return F.nanvl(c(x), F.lit(None).cast("double"))


def div(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(c(a), c(b))


def round_half_up(x) -> Column:
    """floor(x + 0.5), also for negative numbers."""
    return F.floor(c(x) + 0.5)


def clamp(x, low, high) -> Column:
    """x within [low, high]; NaN stays NaN."""
    x = c(x)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, c(low)), c(high)))


def lerp(a, b, t) -> Column:
    return c(a) + c(t) * (c(b) - c(a))


def inverse_lerp(a, b, v) -> Column:
    """Position of v between a and b; 0 for a range under 1e-10."""
    return F.when(F.abs(c(b) - c(a)) < 1e-10, F.lit(0.0)).otherwise(div(c(v) - c(a), c(b) - c(a)))


def remap(v, a, b, to_a, to_b) -> Column:
    return c(to_a) + div(c(v) - c(a), c(b) - c(a)) * (c(to_b) - c(to_a))


def smoothstep(low, high, x) -> Column:
    t = clamp(div(c(x) - c(low), c(high) - c(low)), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def smootherstep(low, high, x) -> Column:
    t = clamp(div(c(x) - c(low), c(high) - c(low)), 0.0, 1.0)
    return t * t * t * (t * (t * 6 - 15) + 10)


def hermite(p0, m0, p1, m1, t) -> Column:
    t = c(t)
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * c(p0) + (t3 - 2 * t2 + t) * c(m0) + (3 * t2 - 2 * t3) * c(p1) + (t3 - t2) * c(m1)


def catmull_rom(p0, p1, p2, p3, t) -> Column:
    """Uniform Catmull-Rom spline: a Hermite curve with half the neighbours' difference as tangents."""
    return hermite(p1, (c(p2) - c(p0)) / 2, p2, (c(p3) - c(p1)) / 2, t)


def bezier_cubic(p0, p1, p2, p3, t) -> Column:
    t = c(t)
    u = 1 - t
    return u * u * u * c(p0) + 3 * u * u * t * c(p1) + 3 * u * t * t * c(p2) + t * t * t * c(p3)


def ease(t, power: int, how: str) -> Column:
    """Polynomial easing of degree ``power``: 'in', 'out' or 'in_out'."""
    t = c(t)
    if how == "in":
        return F.pow(t, F.lit(power))
    if how == "out":
        return 1 - F.pow(1 - t, F.lit(power))
    return F.when(t < 0.5, 2 ** (power - 1) * F.pow(t, F.lit(power))).otherwise(1 - F.pow(-2 * t + 2, F.lit(power)) / 2)


def spring_step(pos, vel, target, stiffness, damping, dt) -> tuple[Column, Column]:
    """One semi-implicit Euler step of a damped spring: (position, velocity)."""
    v = c(vel) + (c(stiffness) * (c(target) - c(pos)) - c(damping) * c(vel)) * c(dt)
    return c(pos) + v * c(dt), v


def normalize_angle(a) -> Column:
    """Radians in (-pi, pi]."""
    import math

    r = F.pmod(c(a), F.lit(2 * math.pi))
    return F.when(r > math.pi, r - 2 * math.pi).otherwise(r)


def angle_difference(a, b) -> Column:
    return normalize_angle(c(b) - c(a))


# Vectors are arrays of doubles of equal length.


def vec_map(f, *vs) -> Column:
    out = c(vs[0])
    return F.transform(out, f) if len(vs) == 1 else F.zip_with(out, c(vs[1]), f)


def vec_add(a, b) -> Column:
    return vec_map(lambda x, y: x + y, a, b)


def vec_sub(a, b) -> Column:
    return vec_map(lambda x, y: x - y, a, b)


def vec_mul(a, b) -> Column:
    return vec_map(lambda x, y: x * y, a, b)


def vec_min(a, b) -> Column:
    return vec_map(lambda x, y: F.least(x, y), a, b)


def vec_max(a, b) -> Column:
    return vec_map(lambda x, y: F.greatest(x, y), a, b)


def vec_scale(a, s) -> Column:
    return vec_map(lambda x: x * c(s), a)


def vec_negate(a) -> Column:
    return vec_scale(a, -1.0)


def vec_lerp(a, b, t) -> Column:
    return vec_map(lambda x, y: x + c(t) * (y - x), a, b)


def vec_dot(a, b) -> Column:
    return F.aggregate(vec_mul(a, b), F.lit(0.0), lambda s, x: s + x)


def vec_cross(a, b) -> Column:
    a, b = c(a), c(b)
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def vec_length2(a) -> Column:
    return vec_dot(a, a)


def vec_length(a) -> Column:
    return F.sqrt(vec_length2(a))


def vec_distance(a, b) -> Column:
    return vec_length(vec_sub(a, b))


def vec_normalize(a) -> Column:
    """Unit vector; the zero vector stays."""
    n = vec_length(a)
    return F.when(n == 0, c(a)).otherwise(vec_scale(a, div(1.0, n)))


def vec_equals(a, b, eps: float = 1e-12) -> Column:
    return F.forall(vec_sub(a, b), lambda x: F.abs(x) <= eps)


def split_double(x) -> tuple[Column, Column]:
    """(high, low) single precision parts of a double."""
    high = c(x).cast("float")
    return high, (c(x) - high.cast("double")).cast("float")


def join_double(high, low) -> Column:
    return c(high).cast("double") + c(low).cast("double")
