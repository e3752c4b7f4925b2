"""Rays, planes, matrices and quaternions: native column expressions on arrays of three doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions import num as N
from terraloom.functions.num import c, div, let


def ray_box(origin, direction, low, high) -> Column:
    """Distance along a ray to a box given by its low and high corners (0 from inside), null if it misses."""
    o, d, lo, hi = c(origin), c(direction), c(low), c(high)
    near, far, ok = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for i in range(3):
        a, b = div(lo[i] - o[i], d[i]), div(hi[i] - o[i], d[i])
        # along a zero component the ray stays where it is
        ok = ok & ((d[i] != 0) | ((o[i] >= lo[i]) & (o[i] <= hi[i])))
        near, far = F.greatest(near, F.least(a, b)), F.least(far, F.greatest(a, b))
    return F.when(ok & (near <= far), near)


def ray_triangle(origin, direction, a, b, corner, eps: float = 1e-10) -> Column:
    """Distance along a ray to a triangle, seen from either side; null if it misses or runs in its plane."""
    e1, e2 = N.vec_sub(b, a), N.vec_sub(corner, a)
    p = N.vec_cross(direction, e2)
    det = N.vec_dot(e1, p)
    s = N.vec_sub(origin, a)
    q = N.vec_cross(s, e1)
    u, v, t = div(N.vec_dot(s, p), det), div(N.vec_dot(direction, q), det), div(N.vec_dot(e2, q), det)
    return F.when((F.abs(det) > eps) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def ray_oriented_box(origin, direction, center, axes, half) -> Column:
    """Distance along a ray to a box with three unit axes and half lengths, null if it misses."""

    def local(v):
        return F.array(*[N.vec_dot(v, c(axes)[i]) for i in range(3)])

    return let(F.struct(local(N.vec_sub(origin, center)).alias("o"), local(c(direction)).alias("d")), lambda r: ray_box(r["o"], r["d"], N.vec_negate(half), c(half)))


def plane_distance(normal, offset, p) -> Column:
    """Signed distance of a point to the plane normal . p + offset = 0."""
    return N.vec_dot(normal, p) + c(offset)


def plane_sphere(normal, offset, center, radius) -> Column:
    """'inside' (in front), 'outside' or 'crosses' of a sphere and a plane."""
    d = plane_distance(normal, offset, center)
    return F.when(d > c(radius), "inside").when(d < -c(radius), "outside").otherwise("crosses")


def transform_matrix(v, m) -> Column:
    """A vector times a 4 x 4 matrix (16 doubles, column by column), divided by the fourth component."""
    v, m = c(v), c(m)
    row = lambda i: m[i] * v[0] + m[4 + i] * v[1] + m[8 + i] * v[2] + m[12 + i]
    w = F.when(row(3) == 0, F.lit(1.0)).otherwise(row(3))
    return F.array(*[row(i) / w for i in range(3)])


def transform_quaternion(v, q) -> Column:
    """A vector turned by a unit quaternion (x, y, z, w)."""
    axis, w = F.slice(c(q), 1, 3), c(q)[3]
    t = N.vec_scale(N.vec_cross(axis, v), 2.0)
    return N.vec_add(N.vec_add(v, N.vec_scale(t, w)), N.vec_cross(axis, t))


def oct_normal(x, y) -> Column:
    """Unit vector of two bytes in octahedral form."""
    u, v = c(x) / 127.5 - 1, c(y) / 127.5 - 1
    z = 1 - F.abs(u) - F.abs(v)
    sign = lambda a: F.when(a >= 0, 1.0).otherwise(-1.0)
    return N.vec_normalize(F.array(F.when(z < 0, (1 - F.abs(v)) * sign(u)).otherwise(u), F.when(z < 0, (1 - F.abs(u)) * sign(v)).otherwise(v), z))
