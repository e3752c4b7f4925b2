"""Filter and style expressions (JSON arrays) as columns.

["==", ["get", "class"], "road"] and the like become Catalyst expressions, so
they are pushed into scans like any other filter.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import shapes as S
from terraloom.functions.num import c

COMPARE = {"==": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "%": lambda a, b: F.try_mod(a, b)}


def compile_value(expr, zoom: float = 0.0) -> Column:
    """Column of an expression; ``zoom`` is a constant of the plan."""
    if not isinstance(expr, list):
        return F.lit(expr)
    op, args = expr[0], expr[1:]
    of = lambda e: compile_value(e, zoom)
    if op == "get":
        return F.col(args[0])
    if op == "has":
        return F.col(args[0]).isNotNull()
    if op == "literal":
        return F.array(*[F.lit(v) for v in args[0]]) if isinstance(args[0], list) else F.lit(args[0])
    if op == "zoom":
        return F.lit(float(zoom))
    if op in COMPARE:
        out = COMPARE[op](of(args[0]), of(args[1]))
        return F.coalesce(out, F.lit(False))
    if op in ARITHMETIC:
        return reduce(ARITHMETIC[op], [of(a) for a in args])
    if op in ("all", "any"):
        parts = [of(a) for a in args]
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), parts, F.lit(op == "all"))
    if op == "!":
        return ~of(args[0])
    if op == "in":
        return F.coalesce(of(args[0]).isin(*(args[1][1] if isinstance(args[1], list) and args[1][0] == "literal" else args[1:])), F.lit(False))
    if op == "match":
        value, rest, out = of(args[0]), args[1:-1], None
        for label, result in zip(rest[::2], rest[1::2]):
            hit = value.isin(*label) if isinstance(label, list) else value.eqNullSafe(F.lit(label))
            out = F.when(hit, of(result)) if out is None else out.when(hit, of(result))
        return of(args[-1]) if out is None else out.otherwise(of(args[-1]))
    if op == "case":
        out = None
        for test, result in zip(args[:-1:2], args[1::2]):
            out = F.when(of(test), of(result)) if out is None else out.when(of(test), of(result))
        return out.otherwise(of(args[-1]))
    if op == "interpolate":
        return interpolate(of(args[1]), list(zip(args[2::2], args[3::2])))
    raise ValueError(f"unknown operator {op!r}")


def interpolate(x, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear between sorted stops, constant outside; null without stops."""
    stops = sorted(stops)
    if not stops:
        return F.lit(None).cast("double")
    x = c(x)
    out = F.when(x <= stops[0][0], float(stops[0][1]))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:]):
        out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
    return out.otherwise(float(stops[-1][1]))


def compile_filter(expr, zoom: float = 0.0) -> Column:
    """Boolean column of an expression or its JSON text; no filter lets all pass."""
    if isinstance(expr, str):
        expr = json.loads(expr)
    return F.lit(True) if expr is None else F.coalesce(compile_value(expr, zoom).cast("boolean"), F.lit(False))


def query_features(features: DataFrame, box=None, expr=None, limit: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Rows inside a closed box that pass a filter; the limit is used only if one is given."""
    out = features
    if box is not None:
        w, s, e, n = box
        out = out.where((F.col(x) >= w) & (F.col(x) <= e) & (F.col(y) >= s) & (F.col(y) <= n))
    if expr is not None:
        out = out.where(compile_filter(expr))
    return out if limit is None else out.limit(limit)


def in_lasso(features: DataFrame, ring, x: str = "x", y: str = "y") -> DataFrame:
    return features.where(S.in_ring(c(x), c(y), ring))


def color(text) -> Column:
    """#RGB, #RRGGBB or #RRGGBBAA as struct<r, g, b, a> from 0 to 1; grey for anything else."""
    h = F.lower(F.trim(c(text)))
    full = F.when(h.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(h, 2, 3), "(.)", "$1$1")).when(h.rlike("^#[0-9a-f]{6}([0-9a-f]{2})?$"), F.substring(h, 2, 8)).otherwise("808080")
    full = F.rpad(full, 8, "f")
    part = lambda i: F.conv(F.substring(full, i, 2), 16, 10).cast("double") / 255
    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), part(7).alias("a"))
