"""Simplification and curves.  A line is an array of struct<x, y> (or of equal structs with z)."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terraloom.functions.num import bezier_cubic, c
from terraloom.functions.shapes import RING, point

LINE3 = "array<struct<x:double,y:double,z:double>>"


def _kept_by_distance(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices of a Douglas-Peucker line: a part is split at its farthest position while that is beyond the tolerance."""
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, inner = p[b] - p[a], p[a + 1 : b] - p[a]
        length = d @ d
        t = np.clip(inner @ d / length, 0, 1) if length else np.zeros(len(inner))
        gap = ((inner - t[:, None] * d) ** 2).sum(axis=1)
        far = int(np.argmax(gap))
        if gap[far] > tolerance * tolerance:
            keep.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.array(sorted(keep))


def _kept_by_area(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices of a Visvalingam line: the position of the least triangle goes first, areas never fall on the way."""
    n = len(p)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    area = lambda a, b, e: abs((p[b][0] - p[a][0]) * (p[e][1] - p[a][1]) - (p[e][0] - p[a][0]) * (p[b][1] - p[a][1])) / 2
    now = {i: area(i - 1, i, i + 1) for i in range(1, n - 1)}
    heap = [(v, i) for i, v in now.items()]
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        if now.get(i) != v:
            continue
        if v >= tolerance:
            break
        del now[i]
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if j in now:
                now[j] = max(v, area(before[j], j, after[j]))
                heapq.heappush(heap, (now[j], j))
    return np.array([0, *sorted(now), n - 1])


def _thinned(line, tolerance: float, kept, names: str, kind: str) -> Column:
    @F.pandas_udf(kind)
    def thin(lines: pd.Series) -> pd.Series:
        def one(own):
            if own is None or len(own) < 3 or tolerance <= 0:
                return own
            rows = list(own)
            return [rows[i] for i in kept(np.array([[r[k] for k in names] for r in rows], float), tolerance)]

        return lines.map(one)

    return thin(c(line).cast(kind))


def douglas_peucker(line, tolerance: float) -> Column:
    """Positions that stand farther than ``tolerance`` off the simplified line stay, and both ends; null stays null."""
    return _thinned(line, tolerance, _kept_by_distance, "xy", RING)


def douglas_peucker_3d(line, tolerance: float) -> Column:
    return _thinned(line, tolerance, _kept_by_distance, "xyz", LINE3)


def visvalingam(line, tolerance: float) -> Column:
    """Positions whose triangle has an area of ``tolerance`` or more stay, and both ends."""
    return _thinned(line, tolerance, _kept_by_area, "xy", RING)


def bezier_line(p0, p1, p2, p3, samples: int = 32) -> Column:
    """``samples`` positions of a cubic curve given by four positions, ends included."""
    ts = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: i / float(samples - 1))
    return F.transform(ts, lambda t: point(*[bezier_cubic(*[c(p)[k] for p in (p0, p1, p2, p3)], t) for k in "xy"]))


def b_spline(line, degree: int = 3, samples: int = 50) -> Column:
    """``samples`` positions of the clamped uniform B-spline with the line's positions as control points; a short line lowers the degree."""

    @F.pandas_udf(RING)
    def curve(lines: pd.Series) -> pd.Series:
        def one(own):
            if own is None or len(own) < 2:
                return own
            p = np.array([[r["x"], r["y"]] for r in own], float)
            n, d = len(p), min(degree, len(p) - 1)
            knots = np.concatenate([np.zeros(d), np.linspace(0, 1, n - d + 1), np.ones(d)])
            t = np.linspace(0, 1, samples)
            span = np.clip(np.searchsorted(knots, t, side="right") - 1, d, n - 1)
            q = np.stack([p[span - d + k] for k in range(d + 1)])
            for r in range(1, d + 1):
                for k in range(d, r - 1, -1):
                    low, high = knots[span - d + k], knots[span + 1 + k - r]
                    w = ((t - low) / (high - low))[:, None]
                    q[k] = (1 - w) * q[k - 1] + w * q[k]
            return [{"x": x, "y": y} for x, y in q[d].tolist()]

        return lines.map(one)

    return curve(c(line).cast(RING))
