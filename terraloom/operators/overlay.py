"""Overlays and relations of many pairs of rings: the clipping and the predicates of ``functions.shapes`` over Arrow batches.

The column expressions there are evaluated one pair after the other; joins with
many pairs take these instead.  Rings are padded with their last position,
which changes no area and no predicate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

CHUNK = 2_000  # pairs whose temporaries stay in the cache
EPS = 1e-10


def _padded(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the positions, a row for each ring (which has one position at least), without closing positions."""
    n = rings.value_lengths().to_numpy(zero_copy_only=False)
    flat = rings.flatten()
    x, y = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    start = np.cumsum(n) - n
    last = start + n - 1
    n = n - ((n > 1) & (x[start] == x[last]) & (y[start] == y[last]))
    at = start[:, None] + np.minimum(np.arange(n.max()), n[:, None] - 1)
    return x[at], y[at]


def _area(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed areas."""
    return (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(axis=1) / 2


def _clip(x: np.ndarray, y: np.ndarray, bx: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings cut by the half planes of convex rings, one after the other; what is left of a ring without a common part has no area."""
    turn = np.where(_area(bx, by) < 0, -1.0, 1.0)[:, None]
    for k in range(bx.shape[1]):
        ax, ay, cx, cy = (v[:, j, None] for j in (k, (k + 1) % bx.shape[1]) for v in (bx, by))
        d = turn * ((cx - ax) * (y - ay) - (cy - ay) * (x - ax))
        ex, ey, f = np.roll(x, -1, 1), np.roll(y, -1, 1), np.roll(d, -1, 1)
        crosses = (d >= 0) != (f >= 0)
        t = np.divide(d, d - f, out=np.zeros_like(d), where=d != f)
        slots = np.stack([crosses, f >= 0], axis=2).reshape(len(x), -1)
        sx = np.stack([x + t * (ex - x), ex], axis=2).reshape(len(x), -1)
        sy = np.stack([y + t * (ey - y), ey], axis=2).reshape(len(x), -1)
        n = slots.sum(axis=1)
        width = max(1, int(n.max()))
        row, col = np.nonzero(slots)
        to = np.cumsum(slots, axis=1)[row, col] - 1
        x, y = np.zeros((len(n), width)), np.zeros((len(n), width))
        x[row, to], y[row, to] = sx[row, col], sy[row, col]
        last = np.minimum(np.arange(width), np.maximum(n, 1)[:, None] - 1)
        x, y = np.take_along_axis(x, last, 1), np.take_along_axis(y, last, 1)
    return x, y


def _areas(a, b) -> dict[str, np.ndarray]:
    return {"area_a": np.abs(_area(*a)), "area_b": np.abs(_area(*b)), "common": np.abs(_area(*_clip(*a, *b)))}


def _inside_and_on(p, r) -> tuple[np.ndarray, np.ndarray]:
    """Of every position of p: whether it is in ring r (even-odd), and whether it is on it."""
    x, y = (v[:, :, None] for v in p)
    ax, ay = (v[:, None, :] for v in r)
    bx, by = (np.roll(v, -1, 1)[:, None, :] for v in r)
    dx, dy = bx - ax, by - ay
    qx, qy = x - ax, y - ay
    with np.errstate(divide="ignore", invalid="ignore"):
        at = dx * (qy / dy) + ax
        t = (qx * dx + qy * dy) / (dx * dx + dy * dy)
    hits = ((ay > y) != (by > y)) & (x < at)
    t = np.clip(np.where(np.isnan(t), 0.0, t), 0.0, 1.0)
    on = (np.hypot(qx - t * dx, qy - t * dy) <= EPS).any(axis=2)
    return hits.sum(axis=2) % 2 == 1, on


def _crossing(a, b) -> np.ndarray:
    """Whether an edge of a crosses one of b properly."""

    def sides(p, r):
        ax, ay = (v[:, None, :] for v in r)
        bx, by = (np.roll(v, -1, 1)[:, None, :] for v in r)
        d = (bx - ax) * (p[1][:, :, None] - ay) - (by - ay) * (p[0][:, :, None] - ax)
        return d * np.roll(d, -1, 1) < 0  # [pair, edge of p, edge of r]

    return (sides(b, a) & sides(a, b).transpose(0, 2, 1)).any(axis=(1, 2))


def _relations(a, b) -> dict[str, np.ndarray]:
    (a_in, a_on), (b_in, b_on), crosses = _inside_and_on(a, b), _inside_and_on(b, a), _crossing(a, b)
    intersects = crosses | a_on.any(axis=1) | b_on.any(axis=1) | a_in[:, 0] | b_in[:, 0]
    within = (a_in | a_on).all(axis=1) & (a_in & ~a_on).any(axis=1)
    contains = (b_in | b_on).all(axis=1) & (b_in & ~b_on).any(axis=1)
    strictly = (a_in & ~a_on).any(axis=1) | (b_in & ~b_on).any(axis=1)
    return {"intersects": intersects, "within": within, "contains": contains, "overlaps": intersects & ~within & ~contains, "touches": intersects & ~strictly & ~crosses}


def _measured(pairs: DataFrame, a: str, b: str, names: list[str], kind: str, of: Callable) -> DataFrame:
    """``pairs`` with the columns that ``of`` gives in place of the two rings; all null where a ring is null or empty."""
    kept = [n for n in pairs.columns if n not in (a, b)]

    def measure(batches):
        for batch in batches:
            ra, rb = batch.column(a), batch.column(b)
            known = np.flatnonzero(np.array(ra.value_lengths().fill_null(0)) * np.array(rb.value_lengths().fill_null(0)))
            out = {n: np.zeros(batch.num_rows) for n in names}
            for at in range(0, len(known), CHUNK):
                own = known[at : at + CHUNK]
                got = of(_padded(ra.take(pa.array(own))), _padded(rb.take(pa.array(own))))
                for n in names:
                    out[n][own] = got[n]
            missing = np.ones(batch.num_rows, bool)
            missing[known] = False
            new = [pa.array(out[n] if kind == "double" else out[n] != 0, mask=missing) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new], [*kept, *names])

    schema = StructType([pairs.schema[n] for n in kept])
    for n in names:
        schema = schema.add(n, kind)
    return pairs.mapInArrow(measure, schema)


def areas(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with area_a, area_b and common (area of ring a inside the convex ring b) in place of the rings."""
    return _measured(pairs, a, b, ["area_a", "area_b", "common"], "double", _areas)


def relations(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with intersects, within (a in b), contains, overlaps and touches in place of the rings, as ``functions.shapes`` defines them."""
    return _measured(pairs, a, b, ["intersects", "within", "contains", "overlaps", "touches"], "boolean", _relations)
