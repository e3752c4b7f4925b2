"""Rasters in long form (row, col, value): local, focal, global operators and hydrology.

Neighbours come from two windows, one along rows and one along columns, with
range frames, so a missing cell is a missing neighbour and a task holds one line
of the raster at a time.  Null and NaN are both no data.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions.num import c, div, null_if_nan, round_half_up
from terraloom.plans.components import jump_to_root, subtree_sizes
from terraloom.plans.lineage import cut

#: Directions in the order in which ties are decided: code, row step, column step.
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))


def neighbours(raster: DataFrame) -> DataFrame:
    """row, col, value and n<row step>_<col step> for the eight neighbours (m stands for -1)."""
    name = lambda i, j: "n" + "m0p"[i + 1] + "m0p"[j + 1]
    along = lambda d: Window.partitionBy("row").orderBy("col").rangeBetween(d, d)
    across = lambda d: Window.partitionBy("col").orderBy("row").rangeBetween(d, d)
    own = raster.select("row", "col", null_if_nan(F.col("value").cast("double")).alias("value"))
    own = own.withColumn("nt", F.struct(F.first("value").over(along(-1)).alias("m"), F.col("value").alias("z"), F.first("value").over(along(1)).alias("p")))
    up, down = F.first("nt").over(across(-1)), F.first("nt").over(across(1))
    own = own.select("row", "col", "value", "nt", up.alias("u"), down.alias("d"))
    cols = {name(i, j): F.col(s).getField("mzp"[j + 1]) for i, s in ((-1, "u"), (0, "nt"), (1, "d")) for j in (-1, 0, 1) if i or j}
    return own.select("row", "col", "value", *[v.alias(k) for k, v in cols.items()])


def _gradients(cell: float) -> tuple[Column, Column, Column]:
    """Horn's differences along columns and rows, and whether all nine cells have values."""
    n = lambda s: F.col("n" + s)
    dx = ((n("mp") + 2 * n("0p") + n("pp")) - (n("mm") + 2 * n("0m") + n("pm"))) / (8 * cell)
    dy = ((n("pm") + 2 * n("p0") + n("pp")) - (n("mm") + 2 * n("m0") + n("mp"))) / (8 * cell)
    whole = F.col("value").isNotNull()
    for s in ("mm", "m0", "mp", "0m", "0p", "pm", "p0", "pp"):
        whole = whole & n(s).isNotNull()
    return dx, dy, whole


def slope(raster: DataFrame, cell: float = 1.0) -> DataFrame:
    """Degrees; null at edges and beside missing cells."""
    dx, dy, whole = _gradients(cell)
    return neighbours(raster).select("row", "col", F.when(whole, F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))).alias("value"))


def _aspect(dx: Column, dy: Column) -> Column:
    return F.when((dx == 0) & (dy == 0), F.lit(-1.0)).otherwise(F.pmod(450 - F.degrees(F.atan2(-dy, dx)), F.lit(360.0)))


def aspect(raster: DataFrame, cell: float = 1.0) -> DataFrame:
    """Compass degrees, -1 where flat."""
    dx, dy, whole = _gradients(cell)
    return neighbours(raster).select("row", "col", F.when(whole, _aspect(dx, dy)).alias("value"))


def hillshade(raster: DataFrame, cell: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light from 0 to 255."""
    dx, dy, whole = _gradients(cell)
    zenith, az = math.radians(90 - altitude), math.radians((360 - azimuth + 90) % 360)
    steep, face = F.atan(F.sqrt(dx * dx + dy * dy)), F.atan2(dy, -dx)
    light = math.cos(zenith) * F.cos(steep) + math.sin(zenith) * F.sin(steep) * F.cos(az - face)
    return neighbours(raster).select("row", "col", F.when(whole, F.least(F.lit(255), F.greatest(F.lit(0), round_half_up(255 * light))).cast("double")).alias("value"))


# Local operators: columns in, a column out; no data in is no data out.


def local(op: str, *values) -> Column:
    """add, sub, mul, div, pow, min, max, abs, sqrt, log, exp, sum, mean of raster values."""
    v = [null_if_nan(c(x).cast("double")) for x in values]
    a, b = v[0], v[-1]
    known = v[0].isNotNull()
    for x in v[1:]:
        known = known & x.isNotNull()
    total = sum(v[1:], v[0])
    out = {
        "add": lambda: a + b,
        "sub": lambda: a - b,
        "mul": lambda: a * b,
        "div": lambda: div(a, b),
        "pow": lambda: null_if_nan(F.pow(a, b)),
        "min": lambda: F.least(a, b),
        "max": lambda: F.greatest(a, b),
        "abs": lambda: F.abs(a),
        "sqrt": lambda: null_if_nan(F.sqrt(a)),
        "log": lambda: F.when(a == 0, F.lit(float("-inf"))).otherwise(F.log(a)),
        "exp": lambda: F.exp(a),
        "sum": lambda: total,
        "mean": lambda: total / len(v),
    }[op]()
    return F.when(known, out)


def condition(test, yes, no) -> Column:
    """``yes`` where test > 0, else ``no``; no data where the test has none."""
    t = null_if_nan(c(test))
    return F.when(t > 0, c(yes)).when(t.isNotNull(), c(no))


def combine(rasters: dict[str, DataFrame]) -> DataFrame:
    """row, col and one column of values for each raster, where all have the cell."""
    out = None
    for name, raster in rasters.items():
        own = raster.select("row", "col", F.col("value").alias(name))
        out = own if out is None else out.join(own, ["row", "col"])
    return out


def map_algebra(expression: str, rasters: dict[str, DataFrame]) -> DataFrame:
    """A Spark SQL expression over the rasters' names, cell by cell; NaN and infinite results are no data."""
    v = F.expr(expression).cast("double")
    return combine(rasters).select("row", "col", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("value"))


# Surfaces.

#: Marching squares: for each case the edges that a segment joins (bottom, right, top, left).
SEGMENTS = {1: "lb", 2: "br", 3: "lr", 4: "rt", 5: "lt br", 6: "bt", 7: "lt", 8: "tl", 9: "tb", 10: "lb rt", 11: "tr", 12: "rl", 13: "rb", 14: "bl"}


def contour_segments(raster: DataFrame, levels: list[float]) -> DataFrame:
    """level, row, col of the cell's lower corner, x0, y0, x1, y1 (x along columns, y along rows)."""
    along = Window.partitionBy("row").orderBy("col").rangeBetween(1, 1)
    across = Window.partitionBy("col").orderBy("row").rangeBetween(1, 1)
    own = raster.select("row", "col", null_if_nan(F.col("value").cast("double")).alias("a")).withColumn("b", F.first("a").over(along))
    own = own.withColumn("up", F.first(F.struct("a", "b")).over(across)).select("row", "col", "a", "b", F.col("up.b").alias("c"), F.col("up.a").alias("d"))
    own = own.where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL").withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    lv = F.col("level")
    case = sum((F.when(F.col(n) >= lv, w).otherwise(0) for n, w in (("a", 1), ("b", 2), ("c", 4), ("d", 8))), F.lit(0))
    part = lambda p, q: F.coalesce(div(lv - F.col(p), F.col(q) - F.col(p)), F.lit(0.5))
    row, col = F.col("row"), F.col("col")
    at = {"b": (col + part("a", "b"), row + 0.0), "r": (col + 1.0, row + part("b", "c")), "t": (col + part("d", "c"), row + 1.0), "l": (col + 0.0, row + part("a", "d"))}
    segment = lambda s: F.struct(at[s[0]][0].alias("x0"), at[s[0]][1].alias("y0"), at[s[1]][0].alias("x1"), at[s[1]][1].alias("y1"))
    pieces = None
    for k, text in SEGMENTS.items():
        value = F.array(*[segment(s) for s in text.split()])
        pieces = F.when(case == k, value) if pieces is None else pieces.when(case == k, value)
    return own.select("level", "row", "col", F.explode(pieces).alias("s")).select("level", "row", "col", "s.x0", "s.y0", "s.x1", "s.y1")


def contour_levels(low: float, high: float, interval: float) -> list[float]:
    first = math.ceil(low / interval)
    return [i * interval for i in range(first, math.floor(high / interval) + 1)]


# Hydrology.


def flow_direction(raster: DataFrame) -> DataFrame:
    """D8 code of the steepest way down (first in the order E, SE, S, SW, W, NW, N, NE), 0 where nothing is lower."""
    drop = lambda i, j: (F.col("value") - F.col("n" + "m0p"[i + 1] + "m0p"[j + 1])) / (math.sqrt(2) if i and j else 1.0)
    ways = F.array(*[F.struct(drop(i, j).alias("drop"), F.lit(-at).alias("order"), F.lit(k).alias("code")) for at, (k, i, j) in enumerate(D8)])
    best = F.array_max(F.filter(ways, lambda w: w["drop"] > 0))
    return neighbours(raster).where("value IS NOT NULL").select("row", "col", F.coalesce(best["code"], F.lit(0)).alias("direction"))


def _downstream(directions: DataFrame) -> DataFrame:
    """node, parent: the cell that each cell drains to, null where it drains nowhere or off the raster."""
    i = sum((F.when(F.col("direction") == k, di).otherwise(0) for k, di, _ in D8), F.lit(0))
    j = sum((F.when(F.col("direction") == k, dj).otherwise(0) for k, _, dj in D8), F.lit(0))
    key = lambda r, q: (r.cast("long") * (1 << 31) + q.cast("long"))
    own = directions.select(key(F.col("row"), F.col("col")).alias("node"), F.when(F.col("direction") != 0, key(F.col("row") + i, F.col("col") + j)).alias("parent"))
    there = own.select(F.col("node").alias("p"))
    return own.join(there, F.col("parent") == F.col("p"), "left").select("node", F.col("p").alias("parent"))


def _cell(df: DataFrame, *rest) -> DataFrame:
    return df.select(F.shiftright("node", 31).cast("int").alias("row"), F.col("node").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("col"), *rest)


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """Cells upstream of each cell, itself included."""
    return _cell(subtree_sizes(_downstream(directions)), F.col("size").alias("value"))


def watershed(directions: DataFrame, row: int, col: int) -> DataFrame:
    """The cells that drain through the outlet (row, col), itself included."""
    outlet = row * (1 << 31) + col
    parents = _downstream(directions).select("node", F.when(F.col("parent").isNull() | (F.col("node") == outlet), F.col("node")).otherwise(F.col("parent")).alias("parent"))
    return _cell(jump_to_root(parents).where(F.col("root") == outlet))


def _settle(cells: pd.DataFrame) -> pd.DataFrame:
    """Lower the cells of one tile, the rim of its neighbours included, until nothing changes inside; only own cells come out."""
    at = {k: i for i, k in enumerate(zip(cells["row"].tolist(), cells["col"].tolist()))}
    ground, level = cells["ground"].tolist(), cells["value"].tolist()
    heap = [(v, *k) for k, v in zip(at, level) if v < math.inf]
    heapq.heapify(heap)
    while heap:
        v, row, col = heapq.heappop(heap)
        if v > level[at[row, col]]:
            continue
        for _, i, j in D8:
            n = at.get((row + i, col + j))
            if n is not None and (new := max(ground[n], v)) < level[n]:
                level[n] = new
                heapq.heappush(heap, (new, row + i, col + j))
    return cells.assign(moved=pd.Series(level, index=cells.index) < cells["value"], value=level)[cells["own"]][["row", "col", "ground", "value", "moved"]]


def fill_sinks(raster: DataFrame, most_rounds: int = 10_000, tile: int = 256) -> DataFrame:
    """The lowest surface above the raster from which every cell drains to the border or to a missing cell.

    The border starts at its height and all else unbounded.  Each round settles
    every tile of ``tile`` x ``tile`` cells with the rim of its neighbours, so
    levels cross a whole tile in a round; it ends when no tile changes.
    """
    around = neighbours(raster).where("value IS NOT NULL")
    edge = F.lit(False)
    for _, i, j in D8:
        edge = edge | F.col("n" + "m0p"[i + 1] + "m0p"[j + 1]).isNull()
    start = F.when(edge, F.col("value")).otherwise(F.lit(float("inf")))
    now = cut(around.select(F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").alias("ground"), start.alias("value")))
    place = lambda i, j: F.struct(F.floor((F.col("row") + i) / tile).alias("r"), F.floor((F.col("col") + j) / tile).alias("c"))
    near = F.array_distinct(F.array(*[place(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    for _ in range(most_rounds):
        sent = now.select("row", "col", "ground", "value", F.explode(near).alias("tile"), place(0, 0).alias("home")).withColumn("own", F.col("tile") == F.col("home"))
        settled = cut(sent.select("row", "col", "ground", "value", "own", "tile.r", "tile.c").groupBy("r", "c").applyInPandas(lambda cells: _settle(cells), "row long, col long, ground double, value double, moved boolean"))
        now = settled.drop("moved")
        if settled.where("moved").isEmpty():
            kinds = dict(raster.dtypes)
            return now.select(F.col("row").cast(kinds["row"]), F.col("col").cast(kinds["col"]), "value")
    raise RuntimeError(f"not settled after {most_rounds} rounds")


def elevation(red, green, blue, encoding: str = "mapbox") -> Column:
    """Metres from the bytes of an elevation tile."""
    r, g, b = c(red), c(green), c(blue)
    if encoding == "mapbox":
        return -10000 + (r * 65536 + g * 256 + b) * 0.1
    return r * 256 + g + b / 256 - 32768


def visible_from(raster: DataFrame, row: int, col: int, height: float, reach: int) -> DataFrame:
    """row, col, visible (0 or 1) of the cells within ``reach`` of an observer standing ``height`` above its cell.

    Every cell is looked at along rays of max(360, 4 * reach) directions; it is
    visible if on one of them its slope exceeds all nearer ones.
    """
    rays = max(360, 4 * reach)
    eye = raster.where((F.col("row") == row) & (F.col("col") == col)).select((F.col("value") + height).alias("eye"))
    spark = raster.sparkSession
    steps = spark.range(rays * reach).select((F.floor(F.col("id") / reach)).alias("ray"), (F.col("id") % reach + 1).alias("step"))
    angle = F.col("ray") * (2 * math.pi / rays)
    looks = steps.select("ray", "step", round_half_up(row + F.col("step") * F.sin(angle)).alias("r"), round_half_up(col + F.col("step") * F.cos(angle)).alias("q"))
    seen = looks.join(raster, (F.col("r") == F.col("row")) & (F.col("q") == F.col("col"))).join(F.broadcast(eye))  # one row
    tangent = (F.col("value") - F.col("eye")) / F.col("step")
    before = Window.partitionBy("ray").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    marked = seen.withColumn("tangent", tangent).withColumn("most", F.max("tangent").over(before)).withColumn("ok", F.when(F.col("most").isNull() | (F.col("tangent") > F.col("most")), 1).otherwise(0))
    return marked.groupBy("row", "col").agg(F.max("ok").alias("visible"))
