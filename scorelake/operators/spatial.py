"""Spatial joins of boxes, symbols and staffs on pages.

Theta joins are rewritten as equal joins on grid cells: both sides are spread over the cells they
cover, so Spark shuffles by (page, cell) and never compares all pairs of a page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scorelake.functions import geometry
from scorelake.sources.tables import by_key

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def box_candidates(left: DataFrame, right: DataFrame, cell: float = 100.0, page: str = "page_id") -> DataFrame:
    """(page, a, b): pairs of box_id whose axis-parallel extents meet. Sides: page, box_id, x1, y1, x2, y2."""

    def spread(df: DataFrame, to: str) -> DataFrame:
        df = df.select(page, F.col("box_id").alias(to), *(F.col(c).alias(f"{to}_{c}") for c in ("x1", "y1", "x2", "y2")))
        return df.withColumn("gx", F.explode(_cells(F.col(f"{to}_x1"), F.col(f"{to}_x2"), cell))).withColumn("gy", F.explode(_cells(F.col(f"{to}_y1"), F.col(f"{to}_y2"), cell)))

    meets = (F.col("a_x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("a_x2")) & (F.col("a_y1") <= F.col("b_y2")) & (F.col("b_y1") <= F.col("a_y2"))
    # a pair counts in the first cell that both cover, so it comes once
    first = (F.col("gx") == F.floor(F.greatest("a_x1", "b_x1") / cell)) & (F.col("gy") == F.floor(F.greatest("a_y1", "b_y1") / cell))
    return spread(left, "a").join(by_key(spread(right, "b")), [page, "gx", "gy"]).filter(meets & first).select(page, "a", "b")


def possibly_touching(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Centres no further apart than the sum of the longer axes: what the exact tests are spared from."""
    return F.hypot(ax - bx, ay - by) <= F.greatest(aw, ah) + F.greatest(bw, bh)


def _inside(polygon: np.ndarray, points: np.ndarray) -> bool:
    """Whether any point is inside a polygon, or on its edge."""
    p, q = polygon, np.roll(polygon, -1, axis=0)
    for x, y in points:
        cross = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x - p[:, 0])
        between = (np.minimum(p[:, 0], q[:, 0]) <= x) & (x <= np.maximum(p[:, 0], q[:, 0])) & (np.minimum(p[:, 1], q[:, 1]) <= y) & (y <= np.maximum(p[:, 1], q[:, 1]))
        if (between & (np.abs(cross) < 1e-9)).any():
            return True
        above = (p[:, 1] > y) != (q[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]
        if (above & (x < at)).sum() % 2:
            return True
    return False


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], float).reshape(-1, 2)


@F.pandas_udf(T.BooleanType())
def polygons_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether a vertex of one polygon is inside the other or on its edge; bars that only cross don't overlap."""
    return pd.Series([_inside(q, p) or _inside(p, q) for p, q in ((_array(x), _array(y)) for x, y in zip(a, b, strict=True))], dtype=bool)


@F.pandas_udf(T.BooleanType())
def polygons_intersect(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two convex polygons share a point: no edge's direction separates them."""

    def meet(p: np.ndarray, q: np.ndarray) -> bool:
        for shape in (p, q):
            edges = np.roll(shape, -1, axis=0) - shape
            for n in np.stack([-edges[:, 1], edges[:, 0]], axis=1):
                if max(p @ n) < min(q @ n) or max(q @ n) < min(p @ n):
                    return False
        return True

    return pd.Series([meet(_array(x), _array(y)) for x, y in zip(a, b, strict=True)], dtype=bool)


def turned_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The polygon of a rotated box."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    corner = lambda i, j: F.struct((cx + i * w / 2 * c - j * h / 2 * s).alias("x"), (cy + i * w / 2 * s + j * h / 2 * c).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def overlapping(left: DataFrame, right: DataFrame, test=polygons_overlap, cell: float = 100.0, page: str = "page_id") -> DataFrame:
    """(page, a, b): boxes whose polygons overlap. Sides: page, box_id, x1, y1, x2, y2, polygon."""
    pairs = box_candidates(left, right, cell, page)
    pairs = pairs.join(by_key(left.select(page, F.col("box_id").alias("a"), F.col("polygon").alias("_p"))), [page, "a"]).join(by_key(right.select(page, F.col("box_id").alias("b"), F.col("polygon").alias("_q"))), [page, "b"])
    return pairs.filter(test("_p", "_q")).select(page, "a", "b")


def intervals_apart(left: DataFrame, right: DataFrame, key: str, size: int, low: str = "low", high: str = "high") -> DataFrame:
    """Anti join: intervals of left that meet none of right with the same key. Both ends belong to an interval."""
    left = left.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in left.columns else left
    a = left.withColumn("_cell", F.explode(_cells(F.col(low), F.col(high), size)))
    b = right.select(F.col(key), F.col(low).alias("_low"), F.col(high).alias("_high")).withColumn("_cell", F.explode(_cells(F.col("_low"), F.col("_high"), size)))
    meets = (a[key] == b[key]) & (a["_cell"] == b["_cell"]) & (a[low] <= b["_high"]) & (b["_low"] <= a[high])
    # cells that meet nothing are counted against all cells of an interval
    free = a.join(by_key(b), meets, "left_anti").groupBy(*[c for c in left.columns]).agg(F.count(F.lit(1)).alias("_free"))
    return free.filter(F.col("_free") == F.size(_cells(F.col(low), F.col(high), size))).drop("_free", "_id")


def first_match(left: DataFrame, right: DataFrame, on: Column, left_id: list[str], order: list, columns: list) -> DataFrame:
    """Left join in which each left row takes only the first matching right row; a right row may serve several."""
    joined = left.join(right, on, "left")
    w = Window.partitionBy(*(left[c] for c in left_id)).orderBy(*order)
    return joined.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*columns)


def noteheads_with_stems(noteheads: DataFrame, stems: DataFrame, thickness: float = 15.0, cell: float = 100.0, page: str = "page_id") -> DataFrame:
    """(page, notehead_id, stem_id, direction): the first stem in order that meets the thickened notehead; up if its centre is above. No stem: nulls."""
    grown = noteheads.select(page, F.col("notehead_id").alias("box_id"), (F.col("cx") - F.col("w") / 2 - thickness / 2).alias("x1"), (F.col("cy") - F.col("h") / 2 - thickness / 2).alias("y1"), (F.col("cx") + F.col("w") / 2 + thickness / 2).alias("x2"), (F.col("cy") + F.col("h") / 2 + thickness / 2).alias("y2"))
    bars = stems.select(page, F.col("stem_id").alias("box_id"), (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"))
    pairs = box_candidates(grown, bars, cell, page).groupBy(page, F.col("a").alias("notehead_id")).agg(F.min("b").alias("stem_id"))
    found = noteheads.select(page, "notehead_id", F.col("cy").alias("_y")).join(pairs, [page, "notehead_id"], "left")
    found = found.join(stems.select(page, "stem_id", F.col("cy").alias("_sy")), [page, "stem_id"], "left")
    return found.select(page, "notehead_id", "stem_id", F.when(F.col("_sy") < F.col("_y"), "up").when(F.col("_sy").isNotNull(), "down").alias("direction"))


def _nearest(xs: np.ndarray, at: np.ndarray, tolerance: float) -> np.ndarray:
    """For each place the index of the nearest of sorted xs, the first of equally near ones; -1 beyond the tolerance."""
    right = np.searchsorted(xs, at).clip(0, len(xs) - 1)
    left = (right - 1).clip(0)
    best = np.where(np.abs(xs[left] - at) <= np.abs(xs[right] - at), left, right)
    return np.where(np.abs(xs[best] - at) <= tolerance, best, -1)


def _doubles(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(float)


def nearest_point(items: DataFrame, grid: DataFrame, keys=("page_id", "staff_id"), item: str = "item_id", tolerance: float = 50.0) -> DataFrame:
    """Each item with the point of the grid nearest in x, the first of equally near ones; null beyond the tolerance.

    items: keys, item, x; grid: keys, x and what a point has. Both are grouped by the first key, a page; a grid that is dealt by it is not exchanged.
    """
    rest = list(keys[1:])
    points = grid.toDF(*("grid_x" if c == "x" else c for c in grid.columns))
    more = [c for c in points.columns if c not in keys]
    schema = T.StructType([*items.schema.fields, *(T.StructField(f.name, f.dataType) for f in points.schema.fields if f.name in more)])
    arrow = to_arrow_schema(schema)

    def run(own: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by([(c, "ascending") for c in (*rest, "grid_x")])
        xs, at = _doubles(points["grid_x"]), _doubles(own["x"])
        found = np.full(len(at), -1)
        for key in set(zip(*(points[c].to_pylist() for c in rest), strict=True)) if rest else {()}:
            here = lambda t: np.flatnonzero(np.logical_and.reduce([np.ones(len(t), bool), *(t[c].to_numpy() == k for c, k in zip(rest, key, strict=True))]))  # noqa: B023, E731
            some, mine = here(points), here(own)
            if len(some) and len(mine):
                k = _nearest(xs[some], at[mine], tolerance)
                found[mine] = np.where(k < 0, -1, some[k])
        picked = points.select(more).take(pa.array(found, mask=found < 0))
        return pa.table([*own.columns, *picked.columns], names=[*own.column_names, *more]).select(arrow.names).cast(arrow)

    return items.groupBy(keys[0]).cogroup(points.groupBy(keys[0])).applyInArrow(run, schema)


def on_staffs(symbols: DataFrame, grid: DataFrame, staffs: DataFrame, page: str = "page_id", tolerance: float = 50.0) -> DataFrame:
    """(page, symbol_id, staff_id, x, cy, grid_x, y, point_unit, unit, and what more symbols have): staffs in whose zone a symbol's centre lies; there may be several.

    symbols: page, symbol_id, x, cy; grid: page, staff_id, x, y (five lines), unit; staffs: page, staff_id,
    min_x, max_x, unit (the median of its points), and perhaps min_y, max_y, which spare most pairs.
    """
    own = staffs.select(page, "staff_id", "min_x", "max_x", F.col("unit").alias("staff_unit"), *(c for c in ("min_y", "max_y") if c in staffs.columns))
    near = symbols.join(by_key(own), page).filter(F.col("x").between(F.col("min_x") - tolerance, F.col("max_x") + tolerance))
    if "min_y" in own.columns:
        # the zones of all of a staff's points
        reach = geometry.LEDGER_LINES * F.col("staff_unit")
        near = near.filter(F.col("cy").between(F.col("min_y") - reach, F.col("max_y") + reach))
    found = nearest_point(near.drop("min_x", "max_x", "min_y", "max_y"), grid.withColumnRenamed("unit", "point_unit"), (page, "staff_id"), "symbol_id", tolerance).filter("grid_x is not null")
    zone = geometry.zone(F.col("y"), F.col("staff_unit"))
    more = [c for c in symbols.columns if c not in (page, "symbol_id", "x", "cy")]
    return found.filter(F.col("cy").between(zone["top"], zone["bottom"])).select(page, "symbol_id", "staff_id", "x", "cy", "grid_x", "y", "point_unit", F.col("staff_unit").alias("unit"), *more)


def staff_units(grid: DataFrame, keys=("page_id", "staff_id")) -> DataFrame:
    """(keys, min_x, max_x, min_y, max_y, unit): extents, and the median of the points' units."""
    return grid.groupBy(*keys).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min(F.array_min("y")).alias("min_y"), F.max(F.array_max("y")).alias("max_y"), F.median(geometry.unit_size(F.col("y"))).alias("unit"))


def nearest_staff(items: DataFrame, grid: DataFrame, page: str = "page_id", tolerance: float = 50.0) -> DataFrame:
    """(page, item_id, staff_id, distance): the staff whose lines are nearest in y at the item's x; off all grids 1e10 and the first staff."""
    # pages of both are sorted for the rule anyway
    own = items.join(by_key(grid.select(page).distinct()), page, "left_semi")
    own = own.select(page, "item_id", F.col("x").cast("double").alias("x"), F.col("cy").cast("double").alias("cy"))
    schema = T.StructType([own.schema[page], own.schema["item_id"], grid.schema["staff_id"], T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(own: pa.Table, points: pa.Table) -> pa.Table:
        if not len(own):
            return arrow.empty_table()
        points = points.sort_by([("staff_id", "ascending"), ("x", "ascending")])
        xs, at, cy = _doubles(points["x"]), _doubles(own["x"]), _doubles(own["cy"])
        lines = _doubles(points["y"].combine_chunks().flatten()).reshape(len(xs), -1)
        names, start = np.unique(points["staff_id"].to_numpy(), return_index=True)
        away = []
        for a, b in zip(start, [*start[1:], len(xs)], strict=True):
            k = _nearest(xs[a:b], at, tolerance)
            d = np.abs(lines[a:b][k] - cy[:, None]).min(axis=1)
            away.append(np.where((k < 0) | np.isnan(d), 1e10, d))
        best = np.argmin(away, axis=0)
        return pa.table([own[page], own["item_id"], pa.array(names[best]), pa.array(np.min(away, axis=0))], names=arrow.names).cast(arrow)

    return own.groupBy(page).cogroup(grid.select(page, "staff_id", F.col("x").cast("double").alias("x"), "y").groupBy(page)).applyInArrow(run, schema)


# what belongs to a staff, by size and place: u is the unit of the staff or page


def bar_line_sized(w: Column, h: Column, u: Column) -> Column:
    return (h >= 3 * u) & (w <= 2 * u)


def bar_line_on_staff(y: Column, top: Column, bottom: Column, u: Column) -> Column:
    """Starts and ends within four units of the outer lines."""
    return (F.abs(F.element_at(y, 1) - top) <= 4 * u) & (F.abs(F.element_at(y, -1) - bottom) <= 4 * u)


def rest_on_staff(y: Column, cy: Column, w: Column, h: Column, u: Column) -> Column:
    """Nearest to the second or third line, between 0.7 and 3.5 units both ways."""
    away = F.transform(y, lambda v: F.abs(v - cy))
    line = F.array_position(away, F.array_min(away)) - 1
    return line.isin(1, 2) & w.between(0.7 * u, 3.5 * u) & h.between(0.7 * u, 3.5 * u)


def accidental_sized(w: Column, h: Column, u: Column) -> Column:
    return w.between(0.5 * u, 3 * u) & h.between(0.5 * u, 3 * u)


def notehead_sized(w: Column, h: Column, u: Column) -> Column:
    return w.between(0.5 * u, 3 * u) & h.between(0.5 * u, 2 * u)


def sized(w: Column, h: Column, least: tuple[float, float], most: tuple[float, float]) -> Column:
    """Between two sizes; -1 is no limit."""
    bound = lambda v, low, high: (v >= low) & (v <= high if high != -1 else F.lit(True))
    return bound(w, least[0], most[0]) & bound(h, least[1], most[1])


def in_view(min_x: Column, max_x: Column, min_y: Column, width: Column, height: Column) -> Column:
    """False for staffs at the edge of an image, of which only a part is seen."""
    return ~((min_x > 0.90 * width) | (min_y > 0.95 * height) | (max_x < 0.20 * width))


def tall_elements(items: DataFrame, grid: DataFrame, staffs: DataFrame, page: str = "page_id") -> DataFrame:
    """Items taller than four units of their nearest staff, after a rough cut by the unit of the page's first staff."""
    first = staffs.groupBy(page).agg(F.min_by("unit", "min_y").alias("_u"))
    rough = items.join(by_key(first), page).filter("h > 2 * _u and w < 3 * _u").drop("_u")
    near = nearest_staff(rough, grid, page).join(by_key(staffs.select(page, "staff_id", "unit")), [page, "staff_id"])
    return rough.join(by_key(near.select(page, "item_id", "staff_id", F.col("unit").alias("_v"))), [page, "item_id"]).filter("h > 4 * _v").drop("_v", "staff_id")


def fragments_in_zones(fragments: DataFrame, zones: DataFrame, page: str = "page_id", cell: float = 50.0) -> DataFrame:
    """(page, anchor_id, fragment_id): fragments whose centre lies in an anchor's zone, ends included."""
    z = zones.select(page, "anchor_id", "low", "high").withColumn("_cell", F.explode(_cells(F.col("low"), F.col("high"), cell)))
    f = fragments.select(page, "fragment_id", "cy").withColumn("_cell", F.floor(F.col("cy") / cell))
    return z.join(by_key(f), [page, "_cell"]).filter("cy between low and high").select(page, "anchor_id", "fragment_id")


def contained_once(sets: DataFrame, supersets: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, set_id, super_id): sets all of whose items are in a superset; super_id is null unless there is exactly one such superset.

    sets: page, set_id, item; supersets: page, super_id, item. A superset must hold the set's rarest item, so a set
    meets only the supersets with that one, and whole sets are compared there.
    """
    of = lambda df, id_: df.groupBy(page, id_).agg(F.collect_set("item").alias("items"))
    each = of(supersets, "super_id").select(page, "super_id", "items", F.explode("items").alias("item"))
    often = each.groupBy(page, "item").agg(F.count(F.lit(1)).alias("n"))
    own = sets.select(page, "set_id", "item").distinct().join(by_key(often), [page, "item"], "left")
    rarest = F.min_by("item", F.struct(F.coalesce("n", F.lit(0)), "item")).alias("item")
    own = own.groupBy(page, "set_id").agg(F.collect_set("item").alias("own"), rarest)
    met = own.join(by_key(each), [page, "item"]).filter(F.size(F.array_except("own", "items")) == 0)
    found = met.groupBy(page, "set_id").agg(F.min("super_id").alias("super_id"), F.count(F.lit(1)).alias("k"))
    return own.select(page, "set_id").join(by_key(found), [page, "set_id"], "left").select(page, "set_id", F.when(F.col("k") == 1, F.col("super_id")).alias("super_id"))


def connected_staffs(links: DataFrame, staffs: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, staff_id, min_y, joined): whether a staff is joined to the one above by a brace that meets symbols of both.

    links: page, brace_id, staff_id, for each brace and staff it meets (see `overlapping`).
    """
    w = Window.partitionBy(page).orderBy("min_y")
    ordered = staffs.select(page, "staff_id", "min_y").withColumn("above", F.lag("staff_id").over(w))
    one = links.select(page, "brace_id", "staff_id")
    two = links.select(page, "brace_id", F.col("staff_id").alias("above"))
    both = one.join(two, [page, "brace_id"]).select(page, "staff_id", "above").distinct().withColumn("_j", F.lit(True))
    return ordered.join(both, [page, "staff_id", "above"], "left").select(page, "staff_id", "min_y", F.coalesce("_j", F.lit(False)).alias("joined"))


def met_staffs(braces: DataFrame, symbols: DataFrame, thickness: Column, page: str = "page_id", cell: float = 100.0) -> DataFrame:
    """(page, brace_id, staff_id): staffs of which a symbol meets a brace that is made thicker. Sides have x1, y1, x2, y2; symbols: staff_id.

    Thickness is 30 for bar lines, 0 for clefs, and two units (a whole number) for staff lines.
    """
    half = F.greatest(thickness, F.lit(0)) / 2
    grown = braces.select(page, F.col("brace_id").alias("box_id"), *((F.col(c) - half).alias(c) for c in ("x1", "y1")), *((F.col(c) + half).alias(c) for c in ("x2", "y2")))
    found = box_candidates(grown, symbols.withColumnRenamed("symbol_id", "box_id"), cell, page)
    return found.join(symbols.select(page, F.col("symbol_id").alias("b"), "staff_id"), [page, "b"]).select(page, F.col("a").alias("brace_id"), "staff_id").distinct()


def continuing_pairs(fragments: DataFrame, unit: float, most_angle: float = 5.0, page: str = "page_id") -> DataFrame:
    """(page, a, b), a < b: line fragments of which one goes on in the other. fragments: page, fragment_id, cx, cy, w, angle (at most most_angle either way)."""
    reach = F.col("w") / 2 + 5 * unit
    tall = reach * F.tan(F.radians(F.lit(most_angle))) + unit
    extent = fragments.select(page, F.col("fragment_id").alias("box_id"), (F.col("cx") - reach).alias("x1"), (F.col("cx") + reach).alias("x2"), (F.col("cy") - tall).alias("y1"), (F.col("cy") + tall).alias("y2"))
    pairs = box_candidates(extent, extent, 200.0, page).filter("a < b")
    own = lambda s: fragments.select(page, F.col("fragment_id").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("cx", "cy", "w", "angle")))
    both = pairs.join(own("a"), [page, "a"]).join(own("b"), [page, "b"])
    ends = [F.col(f"{s}_{c}") for s in "ab" for c in ("cx", "cy", "w", "angle")]
    return both.filter(continues(*ends, F.lit(unit))).select(page, "a", "b")


def continues(ax: Column, ay: Column, aw: Column, aa: Column, bx: Column, by: Column, bw: Column, ba: Column, u: Column) -> Column:
    """Whether one line fragment goes on in another, extrapolated to the middle between them: at most five units from either, and a third of a unit apart there."""
    left_end, right_start = F.least(ax + aw / 2, bx + bw / 2), F.greatest(ax - aw / 2, bx - bw / 2)
    middle = (left_end + right_start) / 2
    gap = lambda x, w: F.greatest(F.abs(middle - x) - w / 2, F.lit(0.0))
    apart = F.abs(geometry.extrapolated(ax, ay, aa, middle) - geometry.extrapolated(bx, by, ba, middle))
    return (gap(ax, aw) <= 5 * u) & (gap(bx, bw) <= 5 * u) & (apart <= u / 3)
