"""Rasters as tables (keys, r, c, z): rasterising, filling, focal filters, lookups.

``keys`` name the columns of a tile; each tile has its own grid whose origin is its points' minimum.
All work is grouped or joined by tile and cell, so tiles are independent units of parallelism.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that one task fills together.
STRIP = 64


def origins(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): bounding boxes of the tiles."""
    return points.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def with_cells(points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, extra: int = 1) -> DataFrame:
    """Adds r, c: the cell from the box's origin, clipped to ceil(range / cell) + extra cells.

    Casting truncates towards zero, which is floor for what lies in the box.
    """

    def index(v: str, lo: str, hi: str) -> Column:
        n = F.ceil((F.col(hi) - F.col(lo)) / cell) + (extra - 1)
        return F.greatest(F.least(F.floor((F.col(v) - F.col(lo)) / cell), n), F.lit(0)).cast("int")

    joined = points.join(boxes, keys)
    return joined.withColumns({"r": index("y", "y0", "y1"), "c": index("x", "x0", "x1")}).drop("x0", "y0", "x1", "y1")


def rasterise(cells: DataFrame, keys: list[str], how: str = "min") -> DataFrame:
    """Minimum or mean height of each cell that has points."""
    z = F.min("z") if how == "min" else F.avg("z")
    return cells.groupBy(*keys, "r", "c").agg(z.alias("z"))


def voxel_thin(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest point of each cell (smallest id on ties), with the cell's highest z."""
    low = F.min(F.struct("z", "point_id", "x", "y")).alias("low")
    found = cells.groupBy(*keys, "r", "c").agg(low, F.max("z").alias("max_z"))
    return found.select(*keys, "r", "c", "low.point_id", "low.x", "low.y", "low.z", "max_z")


def wall_filter(thinned: DataFrame, z_range_max: float) -> DataFrame:
    """Drops cells whose heights range over z_range_max or more; 0 keeps all."""
    return thinned.where(F.col("max_z") - F.col("z") < z_range_max) if z_range_max > 0 else thinned


def dense(raster: DataFrame, boxes: DataFrame, keys: list[str], cell: float, extra: int = 1) -> DataFrame:
    """All cells of each tile, z null in holes."""
    rows = F.sequence(F.lit(0), (F.ceil((F.col("y1") - F.col("y0")) / cell) + (extra - 1)).cast("int"))
    columns = F.sequence(F.lit(0), (F.ceil((F.col("x1") - F.col("x0")) / cell) + (extra - 1)).cast("int"))
    grid = boxes.withColumn("r", F.explode(rows)).withColumn("c", F.explode(columns)).select(*keys, "r", "c")
    return grid.join(raster, [*keys, "r", "c"], "left")


def nearest_fill(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Every hole gets the value of the nearest valid cell of its tile (ties: smallest row, then column).

    An exact distance transform in two passes: windows along the rows find each cell's nearest valid
    cell in its row, then strips of ``STRIP`` columns look up and down from each cell for the row whose
    find is nearest. Two shuffles, no join, whatever the size of the holes; a task holds one strip.
    Tiles without any value become 0.
    """
    row = Window.partitionBy(*keys, "r").orderBy("c")
    known = F.when(F.col("z").isNotNull(), F.struct("c", "z"))
    before = F.last(known, ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(known, ignorenulls=True).over(row.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = grid.select(*keys, "r", "c", before.alias("_b"), after.alias("_a"))
    left = F.col("_a").isNull() | (F.col("c") - F.col("_b.c") <= F.col("_a.c") - F.col("c"))
    best = F.when(F.col("_b").isNotNull() & left, F.col("_b")).otherwise(F.col("_a"))
    own = own.withColumn("_n", best).select(*keys, "r", "c", F.col("_n.c").alias("vc"), F.col("_n.z").alias("z"), F.floor(F.col("c") / STRIP).alias("_strip"))
    schema = T.StructType([f for f in grid.schema if f.name in (*keys, "r", "c", "z")])
    names = schema.names

    def fill(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in "rc")
        r, c = r - r.min(), c - c.min()
        shape = (int(r.max()) + 1, int(c.max()) + 1)
        d2, z = np.full(shape, np.inf), np.zeros(shape)
        vc = table.column("vc").to_numpy()
        found = ~np.isnan(vc) if vc.dtype.kind == "f" else np.ones(len(vc), bool)
        at = r[found], c[found]
        d2[at] = (vc[found] - table.column("c").to_numpy()[found]) ** 2.0
        z[at] = table.column("z").to_numpy()[found]
        filled = filled_columns(d2, z)[r, c]
        return table.set_column(table.schema.get_field_index("z"), "z", pa.array(filled)).select(names)

    return own.groupBy(*keys, "_strip").applyInArrow(fill, schema)


def filled_columns(d2: np.ndarray, z: np.ndarray) -> np.ndarray:
    """For each cell the z of the row whose squared distance d2, seen from the cell, is least; the upper row on ties.

    The rows are visited in steps away from each cell until no cell can find anything nearer.
    """
    best, out, rows = d2.copy(), z.copy(), len(d2)
    for step in range(1, rows):
        far = float(step * step)
        if not (best >= far).any():
            break
        # the upper row is above all rows seen before, the lower one below
        up = d2[:-step] + far
        better = (up <= best[step:]) & np.isfinite(up)
        best[step:][better], out[step:][better] = up[better], z[:-step][better]
        down = d2[step:] + far
        better = down < best[:-step]
        best[:-step][better], out[:-step][better] = down[better], z[step:][better]
    return out


def _focal(grid: DataFrame, keys: list[str], half: int, how: Column | str) -> DataFrame:
    fn = F.min if how == "min" else F.max
    along_row = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-half, half)
    along_column = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-half, half)
    return grid.withColumn("z", fn("z").over(along_row)).withColumn("z", fn("z").over(along_column))


def opening(grid: DataFrame, keys: list[str], passes: int) -> DataFrame:
    """Progressive opening of a filled raster: windows 3, 5, 7, ..., minimum then maximum; edges reflect."""
    for k in range(1, passes + 1):
        grid = _focal(_focal(grid, keys, k, "min"), keys, k, "max")
    return grid


def median(grid: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Median of (2 radius + 1)^2 cells of a filled raster, edges repeated outwards."""

    def spread(frame: DataFrame, value: str, part: str, order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*keys, part).orderBy(order)
        all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before = [F.coalesce(F.lag(value, k).over(w), F.first(value).over(all_of)) for k in range(radius, 0, -1)]
        after = [F.coalesce(F.lead(value, k).over(w), F.last(value).over(all_of)) for k in range(1, radius + 1)]
        return frame.withColumn(out, F.array(*before, F.col(value), *after))

    across = spread(grid, "z", "r", "c", "_a")
    square = spread(across, "_a", "c", "r", "_b")
    middle = ((2 * radius + 1) ** 2 + 1) // 2
    return square.select(*keys, "r", "c", F.element_at(F.array_sort(F.flatten("_b")), middle).alias("z"))


def nz_nearest(points: DataFrame, raster: DataFrame, keys: list[str]) -> DataFrame:
    """Adds nz: height above the own cell's surface; points carry r, c."""
    surface = raster.select(*keys, "r", "c", F.col("z").alias("_ground"))
    return points.join(surface, [*keys, "r", "c"]).withColumn("nz", F.col("z") - F.col("_ground")).drop("_ground")


def nz_bilinear(points: DataFrame, raster: DataFrame, boxes: DataFrame, keys: list[str], cell: float, registration: str = "corner") -> DataFrame:
    """Adds nz: height above the blend of four grid values, which stand for cell corners (or centres).

    ``raster`` is filled and has ceil(range / cell) + 2 cells a side. Fractions aren't clipped.
    """
    row, column = Window.partitionBy(*keys, "r").orderBy("c"), Window.partitionBy(*keys, "c").orderBy("r")
    packed = raster.withColumn("z01", F.lead("z").over(row)).withColumn("_n", F.struct("z", "z01")).withColumn("_n", F.lead("_n").over(column))
    packed = packed.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("z").alias("z00"), "z01", F.col("_n.z").alias("z10"), F.col("_n.z01").alias("z11"))
    shift = 0.5 if registration == "center" else 0.0

    def place(v: str, lo: str, hi: str) -> tuple[Column, Column]:
        f = (F.col(v) - F.col(lo)) / cell - shift
        n = F.ceil((F.col(hi) - F.col(lo)) / cell) + 2
        base = F.greatest(F.least(F.floor(f), n - 2), F.lit(0))
        return base.cast("int"), f - base

    (br, fr), (bc, fc) = place("y", "y0", "y1"), place("x", "x0", "x1")
    placed = points.join(boxes, keys).withColumns({"_r": br, "_c": bc, "_fr": fr, "_fc": fc}).drop("x0", "y0", "x1", "y1")
    joined = placed.join(packed, [*keys, "_r", "_c"])
    top = F.col("z00") * (1 - F.col("_fc")) + F.col("z01") * F.col("_fc")
    bottom = F.col("z10") * (1 - F.col("_fc")) + F.col("z11") * F.col("_fc")
    ground = top * (1 - F.col("_fr")) + bottom * F.col("_fr")
    return joined.withColumn("nz", F.col("z") - ground).drop("_r", "_c", "_fr", "_fc", "z00", "z01", "z10", "z11")
