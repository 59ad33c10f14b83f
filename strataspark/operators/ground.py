"""Ground surfaces: grid minimum, cloth, existing labels; model key points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..params import Params
from ..storage import Workspace
from . import raster, tilewise


def grid_surface(points: DataFrame, boxes: DataFrame, keys: list[str], p: Params, extra: int = 1) -> DataFrame:
    """Cell minima, holes filled, opened progressively."""
    cells = raster.with_cells(points, boxes, keys, p.ground_cell_size, extra)
    grid = raster.dense(raster.rasterise(cells, keys, "min"), boxes, keys, p.ground_cell_size, extra)
    return raster.opening(raster.nearest_fill(grid, keys), keys, p.smooth_passes)


def mean_surface(ground: DataFrame, points: DataFrame, boxes: DataFrame, keys: list[str], cell: float, extra: int = 2) -> DataFrame:
    """Cell means of ground points, holes filled; the lowest of all ``points`` in tiles of fewer than three ground points."""
    cells = raster.with_cells(ground, boxes, keys, cell, extra)
    filled = raster.nearest_fill(raster.dense(raster.rasterise(cells, keys, "mean"), boxes, keys, cell, extra), keys)
    enough = ground.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 3").select(*keys)
    poor = points.groupBy(*keys).agg(F.min("z").alias("_low")).join(enough, keys, "left_anti")
    return filled.join(poor, keys, "left").withColumn("z", F.coalesce("_low", "z")).drop("_low")


def cloth_surface(points: DataFrame, boxes: DataFrame, keys: list[str], p: Params, ws: Workspace) -> DataFrame:
    """Thin to the lowest point a voxel, drop walls in SLAM mode, keep what the cloth touches, take cell means."""
    thin = raster.voxel_thin(raster.with_cells(points, boxes, keys, p.csf_voxel_size), keys)
    if p.point_cloud_source == "slam":
        thin = raster.wall_filter(thin, p.slam_z_range_max)
    ground = tilewise.cloth_ground(
        thin, keys, resolution=p.csf_cloth_resolution, threshold=p.csf_class_threshold, rigidness=p.csf_rigidness, iterations=p.csf_iterations, slope_smooth=p.csf_slope_smooth
    )
    surface = mean_surface(ws.table(ground, "cloth"), points, boxes, keys, p.csf_cloth_resolution)
    if p.point_cloud_source == "slam":
        surface = raster.median(surface, keys, p.slam_zgrid_smooth_cells)
    return surface


def heights(points: DataFrame, surface: DataFrame, boxes: DataFrame, keys: list[str], cell: float, lookup: str, extra: int) -> DataFrame:
    """Points with nz over the surface, by nearest cell or bilinear."""
    if lookup == "bilinear":
        return raster.nz_bilinear(points, surface, boxes, keys, cell)
    return raster.nz_nearest(raster.with_cells(points, boxes, keys, cell, extra), surface, keys).drop("r", "c")


def ground(points: DataFrame, keys: list[str], p: Params, ws: Workspace) -> DataFrame:
    """``points`` with nz and ground; ``points`` may carry is_core, and only core points come back."""
    boxes = ws.table(raster.origins(points, keys), "boxes")
    if p.ground_source == "from_file":
        cell, extra, threshold = p.ground_cell_size, 2, None
        surface = mean_surface(points.where(labels.source_ground(F.col("classification"))), points, boxes, keys, cell)
    elif p.ground_method == "grid":
        cell, threshold = p.ground_cell_size, p.ground_threshold
        extra = 2 if p.surface_lookup == "bilinear" else 1
        surface = grid_surface(points, boxes, keys, p, extra)
    else:
        cell, extra, threshold = p.csf_cloth_resolution, 2, p.csf_class_threshold
        surface = cloth_surface(points, boxes, keys, p, ws)
    surface = ws.table(surface, "surface")
    core = points.where("is_core") if "is_core" in points.columns else points
    out = heights(core, surface, boxes, keys, cell, p.surface_lookup, extra)
    mask = labels.source_ground(F.col("classification")) if threshold is None else labels.ground_mask(F.col("nz"), threshold)
    return out.withColumn("ground", mask)


def support(points: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """(keys, n_ground, enough): tiles whose ground labels are too few to make a surface from."""
    n = F.count_if(labels.source_ground(F.col("classification")))
    return points.groupBy(*keys).agg(n.alias("n_ground"), (n >= least).alias("enough"))


def key_points(points: DataFrame, keys: list[str], step: float, label: str = "class") -> DataFrame:
    """``points`` whose lowest ground point of each step cell (smallest id on ties) becomes class 8."""
    own = points.where(F.col(label) == labels.GROUND)
    cells = raster.with_cells(own, raster.origins(own, keys), keys, step)
    low = cells.groupBy(*keys, "r", "c").agg(F.min(F.struct("z", "point_id")).alias("low")).select(F.col("low.point_id").alias("point_id"), F.lit(True).alias("_key"))
    out = points.join(low, "point_id", "left")
    return out.withColumn(label, F.when(F.col("_key"), labels.KEY_POINT).otherwise(F.col(label)).cast("short")).drop("_key")
