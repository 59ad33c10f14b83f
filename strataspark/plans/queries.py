"""The registered point-cloud queries and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import color, labels
from ..operators import blocks, cluster, detect, ground, raster, tiling, tilewise
from ..params import Params
from ..runtime import importable
from ..storage import Workspace
from . import classify

KEYS = classify.KEYS
TILE, CELL = 20.0, 0.5
GRID = Params(tile_size=TILE, ground_method="grid", ground_threshold=0.05, smooth_passes=2, buffer_m=5.0)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.with_tile(fixtures.points(importable(spark), sf_dir), TILE)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points as a table, as files of points are, for queries that read them more than once."""
    return _ws(spark).table(_points(spark, sf_dir), "points")


def _micro(column: str) -> Column:
    return F.round(F.col(column), 9) + 0.0  # no negative zero


def _z(frame: DataFrame) -> DataFrame:
    return frame.select(*KEYS, "r", "c", _micro("z").alias("z"))


def _ws(spark: SparkSession) -> Workspace:
    return Workspace(spark, "query")


# -- rasters -------------------------------------------------------------------------------------


def raster_of(how: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _stored(spark, sf_dir)
    return _z(raster.rasterise(raster.with_cells(pts, raster.origins(pts, KEYS), KEYS, CELL), KEYS, how))


def voxel_thin_lowest(spark, sf_dir):
    pts = _stored(spark, sf_dir)
    thin = raster.voxel_thin(raster.with_cells(pts, raster.origins(pts, KEYS), KEYS, CELL), KEYS)
    return thin.select(*KEYS, "r", "c", "point_id", _micro("z").alias("z"), _micro("max_z").alias("max_z"))


def wall_filter_cells(spark, sf_dir):
    pts = _stored(spark, sf_dir)
    thin = raster.wall_filter(raster.voxel_thin(raster.with_cells(pts, raster.origins(pts, KEYS), KEYS, CELL), KEYS), 0.5)
    return thin.select(*KEYS, "r", "c", "point_id")


def _filled(spark, sf_dir, extra: int = 1, how: str = "min"):
    ws, pts = _ws(spark), _stored(spark, sf_dir)
    boxes = ws.table(raster.origins(pts, KEYS), "boxes")
    cells = raster.with_cells(pts, boxes, KEYS, CELL, extra)
    grid = raster.nearest_fill(raster.dense(raster.rasterise(cells, KEYS, how), boxes, KEYS, CELL, extra), KEYS)
    return pts, boxes, cells, ws.table(grid, "filled")


def nearest_fill(spark, sf_dir):
    return _z(_filled(spark, sf_dir)[3])


def focal_opening(spark, sf_dir):
    return _z(raster.opening(_filled(spark, sf_dir)[3], KEYS, 2))


def median_smooth(spark, sf_dir):
    return _z(raster.median(_filled(spark, sf_dir)[3], KEYS, 3))


def _nz(frame: DataFrame) -> DataFrame:
    return frame.select("point_id", _micro("nz").alias("nz"))


def nz_nearest(spark, sf_dir):
    _, _, cells, grid = _filled(spark, sf_dir)
    return _nz(raster.nz_nearest(cells, grid, KEYS))


def nz_bilinear(spark, sf_dir):
    pts, boxes, _, grid = _filled(spark, sf_dir, extra=2)
    return _nz(raster.nz_bilinear(pts, grid, boxes, KEYS, CELL))


# -- ground and labels -----------------------------------------------------------------------------


def _heights(spark, sf_dir, params: Params = GRID):
    return ground.ground(_stored(spark, sf_dir), KEYS, params, _ws(spark))


def _labelled(spark, sf_dir, **more):
    own = _heights(spark, sf_dir)
    base = labels.base_label(F.col("ground"))
    return own.withColumn("class", labels.height_label(base, F.col("nz"), threshold=GRID.ground_threshold, **more))


def ground_grid_classify(spark, sf_dir):
    """Counts and summed heights of each class after the grid-minimum ground."""
    own = _labelled(spark, sf_dir)
    return own.groupBy(F.col("class").cast("int").alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("nz"), 4).alias("sum_nz"))


def probable_ground(spark, sf_dir):
    return _labelled(spark, sf_dir, probable_band=0.02).select("point_id", F.col("class").cast("int").alias("class"))


def height_bands(spark, sf_dir):
    return _labelled(spark, sf_dir).select("point_id", F.col("class").cast("int").alias("class"))


def ground_from_source_class(spark, sf_dir):
    own = _heights(spark, sf_dir, replace(GRID, ground_source="from_file"))
    label = labels.height_label(labels.base_label(F.col("ground")), F.col("nz"), threshold=0.05)
    return own.select("point_id", _micro("nz").alias("nz"), label.cast("int").alias("class"))


def model_keypoints(spark, sf_dir):
    own = _stored(spark, sf_dir).withColumn("class", F.col("classification").cast("short"))
    return ground.key_points(own, KEYS, 8.0).where("class = 8 and classification = 2").select("point_id", *KEYS)


def class_summary(spark, sf_dir):
    return classify.class_counts(_points(spark, sf_dir), "classification")


# -- colours ---------------------------------------------------------------------------------------


def veg_mask(index: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _stored(spark, sf_dir)
    mask, used = color.vegetation_mask(pts, index)
    return pts.select("point_id", mask.alias("vegetation"), F.lit(used).alias("index_used"))


# -- birds -----------------------------------------------------------------------------------------


def _candidates(spark, sf_dir):
    own = _heights(spark, sf_dir)
    return own, own.where(labels.bird_candidate(F.col("nz"), F.col("ground"), 0.02, 0.40))


def bird_candidates(spark, sf_dir):
    return _nz(_candidates(spark, sf_dir)[1])


def candidate_guard(spark, sf_dir):
    own, found = _candidates(spark, sf_dir)
    return cluster.guard(found, own, KEYS, 8, 0.05)


def bird_clusters(spark, sf_dir):
    _, found = _candidates(spark, sf_dir)
    ws = _ws(spark)
    found = ws.table(found, "candidates")
    members = ws.table(cluster.dbscan(found, KEYS, 0.30, 8, ws), "members")
    table = cluster.cluster_table(found, members.select("point_id", "cluster", *KEYS), KEYS, 0.005, 1.0)
    rounded = [F.round(c, 9).alias(c) for c in ("x_centroid", "y_centroid", "z_centroid", "nz_mean", "footprint_m2")]
    return table.select(*KEYS, "cluster_id", "point_count", *rounded)


def voxel_downsample_2d(spark, sf_dir):
    return cluster.downsample_2d(_stored(spark, sf_dir), KEYS, 0.1).select("point_id")


def voxel_downsample_3d(spark, sf_dir):
    return cluster.downsample_3d(_stored(spark, sf_dir), KEYS, 0.25).select("point_id")


def cluster_expansion(spark, sf_dir):
    """Candidates within eps of a voxel that belongs to a clump (here: to the supplier's box)."""
    ws = _ws(spark)
    pts = ws.table(_points(spark, sf_dir).select("point_id", *KEYS, "x", "y", "zi", "classification"), "points")
    members = pts.where("zi between 60 and 400 and classification = 1").withColumn("cluster", F.col("tile_e"))
    return cluster.expand(members, pts, KEYS, 0.3, ws).select("point_id", "cluster")


# -- tiles -----------------------------------------------------------------------------------------


def tile_assign(spark, sf_dir):
    return tiling.with_tile(_points(spark, sf_dir), 15.0).select("point_id", *KEYS)


def tile_index_bbox(spark, sf_dir):
    own = tiling.tile_index(_points(spark, sf_dir))
    return own.select(*KEYS, "n_points", "degenerate", *(_micro(c).alias(c) for c in ("xmin", "xmax", "ymin", "ymax", "cx", "cy", "label_height")))


def tile_halo(spark, sf_dir):
    own = tiling.with_halo(_stored(spark, sf_dir).drop(*KEYS), TILE, 5.0)
    return own.select("point_id", *KEYS, "is_core")


def tile_name_parse(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat(F.lit("/data/"), F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), F.col("p_partkey") * 10, F.lit("_"), F.col("p_size"))).otherwise(F.lit("_x")), F.lit(".laz"))
    named = part.select("p_partkey", tiling.tile_name(path).alias("t"))
    return named.select("p_partkey", "t.east", "t.north")


def auto_tile_size(spark, sf_dir):
    own = tiling.auto_tile_size(tiling.tile_index(_points(spark, sf_dir)).select(*KEYS, "n_points", "xmin", "xmax", "ymin", "ymax"), target=4000.0)
    return own.select(*KEYS, "tile_size")


def merge_compatible(spark, sf_dir):
    own = _stored(spark, sf_dir).withColumns({"src_file": F.concat(F.lit("f"), F.col("scan_id")), "point_format": F.when(F.col("scan_id") % 3 == 0, 6).otherwise(7)})
    return tiling.merge_compatible(own, "src_file", "point_format").groupBy("src_file").agg(F.count("*").alias("n"))


def bbox_scan(spark, sf_dir):
    return tiling.in_box(_points(spark, sf_dir), 5.0, 12.5, 8.0, 30.0).select("point_id")


def head_sample(spark, sf_dir):
    return tiling.head(_points(spark, sf_dir), 1000).agg(F.count("*").alias("n"), F.sum("zi").alias("sum_zi"))


def header_scan(spark, sf_dir):
    own = _points(spark, sf_dir).groupBy(F.concat(F.lit("f"), F.col("scan_id")).alias("src_file"))
    return own.agg(F.count("*").alias("n_points"), *(fn(f"{v}i").alias(f"{v}_{n}") for v in "xyz" for fn, n in ((F.min, "min"), (F.max, "max"))))


def _tile_results(spark, sf_dir):
    """Statuses of tiles by the candidate guard, at a share that part of the tiles exceed; a cluster stands for each candidate."""
    own, found = _candidates(spark, sf_dir)
    table = _ws(spark).table(cluster.guard(found, own, KEYS, 8, 0.02), "guard")
    clusters = table.where("status = 'ok'").select(*KEYS, F.explode(F.sequence(F.lit(1), F.col("n_candidates"))).alias("cluster_id"))
    points = own.withColumn("class", labels.base_label(F.col("ground")))
    return classify.tile_results(points, clusters, table)


def tile_status(spark, sf_dir):
    return _tile_results(spark, sf_dir).select(*KEYS, "status", "reason", "n_points", "n_ground", "n_clusters")


# -- sensors and drawings --------------------------------------------------------------------------


def scan_type_detect(spark, sf_dir):
    own = detect.scan_type(_points(spark, sf_dir))
    return own.select("n", "distinct_intensities", F.round("intensity_std", 4).alias("intensity_std"), F.round("rgb_corr", 6).alias("rgb_corr"), "scan_type")


def scan_type_variants(spark, sf_dir):
    """The detector on constant, colour-like and missing intensities."""
    pts = _stored(spark, sf_dir)
    forms = {
        "constant": pts.withColumn("intensity", F.lit(7)),
        "colour": pts.withColumn("intensity", (F.col("red") + F.col("green") + F.col("blue")) / 3.0),
        "missing": pts.drop("intensity"),
        "bare": pts.drop("intensity", "red", "green", "blue"),
        "empty": pts.where("point_id < 0"),
    }
    out = [detect.scan_type(frame).select(F.lit(name).alias("variant"), "scan_type") for name, frame in forms.items()]
    first, *rest = out
    for frame in rest:
        first = first.union(frame)
    return first


def e57_normalise(spark, sf_dir):
    """Valid raw scan points in the global frame with 16-bit channels."""
    raw = _points(spark, sf_dir).select("point_id", "scan_id", "invalid", "x", "y", "z", (F.col("red") / 65535.0).alias("red"), F.col("green").cast("double").alias("green"))
    poses = spark.range(1, 4).select(
        F.col("id").cast("int").alias("scan_id"), F.lit(0.6).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.8).alias("qz"),
        (F.col("id") * 10.0).alias("tx"), F.lit(-5.0).alias("ty"), F.lit(1.5).alias("tz"),
    )
    own = detect.posed(detect.valid_scan_points(raw), poses)
    return own.select("point_id", *(_micro(v).alias(v) for v in "xyz"), detect.channel(F.col("red")).alias("red"), detect.channel(F.col("green")).alias("green"), detect.channel(F.col("green"), 65535.0).alias("green_scaled"))


def scan_count(spark, sf_dir):
    return detect.scan_count(_points(spark, sf_dir))


def ground_support(spark, sf_dir):
    """Whether each tile has the 50 points of a ground class that a surface from labels needs."""
    return ground.support(_points(spark, sf_dir), KEYS)


def run_summary(spark, sf_dir):
    return classify.run_summary(_tile_results(spark, sf_dir))


def rgb_audit(spark, sf_dir):
    return detect.audit(_points(spark, sf_dir), "red", "green", "blue", "nir", "gps_time")


def block_dedupe(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = part.select(F.col("p_brand").alias("name"), F.lit(2.0).alias("width"), F.lit(4.0).alias("height")).distinct().where("name <> 'Brand#11'")
    copies = part.select(F.concat("p_brand", F.lit("_"), "p_size").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 1.0).otherwise(0.0).alias("width"), (F.col("p_size") % 7 * 1.0).alias("height")).distinct()
    return blocks.fold_blocks(base.union(copies))


# -- iterative, without SQL ------------------------------------------------------------------------


def cloth_ground(spark, sf_dir):
    pts = _stored(spark, sf_dir)
    thin = raster.voxel_thin(raster.with_cells(pts, raster.origins(pts, KEYS), KEYS, 0.5), KEYS)
    return tilewise.cloth_ground(thin, KEYS, resolution=1.0, iterations=300).select("point_id", *KEYS)


def ransac_roof(spark, sf_dir):
    own = _heights(spark, sf_dir).where("nz > 2.5 and not ground")
    return tilewise.roofs(own, KEYS, min_pts=30, min_area=5.0)


def classify_photogrammetry(spark, sf_dir):
    p = replace(GRID, point_cloud_source="photogrammetry", building_min_cluster_pts=30, building_min_area_m2=5.0)
    return classify.class_counts(classify.classify(_stored(spark, sf_dir).drop(*KEYS), p).points)


def classify_photo_vegetation(spark, sf_dir):
    """The photogrammetry mode without its plane search: vegetation by colour, then by height."""
    p = replace(GRID, point_cloud_source="photogrammetry", detect_buildings=False)
    return classify.classify(_stored(spark, sf_dir).drop(*KEYS), p).points.select("point_id", F.col("class").cast("int").alias("class"))


def classify_from_file(spark, sf_dir):
    """The lidar mode on the source's ground classes; tiles with too few of them stay as they are."""
    poor = (F.col("x") < 20) & (F.col("y") < 20) & (F.col("point_id") % 997 != 0)  # one tile gets too few ground labels
    own = _stored(spark, sf_dir).drop(*KEYS).withColumn("classification", F.when(poor, 1).otherwise(F.col("classification")))
    done = classify.classify(own, replace(GRID, ground_source="from_file", candidate_share=0.0, buffer_m=0.0))
    return done.tiles.select(*KEYS, "status", "reason", "n_points", "n_ground")


def classify_slam(spark, sf_dir):
    p = Params(tile_size=TILE, point_cloud_source="slam", surface_lookup="bilinear", csf_voxel_size=0.5)
    return classify.class_counts(classify.classify(_stored(spark, sf_dir).drop(*KEYS), p).points)


def classify_lidar(spark, sf_dir):
    """Every step of the lidar mode with halos: labels, clusters and model key points."""
    return classify.class_counts(classify.classify(_stored(spark, sf_dir).drop(*KEYS), replace(GRID, classify_model_keys=True)).points)


# -- SQL -------------------------------------------------------------------------------------------

_PTS = fixtures.POINTS_SQL
_BOX = "box as (select te, tn, min(x) x0, min(y) y0, max(x) x1, max(y) y1 from pts group by te, tn)"


def _cells(extra: int = 1, source: str = "pts") -> str:
    index = lambda v: f"greatest(least(floor(({v} - {v}0) / {CELL}e0), ceil(({v}1 - {v}0) / {CELL}e0) + {extra - 1}), 0)::int"
    return f"cells as (select p.*, {index('y')} r, {index('x')} c from {source} p join box using (te, tn))"


def _raster(how: str = "min", extra: int = 1, where: str = "true") -> str:
    n = lambda v: f"(ceil(({v}1 - {v}0) / {CELL}e0) + {extra})::int"
    return f"""ras as (select te, tn, r, c, {how}(z) z from cells where {where} group by te, tn, r, c),
grid as (select g.te, g.tn, g.r, g.c, ras.z from (select te, tn, r, unnest(range(0, {n("x")})) c from (select *, unnest(range(0, {n("y")})) r from box)) g
  left join ras on g.te = ras.te and g.tn = ras.tn and g.r = ras.r and g.c = ras.c),
near as (select h.te, h.tn, h.r, h.c, v.z, row_number() over (partition by h.te, h.tn, h.r, h.c order by (h.r - v.r) * (h.r - v.r) + (h.c - v.c) * (h.c - v.c), v.r, v.c) k
  from grid h join grid v on h.te = v.te and h.tn = v.tn and h.z is null and v.z is not null),
filled as (select te, tn, r, c, z from grid where z is not null union all select te, tn, r, c, z from near where k = 1)"""


def _opened(passes: int) -> str:
    parts, last = [], "filled"
    for k in range(1, passes + 1):
        for fn in ("min", "max"):
            name = f"{fn}{k}"
            parts.append(f"""{name} as (select te, tn, r, c, {fn}(z) over (partition by te, tn, c order by r range between {k} preceding and {k} following) z
  from (select te, tn, r, c, {fn}(z) over (partition by te, tn, r order by c range between {k} preceding and {k} following) z from {last}) q)""")
            last = name
    parts.append(f"surface as (select * from {last})")
    return ",\n".join(parts)


_HEIGHTS = f"""with {_PTS},
{_BOX},
{_cells()},
{_raster()},
{_opened(2)},
heights as (select p.*, p.z - s.z as nz, abs(p.z - s.z) <= 0.05e0 as ground from cells p join surface s using (te, tn, r, c))"""
_CASE = """case when ground then 2 when nz <= -0.1e0 then 7 when nz >= 0.1e0 and nz < 1 then 3 when nz >= 1 and nz < 3 then 4 when nz >= 3 then 5 else 1 end"""
_FOUND = f"""{_HEIGHTS},
found as (select * from heights where nz between 0.02e0 and 0.40e0 and not ground)"""
_GUARD = f"""{_FOUND},
guard as (select p.te, p.tn, p.n as n_points, coalesce(m.n, 0) as n_candidates from (select te, tn, count(*) n from heights group by te, tn) p left join (select te, tn, count(*) n from found group by te, tn) m using (te, tn))"""
_STATUS = f"""{_GUARD}, soil as (select te, tn, count(*) filter (ground) n_ground from heights group by te, tn),
st as (select te, tn, n_points, n_ground, case when n_candidates < 8 or n_candidates / n_points > 0.02e0 then 0 else n_candidates end as n_clusters,
  case when n_candidates < 8 or n_candidates / n_points > 0.02e0 then 'SKIPPED' else 'PROCESSED' end as status,
  case when n_candidates < 8 then 'too few candidates' when n_candidates / n_points > 0.02e0 then 'too many candidates' end as reason from guard join soil using (te, tn))"""
_FILLED = f"with {_PTS},\n{_BOX},\n{_cells()},\n{_raster()}"
_CLUSTERS = """pairs as (select a.te, a.tn, a.point_id a, b.point_id b from found a join found b on a.te = b.te and a.tn = b.tn and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.3e0 * 0.3e0),
core as (select a id from pairs group by a having count(*) >= 8),
edges as (select a, b from pairs where a in (select id from core) and b in (select id from core)),
reach(id, root) as (select a, b from edges union select r.id, e.b from reach r join edges e on r.root = e.a),
comp as (select id, min(root) cluster from reach group by id),
member as (select p.a id, min(c.cluster) cluster from pairs p join comp c on p.b = c.id group by p.a)"""
_T = "te as tile_e, tn as tile_n"
_SINGLE = {
    "ndvi": ("(case when (nir::float + red::float) > 0 then (nir::float - red::float) / (nir::float + red::float) else 0::float end) > 0.2::float", "ndvi"),
    "vari": ("greatest(least(case when abs(green::float + red::float - blue::float) > 1e-6::float then (green::float - red::float) / (green::float + red::float - blue::float) else 0::float end, 2::float), -2::float) > 0.15::float", "vari"),
    "exg": ("(2::float * green::float - red::float - blue::float) > 15::float", "exg"),
}


def _veg_sql(index: str) -> str:
    test, used = _SINGLE["ndvi" if index == "auto" else index]
    return f"with {_PTS} select point_id, {test} as vegetation, '{used}' as index_used from pts"


#: Points over the mean surface of the source's ground, and whether they are candidates.
_FROM_FILE = f"""with {_BOX.replace("from pts", "from own")}, {_cells(2, "own")}, {_raster("avg", 2, "classification in (2, 8)")}
select p.te, p.tn, coalesce(p.z - s.z between 0.02e0 and 0.40e0 and classification not in (2, 8), false) as is_found from cells p left join filled s using (te, tn, r, c)"""


def _halo_heights() -> str:
    """Heights of each tile's own points over the grid ground made with its halo."""
    halo = f"""all_pts as ({_PTS.split("as (", 1)[1]},
tiles as (select te, tn, min(x) x0, min(y) y0, max(x) x1, max(y) y1 from all_pts group by te, tn),
pts as (select p.* exclude (te, tn), t.te, t.tn, p.te = t.te and p.tn = t.tn as is_core from all_pts p join tiles t
  on p.te between t.te - 20 and t.te + 20 and p.tn between t.tn - 20 and t.tn + 20 and p.x between t.x0 - 5 and t.x1 + 5 and p.y between t.y0 - 5 and t.y1 + 5)"""
    return _FOUND.replace(f"with {_PTS}", f"with recursive {halo}", 1).replace("join surface s using (te, tn, r, c))", "join surface s using (te, tn, r, c) where is_core)")


def _lidar() -> str:
    """The whole lidar mode: halo, grid ground, candidates, clusters, labels, key points."""
    return f"""{_halo_heights()},
allowed as (select f.* from found f join (select te, tn, count(*) n from heights group by te, tn) p using (te, tn) join (select te, tn, count(*) n from found group by te, tn) m using (te, tn) where m.n >= 8 and m.n / p.n <= 0.05e0),
{_CLUSTERS.replace("found", "allowed")},
sized as (select te, tn, cluster, (max(x) - min(x)) * (max(y) - min(y)) a from member join allowed on id = point_id group by te, tn, cluster),
birds as (select distinct id from member join allowed on id = point_id join sized using (te, tn, cluster) where a between 0.005e0 and 1),
labelled as (select h.*, case when ground then 2 when b.id is not null then 20 else {_CASE} end as class from heights h left join birds b on b.id = h.point_id),
soil as (select te, tn, min(x) x0, min(y) y0 from labelled where class = 2 group by te, tn),
keys as (select arg_min(point_id, (z, point_id)) point_id from labelled join soil using (te, tn) where class = 2 group by te, tn, floor((y - y0) / 8.0e0), floor((x - x0) / 8.0e0))
select case when k.point_id is not null then 8 else class end as class, count(*) n from labelled l left join keys k using (point_id) group by 1"""


_SQL = {
    "grid_min_raster": f"with {_PTS},\n{_BOX},\n{_cells()} select {_T}, r, c, round(min(z), 9) + 0 z from cells group by te, tn, r, c",
    "grid_mean_raster": f"with {_PTS},\n{_BOX},\n{_cells()} select {_T}, r, c, round(avg(z), 9) + 0 z from cells group by te, tn, r, c",
    "voxel_thin_lowest": f"with {_PTS},\n{_BOX},\n{_cells()} select {_T}, r, c, arg_min(point_id, (z, point_id)) point_id, round(min(z), 9) + 0 z, round(max(z), 9) + 0 max_z from cells group by te, tn, r, c",
    "wall_filter_cells": f"with {_PTS},\n{_BOX},\n{_cells()} select {_T}, r, c, arg_min(point_id, (z, point_id)) point_id from cells group by te, tn, r, c having max(z) - min(z) < 0.5e0",
    "nearest_fill": f"{_FILLED} select {_T}, r, c, round(z, 9) + 0 z from filled",
    "focal_opening": f"{_FILLED},\n{_opened(2)} select {_T}, r, c, round(z, 9) + 0 z from surface",
    "median_smooth": f"""{_FILLED}, sizes as (select te, tn, max(r) mr, max(c) mc from filled group by te, tn),
asked as (select f.te, f.tn, f.r, f.c, greatest(least(f.r + i.i, mr), 0) sr, greatest(least(f.c + j.j, mc), 0) sc from filled f join sizes using (te, tn), (select unnest(range(-3, 4)) i) i, (select unnest(range(-3, 4)) j) j)
select a.te as tile_e, a.tn as tile_n, a.r, a.c, round(median(s.z), 9) + 0 z from asked a join filled s on a.te = s.te and a.tn = s.tn and a.sr = s.r and a.sc = s.c group by a.te, a.tn, a.r, a.c""",
    "nz_nearest": f"{_FILLED} select point_id, round(p.z - s.z, 9) + 0 nz from cells p join filled s using (te, tn, r, c)",
    "nz_bilinear": f"""with {_PTS},\n{_BOX},\n{_cells(2)},\n{_raster("min", 2)},
based as (select p.point_id, p.te, p.tn, p.z, (p.y - y0) / {CELL}e0 fy, (p.x - x0) / {CELL}e0 fx, greatest(least(floor((p.y - y0) / {CELL}e0), ceil((y1 - y0) / {CELL}e0)), 0)::int br, greatest(least(floor((p.x - x0) / {CELL}e0), ceil((x1 - x0) / {CELL}e0)), 0)::int bc from pts p join box using (te, tn))
select b.point_id, round(b.z - ((a.z * (1 - (fx - bc)) + b1.z * (fx - bc)) * (1 - (fy - br)) + (c1.z * (1 - (fx - bc)) + d.z * (fx - bc)) * (fy - br)), 9) + 0 nz
from based b join filled a on a.te = b.te and a.tn = b.tn and a.r = br and a.c = bc join filled b1 on b1.te = b.te and b1.tn = b.tn and b1.r = br and b1.c = bc + 1
join filled c1 on c1.te = b.te and c1.tn = b.tn and c1.r = br + 1 and c1.c = bc join filled d on d.te = b.te and d.tn = b.tn and d.r = br + 1 and d.c = bc + 1""",
    "ground_grid_classify": f"{_HEIGHTS} select {_CASE} as class, count(*) n, round(sum(nz), 4) sum_nz from heights group by 1",
    "probable_ground": f"{_HEIGHTS} select point_id, case when ground then 2 when abs(nz) <= 0.05e0 + 0.02e0 then 12 else {_CASE} end as class from heights",
    "height_bands": f"{_HEIGHTS} select point_id, {_CASE} as class from heights",
    "ground_from_source_class": f"""with {_PTS},\n{_BOX},\n{_cells(2)},\n{_raster("avg", 2, "classification in (2, 8)")},
heights as (select p.*, p.z - s.z as nz, classification in (2, 8) as ground from cells p join filled s using (te, tn, r, c))
select point_id, round(nz, 9) + 0 nz, {_CASE} as class from heights""",
    "model_keypoints": f"""with {_PTS}, own as (select * from pts where classification = 2), box as (select te, tn, min(x) x0, min(y) y0 from own group by te, tn)
select arg_min(point_id, (z, point_id)) point_id, {_T} from own join box using (te, tn) group by te, tn, floor((y - y0) / 8.0e0), floor((x - x0) / 8.0e0)""",
    "class_summary": f"with {_PTS} select classification::int as class, count(*) n from pts group by 1",
    "ndvi_mask": _veg_sql("ndvi"),
    "vari_mask": _veg_sql("vari"),
    "exg_mask": _veg_sql("exg"),
    "veg_auto": _veg_sql("auto"),
    "bird_candidates": f"{_FOUND} select point_id, round(nz, 9) + 0 nz from found",
    "candidate_guard": f"{_GUARD} select {_T}, n_points, n_candidates, case when n_candidates < 8 then 'too few' when n_candidates / n_points > 0.05e0 then 'too many' else 'ok' end as status from guard",
    "tile_status": f"{_STATUS} select {_T}, status, reason, n_points, n_ground, n_clusters from st",
    "bird_clusters": _FOUND.replace("with ", "with recursive ", 1) + f""",
{_CLUSTERS}
select {_T}, cluster as cluster_id, count(*) point_count, round(avg(x), 9) x_centroid, round(avg(y), 9) y_centroid, round(avg(z), 9) z_centroid, round(avg(nz), 9) nz_mean, round((max(x) - min(x)) * (max(y) - min(y)), 9) footprint_m2
from member join found on id = point_id group by te, tn, cluster having (max(x) - min(x)) * (max(y) - min(y)) between 0.005e0 and 1""",
    "classify_lidar": _lidar(),
    "classify_photo_vegetation": f"""{_halo_heights()} select point_id, case when ground then 2 when nz <= -0.1e0 then 7 when nz >= 0.1e0 and nz < 1 then 3
when nz >= 1 and nz < 3 then 4 when nz >= 3 then 5 when {_SINGLE["ndvi"][0]} then 3 else 1 end as class from heights""",
    "classify_from_file": f"""with {_PTS}, own as (select * exclude (classification), case when x < 20 and y < 20 and point_id % 997 <> 0 then 1 else classification end as classification from pts),
n as (select te, tn, count(*) n_points, count(*) filter (classification in (2, 8)) n_ground from own group by te, tn)
select {_T}, 'SKIPPED' as status, case when n_ground < 50 then 'too few ground points' else reason end as reason, n_points, n_ground from n join
(select te, tn, case when count(*) filter (is_found) < 8 then 'too few candidates' else 'too many candidates' end as reason from ({_FROM_FILE}) q group by te, tn) g using (te, tn)""",
    "voxel_downsample_2d": f"with {_PTS} select min(point_id) point_id from pts group by te, tn, floor(x / 0.1e0), floor(y / 0.1e0)",
    "voxel_downsample_3d": f"with {_PTS} select min(point_id) point_id from pts group by te, tn, floor(x / 0.25e0), floor(y / 0.25e0), floor(z / 0.25e0)",
    "cluster_expansion": f"""with {_PTS}, members as (select *, floor(x / 0.3e0)::int i, floor(y / 0.3e0)::int j from pts where zi between 60 and 400 and classification = 1),
asked as (select *, floor(x / 0.3e0)::int + di as i, floor(y / 0.3e0)::int + dj as j from pts, (select unnest(range(-1, 2)) di) a, (select unnest(range(-1, 2)) dj) b)
select distinct p.point_id, m.te as cluster from asked p join members m using (te, tn, i, j) where (p.x - m.x) * (p.x - m.x) + (p.y - m.y) * (p.y - m.y) <= 0.3e0 * 0.3e0""",
    "tile_assign": f"with {_PTS} select point_id, (floor(x / 15.0e0) * 15)::bigint tile_e, (floor(y / 15.0e0) * 15)::bigint tile_n from pts",
    "tile_index_bbox": f"""with {_PTS}, {_BOX}, n as (select te, tn, count(*) n_points from pts group by te, tn)
select {_T}, n_points, x1 <= x0 or y1 <= y0 as degenerate, round(x0, 9) xmin, round(x1, 9) xmax, round(y0, 9) ymin, round(y1, 9) ymax, round((x0 + x1) / 2, 9) cx, round((y0 + y1) / 2, 9) cy, round(greatest(x1 - x0, y1 - y0) * 0.03e0, 9) label_height from box join n using (te, tn)""",
    "tile_halo": f"""with {_PTS}, {_BOX} select p.point_id, b.te as tile_e, b.tn as tile_n, p.te = b.te and p.tn = b.tn as is_core
from pts p join box b on p.te between b.te - 20 and b.te + 20 and p.tn between b.tn - 20 and b.tn + 20 and p.x between b.x0 - 5 and b.x1 + 5 and p.y between b.y0 - 5 and b.y1 + 5""",
    "tile_name_parse": "select p_partkey, case when p_partkey % 3 = 0 then p_partkey * 10 end::bigint as east, case when p_partkey % 3 = 0 then p_size end::bigint as north from part",
    "auto_tile_size": f"""with {_PTS}, {_BOX}, n as (select te, tn, count(*) n_points from pts group by te, tn)
select {_T}, least(greatest(round_even(sqrt(4000e0 / (n_points / greatest((x1 - x0) * (y1 - y0), 1))) / 5, 0) * 5, 10), 200)::double as tile_size from box join n using (te, tn)""",
    "merge_compatible": f"with {_PTS} select 'f' || scan_id as src_file, count(*) n from pts where (scan_id % 3 = 0) = (select scan_id % 3 = 0 from pts order by 'f' || scan_id limit 1) group by 1",
    "bbox_scan": f"with {_PTS} select point_id from pts where x between 5e0 and 12.5e0 and y between 8e0 and 30e0",
    "head_sample": f"with {_PTS} select count(*) n, sum(zi)::bigint sum_zi from pts where point_id <= 1000",
    "header_scan": f"with {_PTS} select 'f' || scan_id as src_file, count(*) n_points, min(xi) x_min, max(xi) x_max, min(yi) y_min, max(yi) y_max, min(zi) z_min, max(zi) z_max from pts group by 1",
    "scan_type_detect": f"""with {_PTS}, s as (select count(*) n, count(distinct intensity) d, stddev_pop(intensity::double) sd, corr(intensity::double, (red + green + blue) / 3.0e0) co from pts where point_id <= 100000)
select n, d as distinct_intensities, round(sd, 4) intensity_std, round(co, 6) rgb_corr, case when n = 0 then 'unknown' when d <= 1 or sd < 5 then 'photogrammetry' when abs(co) > 0.95 then 'photogrammetry' when sd > 50 then 'lidar' else 'unknown' end scan_type from s""",
    "scan_type_variants": "select * from (values ('constant', 'photogrammetry'), ('colour', 'photogrammetry'), ('missing', 'photogrammetry'), ('bare', 'unknown'), ('empty', 'unknown')) t(variant, scan_type)",
    "e57_normalise": f"""with {_PTS}, v as (select *, case when scan_id between 1 and 3 then scan_id end k from pts where invalid = 0)
select point_id, round(case when k is null then x else (1 - 2 * (0.8e0 * 0.8e0)) * x - 2 * (0.8e0 * 0.6e0) * y + k * 10 end, 9) x, round(case when k is null then y else 2 * (0.8e0 * 0.6e0) * x + (1 - 2 * (0.8e0 * 0.8e0)) * y - 5 end, 9) y,
round(case when k is null then z else z + 1.5e0 end, 9) z, trunc(least(greatest(red / 65535e0, 0), 1) * 65535)::int red, trunc(least(greatest(green::double, 0), 1) * 65535)::int green, trunc(least(greatest(green / 65535e0, 0), 1) * 65535)::int green_scaled from v""",
    "scan_count": f"with {_PTS} select count(distinct scan_id) n_scans from pts",
    "ground_support": f"with {_PTS} select {_T}, count(*) filter (classification in (2, 8)) n_ground, count(*) filter (classification in (2, 8)) >= 50 as enough from pts group by te, tn",
    "run_summary": f"{_STATUS} select case when status = 'PROCESSED' then status else 'OTHER' end as status, count(*) n_tiles, sum(n_clusters)::bigint n_clusters from st group by 1",
    "rgb_audit": f"""with {_PTS} select 'red' as "column", true as present, count(red) n, min(red)::double lowest, max(red)::double highest from pts union all select 'green', true, count(green), min(green), max(green) from pts
union all select 'blue', true, count(blue), min(blue), max(blue) from pts union all select 'nir', true, count(nir), min(nir), max(nir) from pts union all select 'gps_time', false, 0, null, null""",
    "block_dedupe": """with blocks as (select distinct p_brand as name, 2.0e0 as width, 4.0e0 as height from part where p_brand <> 'Brand#11'
union all select distinct p_brand || '_' || p_size, case when p_size % 2 = 0 then p_size * 1.0e0 else 0e0 end, (p_size % 7) * 1.0e0 from part)
select v.name, b.name as base, case when v.width > 0 then v.width / b.width when v.height > 0 then v.height / b.height else 1e0 end as ratio from blocks v join blocks b on regexp_extract(v.name, '^(.+)_(\\d+)$', 1) = b.name""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        voxel_thin_lowest, wall_filter_cells, nearest_fill, focal_opening, median_smooth, nz_nearest, nz_bilinear, ground_grid_classify, probable_ground, height_bands,
        ground_from_source_class, model_keypoints, class_summary, bird_candidates, candidate_guard, bird_clusters, voxel_downsample_2d, voxel_downsample_3d, cluster_expansion,
        tile_assign, tile_index_bbox, tile_halo, tile_name_parse, auto_tile_size, merge_compatible, bbox_scan, head_sample, header_scan, tile_status, scan_type_detect,
        scan_type_variants, e57_normalise, scan_count, ground_support, run_summary, rgb_audit, block_dedupe, cloth_ground, ransac_roof, classify_lidar, classify_photogrammetry, classify_photo_vegetation, classify_from_file, classify_slam,
    )
    out = {f.__name__: f for f in named}
    out |= {"grid_min_raster": partial(raster_of, "min"), "grid_mean_raster": partial(raster_of, "mean")}
    out |= {name: partial(veg_mask, index) for name, index in (("ndvi_mask", "ndvi"), ("vari_mask", "vari"), ("exg_mask", "exg"), ("veg_auto", "auto"))}
    return out


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
