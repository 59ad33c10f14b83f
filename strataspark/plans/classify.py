"""One classification plan for a tile, a file or a whole survey."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, labels
from ..operators import cluster, ground, tiling, tilewise
from ..params import Params
from ..storage import Workspace

KEYS = ["tile_e", "tile_n"]


@dataclass
class Classified:
    """points: the input's columns, nz and class; clusters: accepted contacts; tiles: a status for each tile."""

    points: DataFrame
    clusters: DataFrame
    tiles: DataFrame


def bird_contacts(points: DataFrame, p: Params, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels of members of accepted clusters, cluster table, guard table) of ``points`` with nz and ground."""
    own = points.where(labels.bird_candidate(F.col("nz"), F.col("ground"), p.nz_min, p.nz_max))
    own = ws.table(own.select(*KEYS, "point_id", "x", "y", "z", "nz"), "candidates")
    guard = ws.table(cluster.guard(own, points, KEYS, p.dbscan_min_pts, p.candidate_share), "guard")
    allowed = own.join(guard.where("status = 'ok'").select(*KEYS), KEYS, "left_semi")
    members = ws.table(cluster.dbscan(allowed, KEYS, p.dbscan_eps, p.dbscan_min_pts, ws), "members")
    table = ws.table(cluster.cluster_table(own, members.select("point_id", "cluster", *KEYS), KEYS, p.min_footprint_m2, p.max_footprint_m2), "clusters")
    accepted = members.join(table.select(F.col("cluster_id").alias("cluster")), "cluster", "left_semi")
    return accepted.select("point_id", "cluster"), table, guard


def classify(points: DataFrame, params: Params | None = None) -> Classified:
    """Classify ``points(point_id, x, y, z, ...)``, tile by tile with halos; row count and columns are kept."""
    p = (params or Params()).for_source()
    ws = Workspace(points.sparkSession, "classify")
    photo = p.point_cloud_source == "photogrammetry"
    mask = None
    if photo:
        mask, _ = color.vegetation_mask(points, p.vegetation_index, ndvi_threshold=p.ndvi_threshold, vari_threshold=p.vari_threshold, exg_threshold=p.exg_threshold)
    points = points.withColumn("_veg", F.lit(False) if mask is None else F.coalesce(mask, F.lit(False)))
    halo = ws.table(tiling.with_halo(points, p.tile_size, p.buffer_m), "halo")
    poor = None
    if p.ground_source == "from_file":
        # tiles whose labels can't make a surface are left as they are
        poor = ws.table(ground.support(halo.where("is_core"), KEYS).where("not enough").select(*KEYS), "unsupported")
        left_out = halo.where("is_core").join(poor, KEYS, "left_semi").drop("is_core", "_veg")
        halo = halo.join(poor, KEYS, "left_anti")
    surface_points = halo.where("not _veg or is_core") if p.mask_before_ground else halo
    heights = ws.table(ground.ground(surface_points, KEYS, p, ws).drop("is_core"), "heights")
    label = labels.base_label(F.col("ground"))
    protected = [labels.GROUND, labels.BIRD]
    if photo:
        label = F.when(F.col("_veg") & ~F.col("ground"), labels.LOW_VEG).otherwise(label).cast("short")
        protected.append(labels.BUILDING)
        clusters, members = _no_clusters(heights), None
        guard = heights.groupBy(*KEYS).agg(F.count("*").alias("n_points")).withColumns({"n_candidates": F.lit(0).cast("long"), "status": F.lit("off")})
    else:
        members, clusters, guard = bird_contacts(heights, p, ws)
    labelled = heights.withColumn("class", label)
    if members is not None:
        labelled = labelled.join(members.withColumnRenamed("cluster", "_cluster"), "point_id", "left")
        labelled = labelled.withColumn("class", F.when(F.col("_cluster").isNotNull(), labels.BIRD).otherwise(F.col("class")).cast("short")).drop("_cluster")
    if photo and p.detect_buildings:
        roofs = roof_points(heights, p)
        labelled = labelled.join(ws.table(roofs.select("point_id").withColumn("_roof", F.lit(True)), "roofs"), "point_id", "left")
        labelled = labelled.withColumn("class", F.when(F.col("_roof"), labels.BUILDING).otherwise(F.col("class")).cast("short")).drop("_roof")
    threshold = p.ground_threshold if p.ground_method == "grid" else p.csf_class_threshold
    labelled = labelled.withColumn(
        "class",
        labels.height_label(
            F.col("class"), F.col("nz"), threshold=threshold, low_min=p.veg_low_min, low_max=p.veg_low_max, med_max=p.veg_med_max,
            noise=p.noise_below_ground, probable_band=p.probable_ground_band, protected=tuple(protected), vegetation=p.classify_vegetation,
        ),
    )
    if p.classify_model_keys:
        labelled = ground.key_points(labelled, KEYS, p.modelkey_step_m)
    labelled = labelled.drop("_veg", "ground")
    if poor is not None:
        own = F.coalesce(F.col("classification"), F.lit(labels.UNCLASSIFIED)).cast("short")
        labelled = labelled.unionByName(left_out.withColumns({"nz": F.lit(None).cast("double"), "class": own}))
    out = ws.table(labelled, "classified")
    tiles = tile_results(out, clusters, guard, poor)
    return Classified(out, clusters, tiles)


def roof_points(points: DataFrame, p: Params) -> DataFrame:
    """Points of roofs among what is high above the ground and neither ground nor vegetation."""
    own = points.where(~F.col("ground") & (F.col("nz") > p.building_min_height_agl))
    if "_veg" in points.columns:
        own = own.where("not _veg")
    return tilewise.roofs(own, KEYS, threshold=p.building_plane_threshold, min_pts=p.building_min_cluster_pts, eps=p.building_cluster_eps, min_area=p.building_min_area_m2)


def _no_clusters(points: DataFrame) -> DataFrame:
    kinds = "cluster_id long, point_count long, x_centroid double, y_centroid double, z_centroid double, nz_mean double, footprint_m2 double"
    keys = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in KEYS)
    return points.sparkSession.createDataFrame([], f"{keys}, {kinds}")


def tile_results(points: DataFrame, clusters: DataFrame, guard: DataFrame, poor: DataFrame | None = None) -> DataFrame:
    """(keys, status, reason, n_points, n_ground, n_bird, n_clusters); ``poor`` are tiles without ground to work on."""
    n = points.groupBy(*KEYS).agg(F.count("*").alias("n_points"), F.count_if(F.col("class").isin(2, 8)).alias("n_ground"), F.count_if(F.col("class") == 20).alias("n_bird"))
    m = clusters.groupBy(*KEYS).agg(F.count("*").alias("n_clusters"))
    out = n.join(m, KEYS, "left").join(guard.select(*KEYS, F.col("status").alias("_guard")), KEYS, "left")
    error = F.lit(None).cast("string")
    if poor is not None:
        out = out.join(poor.withColumn("_error", F.lit("too few ground points")), KEYS, "left")
        error = F.col("_error")
    count = F.coalesce("n_clusters", F.lit(0)).cast("long")
    status = labels.tile_status(count, F.lit(True), error)
    reason = F.when(error.isNotNull(), error).when(F.col("_guard").isin("too few", "too many"), F.concat(F.col("_guard"), F.lit(" candidates"))).when(count == 0, "no clusters")
    return out.select(*KEYS, status.alias("status"), reason.alias("reason"), "n_points", "n_ground", "n_bird", count.alias("n_clusters"))


def class_counts(points: DataFrame, label: str = "class") -> DataFrame:
    return points.groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))


def run_summary(tiles: DataFrame) -> DataFrame:
    """Tiles and their points by status; whatever isn't PROCESSED counts as other."""
    group = F.when(F.col("status") == "PROCESSED", "PROCESSED").otherwise("OTHER")
    return tiles.groupBy(group.alias("status")).agg(F.count("*").alias("n_tiles"), F.sum("n_clusters").alias("n_clusters"))


def classify_each(clouds: dict[str, DataFrame], params: Params | None, save: Callable[[str, Classified], None]) -> list[tuple]:
    """(src_file, status, reason, n_points, n_ground, n_bird, n_clusters) of each cloud, classified by itself and saved.

    A cloud that fails gets the status FAILED and its error; the others go on.
    """
    rows = []
    for name, points in clouds.items():
        try:
            done = classify(points, params)
            save(name, done)
            sums = done.tiles.agg(*(F.sum(c).alias(c) for c in ("n_points", "n_ground", "n_bird", "n_clusters"))).first()
            status = "PROCESSED" if sums.n_clusters else "SKIPPED"
            rows.append((name, status, None if sums.n_clusters else "no clusters", *(int(v or 0) for v in sums)))
        except Exception as error:  # one file must not end the batch
            rows.append((name, "FAILED", str(error).partition("\n")[0][:300], 0, 0, 0, 0))
    return rows
