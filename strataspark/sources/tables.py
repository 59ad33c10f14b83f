"""Readers by suffix and the writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import importable
from . import las


def kind_of(spark: SparkSession, path: str) -> str:
    """las, csv or parquet: by the suffix of the path, or of the files in a folder; parquet where nothing tells."""
    names = [path.lower()]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(at) and system.getFileStatus(at).isDirectory():
        names = [f.getPath().getName().lower() for f in system.listStatus(at)]
    kinds = (("las", (".las", ".laz")), ("csv", (".csv", ".txt")), ("e57", (".e57",)))
    return next((k for k, ends in kinds if any(n.endswith(ends) for n in names)), "parquet")


def read_points(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Points of Parquet, CSV or LAS files or folders of them; the format follows the suffix unless given."""
    kind = fmt or kind_of(spark, path)
    if kind == "e57":
        raise ValueError("E57 files need a converter; load the converted scans and use operators.detect for validity, pose and channels")
    if kind == "las":
        las.register(importable(spark))
    if kind == "csv":
        options.setdefault("header", True)
        options.setdefault("inferSchema", True)
    return spark.read.format(kind).options(**options).load(path)


def read_all(spark: SparkSession, paths: list[str], fmt: str | None = None, **options) -> tuple[list[DataFrame], list[int]]:
    """(the points of each path, their point formats): ids follow on from path to path, so none comes twice.

    LAS counts and formats come from headers; other files count as format 0, and their largest id is read.
    """
    clouds, formats, before = [], [], 0
    for path in paths:
        cloud, kind = read_points(spark, path, fmt, **options), fmt or kind_of(spark, path)
        clouds.append(cloud.withColumn("point_id", F.col("point_id") + F.lit(before)))
        if kind == "las":
            heads = [las.read_header(f) for f in las.find(path)]
            before += sum(h.count for h in heads)
            formats.append(heads[0].point_format if heads else -1)
        else:
            before += cloud.agg(F.max("point_id")).first()[0] or 0
            formats.append(0)
    return clouds, formats


def write_classified(points: DataFrame, path: str, source: DataFrame, fmt: str = "parquet", by_tile: bool = True, **options) -> None:
    """Write points partitioned by tile; a row count other than the source's raises."""
    have, want = points.count(), source.count()
    if have != want:
        raise ValueError(f"{have} classified points for {want} points of the source")
    if fmt == "las":
        las.register(importable(points.sparkSession))
        own = points.repartition("tile_e", "tile_n") if by_tile else points
        own.write.format("las").options(**options).mode("append").save(path)
        return
    writer = points.repartition("tile_e", "tile_n").write.partitionBy("tile_e", "tile_n") if by_tile else points.write
    writer.mode("overwrite").format(fmt).options(**options).save(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """Cluster table as one CSV with a header, written even when there are no clusters."""
    clusters.coalesce(1).write.mode("overwrite").csv(path, header=True)
