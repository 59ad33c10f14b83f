"""Scan-type detection, sensor channel conversion, and the audit of a cloud's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiling import head


def scan_type(points: DataFrame, sample: int = 100_000) -> DataFrame:
    """One row: n, distinct_intensities, intensity_std, rgb_corr, scan_type (photogrammetry, lidar or unknown)."""
    own = head(points, sample)
    rgb = all(c in points.columns for c in ("red", "green", "blue"))
    intensity = "intensity" in points.columns
    bright = (F.col("red") + F.col("green") + F.col("blue")) / 3.0 if rgb else F.lit(None).cast("double")
    level = F.col("intensity").cast("double") if intensity else F.lit(None).cast("double")
    stats = own.agg(F.count("*").alias("n"), F.countDistinct(level).alias("distinct_intensities"), F.stddev_pop(level).alias("intensity_std"), F.try_divide(F.covar_pop(level, bright), F.stddev_pop(level) * F.stddev_pop(bright)).alias("rgb_corr"))
    n, distinct, std, corr = (F.col(c) for c in ("n", "distinct_intensities", "intensity_std", "rgb_corr"))
    kind = (
        F.when(n == 0, "unknown")
        .when(F.lit(not intensity), "photogrammetry" if rgb else "unknown")
        .when((distinct <= 1) | (std < 5), "photogrammetry")
        .when(F.lit(rgb) & F.coalesce(~F.isnan(corr) & (F.abs(corr) > 0.95), F.lit(False)), "photogrammetry")
        .when(std > 50, "lidar")
        .otherwise("unknown")
    )
    return stats.withColumn("scan_type", kind)


def valid_scan_points(raw: DataFrame) -> DataFrame:
    """Raw scan points that aren't marked invalid, or are finite where there is no mark."""
    finite = F.lit(True)
    for v in ("x", "y", "z"):
        finite = finite & F.col(v).isNotNull() & ~F.isnan(v) & (F.abs(F.col(v)) != float("inf"))
    return raw.where(F.coalesce(F.col("invalid") == 0, finite) if "invalid" in raw.columns else finite)


def scan_count(raw: DataFrame) -> DataFrame:
    """One row: n_scans, the number of scans in a raw table."""
    return raw.agg(F.countDistinct("scan_id").alias("n_scans"))


def posed(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points in the global frame: rotated by the scan's unit quaternion (qw, qx, qy, qz), then moved by (tx, ty, tz).

    ``poses`` has one row a scan; scans without a pose stay as they are.
    """
    w, i, j, k = (F.col(c) for c in ("qw", "qx", "qy", "qz"))
    x, y, z = (F.col(c) for c in "xyz")
    turned = {
        "x": (1 - 2 * (j * j + k * k)) * x + 2 * (i * j - k * w) * y + 2 * (i * k + j * w) * z + F.col("tx"),
        "y": 2 * (i * j + k * w) * x + (1 - 2 * (i * i + k * k)) * y + 2 * (j * k - i * w) * z + F.col("ty"),
        "z": 2 * (i * k - j * w) * x + 2 * (j * k + i * w) * y + (1 - 2 * (i * i + j * j)) * z + F.col("tz"),
    }
    joined = points.join(poses, "scan_id", "left")
    moved = {v: F.when(w.isNotNull(), e).otherwise(F.col(v)) for v, e in turned.items()}
    return joined.withColumns(moved).drop("qw", "qx", "qy", "qz", "tx", "ty", "tz")


def channel(value: Column, max_value: float = 1.0) -> Column:
    """A 16-bit channel of a value that is clipped to 0..max_value; the original convention is a maximum of 1."""
    return (F.least(F.greatest(value / max_value, F.lit(0.0)), F.lit(1.0)) * 65535).cast("int")


def audit(points: DataFrame, *columns: str) -> DataFrame:
    """column, present, n, lowest, highest: a row for each of the columns asked for; present ones hold a value."""
    has = [c for c in columns if c in points.columns]
    pairs = [F.struct(F.lit(c).alias("column"), (F.count(c) > 0 if c in has else F.lit(False)).alias("present"), (F.count(c) if c in has else F.lit(0).cast("long")).alias("n"), *((fn(F.col(c).cast("double")) if c in has else F.lit(None).cast("double")).alias(a) for fn, a in ((F.min, "lowest"), (F.max, "highest")))) for c in columns]
    return points.agg(F.array(*pairs).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
