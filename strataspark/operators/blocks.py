"""Numbered copies of drawing blocks folded into their originals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_blocks(blocks: DataFrame, *, ignore_case: bool = False) -> DataFrame:
    """(name, base, ratio) for each ``blocks(name, width, height)`` named <base>_<digits> whose base exists.

    The ratio is that of the widths, else that of the heights, else 1. With ``ignore_case`` names
    match without regard to case and anonymous blocks (*...) are left out.
    """
    own = blocks
    if ignore_case:
        own = own.where(~F.col("name").startswith("*"))
    key = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    named = own.withColumn("_base", F.regexp_extract("name", r"^(.+)_(\d+)$", 1)).where("_base <> ''").withColumn("_key", key(F.col("_base")))
    bases = own.select(F.col("name").alias("base"), key(F.col("name")).alias("_key"), F.col("width").alias("_w"), F.col("height").alias("_h")).dropDuplicates(["_key"])
    ratio = F.when((F.col("_w") > 0) & (F.col("width") > 0), F.col("width") / F.col("_w")).when((F.col("_h") > 0) & (F.col("height") > 0), F.col("height") / F.col("_h")).otherwise(1.0)
    return named.join(bases, "_key").select("name", "base", ratio.alias("ratio"))


def rewrite_inserts(inserts: DataFrame, folds: DataFrame) -> DataFrame:
    """``inserts(name, xs, ys, zs, ...)`` of folded blocks renamed to their base and scaled by the ratio."""
    joined = inserts.join(folds, "name", "left")
    scaled = {c: F.col(c) * F.coalesce("ratio", F.lit(1.0)) for c in ("xs", "ys", "zs")}
    return joined.withColumns(scaled).withColumn("name", F.coalesce("base", "name")).drop("base", "ratio")
