"""Tiles classified as they arrive; the stream's checkpoint and a manifest replace a progress file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..params import Params
from ..plans.classify import classify


def classify_stream(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, params: Params | None = None, **options) -> StreamingQuery:
    """Classify Parquet files of points that appear in ``folder``; results go to out/{points,clusters,tiles}.

    Each micro-batch is a plan of its own; a batch that is run again after a failure replaces what
    it wrote, since its id names its folders. A batch sees no neighbours that come later, so where halos
    matter whole surveys should be classified at once.
    """
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)

    def batch(points: DataFrame, number: int) -> None:
        done = classify(points, params)
        for name in ("points", "clusters", "tiles"):
            getattr(done, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tiles that no earlier run has finished; tiles that failed then are taken again."""
    done = manifest.where(F.col("status").isin("PROCESSED", "SKIPPED") & F.coalesce(F.col("reason"), F.lit("")).isin("", "no clusters", "too few candidates", "too many candidates"))
    return tiles.join(done, ["tile_e", "tile_n"], "left_anti")
