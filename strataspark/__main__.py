"""python -m strataspark classify|batch|tile|merge|index|audit|detect ...: thin commands over the API.

``classify`` takes all inputs as one survey, ``batch`` each by itself with a status row.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import detect, tiling
from .params import Params
from .plans.classify import Classified, classify, classify_each, run_summary
from .sources import dxf, tables


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strataspark")
    parser.add_argument("command", choices=["classify", "batch", "tile", "merge", "index", "audit", "detect"])
    parser.add_argument("inputs", nargs="+")
    parser.add_argument("--out")
    parser.add_argument("--format")
    parser.add_argument("--auto-tile-size", action="store_true", help="tile size from the first input's density")
    for f in fields(Params):
        parser.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, type=(lambda s: s.lower() == "true") if f.type == "bool" else {"int": int, "float": float}.get(f.type, str), default=f.default)
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    clouds, formats = tables.read_all(spark, a.inputs, a.format)
    params = Params(**{f.name: getattr(a, f.name) for f in fields(Params)})
    if a.auto_tile_size:
        box = clouds[0].agg(F.count("*").alias("n_points"), *(fn(v).alias(f"{v}{n}") for v in "xy" for n, fn in (("min", F.min), ("max", F.max))))
        params = replace(params, tile_size=tiling.auto_tile_size(box).first().tile_size)
    if a.command == "batch":

        def save(name: str, done: Classified) -> None:
            done.points.write.mode("overwrite").parquet(f"{a.out}/{name}/points")
            tables.write_clusters(done.clusters, f"{a.out}/{name}/clusters")

        names = [f"{i:03d}-{os.path.splitext(os.path.basename(p.rstrip('/')))[0]}" for i, p in enumerate(a.inputs)]
        rows = classify_each(dict(zip(names, clouds, strict=True)), params, save)
        status = spark.createDataFrame(rows, "src_file string, status string, reason string, n_points long, n_ground long, n_bird long, n_clusters long")
        status.coalesce(1).write.mode("overwrite").csv(f"{a.out}/status", header=True)
        status.show(truncate=False)
        return
    points, skipped = tiling.merge(clouds, formats)
    for i in skipped:
        print(f"skipped {a.inputs[i]}: its point format is {formats[i]}, not {formats[0]}")
    if a.command == "classify":
        done = classify(points, params)
        tables.write_classified(done.points, f"{a.out}/points", points)
        tables.write_clusters(done.clusters, f"{a.out}/clusters")
        done.tiles.write.mode("overwrite").parquet(f"{a.out}/tiles")
        run_summary(done.tiles).show()
    elif a.command == "tile":
        tables.write_classified(tiling.with_tile(points, a.tile_size), a.out, points)
    elif a.command == "merge":
        points.write.mode("overwrite").parquet(a.out)
    elif a.command == "index":
        text = dxf.tile_outlines(tiling.tile_index(tiling.with_tile(points, a.tile_size)).toLocalIterator(), skip_degenerate=True)
        with open(a.out, "w") as f:
            f.write(text)
    elif a.command == "audit":
        detect.audit(points, "red", "green", "blue", "nir", "intensity", "classification").show()
    else:
        detect.scan_type(points).show()


if __name__ == "__main__":
    main()
