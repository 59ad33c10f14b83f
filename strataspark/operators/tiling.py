"""Tile keys, names, indexes, halos, merging, and the choice of a tile size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = ("tile_e", "tile_n")


def with_tile(points: DataFrame, size: float) -> DataFrame:
    """Adds the pair of lower-left corners, (tile_e, tile_n)."""
    corner = lambda c: (F.floor(F.col(c) / size) * size).cast("long")
    return points.withColumns({"tile_e": corner("x"), "tile_n": corner("y")})


def in_box(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Points of a closed box in the plane."""
    return points.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def head(points: DataFrame, n: int = 100_000) -> DataFrame:
    """The first n points in file order (ids count from 1)."""
    return points.where(F.col("point_id") <= n)


def tile_name(path: Column) -> Column:
    """struct(east, north) of a file stem that ends in two integers after underscores, else nulls."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    number = lambda k: F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(k)).try_cast("long"))
    both = number(-2).isNotNull() & number(-1).isNotNull()
    return F.struct(F.when(both, number(-2)).alias("east"), F.when(both, number(-1)).alias("north"))


def tile_index(points: DataFrame) -> DataFrame:
    """Bounding box, centre and label height (3 % of the longer side) of each tile."""
    box = points.groupBy(*TILE).agg(F.count("*").alias("n_points"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    dx, dy = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    return box.withColumns({
        "cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2,
        "label_height": F.greatest(dx, dy) * 0.03, "degenerate": (dx <= 0) | (dy <= 0),
    })


def with_halo(points: DataFrame, size: float, buffer: float) -> DataFrame:
    """Each tile's own points (is_core) and its neighbours' within ``buffer`` of its actual bounding box.

    Every point is sent to the tiles of its 3 x 3 neighbourhood that it may concern: those whose
    nominal square, which holds the box, is within the buffer. That is one shuffle, whatever the
    number of tiles. Corners are whole numbers, so the size must be one, and at least the buffer.
    """
    if size != int(size) or size < 1:
        raise ValueError(f"tile size {size} is not a whole number of metres")
    if buffer > size:
        raise ValueError(f"buffer {buffer} is wider than a tile of {size}")
    points = with_tile(points, size)
    box = points.groupBy(*TILE).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    near = F.array(*(F.struct((F.col("tile_e") + F.lit(int(i * size))).alias("e"), (F.col("tile_n") + F.lit(int(j * size))).alias("n")) for i, j in steps))

    def concerns(t: Column) -> Column:
        return (F.col("x") >= t["e"] - buffer) & (F.col("x") <= t["e"] + size + buffer) & (F.col("y") >= t["n"] - buffer) & (F.col("y") <= t["n"] + size + buffer)

    sent = points.withColumn("_to", F.explode(F.filter(near, concerns)))
    core = (F.col("_to.e") == F.col("tile_e")) & (F.col("_to.n") == F.col("tile_n"))
    sent = sent.withColumn("is_core", core).withColumns({"tile_e": F.col("_to.e"), "tile_n": F.col("_to.n")}).drop("_to")
    inside = (F.col("x") >= F.col("_x0") - buffer) & (F.col("x") <= F.col("_x1") + buffer) & (F.col("y") >= F.col("_y0") - buffer) & (F.col("y") <= F.col("_y1") + buffer)
    return sent.join(box, list(TILE)).where(inside).drop("_x0", "_x1", "_y0", "_y1")


def auto_tile_size(headers: DataFrame, target: float = 30e6, smallest: float = 10.0, largest: float = 200.0, least_density: float = 0.0) -> DataFrame:
    """Adds tile_size: sqrt(target / density), to 5 m half-even, within bounds; 100 where there is no density."""
    area = F.greatest((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), F.lit(1.0))
    density = F.greatest(F.col("n_points") / area, F.lit(least_density))
    size = F.least(F.greatest(F.bround(F.sqrt(F.lit(target) / density) / 5) * 5, F.lit(smallest)), F.lit(largest))
    return headers.withColumn("tile_size", F.when(density > 0, size).otherwise(F.lit(100.0)))


def merge(clouds: list[DataFrame], formats: list[int]) -> tuple[DataFrame, list[int]]:
    """(union of the clouds of the first one's point format, indexes of those skipped)."""
    if not clouds:
        raise ValueError("nothing to merge")
    same = [i for i, f in enumerate(formats) if f == formats[0]]
    kept = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [clouds[i] for i in same])
    return kept, [i for i in range(len(clouds)) if i not in same]


def merge_compatible(points: DataFrame, file: str = "src_file", fmt: str = "point_format") -> DataFrame:
    """Points of files whose point format is that of the first file by name."""
    files = points.groupBy(file).agg(F.min(fmt).alias("_own"))
    first = files.agg(F.min(F.struct(file, "_own")).alias("first")).select(F.col("first._own").alias("_first"))
    kept = files.crossJoin(F.broadcast(first)).where("_own = _first").select(file)  # one row
    return points.join(kept, file, "left_semi")
