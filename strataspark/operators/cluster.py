"""Density-based clusters in the plane, voxel downsampling, and cluster tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .components import components

#: Pairs of points that two cells may list to find one within reach.
LISTED = 4096
#: Places of a cell that its neighbours' points meet one by one, and how often cells of more are halved.
FEW, LEVELS = 64, 20


def dbscan(points: DataFrame, keys: list[str], eps: float, min_pts: int, ws: Workspace) -> DataFrame:
    """(keys, point_id, cluster) of clustered points; noise is absent. Point ids are unique over all tiles.

    A core point has min_pts neighbours, itself included. The cluster is the smallest core id; a
    border point joins the adjacent cluster of smallest id, as in a scan in id order.

    Points of one cell of side eps / sqrt(2) are neighbours, so a cell with min_pts points is all
    core and one node. Pairs are listed for points of other cells only, fewer than min_pts a cell,
    which keeps them linear in the number of points; two full cells are linked by ``_touching``.
    """
    side = eps / 2**0.5 * (1 - 1e-9)
    own = points.select(*keys, "point_id", "x", "y", F.floor(F.col("x") / side).alias("i"), F.floor(F.col("y") / side).alias("j"))
    cells = own.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"), F.min("point_id").alias("first"))
    own = own.join(cells, [*keys, "i", "j"]).withColumn("full", F.col("n") >= min_pts)
    own = ws.table(own.withColumn("node", F.when(F.col("full"), F.col("first")).otherwise(F.col("point_id"))).drop("n", "first"), "cells")
    loose = own.where("not full")
    near = ws.table(_within(loose, own, keys, eps, [(i, j) for i in range(-2, 3) for j in range(-2, 3)]), "near")
    core = near.groupBy("a").count().where(F.col("count") >= min_pts).select(F.col("a").alias("b"))
    core = ws.table(core, "core")
    to_core = ws.table(near.where("full").select(*keys, "a", "node").union(near.where("not full").join(core, "b", "left_semi").select(*keys, "a", "node")), "to-core")
    links = to_core.join(core.withColumnRenamed("b", "a"), "a", "left_semi").select("a", F.col("node").alias("b"))
    comps = components(links.union(_touching(own.where("full"), keys, eps, side, ws)), ws).withColumnRenamed("component", "cluster")
    member = own.where("full").select(*keys, "point_id", "node").union(to_core.select(*keys, F.col("a").alias("point_id"), "node"))
    labelled = member.join(comps, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    return labelled.groupBy(*keys, "point_id").agg(F.min("cluster").alias("cluster"))


def _within(left: DataFrame, right: DataFrame, keys: list[str], eps: float, steps: list[tuple[int, int]]) -> DataFrame:
    """(keys, a, own, b, node, full): pairs at most eps apart whose cells differ by one of ``steps``."""
    cells = F.explode(F.array(*(F.struct((F.col("i") + i).alias("i"), (F.col("j") + j).alias("j")) for i, j in steps)))
    a = left.select(*keys, F.col("point_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("node").alias("own"), cells.alias("c"))
    a = a.select(*keys, "a", "ax", "ay", "own", "c.i", "c.j")
    b = right.select(*keys, "i", "j", F.col("point_id").alias("b"), "x", "y", "node", "full")
    d2 = (F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))
    return a.join(b, [*keys, "i", "j"]).where(d2 <= eps * eps).select(*keys, "a", "own", "b", "node", "full")


def _touching(full: DataFrame, keys: list[str], eps: float, side: float, ws: Workspace) -> DataFrame:
    """(a, b): nodes of full cells that have points at most eps apart.

    Boxes around the points decide most pairs of cells: linked where even their far ends are within
    eps, apart where their near ends aren't. Only the few others list pairs of points, or, if that
    were over ``LISTED`` pairs, are halved each way and their parts' boxes compared, level by level.
    """
    boxes = ws.table(_boxes(full, keys, side), "boxes")
    a, b = _end(boxes, "a"), _end(boxes, "b")
    ahead = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    cells = F.explode(F.array(*(F.struct((F.col("ai") + i).alias("bi"), (F.col("aj") + j).alias("bj")) for i, j in ahead)))
    pairs = a.withColumn("c", cells).select(*a.columns, "c.bi", "c.bj").join(b, [*keys, "bi", "bj"])
    linked, open_pairs = _judged(pairs, eps, ws)
    done, size = [linked], side
    while not open_pairs.isEmpty():
        few = open_pairs.where(F.col("am") * F.col("bm") <= LISTED)
        many = open_pairs.where(F.col("am") * F.col("bm") > LISTED)
        cell = lambda v, s=size: F.floor(F.col(v) / s)
        own = full.select("node", "x", "y", cell("x").alias("i"), cell("y").alias("j"))
        one, two = (own.select(*(F.col(c).alias(f"{e}{c}") for c in own.columns)) for e in "ab")
        d2 = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
        listed = few.select("anode", "ai", "aj", "bnode", "bi", "bj").join(one, ["anode", "ai", "aj"]).join(two, ["bnode", "bi", "bj"])
        found = ws.table(listed.where(d2 <= eps * eps).select("anode", "bnode").distinct(), "listed")
        done.append(found)
        size /= 2
        parts = _boxes(full.join(many.select(F.col("anode").alias("node")).union(many.select("bnode")).distinct(), "node", "left_semi"), keys, size)
        parts = ws.table(parts, "parts")
        halves = [many.select("anode", "bnode", "ai", "aj", "bi", "bj").join(found, ["anode", "bnode"], "left_anti")]
        for e in "ab":
            own = _end(parts, e).withColumns({"_i": F.shiftright(f"{e}i", 1), "_j": F.shiftright(f"{e}j", 1)}).drop(*keys)
            up = halves[-1].withColumnsRenamed({f"{e}i": "_i", f"{e}j": "_j"})
            halves.append(up.join(own, [f"{e}node", "_i", "_j"]).drop("_i", "_j"))
        linked, open_pairs = _judged(halves[-1], eps, ws)
        done.append(linked)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(F.col("anode").alias("a"), F.col("bnode").alias("b"))


def _boxes(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """(keys, node, i, j, m, x0, x1, y0, y1) of each node's points in each cell of side ``size``."""
    cell = lambda v: F.floor(F.col(v) / size).alias("i" if v == "x" else "j")
    extent = (fn(v).alias(f"{v}{k}") for v in "xy" for k, fn in ((0, F.min), (1, F.max)))
    return points.select(*keys, "node", "x", "y", cell("x"), cell("y")).groupBy(*keys, "node", "i", "j").agg(F.count("*").alias("m"), *extent)


def _end(boxes: DataFrame, e: str) -> DataFrame:
    return boxes.withColumnsRenamed({c: f"{e}{c}" for c in ("node", "i", "j", "m", "x0", "x1", "y0", "y1")})


def _judged(pairs: DataFrame, eps: float, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(linked pairs of nodes, pairs of boxes that their boxes don't decide, of nodes that aren't linked yet)."""
    zero = F.lit(0.0)
    gap = [F.greatest(F.col(f"a{v}0") - F.col(f"b{v}1"), F.col(f"b{v}0") - F.col(f"a{v}1"), zero) for v in "xy"]
    reach = [F.greatest(F.col(f"a{v}1") - F.col(f"b{v}0"), F.col(f"b{v}1") - F.col(f"a{v}0")) for v in "xy"]
    square = lambda d: d[0] * d[0] + d[1] * d[1]
    own = pairs.withColumn("sure", square(reach) <= eps * eps).where(F.col("sure") | (square(gap) <= eps * eps))
    own = ws.table(own.select("anode", "bnode", "ai", "aj", "bi", "bj", "am", "bm", "sure"), "judged")
    linked = own.where("sure").select("anode", "bnode").distinct()
    return linked, own.where("not sure").drop("sure").join(linked, ["anode", "bnode"], "left_anti")


def cluster_table(points: DataFrame, labels: DataFrame, keys: list[str], min_area: float = 0.0, max_area: float = float("inf")) -> DataFrame:
    """Count, centroid, mean nz and footprint (bounding box area) of clusters within the area limits."""
    joined = labels.join(points.select("point_id", "x", "y", "z", "nz"), "point_id")
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    table = joined.groupBy(*keys, F.col("cluster").alias("cluster_id")).agg(
        F.count("*").alias("point_count"), F.avg("x").alias("x_centroid"), F.avg("y").alias("y_centroid"), F.avg("z").alias("z_centroid"), F.avg("nz").alias("nz_mean"), area.alias("footprint_m2")
    )
    return table.where(F.col("footprint_m2").between(min_area, max_area))


def downsample_2d(points: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """The first point of each square cell."""
    own = points.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell)})
    first = own.groupBy(*keys, "_i", "_j").agg(F.min("point_id").alias("point_id")).select("point_id")
    return points.join(first, "point_id", "left_semi")


def downsample_3d(points: DataFrame, keys: list[str], cell: float, most: int | None = None) -> DataFrame:
    """The first point of each cube; ``most`` takes that many of them by hash where there are more."""
    own = points.withColumns({"_i": F.floor(F.col("x") / cell), "_j": F.floor(F.col("y") / cell), "_k": F.floor(F.col("z") / cell)})
    first = own.groupBy(*keys, "_i", "_j", "_k").agg(F.min("point_id").alias("point_id")).select("point_id")
    if most is not None:
        first = first.orderBy(F.xxhash64("point_id"), "point_id").limit(most)
    return points.join(first, "point_id", "left_semi")


def expand(members: DataFrame, points: DataFrame, keys: list[str], eps: float, ws: Workspace) -> DataFrame:
    """(keys, point_id, cluster): points within eps of any member(x, y, cluster); possibly in several clusters.

    Whether a member is in reach counts, not how many are, so points meet boxes: one around a
    cluster's members in the point's own cell of side eps / sqrt(2), which is in reach, and only in
    cells without such members the members of the cells around, or a cell's box where it has more
    than ``FEW`` places. Members without a cluster or a finite place are in reach of nothing.
    """
    side = eps / 2**0.5 * (1 - 1e-6)
    cell = lambda v, name, size=side: F.floor(F.col(v) / size).alias(name)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    spots = ws.table(members.where(finite & F.col("cluster").isNotNull()).select(*keys, F.col("cluster").alias("node"), "x", "y").distinct(), "spots")
    boxes = ws.table(_boxes(spots, keys, side), "boxes")
    corners = ["x0", "x1", "y0", "y1"]
    inner = boxes.select(*keys, "i", "j", "node", F.col("i").alias("bi"), F.col("j").alias("bj"), "m", *corners)
    places = spots.select(*keys, "node", cell("x", "i"), cell("y", "j"), F.lit(1).cast("long").alias("m"), *(F.col(c[0]).alias(c) for c in corners))
    places = places.join(boxes.where(F.col("m") <= FEW).select(*keys, "node", "i", "j"), [*keys, "node", "i", "j"], "left_semi")
    around = F.explode(F.array(*(F.struct((F.col("i") + i).alias("i"), (F.col("j") + j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i or j)))
    outer = boxes.where(F.col("m") > FEW).select(*places.columns).union(places).withColumn("c", around)
    outer = outer.select(*keys, "c.i", "c.j", "node", F.col("i").alias("bi"), F.col("j").alias("bj"), "m", *corners)
    marks = inner.union(outer.join(boxes.select(*keys, "i", "j", "node"), [*keys, "i", "j", "node"], "left_anti"))
    met = points.where(finite).select(*keys, "point_id", "x", "y", cell("x", "i"), cell("y", "j")).join(marks, [*keys, "i", "j"])
    sure, maybe = _reach(eps)
    # rows stand by cell already, so this needs no further shuffle
    found = met.where(sure).select(*keys, "i", "j", "point_id", "node").distinct().select(*keys, "point_id", "node")
    # beyond 2^31 cells the same cell no longer proves reach
    far = side * 2.0**31
    if not boxes.where((F.col("m") > FEW) | (F.greatest(*(F.abs(c) for c in corners)) >= far)).isEmpty():
        found = ws.table(found, "found")
        left = met.where(maybe & ~sure & (F.col("m") > 1)).select(*keys, "point_id", "x", "y", "node", "bi", "bj", "m")
        found = found.union(_settled(left.join(found, [*keys, "point_id", "node"], "left_anti"), spots, keys, eps, side, far, ws))
    return found.withColumnRenamed("node", "cluster")


def _reach(eps: float) -> tuple[Column, Column]:
    """Whether all, and whether any, of the box (x0, x1, y0, y1) can be within eps of (x, y)."""
    zero = F.lit(0.0)
    near = [F.greatest(F.col(f"{v}0") - F.col(v), F.col(v) - F.col(f"{v}1"), zero) for v in "xy"]
    away = [F.greatest(F.col(f"{v}1") - F.col(v), F.col(v) - F.col(f"{v}0")) for v in "xy"]
    square = lambda d: d[0] * d[0] + d[1] * d[1]
    return square(away) <= eps * eps, square(near) <= eps * eps


def _settled(left: DataFrame, spots: DataFrame, keys: list[str], eps: float, size: float, far: float, ws: Workspace) -> DataFrame:
    """(keys, point_id, node) of those points of ``left`` that have one of ``spots`` in reach.

    Boxes of few places, or after ``LEVELS`` halvings, list them; others are halved each way.
    """
    own, done = [*keys, "point_id", "node"], []
    sure, maybe = _reach(eps)
    left = ws.table(left, "left")
    for level in range(LEVELS + 1):
        if left.isEmpty():
            break
        cell = lambda v, s=size: F.floor(F.col(v) / s)
        plain = (F.col("m") <= FEW) | (F.greatest(F.abs("x"), F.abs("y")) >= far) | F.lit(level == LEVELS)
        places = spots.select(*keys, "node", cell("x").alias("bi"), cell("y").alias("bj"), *(F.col(c[0]).alias(c) for c in ("x0", "x1", "y0", "y1")))
        found = ws.table(left.where(plain).join(places, [*keys, "node", "bi", "bj"]).where(sure).select(*own).distinct(), "listed")
        size /= 2
        parts = _boxes(spots, keys, size).withColumns({"bi": F.shiftright("i", 1), "bj": F.shiftright("j", 1)})
        halves = left.where(~plain).drop("m").join(found, own, "left_anti").join(parts, [*keys, "node", "bi", "bj"]).where(maybe)
        halves = ws.table(halves.select(*own, "x", "y", F.col("i").alias("bi"), F.col("j").alias("bj"), "m", sure.alias("sure")), "halves")
        inside = ws.table(halves.where("sure").select(*own).distinct(), "inside")
        done += [found, inside]
        left = ws.table(halves.where("not sure").drop("sure").join(inside, own, "left_anti"), "left")
    out = left.select(*own).limit(0)
    for part in done:
        out = out.union(part)
    return out.distinct()


def guard(candidates: DataFrame, points: DataFrame, keys: list[str], min_pts: int, share: float) -> DataFrame:
    """(keys, n_points, n_candidates, status): tiles with too few candidates, or too large a share of them, are skipped."""
    n = points.groupBy(*keys).agg(F.count("*").alias("n_points"))
    m = candidates.groupBy(*keys).agg(F.count("*").alias("n_candidates"))
    both = n.join(m, keys, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("long"))
    status = F.when(F.col("n_candidates") < min_pts, "too few").when(F.col("n_candidates") / F.col("n_points") > share, "too many").otherwise("ok")
    return both.withColumn("status", status)
