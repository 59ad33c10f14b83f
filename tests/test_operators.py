"""Operators against brute force in NumPy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import color, labels
from strataspark.operators import blocks, cluster, components, detect, ground, raster, tiling, tilewise
from strataspark.params import Params
from strataspark.plans import classify, queries
from strataspark.storage import Workspace

KEYS = ["tile_e", "tile_n"]


def grid_frame(spark, z):
    rows = [(0, 0, r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "tile_e long, tile_n long, r int, c int, z double")


def as_array(frame, shape):
    out = np.full(shape, np.nan)
    for row in frame.collect():
        out[row.r, row.c] = row.z
    return out


def focal(z, k, fn):
    p = np.pad(z, k, mode="symmetric")
    return np.array([[fn(p[r : r + 2 * k + 1, c : c + 2 * k + 1]) for c in range(z.shape[1])] for r in range(z.shape[0])])


def test_opening_and_median(spark):
    z = np.random.default_rng(1).normal(size=(9, 13)).round(3)
    frame = grid_frame(spark, z)
    want = z
    for k in (1, 2):
        want = focal(focal(want, k, np.min), k, np.max)
    assert np.array_equal(as_array(raster.opening(frame, KEYS, 2), z.shape), want)
    p = np.pad(z, 3, mode="edge")
    want = np.array([[np.median(p[r : r + 7, c : c + 7]) for c in range(z.shape[1])] for r in range(z.shape[0])])
    assert np.array_equal(as_array(raster.median(frame, KEYS, 3), z.shape), want)


@pytest.mark.parametrize("share", [0.3, 0.02, 0.0])
def test_nearest_fill(spark, share):
    rng = np.random.default_rng(2)
    z = np.where(rng.random((25, 19)) < share, rng.normal(size=(25, 19)).round(3), np.nan)
    got = as_array(raster.nearest_fill(grid_frame(spark, z), KEYS), z.shape)
    valid = np.argwhere(~np.isnan(z))
    for r, c in np.ndindex(z.shape):
        if not len(valid):
            assert got[r, c] == 0
        else:
            best = min((int((r - a) ** 2 + (c - b) ** 2), int(a), int(b)) for a, b in valid)
            assert got[r, c] == z[best[1], best[2]]


def cloud(spark, n, seed, size=6.0):
    rng = np.random.default_rng(seed)
    xy = rng.random((n, 2)) * size
    rows = [(i + 1, float(x), float(y), float(rng.normal())) for i, (x, y) in enumerate(xy)]
    frame = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    return xy, frame.withColumns({"tile_e": F.lit(0).cast("long"), "tile_n": F.lit(0).cast("long")})


@pytest.mark.parametrize("size", [6.0, 3.0, 1.5])
def test_dbscan_equals_sequential(spark, size):
    xy, frame = cloud(spark, 260, 3, size)
    got = {r.point_id: r.cluster for r in cluster.dbscan(frame, KEYS, 0.35, 5, Workspace(spark, "t")).collect()}
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 0.35 * 0.35
    core = near.sum(1) >= 5
    label = {}
    for i in range(len(xy)):
        if core[i] and i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j in label:
                    continue
                label[j] = i + 1
                todo += [k for k in np.flatnonzero(near[j] & core) if k not in label]
    want = {i + 1: min(label[k] for k in np.flatnonzero(near[i] & core)) for i in range(len(xy)) if (near[i] & core).any()}
    assert got == want
    local = tilewise.plane_clusters(xy[:, 0], xy[:, 1], 0.35, 5)
    assert {i + 1 for i in np.flatnonzero(local >= 0)} == set(want)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert components.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t")).count() == 0


def test_components_of_an_ordered_chain(spark):
    """Rounds grow with the logarithm of a chain's length, not with the length."""
    ws = Workspace(spark, "t")
    chain = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(chain, ws)
    assert got.agg(F.min("component"), F.max("component"), F.count("*")).first()[:] == (0, 0, 2001)
    assert ws._n < 1 + 2 * 15 + 1


def test_nearest_fill_of_a_half_empty_raster():
    rng = np.random.default_rng(3)
    z = np.where(np.arange(300)[:, None] < 150, rng.normal(size=(300, 300)), np.nan)
    d2 = np.where(np.isnan(z), np.inf, 0.0)
    began = time.time()
    got = raster.filled_columns(d2, np.nan_to_num(z))
    assert np.array_equal(got[150:], np.broadcast_to(z[149], (150, 300))) and time.time() - began < 5


@pytest.mark.parametrize("gap", [0.299, 0.301])
def test_dbscan_of_crowded_cells(spark, monkeypatch, gap):
    """Cells of thousands of points that are near at one pair only, or nowhere."""
    monkeypatch.setattr(cluster, "LISTED", 64)
    rng = np.random.default_rng(1)
    left = np.vstack([rng.random((3000, 2)) * [0.05, 0.15], [[0.06, 0.07]]])
    right = np.vstack([rng.random((3000, 2)) * [0.05, 0.15] + [0.07 + gap, 0], [[0.06 + gap, 0.07]]])
    rows = [(k + 1, float(x), float(y), 0.0) for k, (x, y) in enumerate(np.vstack([left, right]))]
    frame = spark.createDataFrame(rows, "point_id long, x double, y double, z double").withColumns({"tile_e": F.lit(0).cast("long"), "tile_n": F.lit(0).cast("long")})
    found = cluster.dbscan(frame, KEYS, 0.3, 8, Workspace(spark, "t")).select("cluster").distinct().count()
    assert found == (1 if gap <= 0.3 else 2)


def test_halo(spark):
    xy, frame = cloud(spark, 120, 7, 30.0)
    got = {(r.point_id, r.tile_e, r.tile_n) for r in tiling.with_halo(frame, 10.0, 2.0).collect()}
    tile = np.floor(xy / 10).astype(int) * 10
    want = set()
    for t in {tuple(t) for t in tile.tolist()}:
        own = xy[(tile == t).all(1)]
        lo, hi = own.min(0) - 2, own.max(0) + 2
        want |= {(int(i) + 1, *t) for i in np.flatnonzero(((xy >= lo) & (xy <= hi)).all(1))}
    assert got == want


def test_small_inputs_get_height_classes(spark):
    rows = [(i + 1, (i % 20) * 0.5, (i // 20) * 0.5, 0.0) for i in range(400)] + [(401, 3.1, 3.1, 0.5), (402, 5.1, 5.1, 2.0), (403, 7.1, 7.1, 6.0)]
    pts = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    p = Params(tile_size=20.0, ground_method="grid", ground_threshold=0.05, smooth_passes=1)
    out = classify.classify(pts, p)
    got = {r.point_id: r["class"] for r in out.points.collect()}
    assert len(got) == 403
    assert (got[401], got[402], got[403], got[1]) == (3, 4, 5, 2)
    assert out.tiles.first().status == "SKIPPED"


def test_nan_heights_stay(spark):
    frame = spark.createDataFrame([(float("nan"),), (None,), (5.0,)], "nz double").withColumn("class", F.lit(1))
    got = [r[0] for r in frame.select(labels.height_label(F.col("class"), F.col("nz"), threshold=0.05)).collect()]
    assert got == [1, 1, 5]


def test_cloth_and_roof(spark):
    rng = np.random.default_rng(0)
    ground_points = [(i + 1, float(x), float(y), float(0.02 * rng.normal())) for i, (x, y) in enumerate(rng.random((900, 2)) * 20)]
    roof = [(1000 + i, float(x), float(y), 6.0 + float(0.01 * rng.normal())) for i, (x, y) in enumerate(rng.random((400, 2)) * 6 + 7)]
    frame = spark.createDataFrame(ground_points + roof, "point_id long, x double, y double, z double").withColumns({"tile_e": F.lit(0).cast("long"), "tile_n": F.lit(0).cast("long")})
    found = {r.point_id for r in tilewise.cloth_ground(frame, KEYS, resolution=1.0, threshold=0.2, rigidness=2, iterations=300).collect()}
    assert len([i for i in found if i < 1000]) > 600 and not [i for i in found if i >= 1000]
    planes = tilewise.roofs(frame.where("z > 2"), KEYS, min_pts=15)
    assert planes.count() > 350


@pytest.mark.parametrize(("n", "size", "min_pts"), [(400, 3.0, 5), (400, 3.0, 40), (1500, 2.0, 30), (50, 30.0, 3)])
def test_plane_clusters_equal_brute_force(n, size, min_pts):
    rng = np.random.default_rng(n)
    x, y = rng.random((2, n)) * size
    near = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 <= 0.25 * 0.25
    core = near.sum(1) >= min_pts
    label = np.where(core, np.arange(n), n)
    for _ in range(n):
        new = np.where(core, np.where(near & core, label, n).min(1), n)
        if (new == label).all():
            break
        label = new
    label = np.where(core, label, np.where(near & core, label, n).min(1))
    got = tilewise.plane_clusters(x, y, 0.25, min_pts)
    assert ((got < 0) == (label == n)).all() and len(set(zip(got.tolist(), label.tolist()))) == len(set(got.tolist()))


def test_all_roofs_beside_a_large_rejected_plane(spark):
    """A wide flat plane of clusters that are too small is consumed once and hides none of three roofs."""
    rng = np.random.default_rng(2)
    patches = rng.integers(0, 40, (60, 2)) * 2.5
    rows = [(*(p + rng.random(2) * 0.8), 3.0) for p in patches for _ in range(40)]
    rows += [(*(rng.random(2) * 7 + at), z) for at, z in (((5, 5), 8.0), ((40, 10), 8.0), ((60, 60), 14.0)) for _ in range(700)]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "point_id long, x double, y double, z double")
    frame = frame.withColumns({"tile_e": F.lit(0).cast("long"), "tile_n": F.lit(0).cast("long")})
    found = tilewise.roofs(frame, KEYS, min_pts=12, max_planes=5).collect()
    assert {r.point_id for r in found} == set(range(2400, 4500)) and {r.plane for r in found} == {1, 2}
    thin = tilewise.roofs(frame, KEYS, min_pts=12, max_planes=5, most=1500).collect()
    assert len({r.point_id for r in thin} & set(range(2400, 4500))) > 1800


def test_colours_without_bands(spark):
    frame = spark.createDataFrame([(10, 20, 5)], "red int, green int, blue int")
    mask, used = color.vegetation_mask(frame, "auto")
    assert used == "vari" and frame.select(mask).first()[0]
    assert color.vegetation_mask(frame, "ndvi") == (None, "unavailable")
    assert color.vegetation_mask(frame.drop("blue"), "auto") == (None, "unavailable")


def test_merge_and_blocks(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    merged, skipped = tiling.merge([a, b, a], [7, 6, 7])
    assert merged.count() == 2 and skipped == [1]
    with pytest.raises(ValueError):
        tiling.merge([], [])
    named = spark.createDataFrame([("Tree", 2.0, 1.0), ("TREE_2", 4.0, 1.0), ("*U_1", 1.0, 1.0)], "name string, width double, height double")
    assert blocks.fold_blocks(named).count() == 0
    folds = blocks.fold_blocks(named, ignore_case=True)
    assert [tuple(r) for r in folds.collect()] == [("TREE_2", "Tree", 2.0)]
    inserts = spark.createDataFrame([("TREE_2", 1.0, 1.0, 1.0)], "name string, xs double, ys double, zs double")
    assert blocks.rewrite_inserts(inserts, folds).first().asDict() == {"name": "Tree", "xs": 2.0, "ys": 2.0, "zs": 2.0}


def test_valid_points_without_mark(spark):
    frame = spark.createDataFrame([(1.0, 2.0, 3.0), (float("nan"), 1.0, 1.0), (float("inf"), 1.0, 1.0)], "x double, y double, z double")
    assert detect.valid_scan_points(frame).count() == 1


def test_key_points_take_first_on_ties(spark):
    frame = spark.createDataFrame([(5, 0.0, 0.0, 1.0, 2), (3, 0.5, 0.5, 1.0, 2), (9, 0.2, 0.1, 0.0, 1)], "point_id long, x double, y double, z double, class int")
    frame = frame.withColumns({"tile_e": F.lit(0), "tile_n": F.lit(0)})
    got = {r.point_id: r["class"] for r in ground.key_points(frame, KEYS, 8.0).collect()}
    assert got == {5: 2, 3: 8, 9: 1}


def test_plane_queries_take_all_points(spark, sf_dir):
    pts = queries._points(spark, sf_dir).select("point_id", "tile_e", "tile_n", "x", "y", "zi", "classification").toPandas()
    first = pts.groupby([pts.tile_e, pts.tile_n, np.floor(pts.x / 0.1), np.floor(pts.y / 0.1)]).point_id.min()
    assert sorted(r.point_id for r in queries.voxel_downsample_2d(spark, sf_dir).collect()) == sorted(first)
    want = set()
    for (e, _), own in pts.groupby(["tile_e", "tile_n"]):
        near = own[own.zi.between(60, 400) & (own.classification == 1)]
        dx, dy = (np.subtract.outer(own[v].to_numpy(), near[v].to_numpy()) for v in "xy")
        want |= {(p, e) for p in own.point_id[(dx * dx + dy * dy <= 0.3 * 0.3).any(1)]}
    got = [(r.point_id, r.cluster) for r in queries.cluster_expansion(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("few", "levels"), [(64, 20), (3, 20), (1, 2)])
def test_expansion_equals_all_pairs(spark, monkeypatch, few, levels):
    """Sparse, crowded, repeated, distant and unfinished places, in boxes of any size."""
    monkeypatch.setattr(cluster, "FEW", few)
    monkeypatch.setattr(cluster, "LEVELS", levels)
    rng = np.random.default_rng(few)
    at = np.concatenate([rng.uniform(-2, 2, (300, 2)), rng.normal(0.2, 0.1, (150, 2)), rng.integers(0, 9, (60, 2)) * 0.3, [[5e6, 5e6], [5e6, 5e6 + 0.2], [np.nan, 0.1], [np.inf, 0.1]]])
    rows = [(i, float(x), float(y), int(i % 3)) for i, (x, y) in enumerate(at)]
    frame = spark.createDataFrame(rows, "point_id long, x double, y double, cluster long").withColumns({"tile_e": F.lit(0), "tile_n": F.when(F.col("point_id") % 7 == 0, 1).otherwise(0)})
    members = frame.where("point_id % 4 = 1 or point_id > 300").withColumn("cluster", F.when(F.col("point_id") != 310, F.col("cluster")))
    got = [(r.point_id, r.cluster) for r in cluster.expand(members, frame, KEYS, 0.3, Workspace(spark, "t")).collect()]
    with np.errstate(invalid="ignore"):
        want = {
            (p, k) for p, x, y, _ in rows for m, u, v, k in rows
            if (m % 4 == 1 or m > 300) and m != 310 and (p % 7 == 0) == (m % 7 == 0) and np.float64(x - u) ** 2 + np.float64(y - v) ** 2 <= 0.3 * 0.3
        }
    assert len(got) == len(set(got)) and set(got) == want


def test_expansion_of_crowds_lists_no_pairs(spark):
    """20,000 points in reach of 20,000 members, and as many at the edge of it: 8 * 10^8 pairs."""
    n = 20_000
    members = spark.range(n).select(F.col("id").alias("point_id"), (F.rand(1) * 0.2).alias("x"), (F.rand(2) * 0.2).alias("y"), F.lit(7).cast("long").alias("cluster"))
    points = spark.range(2 * n).select(F.col("id").alias("point_id"), (F.rand(3) * 0.2 + F.when(F.col("id") >= n, 0.3).otherwise(0.0)).alias("x"), (F.rand(4) * 0.2).alias("y"))
    tile = {"tile_e": F.lit(0), "tile_n": F.lit(0)}
    ws, began = Workspace(spark, "t"), time.time()
    members, points = ws.table(members.withColumns(tile), "members"), ws.table(points.withColumns(tile), "points")
    found = cluster.expand(members, points, KEYS, 0.3, ws).agg(F.count("*"), F.sum((F.col("point_id") < n).cast("int"))).first()
    assert time.time() - began < 60
    m, p = (np.array([(r.x, r.y) for r in t.orderBy("point_id").collect()]) for t in (members, points))
    m = m[m[:, 0] > 0.15]  # the others are no nearer to points at the edge by over 0.1
    edge = sum(bool((((m - q) ** 2).sum(1) <= 0.3 * 0.3).any()) for q in p[n:])
    assert found[1] == n and found[0] - n == edge
