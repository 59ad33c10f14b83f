"""Operators that run inside one tile: cloth simulation and roof planes, as grouped NumPy functions.

A tile is bounded by the tile size; what is passed in is thinned cells (cloth) or the candidates of
one tile (planes), never a whole cloud.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def cloth_heights(x, y, z, resolution: float, rigidness: int, iterations: int, slope_smooth: bool, time_step: float = 0.65):
    """(origin x, origin y, cloth heights): a cloth dropped on the inverted points (Zhang et al. 2016).

    Particles on a grid fall by gravity, are pulled together by springs to their grid neighbours
    (``rigidness`` times a step), and stop where they meet the inverted surface.
    """
    ox, oy = x.min() - 2 * resolution, y.min() - 2 * resolution
    width, height = int(np.ceil((x.max() - ox) / resolution)) + 3, int(np.ceil((y.max() - oy) / resolution)) + 3
    c, r = np.floor((x - ox) / resolution + 0.5).astype(int), np.floor((y - oy) / resolution + 0.5).astype(int)
    surface = np.full((height, width), -np.inf)
    np.maximum.at(surface, (r, c), -z)
    empty = ~np.isfinite(surface)
    while empty.any():  # particles over nothing take the highest neighbour
        padded = np.pad(surface, 1, constant_values=-np.inf)
        near = np.max([padded[i : i + height, j : j + width] for i in range(3) for j in range(3)], axis=0)
        surface[empty] = near[empty]
        empty = ~np.isfinite(surface)
    cloth = np.full(surface.shape, surface.max() + 0.05)
    old, free = cloth.copy(), np.ones(surface.shape, bool)
    fall = 0.2 * time_step * time_step
    for _ in range(iterations):
        now = np.where(free, cloth + (cloth - old) * 0.99 - fall, cloth)
        old = cloth
        for _ in range(rigidness):
            for axis in (0, 1):
                step = np.diff(now, axis=axis)
                a, b = (free[:-1], free[1:]) if axis == 0 else (free[:, :-1], free[:, 1:])
                share = np.where(a & b, 0.5, 1.0) * 0.5 * step
                pull = np.zeros_like(now)
                lo, hi = (pull[:-1], pull[1:]) if axis == 0 else (pull[:, :-1], pull[:, 1:])
                lo += np.where(a, share, 0)
                hi -= np.where(b, share, 0)
                now = now + pull * 0.5
        hit = now <= surface
        now = np.where(hit, surface, now)
        free &= ~hit
        moved = np.abs(now - cloth).max()
        cloth = now
        if moved < 0.005 or not free.any():
            break
    if slope_smooth:  # hanging particles beside ground ones follow the surface where it is close
        for _ in range(3):
            padded = np.pad(~free, 1)
            beside = padded[:-2, 1:-1] | padded[2:, 1:-1] | padded[1:-1, :-2] | padded[1:-1, 2:]
            drop = free & beside & (cloth - surface < 0.3)
            if not drop.any():
                break
            cloth = np.where(drop, surface, cloth)
            free &= ~drop
    return ox, oy, -cloth


def cloth_ground(cells: DataFrame, keys: list[str], *, resolution=0.30, threshold=0.05, rigidness=1, iterations=1000, slope_smooth=True) -> DataFrame:
    """The rows of ``cells(keys, point_id, x, y, z)`` that lie within ``threshold`` of each tile's cloth."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = (pdf[v].to_numpy(float) for v in "xyz")
        if len(pdf) < 3:
            return pdf.iloc[:0]
        ox, oy, cloth = cloth_heights(x, y, z, resolution, rigidness, iterations, slope_smooth)
        fc, fr = (x - ox) / resolution, (y - oy) / resolution
        c, r = np.floor(fc).astype(int), np.floor(fr).astype(int)
        fc, fr = fc - c, fr - r
        at = (cloth[r, c] * (1 - fc) + cloth[r, c + 1] * fc) * (1 - fr) + (cloth[r + 1, c] * (1 - fc) + cloth[r + 1, c + 1] * fc) * fr
        return pdf[np.abs(z - at) < threshold]

    own = cells.select(*keys, "point_id", "x", "y", "z")
    return own.groupBy(*keys).applyInPandas(run, own.schema)


def best_plane(points: np.ndarray, threshold: float, trials: int, rng) -> np.ndarray | None:
    """(unit normal, offset) of the plane through three random points that most points are close to; the first on ties.

    All planes are drawn at once, and points are counted in blocks as one matrix product each.
    """
    corners = points[rng.integers(0, len(points), (trials, 3))]
    normals = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    sizes = np.linalg.norm(normals, axis=1)
    flat = sizes >= 1e-9  # three points that don't span a plane are no trial
    if not flat.any():
        return None
    normals = normals[flat] / sizes[flat, None]
    offsets = -(normals * corners[flat, 0]).sum(1)
    counts = np.zeros(len(normals), np.int64)
    for lo in range(0, len(points), 16384):
        counts += (np.abs(points[lo : lo + 16384] @ normals.T + offsets) < threshold).sum(0)
    best = int(counts.argmax())
    return np.r_[normals[best], offsets[best]]


def thinned(points: np.ndarray, most: int) -> np.ndarray:
    """Places of the first point of each cube, of a side that leaves about ``most``; at most that many, evenly taken."""
    if len(points) <= most:
        return np.arange(len(points))
    side = max(0.05, (np.prod(np.maximum(np.ptp(points, axis=0), 1e-3)) / most) ** (1 / 3))
    first = np.sort(np.unique(np.floor(points / side).astype(np.int64), axis=0, return_index=True)[1])
    return first if len(first) <= most else first[np.linspace(0, len(first) - 1, most).astype(np.int64)]


def plane_clusters(x: np.ndarray, y: np.ndarray, eps: float, min_pts: int) -> np.ndarray:
    """DBSCAN labels in the plane, -1 for noise; a border point joins the cluster of the smallest label.

    Cells of side eps / sqrt(2) that hold min_pts points are all core and one node; other points look
    at the cells around them. Pairs are taken in blocks, so memory is bounded.
    """
    if not len(x):
        return np.zeros(0, np.int64)
    side = eps / 2**0.5 * (1 - 1e-9)
    i, j = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    i, j = i - i.min() + 2, j - j.min() + 2
    key = i * (j.max() + 3) + j
    order = np.argsort(key, kind="stable")
    cells, first, size = np.unique(key[order], return_index=True, return_counts=True)
    cell = np.searchsorted(cells, key)
    full = size >= min_pts
    node = np.where(full[cell], order[first][cell], np.arange(len(x)))
    steps = np.array([a * (j.max() + 3) + b for a in range(-2, 3) for b in range(-2, 3)])

    def pairs(own: np.ndarray, ahead: np.ndarray):
        """Blocks of (point, point at most eps away) for points ``own`` and the cells ``ahead`` of theirs."""
        at = np.searchsorted(cells, key[own][:, None] + ahead).clip(0, len(cells) - 1)
        there = cells[at] == key[own][:, None] + ahead
        a, c = np.repeat(own, there.sum(1)), at[there]
        ends = np.cumsum(size[c])
        lo = 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000)))
            n = size[c[lo:hi]]
            p = np.repeat(a[lo:hi], n)
            q = order[np.repeat(first[c[lo:hi]] + n - np.cumsum(n), n) + np.arange(n.sum())]
            near = (x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 <= eps * eps
            yield p[near], q[near]
            lo = hi

    loose = np.flatnonzero(~full[cell])
    count = np.zeros(len(x), np.int64)
    for p, _ in pairs(loose, steps):
        count += np.bincount(p, minlength=len(x))
    core = full[cell] | (count >= min_pts)
    links, border = [], np.full(len(x), len(x))
    for p, q in pairs(loose, steps):
        to = core[q]
        p, q = p[to], q[to]
        links.append(np.unique(np.c_[node[p], node[q]][core[p]], axis=0))
        border[p] = np.minimum(border[p], len(x) - 1)
    for a in np.flatnonzero(full):  # two crowded cells are linked by any pair
        for step in steps[len(steps) // 2 + 1 :]:
            b = np.searchsorted(cells, cells[a] + step)
            if b < len(cells) and cells[b] == cells[a] + step and full[b]:
                p, q = order[first[a] : first[a] + size[a]], order[first[b] : first[b] + size[b]]
                if any(((x[p[k : k + 1024], None] - x[q]) ** 2 + (y[p[k : k + 1024], None] - y[q]) ** 2 <= eps * eps).any() for k in range(0, len(p), 1024)):
                    links.append(np.array([[node[p[0]], node[q[0]]]]))
    root = np.arange(len(x))
    edges = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    while len(edges):  # hook larger roots to smaller ones, then follow to the end
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    labels = np.where(core, root[node], len(x))
    for p, q in pairs(loose[~core[loose]], steps):
        to = core[q]
        np.minimum.at(labels, p[to], labels[q[to]])
    found, labels = np.unique(labels, return_inverse=True)
    return np.where(labels == len(found) - 1, -1, labels) if found[-1] == len(x) else labels


def roofs(candidates: DataFrame, keys: list[str], *, threshold=0.10, trials=500, max_planes=8, min_pts=300, eps=1.0, min_area=20.0, most=2_000_000, seed=42) -> DataFrame:
    """(keys, point_id, plane): points of near-horizontal planes whose clusters are large enough.

    Up to ``max_planes`` rounds a tile. Planes are sought among at most ``most`` points, thinned by cubes,
    and take all points close to them. A plane's points are consumed, whether it is steep or
    its clusters are too small or not.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id", ignore_index=True)
        points, left = pdf[["x", "y", "z"]].to_numpy(float), np.arange(len(pdf))
        points -= points.mean(0) if len(points) else 0.0
        rng = np.random.default_rng(seed)
        ids, planes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for plane in range(max_planes):
            if len(left) < max(min_pts, 3):
                break
            sought = thinned(points[left], most)
            found = best_plane(points[left[sought]], threshold, trials, rng)
            if found is None:
                break
            inside = np.abs(points[left] @ found[:3] + found[3]) < threshold
            if inside[sought].sum() < min_pts:
                break
            own, left = left[inside], left[~inside]
            if abs(found[2]) < 0.90:
                continue
            labels = plane_clusters(points[own, 0], points[own, 1], eps, min_pts)
            for label in range(labels.max() + 1):
                at = own[labels == label]
                if len(at) >= min_pts and np.ptp(points[at, 0]) * np.ptp(points[at, 1]) >= min_area:
                    ids.append(pdf.point_id.to_numpy()[at])
                    planes.append(np.full(len(at), plane, np.int32))
        frame = pd.DataFrame({"point_id": np.concatenate(ids), "plane": np.concatenate(planes)})
        for key in reversed(keys):
            frame.insert(0, key, pdf[key].iloc[0])
        return frame

    own = candidates.select(*keys, "point_id", "x", "y", "z")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in keys)
    return own.groupBy(*keys).applyInPandas(run, f"{schema}, point_id long, plane int")
