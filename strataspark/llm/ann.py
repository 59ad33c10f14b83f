"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node. A neighbour graph starts from the cells of random-projection trees
(fitted on a bounded sample; every vector goes down every tree; what is still too large is halved
by hyperplanes of its own) and is refined by NN-descent until few lists change: each round brings
together, around each node, its best neighbours and the nodes it is a best neighbour of, compares the
pairs of which one came in the last round, and keeps each node's best ``K``. Queries start from their own
node's list and expand the best ``BEAM`` nodes found, by joins with graph and vectors, until none of
these is left to expand. Graph and search work on vectors of two bytes a component, whose inner products are
whole numbers times both scales and so are the same wherever they are computed; what the search ends
with is scored on the original vectors in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

K = 64
#: MOST_LEAVES bounds the trees that are broadcast; cells that are too large after them are halved by joins.
TREES, CELL, SAMPLE, MOST_LEAVES, FROM_CELL = 6, 256, 8192, 2048, 24
#: Neighbours each way that meet around a node, new neighbours that a node takes from one meeting, and the
#: share of list places that change in a round after which no round follows.
MEMBERS, TAKEN, CHANGED = 56, 8, 0.02
#: Nodes that a query expands at last, those of one step, those it holds, and those it scores exactly.
BEAM, EXPANDED, HELD, RESCORED = 96, 64, 256, 64

_NODE = "id long, x binary, s float"
_LISTS = f"{_NODE}, ids array<long>, scores array<float>, fresh array<boolean>"


def _whole_groups(batches, key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut so that no group spans two of them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if last:
            yield from table.slice(0, last).combine_chunks().to_batches()
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield from rest.combine_chunks().to_batches()


def _borders(keys: np.ndarray) -> np.ndarray:
    return np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def _matrix(column, dim: int, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _whole(column, dim: int) -> np.ndarray:
    """Vectors of whole numbers as floats in which sums of their products are exact."""
    return _matrix(column, dim, np.int16).astype(np.float64)


def _unit(column, dim: int) -> np.ndarray:
    x = _matrix(column, dim, np.int16).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def quantised(e: np.ndarray) -> tuple[bytes, float]:
    """A vector as 16-bit whole numbers and their scale."""
    largest = np.abs(e).max()
    scale = np.float32(np.clip(largest / 32767, np.finfo(np.float32).tiny, np.finfo(np.float32).max))
    return np.rint(e / np.float64(scale)).clip(-32767, 32767).astype(np.int16).tobytes(), float(scale)


def _list_batch(found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A batch of _LISTS from (owners, lengths of their lists, ids, scores): new neighbours."""
    owners, sizes, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    ptr = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    lists = [pa.ListArray.from_arrays(ptr, pa.array(v, k)) for v, k in ((ids, pa.int64()), (scores, pa.float32()), (np.ones(len(ids), bool), pa.bool_()))]
    n = len(owners)
    return pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float32()), *lists], names=["id", "x", "s", "ids", "scores", "fresh"])


def _classes(keep: int):
    """Equal vectors of a batch as one row: key, original vector, its smallest ids."""

    def run(batches):
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, e in zip(batch.column("vec_id").to_pylist(), batch.column("e").to_pylist(), strict=True):
                found.setdefault(np.asarray(e, np.float64).tobytes(), []).append(i)
            rows = [(hashlib.md5(e).digest(), e, sorted(set(ids))[:keep]) for e, ids in found.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["key", "e", "ids"]
            )

    return run


def _keys(batches):
    for batch in batches:
        keys = [hashlib.md5(np.asarray(e, np.float64).tobytes()).digest() for e in batch.column("e").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], names=["vec_id", "key"])


def _trees(unit: np.ndarray, leaves: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """TREES complete trees of hyperplanes between two random points, cut at the sample's median."""
    rng = np.random.Generator(np.random.Philox(seed))
    out = []
    for _ in range(TREES):
        normals, cuts = np.zeros((leaves, unit.shape[1]), np.float32), np.zeros(leaves, np.float32)
        cells = {1: np.arange(len(unit))}
        for node in range(1, leaves):
            own = cells.pop(node)
            pool = unit[own] if len(own) >= 2 else unit
            a, b = pool[rng.integers(len(pool))], pool[rng.integers(len(pool))]
            normal = a - b
            if not normal.any():
                normal = rng.normal(size=len(a))
            side = pool @ normal
            normals[node], cuts[node] = normal, np.median(side)
            right = unit[own] @ normal > cuts[node]
            cells[2 * node], cells[2 * node + 1] = own[~right], own[right]
        out.append((normals, cuts))
    return out


def _cells(state, dim: int):
    """(cell, id, x, s) for each tree."""

    def run(batches):
        trees = state.value
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column("x"), dim)
            for t, (normals, cuts) in enumerate(trees):
                node = np.ones(len(unit), np.int64)
                for _ in range(len(cuts).bit_length() - 1):
                    node = 2 * node + ((unit * normals[node]).sum(1) > cuts[node])
                yield pa.RecordBatch.from_arrays([pa.array(t * 2 * len(cuts) + node), *batch.columns], names=["cell", *batch.schema.names])

    return run


def _splits(dim: int):
    """(cell, normal, cut): a hyperplane between two random points of a cell's sample, cut at its median."""

    def run(batches):
        for batch in _whole_groups(batches, "cell"):
            cells, unit = batch.column("cell").to_numpy(), _unit(batch.column("x"), dim)
            borders, rows = _borders(cells), []
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if hi == lo:
                    continue
                rng = np.random.Generator(np.random.Philox(int(cells[lo]) & (2**63 - 1)))
                a, b = rng.integers(lo, hi, 2)
                normal = unit[a] - unit[b]
                if not normal.any():
                    normal = rng.normal(size=dim).astype(np.float32)
                rows.append((cells[lo], normal.tobytes(), float(np.median((unit[lo:hi] * normal).sum(1)))))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.float32())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["cell", "normal", "cut"])

    return run


def _sides(dim: int):
    """(cell, id, x, s, side): rows on the cut go by ``coin``, so that equal projections part too."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            normal, cut = _matrix(batch.column("normal"), dim), batch.column("cut").to_numpy()
            at = (_unit(batch.column("x"), dim) * normal).sum(1)
            coin = batch.column("coin").to_numpy(zero_copy_only=False)
            side = np.where(at == cut, coin, at > cut)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "id", "x", "s")), pa.array(side.astype(np.int64))], names=["cell", "id", "x", "s", "side"])

    return run


def _best(scores: np.ndarray, owners: np.ndarray, others: np.ndarray, least: np.ndarray, most: int):
    """For each row of ``scores`` the ``most`` others above its ``least``, as ``_list_batch`` takes them."""
    most = min(most, scores.shape[1])
    top = np.argpartition(-scores, most - 1, axis=1)[:, :most]
    found = np.take_along_axis(scores, top, 1)
    good = found > least[:, None]
    sizes = good.sum(1)
    return owners[sizes > 0], sizes[sizes > 0], others[top[good]], found[good]


def _within_cells(dim: int):
    """The best neighbours of each node in its cell."""

    def run(batches):
        for batch in _whole_groups(batches, "cell"):
            ids, x, s = batch.column("id").to_numpy(), _whole(batch.column("x"), dim), batch.column("s").to_numpy()
            borders = _borders(batch.column("cell").to_numpy())
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                own, found = ids[lo:hi], []
                for a in range(lo, hi, 1024):
                    b = min(a + 1024, hi)
                    scores = (x[a:b] @ x[lo:hi].T * (s[a:b, None] * s[None, lo:hi])).astype(np.float32)
                    scores[own[None, :] == ids[a:b, None]] = -np.inf
                    found.append(_best(scores, ids[a:b], own, np.full(b - a, -np.inf), FROM_CELL))
                if found:
                    yield _list_batch(found)

    return run


def _merge(batches):
    """The best K of all lists of each node; those that its own list, the row with a vector, didn't have are fresh."""
    for batch in _whole_groups(batches, "id"):
        lists = batch.column("ids")
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        owner, own = batch.column("id").to_numpy()[row], batch.column("x").is_valid().to_numpy(zero_copy_only=False)
        ids, scores, new = lists.flatten().to_numpy(), batch.column("scores").flatten().to_numpy(), ~own[row]
        order = np.lexsort((new, ids, owner))
        owner, ids, scores, new = owner[order], ids[order], scores[order], new[order]
        first = np.ones(len(ids), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
        owner, ids, scores, new = owner[first], ids[first], scores[first], new[first]
        order = np.lexsort((ids, -scores, owner))
        owner, ids, scores, new = owner[order], ids[order], scores[order], new[order]
        keep = np.arange(len(owner)) - np.searchsorted(owner, owner) < K
        owner, ids, scores, new = owner[keep], ids[keep], scores[keep], new[keep]
        nodes = batch.filter(pa.array(own))
        at = nodes.column("id").to_numpy()
        ptr = np.r_[np.searchsorted(owner, at), np.searchsorted(owner, at[-1:], "right")].astype(np.int32)
        out = [pa.ListArray.from_arrays(ptr, pa.array(v, k)) for v, k in ((ids, pa.int64()), (scores, pa.float32()), (new, pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*(nodes.column(c) for c in ("id", "x", "s")), *out], names=["id", "x", "s", "ids", "scores", "fresh"])


def _around(dim: int):
    """Around each node, new neighbours of its members better than what they have."""

    def run(batches):
        for batch in _whole_groups(batches, "center"):
            ids, worst, s, fresh = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "worst", "s", "fresh"))
            x = _whole(batch.column("x"), dim)
            borders, found = _borders(batch.column("center").to_numpy()), []
            for lo, hi in zip(borders[:-1], borders[1:], strict=True):
                if not fresh[lo:hi].any():
                    continue
                own, first, at = np.unique(ids[lo:hi], return_index=True, return_inverse=True)
                if len(own) < 2:
                    continue
                new = np.zeros(len(own), bool)
                np.logical_or.at(new, at, fresh[lo:hi])
                first += lo
                v = x[first]
                scores = (v @ v.T * (s[first][:, None] * s[first][None, :])).astype(np.float32)
                np.fill_diagonal(scores, -np.inf)
                scores[~(new[:, None] | new[None, :])] = -np.inf
                found.append(_best(scores, own, own, worst[first], TAKEN))
            if found:
                yield _list_batch(found)

    return run


def _search_step(dim: int):
    """Scores the new candidates of each query and chooses what to expand next."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in ("query_id", "x", "s", "ids", "scores", "done", "found")}
                ids, scores = (r[c].values.to_numpy(zero_copy_only=False) for c in ("ids", "scores"))
                x, s = r["x"].as_py(), r["s"].as_py()
                done = r["done"].values.to_numpy(zero_copy_only=False)
                if r["found"].is_valid and len(r["found"]):
                    found = r["found"].values
                    new = found.field("id").to_numpy()
                    fresh = ~np.isin(new, ids)
                    v = _whole(found.field("x").filter(pa.array(fresh)), dim)
                    more = (v @ np.frombuffer(x, np.int16).astype(np.float64) * (found.field("s").to_numpy()[fresh] * np.float32(s))).astype(np.float32)
                    ids, scores = np.r_[ids, new[fresh]], np.r_[scores, more]
                order = np.lexsort((ids, -scores))[:HELD]
                ids, scores = ids[order], scores[order]
                best = ids[:BEAM]
                todo = best[~np.isin(best, done)][:EXPANDED]
                out.append((r["query_id"].as_py(), x, s, ids, scores, np.r_[done, todo], todo))
            kinds = (pa.int64(), pa.binary(), pa.float32(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["query_id", "x", "s", "ids", "scores", "done", "todo"]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=names)

    return run


class NeighbourGraph:
    """Nodes (distinct valid vectors) and their neighbour lists."""

    def __init__(self, embeddings: DataFrame, k: int = 20, seed: int = 10):
        self.spark = embeddings.sparkSession
        self.ws, self.k = Workspace(self.spark, "neighbours"), k
        e = F.transform("embedding", lambda x: x.cast("double"))
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and embedding is not null")
        finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = rows.where(finite & F.exists("e", lambda x: x != 0))
        sizes = rows.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
        self.dim = sizes[0]["dim"] if sizes else 1
        self.rows = rows.where(F.size("e") == self.dim)
        parts = self.rows.mapInArrow(_classes(k + 1), "key binary, e binary, ids array<long>")
        nodes = parts.groupBy("key").agg(F.first("e").alias("e"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("members"))
        dim = self.dim

        def small(batches):
            for batch in batches:
                found = [quantised(np.frombuffer(e, np.float64)) for e in batch.column("e").to_pylist()]
                more = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "x", "s"])

        nodes = nodes.select(F.col("members")[0].alias("id"), "key", "e", "members").mapInArrow(small, "id long, key binary, e binary, members array<long>, x binary, s float")
        self.nodes = self.ws.table(nodes, "nodes")
        self.vectors = self.nodes.select("id", "x", "s")
        self.graph = self._build(dim, seed)

    def _build(self, dim: int, seed: int) -> DataFrame:
        count = self.nodes.count()
        sample = self.vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("x").toArrow()
        points = _unit(sample.column("x"), dim)
        leaves = 1
        while leaves < MOST_LEAVES and leaves * CELL < count:
            leaves *= 2
        trees = self.spark.sparkContext.broadcast(_trees(points, leaves, seed) if len(points) else [])
        placed = self.ws.table(self.vectors.mapInArrow(_cells(trees, dim), f"cell long, {_NODE}"), "cells")
        lists = self._split(placed, dim).repartition("cell").sortWithinPartitions("cell").mapInArrow(_within_cells(dim), _LISTS)
        none = {"ids": F.array().cast("array<long>"), "scores": F.array().cast("array<float>"), "fresh": F.array().cast("array<boolean>")}
        graph, used = self.vectors.withColumns(none), placed
        while True:
            graph = graph.unionByName(lists).repartition("id").sortWithinPartitions("id").mapInArrow(_merge, _LISTS)
            graph = self.ws.table(graph, "graph")
            self.ws.drop(used)
            changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
            if changed <= CHANGED * K * count:
                return graph
            lists, used = self._round(graph), graph

    def _split(self, placed: DataFrame, dim: int) -> DataFrame:
        """(cell, id, x, s) with cells halved by further hyperplanes until none has over 2 * CELL rows."""
        done, level, columns = [], 0, ["cell", "id", "x", "s"]
        while True:
            large = self.ws.table(placed.groupBy("cell").count().where(F.col("count") > 2 * CELL), "large")
            if large.isEmpty():
                done.append(placed)
                break
            done.append(placed.join(large, "cell", "left_anti"))
            level += 1
            own = placed.join(large, "cell").withColumn("coin", F.pmod(F.xxhash64(F.lit(-level), "id"), F.lit(2)))
            chance = F.pmod(F.xxhash64(F.lit(level), "id"), F.lit(1 << 30)) * F.col("count")
            sample = own.where(chance < CELL << 30).select("cell", "id", "x").repartition("cell").sortWithinPartitions("cell", "id")
            cuts = self.ws.table(sample.mapInArrow(_splits(dim), "cell long, normal binary, cut float"), "cuts")
            halves = own.join(cuts, "cell").select(*columns, "coin", "normal", "cut").mapInArrow(_sides(dim), f"cell long, {_NODE}, side long")
            kept = placed.join(large, "cell", "left_semi").join(cuts, "cell", "left_anti").withColumn("cell", F.xxhash64("cell", F.lit(2)))
            placed = self.ws.table(halves.withColumn("cell", F.xxhash64("cell", "side")).select(columns).union(kept.select(columns)), "cells")
        out = done[0]
        for part in done[1:]:
            out = out.union(part)
        return out

    def _edges(self, graph: DataFrame, limit: int) -> DataFrame:
        """(id, other, score, fresh, and the columns of ``graph``) of each node's ``limit`` best neighbours."""
        each = F.explode(F.slice(F.arrays_zip("ids", "scores", "fresh"), 1, limit)).alias("e")
        more = [c for c in graph.columns if c not in ("ids", "scores", "fresh")]
        return graph.select(*more, each).select(*more, F.col("e.ids").alias("other"), F.col("e.scores").alias("score"), F.col("e.fresh").alias("fresh"))

    @staticmethod
    def _back(edges: DataFrame, limit: int) -> DataFrame:
        """The ``limit`` best edges that lead to each node."""
        order = Window.partitionBy("other").orderBy(F.desc("score"), "id")
        return edges.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")

    def _round(self, graph: DataFrame) -> DataFrame:
        """Lists of new neighbours, from meetings around each node."""
        worst = F.when(F.size("ids") >= K, F.element_at("scores", -1)).otherwise(F.lit(float("-inf")).cast("float"))
        known = graph.withColumn("worst", worst)
        edges = self._edges(known, MEMBERS)
        columns = ["center", "id", "x", "s", "worst", "fresh"]
        back = self._back(edges, MEMBERS).withColumnRenamed("other", "center").select(columns)
        ahead = edges.select(F.col("id").alias("center"), F.col("other").alias("id"), "fresh").join(known.select("id", "x", "s", "worst"), "id").select(columns)
        return ahead.union(back).repartition("center").sortWithinPartitions("center").mapInArrow(_around(self.dim), _LISTS)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found for each query(vec_id), itself left out.

        Queries are rows of the table; those whose vector takes no part have no results. Rank
        counts from 1, ties go to the smaller id; score is the inner product of the originals.
        """
        own = self.rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id").mapInArrow(_keys, "vec_id long, key binary")
        own = self.ws.table(own.dropDuplicates(["vec_id"]).join(self.nodes, "key").select(F.col("vec_id").alias("query_id"), "id", "x", "s", "e"), "queries")
        back = self._back(self._edges(self.graph.select("id", "ids", "scores", "fresh"), K), K).groupBy("other").agg(F.collect_list("id").alias("back"))
        near = F.array_union("ids", F.coalesce("back", F.array().cast("array<long>")))
        links = self.ws.table(self.graph.select("id", "ids").join(back.withColumnRenamed("other", "id"), "id", "left").select(F.col("id").alias("center"), near.alias("near")), "links")
        # a query starts from its own node, whose copies are results too, and the node's list
        start = own.drop("e").join(self.graph.select("id", "ids", "scores"), "id")
        itself = F.lit(float("inf")).cast("float")
        beam = start.select("query_id", "x", "s", F.concat(F.array("id"), "ids").alias("ids"), F.concat(F.array(itself), "scores").alias("scores"), F.array("id").alias("done"), F.slice("ids", 1, EXPANDED).alias("todo"))
        beam = beam.withColumn("done", F.concat("done", "todo"))
        schema = "query_id long, x binary, s float, ids array<long>, scores array<float>, done array<long>, todo array<long>"
        used = None
        while True:
            front = beam.select("query_id", F.explode("todo").alias("center"))
            # dealt by node, so that what several centers reach is one and meets its vector without another exchange
            reached = front.join(links, "center").select("query_id", F.explode("near").alias("id")).repartition("id").distinct()
            scored = reached.join(self.vectors, "id").groupBy("query_id").agg(F.collect_list(F.struct("id", "x", "s")).alias("found"))
            beam = self.ws.table(beam.join(scored, "query_id", "left").mapInArrow(_search_step(self.dim), schema), "beam")
            if used is not None:
                self.ws.drop(used)
            used = beam
            if beam.where(F.size("todo") > 0).isEmpty():
                break
        last = beam.select("query_id", F.explode(F.slice("ids", 1, RESCORED)).alias("id"))
        last = last.join(own.select("query_id", F.col("e").alias("q")), "query_id").join(self.nodes.select("id", "e", "members"), "id")
        dim = self.dim

        def exact(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    part = batch.slice(lo, 2048)
                    score = (_matrix(part.column("q"), dim, np.float64) * _matrix(part.column("e"), dim, np.float64)).sum(1)
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("members"), pa.array(score)], names=["query_id", "members", "score"])

        last = last.select("query_id", "members", "q", "e").mapInArrow(exact, "query_id long, members array<long>, score double")
        each = last.select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
        each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may have several vectors
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")
