"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched by ``m`` registers: the minimum of one hash per
register, seen as an exponential variable of rate ``a`` and truncated to the integer
``1 - log_b(min)``. Registers of a union are the larger registers of its parts, so sketches merge,
and the share of equal registers follows the Jaccard similarity. Bands of registers propose pairs,
the joint likelihood of (greater, smaller, equal) registers given both set sizes estimates their
similarity, and pairs whose estimate is not clearly below the threshold are verified on full sets.

Documents with equal sets become one class before anything is paired. Inside a band's bucket each
document is paired with the bucket's most central one only; then, where a bucket still holds more than one
component, its documents outside the bucket's main component are compared with all others, so no
link that joins two components is lost. Documents of the main component, the bulk of a large group,
aren't compared with each other; a stray of a large bucket meets those that share one of its rarest
shingles, of matching length and place. All pairs must pass an exact bound on how many shingles they
can share, from their sizes and from ``PARITIES`` (see ``_may_link``), before sketches are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from ..operators.components import components
from .sieve import Sieve
from ..storage import Workspace

_U = np.uint64
#: SetSketch parameters: base and rate of the exponential spacing, largest register value.
BASE, RATE, TOP = 1.1, 20.0, 254
REGISTERS = 128
#: Registers of a band and number of bands; a register serves in several bands. Of two million simulated
#: pairs at a similarity of exactly 0.8 all met in a band (with six registers a band 50 didn't).
ROWS, BANDS = 5, 48
#: Candidates whose estimate lies more than this below the threshold are dropped (over 5 sigma).
MARGIN = 0.2
#: Up to this size all pairs of a bucket that holds several components are looked at.
SMALL_BUCKET = 32
#: Slots of the table that orders shingles from rare to common, as a power of two.
SLOT_BITS = 22
#: Words of 64 bits that hold, for each of their bits, the parity of the shingles that fall on it.
PARITIES = 8
_MARKS = [f"p{i}" for i in range(PARITIES)]
_MARK_TYPES = "size long, " + ", ".join(f"{c} long" for c in _MARKS)


def shingle_sets(column, words: int, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, sorted distinct shingle hashes, row borders) for groups of documents."""
    hasher = tk.ByteHash(0x51D, lower)
    steps = tk.stream(0x5115, words)
    for lo, hi, data, offsets in tk.document_groups(column):
        w = tk.Words(data, offsets, tk.SPACES, hasher)
        n = len(w.hashes)
        whole = np.zeros(max(n - words + 1, 0), _U)
        for j in range(words):
            whole += tk.mix(w.hashes[j : j + len(whole)] + steps[j])
            whole *= _U(0x9FB21C651E98DF25)
        whole = tk.mix(whole)
        sets, ptr = [], [0]
        for i in range(hi - lo):
            s, e = int(w.ptr[i]), int(w.ptr[i + 1])
            if e - s >= words:
                own = np.unique(whole[s : e - words + 1])
            elif e > s:  # too short: the whole sequence is one shingle
                h = np.array([e - s], _U)
                for j in range(s, e):
                    h = tk.mix(h * _U(0x9E3779B97F4A7C15) + w.hashes[j : j + 1])
                own = h
            else:
                own = np.zeros(0, _U)
            sets.append(own)
            ptr.append(ptr[-1] + len(own))
        yield lo, hi, np.concatenate(sets), np.array(ptr)


def registers(values: np.ndarray, ptr: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """m registers for each non-empty set (others are zero)."""
    out = np.zeros((len(ptr) - 1, m), np.uint8)
    full = np.flatnonzero(np.diff(ptr))
    if not len(full):
        return out
    least = np.empty((len(full), m), _U)
    for i, c in enumerate(tk.stream(0x5E75, 2 * m).reshape(m, 2)):
        least[:, i] = np.minimum.reduceat((values ^ c[1]) * (c[0] | _U(1)), ptr[:-1][full])
    u = (least.astype(np.float64) + 0.5) * 2.0**-64
    k = np.floor(1.0 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE) / np.log(BASE))
    out[full] = np.clip(k, 0, TOP).astype(np.uint8)
    return out


def parities(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Words of parity bits for each set; they differ in no more bits than the sets do in values."""
    out = np.zeros((len(ptr) - 1, PARITIES), _U)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        bits, word = _U(1) << (values & _U(63)), (values >> _U(6)) % _U(PARITIES)
        for i in range(PARITIES):
            out[full, i] = np.bitwise_xor.reduceat(np.where(word == _U(i), bits, _U(0)), ptr[:-1][full])
    return out


def _may_link(percent: int, a: str = "", b: str = "") -> Column:
    """False only where sets can't be similar enough, of sizes and parities in columns of these endings.

    Sets differ in |a| + |b| - 2 |a & b| shingles, which at the threshold is (100 - p) / (100 + p) of
    |a| + |b|. Unknown parities pass.
    """
    na, nb = F.col(f"size{a}"), F.col(f"size{b}")
    apart = sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in _MARKS), F.lit(0))
    return F.coalesce(((100 + percent) * apart <= (100 - percent) * (na + nb)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb)), F.lit(True))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities of greatest likelihood given the registers and both cardinalities."""
    more, fewer = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - fewer
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        over, under = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        return more * log(over) + fewer * log(under) + same * log(1 - over - under)

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave in the similarity
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def _bands(rows: int, bands: int, m: int) -> np.ndarray:
    """Register numbers of each band, dealt by fixed permutations so that all serve equally often."""
    rng, dealt = np.random.Generator(np.random.Philox(7)), []
    while len(dealt) < bands:
        order = rng.permutation(m)
        dealt += [order[i : i + rows] for i in range(0, m - rows + 1, rows)]
    return np.array(dealt[:bands])


def _sketch(words: int):
    def run(batches):
        for batch in batches:
            for lo, hi, values, ptr in shingle_sets(batch.column("text"), words):
                regs, marks = registers(values, ptr), parities(values, ptr).view(np.int64)
                sums = [np.concatenate([np.zeros(1, _U), np.cumsum(x)]) for x in (values, tk.mix(values + _U(0x2545F4914F6CDD1D)))]
                fp = [(x[ptr[1:]] - x[ptr[:-1]]).view(np.int64) for x in sums]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(np.diff(ptr), pa.int64()),
                        pa.array(fp[0]),
                        pa.array(fp[1]),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                        *(pa.array(m) for m in marks.T),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "regs", *_MARKS],
                )

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _band_rows(shared: Sieve | None = None):
    """(h, doc_id) for each band; if ``shared`` is given of those in it only, with size and parities."""

    def run(batches):
        bands = _bands(ROWS, BANDS, REGISTERS)
        tags = tk.stream(0xBA2D, BANDS)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                regs = _matrix(part.column("regs")).astype(_U)
                h = np.broadcast_to(tags, (len(regs), BANDS)).copy()
                for r in range(ROWS):
                    h = tk.mix((h + regs[:, bands[:, r]]) * _U(0x9FB21C651E98DF25))
                h, row, names = h.reshape(-1), np.repeat(np.arange(len(regs)), BANDS), ["doc_id"]
                if shared is not None:
                    hit = shared.hits(h)
                    h, row, names = h[hit], row[hit], ["doc_id", "n", *_MARKS]
                own = [part.column(c).take(pa.array(row)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *own], names=["h", *("size" if c == "n" else c for c in names)])

    return run


def _likely(least: float):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                na, nb = (part.column(x).to_numpy().astype(np.float64) for x in ("na", "nb"))
                j = estimate(_matrix(part.column("ra")), _matrix(part.column("rb")), na, nb)
                yield part.select(["a", "b"]).filter(pa.array(j >= least))

    return run


def _sets(words: int, wanted: Sieve):
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(wanted.hits(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64).view(_U))))
            for lo, hi, values, ptr in shingle_sets(batch.column("text"), words):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), tk.arrow_lists(values.view(np.int64), ptr, pa.int64())], names=["doc_id", "shingles"]
                )

    return run


def _slots(bits: int):
    """(slot, held, strays): documents and strays that hold a shingle of each slot, by task."""

    def run(batches):
        counts = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            lists = batch.column("shingles")
            slot = (lists.flatten().to_numpy().view(_U) & _U((1 << bits) - 1)).astype(np.int64)
            stray = np.repeat(batch.column("stray").to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy())
            for own, x in zip(counts, (slot, slot[stray]), strict=True):
                np.add.at(own, x, 1)
        found = np.flatnonzero(counts[0])
        for lo in range(0, len(found), 65536):
            part = found[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, *counts[:, part])], names=["slot", "held", "strays"])

    return run


class _Crowds:
    """For each shingle how many documents hold it times how many of them are strays, broadcast.

    This is what a join of strays and documents on the shingle would compare, and zero where no stray
    holds it. Shingles of equal low bits share one of at most 2^SLOT_BITS slots (16 MB): the order
    they give is less sharp then, but an order all the same, so results don't depend on it.
    """

    def __init__(self, own: DataFrame, ws: Workspace):
        """``own(shingles, stray)``: a written table."""
        n = own.agg(F.sum(F.size("shingles"))).first()[0] or 0
        self.bits = min(max(int(4 * n).bit_length(), 16), SLOT_BITS)
        slots = own.mapInArrow(_slots(self.bits), "slot long, held long, strays long").groupBy("slot").agg(F.sum("held").alias("held"), F.sum("strays").alias("strays"))
        counts = ws.table(slots.where("strays > 0").select(F.col("slot").cast("int"), (F.col("held") * F.col("strays")).cast("float").alias("k")), "crowds")
        found, table = counts.toArrow(), np.zeros(1 << self.bits, np.float32)
        table[found["slot"].to_numpy()] = found["k"].to_numpy()
        self.state = own.sparkSession.sparkContext.broadcast(table.tobytes())

    def of(self, values: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.state.value, np.float32)
        return table[(values & _U((1 << self.bits) - 1)).astype(np.int64)]


def _prefixes(percent: int, crowds: _Crowds):
    """(g, i, n) and the row's other columns for the shingles at the first places i of each set's order that strays may hold."""

    def run(batches):
        for batch in batches:
            lists = batch.column("shingles")
            values, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            row, crowd = np.repeat(np.arange(len(n)), n), crowds.of(values.view(_U))
            order = np.lexsort((values, crowd, row))
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = (100 * i <= (100 - percent) * n[row]) & (crowd[order] > 0)
            row, own = row[first], ("doc_id", "c", "stray", "size", *_MARKS)
            columns = [pa.array(values[order][first]), pa.array(i[first]), pa.array(n[row]), *(batch.column(c).take(pa.array(row)) for c in own)]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "i", "n", *own])

    return run


class NearDuplicates:
    """Components of documents linked by a Jaccard similarity of at least ``percent`` per cent.

    ``words``: words of a shingle (ASCII case folded, words between ASCII white space). Documents
    with fewer words count as one shingle; empty or null texts have the empty set and no link.
    Rows without id get no component; rows that repeat an id count as one node.
    """

    def __init__(self, words: int = 5, percent: int = 80):
        self.words, self.percent = words, percent

    def run(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs(doc_id, text)``."""
        spark = docs.sparkSession
        ws = Workspace(spark, "near-dedup")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        sketches = ws.table(
            docs.mapInArrow(_sketch(self.words), "doc_id long, n_shingles long, fp1 long, fp2 long, regs binary, " + _MARK_TYPES.partition(", ")[2]), "sketches"
        )
        nodes = sketches.where("n_shingles > 0 and doc_id is not null")
        classes = ws.table(nodes.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
        twins = nodes.join(classes, ["fp1", "fp2", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
        # one sketch a class; an id with several texts keeps them all as rows
        reps = ws.table(
            nodes.join(classes.select("fp1", "fp2", F.col("rep").alias("doc_id")), ["fp1", "fp2", "doc_id"], "left_semi")
            .dropDuplicates(["fp1", "fp2", "doc_id"])
            .select("doc_id", F.col("n_shingles").alias("n"), "regs", *_MARKS),
            "representatives",
        )
        links = self._links(docs, reps, ws)
        comps = components(twins.union(links), ws)
        out = sketches.select("doc_id", "n_shingles").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        component = F.coalesce("component", "doc_id")
        return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))

    def _links(self, docs: DataFrame, reps: DataFrame, ws: Workspace) -> DataFrame:
        """Verified links (a < b) between representatives that join all their components."""
        schema = "h long, doc_id long"
        rows = reps.mapInArrow(_band_rows(), schema)
        buckets = rows.groupBy("h").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.count("*").alias("n")).where("p <> q")
        buckets = ws.table(buckets.select("h", "n"), "buckets")
        shared = reps.mapInArrow(_band_rows(Sieve(buckets.select("h"))), f"{schema}, {_MARK_TYPES}")
        shared = ws.table(shared.join(buckets, "h"), "shared")
        ids = ws.table(shared.select("doc_id").distinct(), "ids")
        texts = docs.where("doc_id is not null")
        sets = ws.table(texts.mapInArrow(_sets(self.words, Sieve(ids)), "doc_id long, shingles array<long>"), "sets")
        # what shares many large buckets is central to its group and links to most of it
        weights = shared.groupBy("doc_id").agg(F.sum("n").alias("w"))
        rank = F.struct("w", (-F.col("doc_id")).alias("i"), "size", *_MARKS)
        pivots = shared.join(weights, "doc_id").groupBy("h").agg(F.max(rank).alias("top"))
        pivots = pivots.select("h", (-F.col("top.i")).alias("a"), *(F.col(f"top.{c}").alias(f"{c}1") for c in ("size", *_MARKS)))
        star = shared.join(pivots, "h").where((F.col("a") != F.col("doc_id")) & _may_link(self.percent, "1"))
        star = star.select("a", F.col("doc_id").alias("b")).distinct()
        star = ws.table(self._candidates(star, reps), "star")
        edges = ws.table(self._verify(star, sets), "links")
        comps = components(edges, ws)
        strays = ws.table(self._candidates(self._strays(sets, shared, comps, ws), reps), "strays")
        return edges.union(self._verify(strays, sets))

    def _candidates(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes allow the threshold and whose estimate is not clearly below it."""
        a = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        b = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        near = pairs.join(b, "b").join(a, "a").where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(self.percent / 100 - MARGIN), "a long, b long").distinct()

    def _verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs linked on their full sets; merge joins, which split hot keys, at every size."""
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        inter = F.size(F.array_intersect("sa", "sb"))
        linked = 100 * inter >= self.percent * (F.size("sa") + F.size("sb") - inter)
        return pairs.hint("merge").join(b, "b").hint("merge").join(a, "a").where(linked).select("a", "b")

    def _strays(self, sets: DataFrame, shared: DataFrame, comps: DataFrame, ws: Workspace) -> DataFrame:
        """Pairs between components in buckets of several components that may still be linked.

        In small buckets documents outside the main component meet all the others. Documents of
        larger buckets are joined on rare shingles instead (see ``_rare``), which is exact as well.
        """
        own = comps.withColumnRenamed("node", "doc_id")
        marks = ["size", *_MARKS]
        rows = shared.join(own, "doc_id", "left").select("h", "n", "doc_id", F.coalesce("component", "doc_id").alias("c"), *marks)
        parts = rows.groupBy("h", "c").count()
        mixed = parts.groupBy("h").agg(F.max(F.struct("count", "c")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        rows = ws.table(rows.join(mixed.select("h", F.col("main.c").alias("main")), "h"), "mixed")
        few = rows.where(F.col("n") <= SMALL_BUCKET)
        x = few.where("c <> main").select("h", F.col("doc_id").alias("x"), F.col("c").alias("cx"), *(F.col(c).alias(f"{c}1") for c in marks))
        y = few.select("h", F.col("doc_id").alias("y"), F.col("c").alias("cy"), "main", *marks)
        pairs = x.join(y, "h").where("cx <> cy and (cy = main or x < y)").where(_may_link(self.percent, "1")).select("x", "y")
        # an id with several texts has several parities and is compared whatever they are
        single = (F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in marks)
        many = rows.where(F.col("n") > SMALL_BUCKET).groupBy("doc_id").agg(F.max(F.col("c") != F.col("main")).alias("stray"), F.first("c").alias("c"), *single)
        pairs = pairs.union(self._rare(sets, ws.table(many, "many"), ws))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def _rare(self, sets: DataFrame, many: DataFrame, ws: Workspace) -> DataFrame:
        """Prefix-filter join of ``many(doc_id, stray, c, size, parities)``: pairs of different components, one a stray.

        Shingles are ordered from rare to common (see ``_Crowds``). A linked pair's first common
        shingle is so early in both that what follows can still hold the overlap needed; the smaller
        set's prefix is 1 + (100 - p) / (100 + p) of it, the larger one's 1 + (100 - p) / 100.
        """
        p, held = self.percent, ("doc_id", "n", "i", "c", "stray", "size", *_MARKS)
        own = ws.table(sets.join(many, "doc_id"), "own")
        prefix = ws.table(own.mapInArrow(_prefixes(p, _Crowds(own, ws)), f"g long, i long, n long, doc_id long, c long, stray boolean, {_MARK_TYPES}"), "prefixes")
        short = prefix.where((100 + p) * F.col("i") <= (100 - p) * F.col("n")).select("g", *(F.col(x).alias(f"{x}1") for x in held))
        need = 100 + p
        late = (need * (F.col("n1") - F.col("i1")) >= p * (F.col("n1") + F.col("n"))) & (need * (F.col("n") - F.col("i")) >= p * (F.col("n1") + F.col("n")))
        # two joins, as one with "a stray or a stray" as its condition compares all members with each other
        met = [x.join(y, "g") for x, y in ((short.where("stray1"), prefix), (short.where("not stray1"), prefix.where("stray")))]
        pairs = met[0].union(met[1].select(met[0].columns)).where("n1 <= n and c1 <> c").where(late & (100 * F.col("n1") >= p * F.col("n")) & _may_link(p, "1"))
        return pairs.select(F.col("doc_id1").alias("x"), F.col("doc_id").alias("y"))
