"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Each window has an anchor, the gram of ``GRAM`` words in it
whose hash is smallest (leftmost on ties): equal windows have equal anchors, and neighbouring
windows mostly share theirs, so one fingerprint stands for about eight windows. The index is a
list of runs, immutable tables of distinct fingerprints in buckets sorted by fingerprint. A new
batch becomes a run, which is merge-joined, bucket by bucket and without a shuffle, with the older runs;
windows at fingerprints that occur again are read from the batch's texts, and from those older texts only
that have one of them, and verified by 128-bit hashes of their words. When there are ``max_runs`` of
them the runs are compacted into one.

The fingerprints found again reach the workers as a bitmap of bounded size; beyond ``MOST_AGAIN`` of
them, each text is joined with the places of its own. Either only decides which windows are compared,
so any corpus size gives the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .sieve import Sieve
from ..storage import Workspace

_U = np.uint64
WINDOW, GRAM = 20, 6
MAX_RUNS = 4
#: Fingerprints told by bitmap: at eight bits each this fills the largest one.
MOST_AGAIN = 1 << 26


class _Roll:
    """Hashes of fixed-length runs of words from one cumulative sum."""

    def __init__(self, seed: int):
        self.base = int(tk.stream(seed, 1)[0]) | 1
        self.powers = self.inverses = np.ones(1, _U)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) + 1
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", tk.odd_inverse(self.base))):
                table = np.full(2 * n, _U(base))
                table[0] = _U(1)
                setattr(self, name, np.multiply.accumulate(table))
        out = np.zeros(n, _U)
        np.cumsum(hashes * self.powers[: n - 1], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return tk.mix((sums[at + length] - sums[at]) * self.inverses[at])


class _Texts:
    """Words, windows and anchors of groups of documents."""

    def __init__(self):
        self.first, self.second = tk.ByteHash(0xA11CE, False), tk.ByteHash(0xB0B, False)
        self.grams, self.left, self.right = _Roll(1), _Roll(2), _Roll(3)

    def anchors(self, data, offsets):
        """(words, window starts, their anchors' word positions, grams' hashes)."""
        words = tk.Words(data, offsets, tk.SPACES, self.first)
        n = len(words.hashes)
        grams = self.grams.runs(self.grams.sums(words.hashes), np.arange(max(n - GRAM + 1, 0)), GRAM)
        count = max(n - WINDOW + 1, 0)
        best, arg = grams[:count].copy(), np.zeros(count, np.int8)
        for j in range(1, WINDOW - GRAM + 1):
            other = grams[j : j + count]
            less = other < best
            np.copyto(best, other, where=less)
            arg[less] = j
        inside = np.zeros(count + 1, np.int32)  # windows that cross a document's border don't count
        for border in words.ptr[1:-1]:
            lo, hi = max(int(border) - WINDOW + 1, 0), min(int(border), count)
            if hi > lo:
                inside[lo] += 1
                inside[hi] -= 1
        starts = np.flatnonzero(np.cumsum(inside[:count]) == 0)
        return words, starts, starts + arg[starts], grams

    def hashes(self, data, offsets, words, starts):
        second = tk.Words(data, offsets, tk.SPACES, self.second)
        return (roll.runs(roll.sums(w.hashes), starts, WINDOW) for roll, w in ((self.left, words), (self.right, second)))


def _fingerprints(batches):
    texts = _Texts()
    for batch in batches:
        for lo, _, data, offsets in tk.document_groups(batch.column("text")):
            words, _, at, grams = texts.anchors(data, offsets)
            at = np.unique(at)
            if len(at):
                doc = np.searchsorted(words.ptr, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), batch.column("doc_id").take(pa.array(doc + lo)), pa.array((at - words.ptr[doc]).astype(np.int32))], names=["g", "doc_id", "pos"]
                )


def _met(again: Sieve):
    """doc_id of rows whose fingerprint may be in ``again``."""

    def run(batches):
        for batch in batches:
            hit = again.hits(batch.column("g").to_numpy().view(_U))
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column("doc_id").to_numpy()[hit]))], names=["doc_id"])

    return run


def _windows(again: Sieve | None, met: Sieve | None = None):
    """Windows at fingerprints in ``again``, or at the batch's ``places`` of a text, of texts whose id is in ``met``, if given."""

    def run(batches):
        texts = _Texts()
        for batch in batches:
            if met is not None:
                batch = batch.filter(pa.array(met.hits(batch.column("doc_id").to_numpy().view(_U))))
            for lo, hi, data, offsets in tk.document_groups(batch.column("text")):
                words, starts, at, grams = texts.anchors(data, offsets)
                if again is not None:
                    starts = starts[again.hits(grams[at])]
                else:
                    own = batch.column("places").slice(lo, hi - lo)
                    doc = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(own), 0).to_numpy())
                    starts = starts[np.isin(at, own.flatten().to_numpy() + words.ptr[doc])]
                if len(starts):
                    doc = np.searchsorted(words.ptr, starts, "right") - 1
                    rows = pa.array(doc + lo)
                    h1, h2 = texts.hashes(data, offsets, words, starts)
                    order = np.lexsort((starts, h2, h1, doc))
                    same = np.zeros(len(order), bool)
                    same[order[1:]] = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h1.view(np.int64)),
                            pa.array(h2.view(np.int64)),
                            batch.column("doc_id").take(rows),
                            batch.column("fp").take(rows),
                            pa.array((starts - words.ptr[doc]).astype(np.int32)),
                            pa.array(same),
                        ],
                        names=["h1", "h2", "doc_id", "fp", "start", "again"],
                    )

    return run


def kept_words(text: bytes, starts) -> tuple[int, list[bytes]]:
    """Number of words, and those that no window starting at ``starts`` covers."""
    words = text.split()  # splits bytes at exactly [\x20\x09-\x0D]
    if starts is None or not len(starts):
        return len(words), words
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.asarray(starts)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _cut(digest: bool):
    def run(batches):
        for batch in batches:
            data, offsets = tk.utf8(batch.column("text"))
            spans = batch.column("starts")
            n_words, n_removed, out = [], [], []
            for i in range(batch.num_rows):
                own = spans[i].values
                n, kept = kept_words(data[offsets[i] : offsets[i + 1]].tobytes(), None if own is None else own.to_numpy())
                n_words.append(n)
                n_removed.append(n - len(kept))
                joined = b" ".join(kept)
                out.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"],
            )

    return run


_WINDOW = "h1 long, h2 long, doc_id long, fp long, start int, again boolean"


class FingerprintIndex:
    """The runs of all batches added so far, their fingerprints' places, and the texts they were made from.

    Batches must come in the order of their ids: what starts earlier is kept, in an earlier batch,
    a smaller id, or earlier in the same document. Rows of a null id keep all their words and make
    none go; texts with fewer words than a window keep all. Rows that repeat an id are the same
    document, of which none starts earlier; what repeats within one of their texts goes.
    """

    def __init__(self, spark: SparkSession, max_runs: int = MAX_RUNS, buckets: int | None = None):
        """``buckets`` of a run: the session's shuffle partitions unless given."""
        self.spark, self.ws, self.max_runs = spark, Workspace(spark, "fingerprints"), max_runs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.compactions = 0
        self.places: DataFrame | None = None
        self.texts: DataFrame | None = None

    def add(self, docs: DataFrame) -> DataFrame:
        """(doc_id, fp, starts): the windows of ``docs(doc_id, fp, text)`` that started earlier."""
        if len(self.runs) >= self.max_runs:
            self.compact()
        docs = docs.where("doc_id is not null").select("doc_id", "fp", "text")
        places = self.ws.table(docs.mapInArrow(_fingerprints, "g long, doc_id long, pos int"), "places")
        run = self._run(places.groupBy("g").agg((F.count("*") > 1).alias("twice")))
        again = self._again(run)
        fresh = self.ws.table(self._found(docs, places, again.select("g"), None), "windows")
        seen = fresh.where("not again").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        if self.texts is None:
            shared = seen.where("first < last").select("h1", "h2", "first")
        else:
            old = self._found(self.texts, self.places, again.where("old").select("g"), again)
            seen = fresh.where("not again").select("h1", "h2", "doc_id").union(old.where("not again").select("h1", "h2", F.lit(None).cast("long")))
            earlier = F.count("*") > F.count("doc_id")
            seen = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), earlier.alias("earlier"))
            # no first one: all of the batch go
            shared = seen.where("first < last or (earlier and first is not null)").select("h1", "h2", F.when(~F.col("earlier"), F.col("first")).alias("first"))
        shared = self.ws.table(shared, "shared")
        later = fresh.where("not again").join(shared.hint("merge"), ["h1", "h2"]).where("first is null or doc_id > first")
        # what comes again within a document goes with it or without
        later = later.select("doc_id", "fp", "start").union(fresh.where("again").select("doc_id", "fp", "start"))
        removed = self.ws.table(later.groupBy("doc_id", "fp").agg(F.collect_set("start").alias("starts")), "removed")
        self.ws.drop(fresh, shared)
        self.runs.append(run)
        self.places = places if self.places is None else self.places.union(places)
        self.texts = docs if self.texts is None else self.texts.union(docs)
        return removed

    def compact(self) -> None:
        """Merge all runs into one."""
        old, merged = self.runs, self.spark.table(self.runs[0])
        for name in old[1:]:
            merged = merged.union(self.spark.table(name))
        self.runs = [self._run(merged.groupBy("g").agg(F.lit(True).alias("twice")))]
        self.compactions += 1
        for name in old:
            self.ws.drop_buckets(name)

    def close(self) -> None:
        """Drop the runs' tables; what ``add`` returned stays."""
        for name in self.runs:
            self.ws.drop_buckets(name)
        self.runs = []

    def _run(self, rows: DataFrame) -> str:
        """The name of a new table of ``rows(g, twice)`` in sorted buckets, a file each."""
        return self.ws.buckets(rows, "run", "g", self.buckets)

    def _again(self, run: str) -> DataFrame:
        """(g, old): the run's fingerprints that it has twice or that an older run has."""
        return self.ws.table(self._joined(run).where("twice or old").select("g", "old"), "again")

    def _joined(self, run: str) -> DataFrame:
        """The run merge-joined with all older ones."""
        again = self.spark.table(run).withColumn("old", F.lit(False))
        for k, name in enumerate(self.runs):
            one = self.spark.table(name).select("g", F.lit(True).alias(f"_{k}"))
            again = again.join(one.hint("merge"), "g", "left").withColumn("old", F.col("old") | F.coalesce(f"_{k}", F.lit(False)))
        return again

    def _found(self, docs: DataFrame, places: DataFrame, again: DataFrame, met: DataFrame | None) -> DataFrame:
        """Windows of ``docs`` at the fingerprints ``again``; of older texts (``met`` is given) only those that have one."""
        again = self.ws.table(again, "told")
        if again.count() <= MOST_AGAIN:
            sieve, ids = Sieve(again), None
            if met is not None:
                ids = Sieve(self.ws.table(places.mapInArrow(_met(sieve), "doc_id long").distinct(), "met"))
            return docs.mapInArrow(_windows(sieve, ids), _WINDOW)
        own = places.join(again.hint("merge"), "g").groupBy("doc_id").agg(F.collect_list("pos").alias("places"))
        return docs.join(own, "doc_id").mapInArrow(_windows(None), _WINDOW)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text); fp tells different texts under one id apart."""
    text: Column = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("fp"), text.alias("text"))


def remove_repeats(docs: DataFrame, batches: int = 2, digest: bool = False, max_runs: int = MAX_RUNS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text or kept_sha256), a row for each row of ``docs``.

    The table goes through the index in ``batches`` ranges of doc_id, cut at quantiles. Null and empty
    texts have no words. Other columns are not returned, whatever their names.
    """
    index = FingerprintIndex(docs.sparkSession, max_runs)
    own = keyed(docs)
    cuts = own.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("q")).first().q or [] if batches > 1 else []
    borders = [None, *sorted(set(cuts)), None]
    removed = None
    for lo, hi in zip(borders, borders[1:], strict=False):
        part = own
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        found = index.add(part)
        removed = found if removed is None else removed.union(found)
    index.close()
    name = "kept_sha256" if digest else "kept_text"
    joined = own.join(removed, ["doc_id", "fp"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut(digest), f"doc_id long, n_words long, n_removed long, {name} string")
