"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are words (ASCII letters, digits and non-ASCII characters, ASCII case folded). A document
leaks an item when some run of its words is within ``k`` word edits of the whole item, with
k = rate * n, rounded down, for n words. Of any k + 1 separate pieces of an item one then stands
unchanged, so item-sized windows are cut only around pieces of n // (k + 1) words, ``PIECE`` at most, at
every shift up to k; this loses none. The windows are embedded by CGK random walks, which turn edit
distance into Hamming distance; signatures of a few sampled steps are looked up among the items'
signatures, with as many repetitions as the target recall asks for, and what collides is verified exactly.

Pieces are kept once for each length and place they have in items, so a stem that many items share
costs no more than one of them. Items are taken in blocks of bounded size, each broadcast and set
against all documents; a usual benchmark collection is one block, so documents are read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

_U = np.uint64
PIECE = 5
#: Bounds of a block of items.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
SAMPLED = 3
#: Agreement of embeddings assumed at the largest number of edits, for the number of repetitions.
AGREEMENT = 0.5


def allowed_edits(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def piece_length(n: int, k: int) -> int:
    return min(PIECE, n // (k + 1))


def repetitions(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREEMENT**SAMPLED))


def _grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of q consecutive words at each start (borders are the caller's business)."""
    out = np.zeros(max(len(hashes) - q + 1, 0), _U)
    for j, step in enumerate(tk.stream(0x6EA4, q)):
        out += tk.mix(hashes[j : j + len(out)] + step)
        out *= _U(0x9FB21C651E98DF25)
    return tk.mix(out)


def _words(data, offsets) -> tk.Words:
    return tk.Words(data, offsets, tk.NON_ALNUM, _HASHER)


_HASHER = tk.ByteHash(0xDEC0, True)


def signatures(windows: np.ndarray, reps: int) -> np.ndarray:
    """reps x windows signatures: sampled steps of CGK walks of 3n steps over rows of n words."""
    count, n = windows.shape
    steps = 3 * n
    rng = np.random.Generator(np.random.Philox(n))
    coins = rng.integers(0, 2**63, (reps, steps), dtype=np.int64).astype(_U) * _U(2) + _U(1)
    sampled = np.zeros((reps, steps), bool)
    for r in range(reps):
        sampled[r, rng.choice(steps, SAMPLED, replace=False)] = True
    padded = np.hstack([windows, np.zeros((count, 1), _U)])
    at = np.zeros((reps, count), np.int64)
    rows = np.arange(count)[None, :]
    out = np.zeros((reps, count), _U)
    for j in range(steps):
        symbol = padded[rows, at]
        for r in np.flatnonzero(sampled[:, j]):
            out[r] = tk.mix((out[r] + symbol[r]) * _U(0x9FB21C651E98DF25))
        at = np.minimum(at + ((symbol * coins[:, j : j + 1]) >> _U(63)).astype(np.int64), n)
    return out


def edit_distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Row by row, the least edits between an item and any prefix of a text (zeros are padding)."""
    width = texts.shape[1]
    column = np.arange(width + 1)
    last = np.broadcast_to(column, (len(items), width + 1)).astype(np.int64)
    for i in range(items.shape[1]):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (texts != items[:, i : i + 1]))
        last = np.minimum.accumulate(now - column, axis=1) + column
    return last.min(1)


class Items:
    """One block of items with its pieces and signatures."""

    def __init__(self, ids: list[int], texts: list[str], rate: float, reps: int):
        self.ids, self.reps = np.array(ids, np.int64), reps
        column = pa.array(texts, pa.large_string())
        data, offsets = tk.utf8(column)
        words = _words(data, offsets)
        self.words = [words.hashes[words.ptr[i] : words.ptr[i + 1]] for i in range(len(ids))]
        self.edits = {n: allowed_edits(n, rate) for n in {len(w) for w in self.words}}
        pieces: dict[int, set[tuple[int, int, int]]] = {}
        self.by_length: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            if len(w):
                q = piece_length(len(w), self.edits[len(w)])
                self.by_length.setdefault(len(w), []).append(i)
                grams = _grams(w, q)
                pieces.setdefault(q, set()).update((int(grams[o]), len(w), o) for o in range(0, len(w) - q + 1, q))
        self.pieces = {}
        for q, unsorted in pieces.items():
            found = sorted(unsorted)
            h = np.array([x[0] for x in found], _U)
            bits = max(16, (4 * len(found)).bit_length() + 3)
            seen = np.zeros(1 << bits, bool)
            seen[h & _U((1 << bits) - 1)] = True
            self.pieces[q] = (h, np.array([x[1] for x in found]), np.array([x[2] for x in found]), seen, _U((1 << bits) - 1))
        self.signed = {n: signatures(np.array([self.words[i] for i in own]), reps) for n, own in self.by_length.items()}

    def matches(self, words: tk.Words) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, first word, edits): the best run for each leaked item of each document."""
        hashes, ptr = words.hashes, words.ptr
        windows: dict[int, list[np.ndarray]] = {}
        for q, (known, length, offset, seen, mask) in self.pieces.items():
            grams = _grams(hashes, q)
            at = np.flatnonzero(seen[(grams & mask).astype(np.int64)])
            at = at[at + q <= ptr[np.searchsorted(ptr, at, "right")]]
            lo, hi = np.searchsorted(known, grams[at], "left"), np.searchsorted(known, grams[at], "right")
            for part in range(0, len(at), 65536):
                p, first, many = at[part : part + 65536], lo[part : part + 65536], (hi - lo)[part : part + 65536]
                p, row = np.repeat(p, many), np.repeat(first + many - np.cumsum(many), many) + np.arange(many.sum())
                for n in np.unique(length[row]).tolist():
                    k, own = self.edits[n], length[row] == n
                    d = np.searchsorted(ptr, p[own], "right") - 1
                    start = np.unique((p[own] - offset[row[own]])[:, None] + np.arange(-k, k + 1) + 1j * d[:, None])
                    s, d = start.real.astype(np.int64), start.imag.astype(np.int64)
                    windows.setdefault(n, []).append(s[(s >= ptr[d]) & (s < ptr[d + 1])])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, own in windows.items():
            start = np.unique(np.concatenate(own))
            for lo in range(0, len(start), 4096):
                for d, i, s, e in self._verified(hashes, ptr, n, start[lo : lo + 4096]):
                    best[d, i] = min(best.get((d, i), (e, s)), (e, s))
        for (d, i), (e, s) in sorted(best.items()):
            yield d, i, s - int(ptr[d]), e

    def _verified(self, hashes, ptr, n, start):
        items, k = np.array(self.by_length[n]), self.edits[n]
        doc = np.searchsorted(ptr, start, "right") - 1
        column = start[:, None] + np.arange(n + k)
        text = np.where(column < ptr[doc + 1][:, None], hashes[np.minimum(column, len(hashes) - 1)], _U(0))
        signed, known = signatures(text[:, :n], self.reps), self.signed[n]
        pairs = set()
        for r in range(self.reps):
            order = np.argsort(known[r], kind="stable")
            ordered = known[r][order]
            lo, hi = np.searchsorted(ordered, signed[r], "left"), np.searchsorted(ordered, signed[r], "right")
            for w in np.flatnonzero(hi > lo).tolist():
                pairs.update((w, int(x)) for x in order[lo[w] : hi[w]])
        if not pairs:
            return
        found = np.array(sorted(pairs))
        for lo in range(0, len(found), 4096):
            w, x = found[lo : lo + 4096].T
            own = np.array([self.words[items[y]] for y in x])
            for a, b, e in zip(w.tolist(), x.tolist(), edit_distances(own, text[w]).tolist(), strict=True):
                if e <= k:
                    yield int(doc[a]), int(items[b]), int(start[a]), e


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Items in id order, in blocks within BLOCK_ITEMS and about BLOCK_WORDS; items without words or id are left out."""
    ids, texts, words = [], [], 0
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in own.where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        words += len(row[1]) // 2
        if len(ids) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.15, recall: float = 0.99) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, edits) for every item a document leaks, at its best run.

    first_word counts the document's words from 0, n_words is the item's length. Null or empty
    documents leak nothing, nor do items without words. Rows that repeat a document repeat its rows.
    """
    schema = "doc_id long, item_id long, first_word long, n_words long, edits long"
    spark = docs.sparkSession
    out = None
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for ids, texts in _blocks(items):
        state = spark.sparkContext.broadcast((ids, texts))

        def run(batches, state=state):
            block = Items(*state.value, rate, repetitions(recall))
            for batch in batches:
                for lo, _, data, offsets in tk.document_groups(batch.column("text")):
                    found = list(block.matches(_words(data, offsets)))
                    if found:
                        d, i, s, e = (np.array(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(d + lo)), pa.array(block.ids[i]), pa.array(s), pa.array(np.array([len(block.words[x]) for x in i])), pa.array(e)],
                            names=["doc_id", "item_id", "first_word", "n_words", "edits"],
                        )

        found = own.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = 0.15, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    spark = docs.sparkSession
    for ids, texts in _blocks(items):
        state = spark.sparkContext.broadcast((ids, texts))

        def run(batches, state=state):
            block = Items(*state.value, rate, repetitions(recall))
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in tk.document_groups(batch.column("text")):
                    for d, *_ in block.matches(_words(data, offsets)):
                        clean[lo + d] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
