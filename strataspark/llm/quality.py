"""Quality scores of documents by a factorisation machine.

Inputs are hashed words (a log-scaled, length-normalised bag of ``BUCKETS`` buckets), structure
statistics of the text and the text's own sizes as metadata. Pairwise interactions have rank
``RANK`` and are scored by the identity  sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if
x_i)^2 - sum_i v_if^2 x_i^2), linear in the number of non-zero inputs. Identifiers, language and
source are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 2048
RANK = 6
#: Documented bound of the training sample: the labelled rows of smallest hash.
MAX_TRAINING_ROWS = 6000
EPOCHS, BATCH, RATE, DECAY = 14, 128, 0.05, 1e-5
#: Rows scored at once; their dense inputs take ROWS * (BUCKETS + len(STATS)) * 4 bytes.
ROWS = 256

STATS = (
    "words", "bytes", "lines", "word_length", "line_length", "upper", "digit", "space", "newline", "period", "comma", "bar",
    "symbol", "exclaim", "other_punctuation", "non_ascii", "lower", "distinct_words", "top_word", "repeated_lines", "upper_words", "odd_ends",
)
INPUTS = len(STATS) + BUCKETS


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 '.', 6 ',', 7 '|', 8 symbol, 9 '!', 10 other, 11 not ASCII."""
    out = np.full(256, 10, np.int64)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A], out[0x80:] = 0, 1, 2, 11
    for chars, k in ((b" \t\r", 3), (b"\n", 4), (b".", 5), (b",", 6), (b"|", 7), (b"#$%&*@<>{}[]\\^~=_+", 8), (b"!", 9)):
        out[list(chars)] = k
    return out


_CLASS = _classes()


def _per_doc(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: number of distinct hashes and count of the most frequent one."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        counts = np.diff(np.r_[first, len(h)])
        np.add.at(distinct, o[first], 1)
        np.maximum.at(top, o[first], counts)
    return distinct, top


def inputs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Dense inputs of a group of documents, a row each."""
    n = len(offsets) - 1
    words = tk.Words(data, offsets, tk.SPACES, tk.ByteHash(0xF3, True))
    count = np.diff(words.ptr).astype(float)
    owner = np.repeat(np.arange(n), np.diff(words.ptr))
    sizes = np.diff(offsets).astype(float)
    share = np.zeros((n, 12))
    for lo in range(0, len(data), tk.SEGMENT_BYTES):
        part = data[lo : lo + tk.SEGMENT_BYTES]
        cuts = np.clip(offsets - lo, 0, len(part))
        rows = np.repeat(np.arange(n), np.diff(cuts))
        share += np.bincount(rows * 12 + _CLASS[part], minlength=12 * n).reshape(n, 12)
    newlines = share[:, 4].copy()
    share /= np.maximum(sizes, 1)[:, None]
    lines = tk.Words(data, offsets, tk.NEWLINE, tk.ByteHash(0xF5, False))
    line_owner = np.repeat(np.arange(n), np.diff(lines.ptr))
    n_lines = np.diff(lines.ptr).astype(float)
    distinct, top = _per_doc(words.hashes, owner, n)
    distinct_lines, _ = _per_doc(lines.hashes, line_owner, n)
    w1 = np.maximum(count, 1)
    by_doc = lambda mask: np.bincount(owner[mask], minlength=n) / w1
    head, tail = (_CLASS[data[words.starts]], _CLASS[data[words.ends - 1]]) if len(words.starts) else (np.zeros(0, int),) * 2
    stats = np.column_stack([
        np.log1p(count) / 8, np.log1p(sizes) / 10, np.log1p(newlines) / 6,
        np.minimum(np.bincount(owner, words.ends - words.starts, n) / w1 / 10, 4),
        np.log1p(sizes / np.maximum(n_lines, 1)) / 8,
        share[:, 1], share[:, 2], share[:, 3], np.minimum(share[:, 4] * 20, 4), share[:, 5] * 5, share[:, 6] * 5, share[:, 7] * 5,
        share[:, 8] * 5, share[:, 9] * 5, share[:, 10] * 5, share[:, 11] * 2, share[:, 0],
        distinct / w1, top / w1, 1 - distinct_lines / np.maximum(n_lines, 1),
        by_doc((head == 1) & (tail == 1)), by_doc((tail >= 7) & (tail <= 9)),
    ])
    bag = np.bincount(owner * BUCKETS + (words.hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
    bag = np.log1p(bag).astype(np.float32)
    norm = np.sqrt((bag * bag).sum(1, keepdims=True))
    return np.hstack([stats.astype(np.float32), bag / np.maximum(norm, 1e-6)])


def row_groups(column):
    """(lo, hi, inputs) for groups of at most ROWS documents."""
    for lo, hi, data, offsets in tk.document_groups(column):
        for a in range(0, hi - lo, ROWS):
            own = offsets[a : min(a + ROWS, hi - lo) + 1]
            yield lo + a, lo + a + len(own) - 1, inputs(data[own[0] : own[-1]], own - own[0])


class FactorisationMachine:
    """Weights and logistic training by AdaGrad; a fixed seed makes it repeatable."""

    def __init__(self, inputs_: int = INPUTS, rank: int = RANK, seed: int = 11):
        rng = np.random.Generator(np.random.Philox(seed))
        self.bias = 0.0
        self.w = np.zeros(inputs_, np.float32)
        self.v = rng.normal(0, 0.02, (inputs_, rank)).astype(np.float32)
        self.rng = rng

    def logits(self, x: np.ndarray) -> np.ndarray:
        xv = x @ self.v
        return self.bias + x @ self.w + 0.5 * ((xv * xv).sum(1) - (x * x) @ (self.v * self.v).sum(1))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(float), -40, 40)))

    def fit(self, rows, y: np.ndarray) -> None:
        """rows(indexes) gives their dense inputs."""
        gw, gv, gb = np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6), 1e-6
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        for _ in range(EPOCHS):
            order = self.rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                own = order[lo : lo + BATCH]
                x = rows(own)
                d = ((self.scores(x) - y[own]) / len(own)).astype(np.float32)
                xv = x @ self.v
                dw = x.T @ d + DECAY * self.w
                dv = x.T @ (d[:, None] * xv) - self.v * ((x * x).T @ d)[:, None] + DECAY * self.v
                db = float(d.sum())
                gw += dw * dw
                gv += dv * dv
                gb += db * db
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= RATE * dv / np.sqrt(gv)
                self.bias -= RATE * db / gb**0.5


def _features(batches):
    for batch in batches:
        for lo, hi, x in row_groups(batch.column("text")):
            for i, row in zip(range(lo, hi), x, strict=True):
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), batch.column("y").slice(i, 1), pa.array([at.astype(np.int16).tobytes()], pa.binary()), pa.array([row[at].tobytes()], pa.binary())],
                    names=["doc_id", "y", "at", "x"],
                )


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> FactorisationMachine:
    """Fit on at most ``max_rows`` labelled documents (those of smallest id hash) that aren't held out.

    Without labels of both kinds the model scores every text alike, at the smoothed share of label 1.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers, so the broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "y", "text").mapInArrow(_features, "doc_id long, y int, at binary, x binary")
    found = {r.doc_id: r for r in found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toLocalIterator()}
    rows = [found[k] for k in sorted(found)]
    at, x = [np.frombuffer(r["at"], np.int16) for r in rows], [np.frombuffer(r["x"], np.float32) for r in rows]
    y = np.array([r["y"] for r in rows], np.float32)
    model = FactorisationMachine()

    def dense(own):
        out = np.zeros((len(own), INPUTS), np.float32)
        for k, i in enumerate(own):
            out[k, at[i]] = x[i]
        return out

    if len(y) and 0 < y.sum() < len(y):
        model.fit(dense, y)
    else:
        model.v[:] = 0
        model.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return model


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """(doc_id, text, score) of ``docs``; score is 0 to 1, and a null text scores as an empty one."""
    state = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches):
        fm = FactorisationMachine()
        fm.bias, fm.w, fm.v = state.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, x in row_groups(batch.column("text")):
                scores[lo:hi] = fm.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, least: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``."""
    state = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))

    def run(batches):
        fm = FactorisationMachine()
        fm.bias, fm.w, fm.v = state.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, x in row_groups(batch.column("text")):
                scores[lo:hi] = fm.scores(x)
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)
