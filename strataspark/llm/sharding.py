"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into P parts by a hash of the whole row, so a lost task deals them alike again.
From the parts' exact counts the driver draws how many rows each part sends to each shard: rows of
the matrix sum to the parts' counts, columns to the shard sizes, and its law is that of a uniform
permutation. Each part is permuted locally and cut at the matrix row's borders; each shard then
permutes what it gets, in cells of bounded size whose exact counts give every row its slot.
Equal rows are in one part, which the law allows for, and are numbered there; all that follows the
parts draws from the row's hash and that number, so copies of a row go apart like any other rows.
Rows that repeat so often that they would swell a part are counted, numbered from the count, and dealt
into parts by hash and number.
DataFrame functions only; the driver sees P counts and cell counts, one for some 100,000 rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a part and of a cell, about; and the least number of parts.
PART_ROWS, CELL_ROWS, LEAST_PARTS = 50_000, 50_000, 64


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric variate by inversion over the window that holds all but 1e-20 of the mass."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), lo), hi)
    spread = (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    reach = int(10 * spread) + 30
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    log = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(log - log.max()))
    return lo + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, hi - lo))


def communication_matrix(parts: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each part to each shard: sums are exactly ``parts`` and ``shards``."""
    rng = np.random.Generator(np.random.Philox(seed))
    left, out = list(shards), []
    for n in parts:
        rest, row = sum(left), []
        for s, room in enumerate(left):
            k = draw(rng, room, rest - room, n)
            row.append(k)
            left[s] -= k
            n -= k
            rest -= room
        out.append(row)
    return out


def _values(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from literals."""
    column = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(column).alias("r")).select("r.*")


def _fresh(names: list[str], wanted: str) -> str:
    while wanted.lower() in {n.lower() for n in names}:
        wanted = f"_{wanted}"
    return wanted


def _numbered_repeats(keyed: DataFrame, full: list[int], h: str, p: str, copy: str, other: str, parts: int, seed: int) -> DataFrame:
    """``keyed`` with numbers in ``copy`` for rows that repeat over PART_ROWS times in the parts ``full``; these rows are dealt anew."""
    n, chunk = _fresh(keyed.columns, "count"), _fresh(keyed.columns, "chunk")
    own = keyed.withColumn(other, F.xxhash64(F.lit(~seed), *(F.col(f"`{f.name}`") for f in keyed.schema if not isinstance(f.dataType, (T.MapType, T.VariantType)))))
    often = own.where(F.col(p).isin(full)).groupBy(h, other).agg(F.count("*").alias(n)).where(F.col(n) > PART_ROWS)
    often = F.broadcast(often)  # at most rows / PART_ROWS of them
    rest = own.join(often, [h, other], "left_anti").withColumn(copy, F.lit(None).cast("long"))
    one = own.join(often, [h, other]).dropDuplicates([h, other])
    many = one.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / PART_ROWS)))).repartition(h, other, chunk)
    last = F.least(F.col(n), (F.col(chunk) + 1) * PART_ROWS) - 1
    many = many.withColumn(copy, F.explode(F.sequence(F.col(chunk) * PART_ROWS, last)))
    many = many.withColumn(p, F.pmod(F.xxhash64(F.lit(seed + 1), h, copy), F.lit(parts)))
    return rest.drop(other).unionByName(many.select(rest.drop(other).columns))


def shard_rows(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``docs`` with shard (0 to shards - 1, sizes at most one apart) and slot (gapless from 0 in each shard).

    The shuffle is uniform, repeatable for a seed, and independent of the input's partitions. Rows
    equal in all columns are interchangeable, and each is placed on its own. Empty tables give empty
    results. Columns of ``docs`` that are named shard or slot are kept under a leading underscore.
    """
    spark = docs.sparkSession
    for name in [c for c in docs.columns if c.lower() in ("shard", "slot")]:
        docs = docs.withColumnRenamed(name, _fresh([*docs.columns, "shard", "slot"], name))
    names = docs.columns
    h, p, copy, rank, cell, other = (_fresh(names, x) for x in ("h", "part", "copy", "rank", "cell", "other"))
    hashable = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = docs.withColumn(h, F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in hashable)))
    total = docs.count()
    parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    cells = max(-(-LEAST_PARTS // shards), -(-total // (shards * CELL_ROWS)))
    keyed = keyed.withColumn(p, F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(parts)))
    counted = lambda: {r[0]: r[1] for r in keyed.groupBy(p).count().collect()}
    counts = counted()
    full = [i for i, n in counts.items() if n > 3 * PART_ROWS]
    if full:
        keyed = _numbered_repeats(keyed, full, h, p, copy, other, parts, seed)
        counts = counted()
    else:
        keyed = keyed.withColumn(copy, F.lit(None).cast("long"))
    sent = [counts.get(i, 0) for i in range(parts)]
    total = sum(sent)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(sent, sizes, seed)
    borders = _values(spark, [{p: i, "borders": np.cumsum(row).tolist()} for i, row in enumerate(matrix)], f"`{p}` bigint, borders array<bigint>")

    def sharded(frame: DataFrame) -> DataFrame:
        alike = Window.partitionBy(p).orderBy(h)
        # both windows follow one exchange by part
        own = frame.withColumn(copy, F.coalesce(copy, F.row_number().over(alike) - F.rank().over(alike)))
        local = Window.partitionBy(p).orderBy(F.xxhash64(F.lit(seed + 2), h, copy), h, copy)
        ranked = own.withColumn(rank, F.row_number().over(local) - 1)
        # one row a part: at most rows / PART_ROWS of them
        placed = ranked.join(F.broadcast(borders), p)
        shard = F.size(F.filter("borders", lambda b: b <= F.col(rank)))
        placed = placed.withColumn("shard", shard).drop("borders", rank, p)
        return placed.withColumn(cell, F.pmod(F.xxhash64(F.lit(seed + 3), h, copy), F.lit(cells)))

    found = sharded(keyed.select(h, p, copy)).groupBy("shard", cell).count()
    filled = {(r[0], r[1]): r[2] for r in found.collect()}
    starts, at = [], 0
    for s in range(shards):
        at = 0
        for c in range(cells):
            starts.append({"shard": s, cell: c, "start": at})
            at += filled.get((s, c), 0)
    offsets = _values(spark, starts, f"shard int, `{cell}` bigint, start bigint")
    again = Window.partitionBy("shard", cell).orderBy(F.xxhash64(F.lit(seed + 4), h, copy), h, copy)
    out = sharded(keyed).withColumn(rank, F.row_number().over(again) - 1)
    out = out.join(F.broadcast(offsets), ["shard", cell])
    return out.select(*(F.col(f"`{c}`") for c in names), "shard", (F.col("start") + F.col(rank)).alias("slot"))
