"""Broadcast bitmaps of bounded size that let workers skip rows early.

A value sets the bit of its low bits. False hits only pass a row on to an exact comparison, so
results don't depend on the size: eight bits a value, within 2^LEAST_BITS and 2^MOST_BITS bits
(64 MB at most), beyond which more rows pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS = 20, 29
_U = np.uint64


class Sieve:
    def __init__(self, values: DataFrame):
        """``values``: a written table of one long column without nulls."""
        spark, name = values.sparkSession, values.columns[0]
        self.bits = min(max((8 * values.count()).bit_length(), LEAST_BITS), MOST_BITS)
        place = F.col(name).bitwiseAND(F.lit((1 << self.bits) - 1)) + 1  # bucket b holds values from (b - 1) * 32768 + 1
        maps = values.select(place.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m"))
        out = bytearray(1 << (self.bits - 3))
        for r in maps.toLocalIterator():  # 2^MOST_BITS bits at most, in rows of 4 kB
            out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["m"]
        self.state = spark.sparkContext.broadcast(bytes(out))

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Which of the 64-bit values may be in the table."""
        seen = np.frombuffer(self.state.value, np.uint8)
        slot = (values & _U((1 << self.bits) - 1)).astype(np.int64)
        return ((seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
