"""Mixing sources to target weights by Poisson replication.

A source's rate is its target mass over its own mass; a document's number of copies is the inverse
of the Poisson distribution of that rate at a uniform number hashed from seed and id, so the draw
repeats wherever and whenever it is made. Copies are then shuffled globally by another hash.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

#: A rate above this is the sum of equal parts, each with its own hash, so exp(-rate) stays a normal number.
PART_RATE = 256.0
#: Rates are broadcast up to this many sources; beyond, they are joined with a shuffle.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)


def rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """(source, rate) with rate = total mass * weight / (sum of weights * the source's mass).

    Mass is UTF-8 bytes plus 1 a document. Weights default to mass ** alpha; of given weights,
    sources without one have 0. A null source is a source of its own, weighed by the key "".
    """
    mass = F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(1).cast("long"))
    sizes = docs.groupBy("source").agg(mass.alias("mass"))
    if weights is None:
        weight = F.pow(F.col("mass").cast("double"), F.lit(alpha))
    else:
        key = F.coalesce(F.col("source"), F.lit(""))
        pairs = [F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("mass").alias("total"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("weights") > 0, F.col("total") * F.col("weight") / (F.col("weights") * F.col("mass"))).otherwise(0.0)
    # the sums are one row
    return sizes.crossJoin(F.broadcast(sums)).select("source", rate.alias("rate"))


def _with_distribution(table: DataFrame) -> DataFrame:
    """Adds parts and cdf: the cumulative probabilities of a part's rate, to where they reach 1."""
    table = table.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    table = table.withColumn("part_rate", F.col("rate") / F.col("parts"))
    last = F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 40).cast("int")
    first = F.exp(-F.col("part_rate"))
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(first.alias("term"), first.alias("sum"), F.array(first).alias("cdf")),
        lambda a, k: F.struct(
            (a["term"] * F.col("part_rate") / k).alias("term"),
            (a["sum"] + a["term"] * F.col("part_rate") / k).alias("sum"),
            F.concat(a["cdf"], F.array(a["sum"] + a["term"] * F.col("part_rate") / k)).alias("cdf"),
        ),
    )
    return table.withColumn("cdf", steps["cdf"]).drop("part_rate")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 0, with_copy: bool = False) -> DataFrame:
    """Each row of ``docs`` as many times as drawn, shuffled globally.

    Copies of a row are equal rows; ``with_copy`` adds rate, copy (from 1) and shuffle_key. The id
    decides the draw, so rows that repeat an id are drawn alike; null ids count as the word null.
    Other columns of ``docs`` are kept; columns named like the added ones are replaced by them.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    table = ws.table(_with_distribution(rates(docs, weights, alpha)), "rates")
    table = table.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"), F.col("parts").alias("_parts"), F.col("cdf").alias("_cdf"))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    # the row travels as one column, so its columns' names can't clash with these
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    joined = rows.join(table, F.col("_row.source").eqNullSafe(F.col("_source")))
    key = F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("null"))
    draw = lambda i: F.size(F.filter("_cdf", lambda c: c <= uniform(F.lit(f"draw{seed}"), key, i.cast("string"))))
    one = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    many = F.aggregate(F.sequence(F.lit(2), F.col("_parts")), one, lambda n, i: n + draw(i))
    joined = joined.withColumn("_u", uniform(F.lit(f"draw{seed}"), key, F.lit("1")))
    joined = joined.withColumn("_n", F.when(F.col("_parts") > 1, many).otherwise(one)).where("_n > 0")
    copies = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"order{seed}"), key, F.col("_copy").cast("string"))), 1, 13), 16, 10).cast("long")
    shuffled = copies.select("_row", "_rate", "_copy", order.alias("_key")).repartition("_key").sortWithinPartitions("_key")
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if not (with_copy and c in ("rate", "copy", "shuffle_key"))]
    more = [F.col("_rate").alias("rate"), F.col("_copy").alias("copy"), F.col("_key").alias("shuffle_key")]
    return shuffled.select(*own, *(more if with_copy else []))
