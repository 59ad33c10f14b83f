"""Points derived from the lineitem table by integer arithmetic, for queries and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")

#: The scene in millimetres; reads lineitem columns, and evaluates alike in Spark and DuckDB.
_PLACED = """
select *, case when q=31 then 1000+(sk*6007)%38000+(pk%300) when q between 46 and 47 then 12000+(l_orderkey*7919+pk*31)%9000 else (l_orderkey*7919+l_linenumber*104729+pk*31)%40000 end as xi,
 case when q=31 then 1000+(sk*9973)%38000+((pk*7)%300) when q between 46 and 47 then 12000+(pk*15485863+sk*611953)%9000 else (pk*15485863+sk*611953+l_linenumber*7907)%40000 end as yi
from (select *, cast(l_partkey as bigint) pk, cast(l_suppkey as bigint) sk, cast(l_quantity as int) q from {source}) a"""
_COLUMNS = """cast(xi as int) xi, cast(yi as int) yi, cast(floor((xi+2*yi)/400.0) + case when q=31 then 60+pk%300 when q=50 and pk%20=0 then -300-(pk%500)
 when q between 32 and 40 then 500+(pk%2400) when q between 46 and 47 then 6000+(pk%5)*10-cast(floor((xi+2*yi)/400.0) as bigint) when q between 41 and 45 then 3000+(pk%6000) else (q%3-1)*10 end as int) zi,
 cast(floor(l_extendedprice) as bigint)%65536 intensity, cast((pk*257+sk*31)%65536 as int) red, cast((pk*521+l_linenumber*4099)%65536 as int) green,
 cast((sk*1031+pk*17)%65536 as int) blue, cast((pk*769+sk*13)%65536 as int) nir, case when q=31 or q between 32 and 47 then 1 when l_returnflag='A' then 8 else 2 end classification,
 l_linenumber as scan_id, cast(case when pk%50=0 then 1 else 0 end as int) as invalid"""

#: The same points in SQL.
POINTS_SQL = f"""pts as (
select point_id, xi, yi, zi, intensity, red, green, blue, nir, classification, scan_id, invalid, xi*0.001e0 as x, yi*0.001e0 as y, zi*0.001e0 as z,
 cast(floor(xi*0.001e0/20.0e0)*20 as bigint) as te, cast(floor(yi*0.001e0/20.0e0)*20 as bigint) as tn
from (select row_number() over (order by {", ".join(_ORDER)}) as point_id, {_COLUMNS} from ({_PLACED.format(source="lineitem")}) b) p)"""


def with_row_ids(frame: DataFrame, order: tuple[str, ...], name: str, parts: int = 64) -> DataFrame:
    """Dense ids from 1 in ``order``, whose first column is a number.

    Ranges of that column, cut at quantiles, are numbered each for themselves, after the rows of
    those before; no task sees more than a range.
    """
    first = F.col(order[0])
    cuts = frame.select(F.percentile_approx(first, [i / parts for i in range(1, parts)]).alias("q")).first().q or []
    bounds = sorted(set(cuts))

    def below(lo: int, hi: int) -> Column:  # the number of bounds below the value, by halving
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.lit(bounds[mid]) < first, below(mid + 1, hi)).otherwise(below(lo, mid))

    ranged = frame.withColumn("_part", below(0, len(bounds)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_part").orderBy(*order)
    numbered = ranged.withColumn("_row", F.row_number().over(local)).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived points with x, y, z in metres."""
    lines = with_row_ids(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _ORDER, "point_id")
    return from_lines(lines)


def from_lines(lines: DataFrame) -> DataFrame:
    placed = lines.sparkSession.sql(f"select point_id, {_COLUMNS} from ({_PLACED.format(source='{lines}')}) b", lines=lines)
    metres = {v: F.col(f"{v}i") * F.lit(0.001) for v in "xyz"}
    return placed.withColumns(metres)
