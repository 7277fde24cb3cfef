"""Running sums, ranks and order statistics of hot groups, in ranges of their order.

A window over a group is one task's work, however many rows the group has. Here rows
are dealt by ranges of (keys, order), so that a hot group lies in many ranges. What
each range sums up to is combined in the order of ranges; a window is over the rows
of one group in one range, or over a group's ranges, one row each.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from webstrata.sources.tables import written

#: Leading bits that tell the ranges of a histogram: values below 2^PRECISION are ranges of their own, others share one with a thousandth of their size.
PRECISION = 10


def in_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``part``: the number of its range of (keys, order). Written once, as a range must not change between two uses."""
    return written(df.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the keys of ``a`` stay."""
    if not keys:
        return a.crossJoin(b)  # one row each
    renamed = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(renamed, on, how).drop(*(f"_{k}" for k in keys))


def greatest_running_sum(df: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """(keys, peak): the greatest sum of the first rows of each group in ``order``, 0 rows not among them.

    Each range gives its sum and its greatest prefix; a group's peak is the greatest
    of what came before a range plus that range's prefix.
    """
    dealt = in_ranges(df.select(*keys, *order, F.col(step).cast("long").alias("step")), keys, order)
    running = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.withColumn("upto", F.sum("step").over(running)).groupBy(*keys, "part").agg(F.sum("step").alias("total"), F.max("upto").alias("peak"))
    listed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "total", "peak"))).alias("ranges"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("peak"))
    whole = F.aggregate("ranges", start, lambda a, r: F.struct((a["total"] + r["total"]).alias("total"), F.greatest(a["peak"], a["total"] + r["peak"]).alias("peak")))
    return listed.select(*keys, whole["peak"].alias("peak"))


def running_totals(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, str]) -> DataFrame:
    """``df`` with running sums of whole numbers, each row included: ``totals`` has a new column for each column to add up."""
    dealt = in_ranges(df, keys, order)
    sums = dealt.groupBy(*keys, "part").agg(*(F.sum(F.col(c).cast("long")).alias(f"_{name}") for name, c in totals.items()))
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select(*keys, "part", *(F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in totals))
    within = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = same(dealt, starts, [*keys, "part"])
    return counted.select(*df.columns, *((F.coalesce(F.sum(F.col(c).cast("long")).over(within), F.lit(0)) + F.col(f"_{name}")).alias(name) for name, c in totals.items()))


def first_of_each(df: DataFrame, keys: list[str], order: list[str], limit: Column) -> DataFrame:
    """The first ``limit`` rows of each group, with ``rank`` (from 1). ``order`` must tell a group's rows apart; ``limit`` is the same for all of them.

    Rows are counted by range; ranges beyond a group's limit are left out before
    anything is ranked, and ranks count on from the ranges before.
    """
    dealt = in_ranges(df.withColumn("_limit", limit), keys, order)
    sizes = dealt.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"), F.max("_limit").alias("most"))
    ahead = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("before") < F.col("most"))
    within = Window.partitionBy(*keys, "part").orderBy(*order)
    kept = same(dealt, starts.select(*keys, "part", "before"), [*keys, "part"])
    ranked = kept.withColumn("rank", F.col("before") + F.row_number().over(within))
    return ranked.where(F.col("rank") <= F.col("_limit")).drop("part", "before", "_limit")


def value_range(c: Column) -> Column:
    """The range of a whole number in a histogram: its size and PRECISION leading bits, in the order of the numbers."""
    size = F.when(c < 0, F.bitwise_not(c)).otherwise(c)
    shift = F.greatest(F.length(F.bin(size)) - PRECISION, F.lit(0)).cast("int")
    place = F.shiftleft(shift.cast("long"), PRECISION + 1) + F.call_function("shiftright", size, shift)
    return F.when(c < 0, F.bitwise_not(place)).otherwise(place)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, str]) -> DataFrame:
    """(keys, one column a share): exact discrete quantiles of whole numbers, the first value at or above a share of the rows.

    ``shares``: column names and decimal texts ('0.95'). Nulls don't count; a group of
    nulls has null quantiles. Rows are counted by value before the shuffle. A group's
    histogram over ranges of values tells which range has the rank, and only that
    range's values are gone through: no task holds all values of a group.
    """
    counts = df.groupBy(*keys, F.col(value).cast("long").alias("_value")).agg(F.count(F.col(value)).alias("n"))
    counts = written(counts).withColumn("_range", value_range(F.col("_value")))  # used three times; the rows are gone through once
    ranges = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("n"))
    listed = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("_range", "n")))).alias("ranges"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("_range"))

    def rank(share: str) -> Column:
        """The whole number at or above share * total, exactly."""
        over, under = Decimal(share).as_integer_ratio()
        return F.greatest(F.expr(f"(total * {over} + {under - 1}) div {under}"), F.lit(1))

    def found(name: str, share: str) -> Column:
        at = F.aggregate("ranges", start, lambda a, r: F.when(a["_range"].isNotNull(), a).when(a["before"] + r["n"] >= rank(share), F.struct(a["before"].alias("before"), r["_range"].alias("_range"))).otherwise(F.struct((a["before"] + r["n"]).alias("before"), a["_range"].alias("_range"))))
        return F.struct(F.lit(name).alias("name"), at["_range"].alias("_range"), (rank(share) - at["before"]).alias("rank"))

    wanted = listed.select(*keys, F.explode(F.array(*(found(n, s) for n, s in shares.items()))).alias("w")).select(*keys, "w.*")
    if not keys:
        inside = counts.where("_value is not null").join(F.broadcast(wanted), "_range")  # a row a share
    else:
        inside = same(counts.where("_value is not null"), wanted, [*keys, "_range"])
    values = inside.groupBy(*keys, "name", "rank").agg(F.array_sort(F.collect_list(F.struct("_value", "n"))).alias("own"))
    first = F.aggregate(
        "own", F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("value")),
        lambda a, v: F.when(a["value"].isNotNull(), a).otherwise(F.struct((a["before"] + v["n"]).alias("before"), F.when(a["before"] + v["n"] >= F.col("rank"), v["_value"]).alias("value"))),
    )["value"]
    each = values.select(*keys, "name", first.alias("value")).groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares))
    return same(listed.select(*keys), each, keys, "left") if keys else each
