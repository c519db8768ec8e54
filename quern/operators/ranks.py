"""Running sums, percentiles and neighbours within groups of any size, without a task that holds a group.

Rows are dealt to ranges of (group, order), which are as large as each other however large a group is, and written with the number of their
range. Within a range a window runs as usual. What a range needs of those before it is one row for each group and range: the
sums so far, or the last row. A group has as many of these as ranges, so a window over them is small.

Groups and values may be null; nulls come first in an order, and percentiles leave them out. Rows that are equal in the order
stand in one range. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.files import stored


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; right has one row for each key."""
    own = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    return left.join(own, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys], "left").drop(*[f"_on_{k}" for k in keys])


def ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df, written, with the range of each row as `_part`; ranges follow each other in the order of (by, order)."""
    return stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """Adds upto_<c>, the sum of c over the rows of the group so far, and total_<c>, over all of them; order tells all rows of a group apart."""
    dealt = ranges(df, by, order)
    each = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ahead = each.select(*by, "_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums])
    upto = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumns({f"upto_{c}": F.sum(c).over(upto) for c in sums})
    met = _met(own, ahead, [*by, "_part"]).withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_before_{c}") for c in sums})
    return met.drop("_part", *[f"_before_{c}" for c in sums])


def with_previous(df: DataFrame, by: list[str], order: list[str], name: str = "previous") -> DataFrame:
    """Adds the row before in the group as a struct of the order's columns; null for the first one."""
    dealt = ranges(df, by, order)
    row = F.struct(*order)
    last = dealt.groupBy(*by, "_part").agg(F.max(row).alias("_last"))
    carried = last.select(*by, "_part", F.lag("_last").over(Window.partitionBy(*by).orderBy("_part")).alias("_carried"))
    own = dealt.withColumn(name, F.lag(row).over(Window.partitionBy(*by, "_part").orderBy(*order)))
    return _met(own, carried, [*by, "_part"]).withColumn(name, F.coalesce(name, "_carried")).drop("_part", "_carried")


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """(by, names of wanted...): percentiles from 0 to 1 of columns by group, interpolated linearly; null without a value.

    Equal values are counted before they are dealt, and a wanted place is picked from the running counts.
    """
    values = list({id(c): c for c, _ in wanted.values()}.values())
    place = {name: next(i for i, v in enumerate(values) if v is c) for name, (c, _) in wanted.items()}
    each = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_measure"), v.cast("double").alias("_value")) for i, v in enumerate(values)])).alias("_m")).select(*by, "_m.*")
    counted = each.where("_value is not null").groupBy(*by, "_measure", "_value").agg(F.count("*").alias("_n"))
    run = running_sums(counted, [*by, "_measure"], ["_value"], ["_n"])
    picks, out = [], []
    for name, (_, q) in wanted.items():
        own, at = F.col("_measure") == place[name], F.lit(float(q)) * (F.col("total__n") - 1)
        holds = lambda rank: (F.col("upto__n") - F.col("_n") <= rank) & (rank < F.col("upto__n"))
        picks += [F.max(F.when(own & holds(end(at)), F.col("_value"))).alias(f"_{side}_{name}") for side, end in (("low", F.floor), ("high", F.ceil))]
        picks.append(F.max(F.when(own, at)).alias(f"_at_{name}"))
        low, high, place_at = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_at_{name}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place_at) - place_at) * low + (place_at - F.floor(place_at)) * high).alias(name))
    return run.groupBy(*by).agg(*picks).select(*by, *out)


def with_percentiles(groups: DataFrame, df: DataFrame, by: list[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """groups, one row each, with percentiles of df."""
    return _met(groups, percentiles(df, by, wanted), by)
