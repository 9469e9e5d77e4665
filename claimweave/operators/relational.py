"""Joins, windows and top-k written so that one hot key cannot fill one task.

Facts are reduced to their join or window grain by a (map-side combined)
aggregation before they meet another table; ranks over large groups are split
into value ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Keys = Sequence[str]


def _keys(key: str | Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def master_detail(master: DataFrame, detail: DataFrame, key: str, aggs: Sequence[Column],
                  zero: Keys = ()) -> DataFrame:
    """Every master row with its aggregated details; ``zero`` columns are 0 without any."""
    totals = detail.groupBy(key).agg(*aggs)
    joined = master.join(totals, key, "left")
    return joined.na.fill(0, list(zero)) if zero else joined


def with_event(members: DataFrame, events: DataFrame, key: str, rule: Column) -> DataFrame:
    """Members having at least one event for which ``rule`` holds."""
    keys = events.filter(rule).select(key).distinct()
    return members.join(keys, key, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child keys without a parent, with the number of child rows of each."""
    parents = parent.select(F.col(parent_key or key).alias(key)).distinct()
    children = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("child_rows"))
    return children.join(parents, key, "left_anti")


def join_as(left: DataFrame, right: DataFrame, key: str, type: str | T.DataType,
            how: str = "inner") -> DataFrame:
    """Join on a key cast to one type on both sides."""
    return left.withColumn(key, F.col(key).cast(type)).join(
        right.withColumn(key, F.col(key).cast(type)), key, how
    )


def running_total(df: DataFrame, part: str | Keys, order: str | Keys, value: Column, name: str,
                  total: str) -> DataFrame:
    """An aggregate per partition and order key, with its running total.

    The window runs over aggregated rows, one per order key.
    """
    part, order = _keys(part), _keys(order)
    grain = df.groupBy(*order, *part).agg(value.alias(name))
    window = (
        Window.partitionBy(*part).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return grain.withColumn(total, F.sum(name).over(window))


def latest_per(df: DataFrame, key: str | Keys, order: Sequence[Column]) -> DataFrame:
    """The first row per key in ``order``, which should be a total order.

    Spark keeps only each task's best row per key before the shuffle, so a hot
    key costs one row per task.
    """
    window = Window.partitionBy(*_keys(key)).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(window))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def keep_top(df: DataFrame, part: str | Keys, order: Sequence[Column], unless: Column) -> DataFrame:
    """Rows that satisfy ``unless``, and the first row of each group.

    A plain ``unless or row_number() = 1`` would sort whole groups in one task.
    The same rows are those satisfying ``unless`` plus the group leaders that do not.
    """
    exempt = F.coalesce(unless, F.lit(False))
    leaders = latest_per(df, part, order).filter(~exempt)
    return df.filter(exempt).unionByName(leaders)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows in ``order``; end it with a key so that ties are settled."""
    return df.orderBy(*order).limit(k)


def rank_within(df: DataFrame, part: str, value: str, name: str = "rank", ranges: int = 64, large: int = 10_000, salts: int = 16) -> DataFrame:
    """``rank()`` by descending ``value`` within ``part``, for groups of any size.

    Rows are first counted by value. The values of a group of more than about ``large``
    are cut into ``ranges``; a value's rank is one more than the rows in higher ranges plus
    the rows with higher values in its own range, so no task ranks a whole large group. The
    cuts are the group's values with the smallest hashes: an even sample, bounded in
    size, that is the same whenever it is computed again. How small those hashes are
    also tells how many values there are. Smaller groups are one range.

    Only the cuts of large groups are repeated, ``salts`` times, for their join with the
    group's values; a frequent value's rows are split by adaptive execution where they join
    their one rank. Neither parameter changes a result.
    """
    values = df.groupBy(part, value).agg(F.count(F.lit(1)).alias("_n"))
    spread = F.shiftrightunsigned(F.xxhash64(value), 1)  # 0 to 2**63
    # Ordering by the count last changes nothing; it keeps the column, so that
    # both uses of ``values`` share one shuffle.
    by_hash = Window.partitionBy(part).orderBy("_h", value, "_n")
    sample = values.withColumn("_h", spread).withColumn("_rn", F.row_number().over(by_hash)).filter(F.col("_rn") < ranges)
    cuts = sample.groupBy(F.col(part).alias("_p")).agg(F.collect_list(value).alias("_cuts"), F.max("_h").alias("_top"), F.count(F.lit(1)).alias("_m"))
    # The m-th smallest of n even draws lies at about m / n of their span.
    cuts = cuts.filter((F.col("_m") == ranges - 1) & (F.col("_top") < F.col("_m") * F.lit(2.0**63 / large)))
    cuts = cuts.select("_p", "_cuts", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_c"))
    salt = F.pmod(F.xxhash64(value), F.lit(salts)).cast("int")
    ranged = values.join(cuts, F.col(part).eqNullSafe(F.col("_p")) & (salt == F.col("_c")), "left").select(
        part, value, "_n",
        # NULL values rank last.
        F.when(F.col(value).isNull(), F.lit(ranges)).otherwise(
            F.coalesce(F.size(F.filter("_cuts", lambda c: c > F.col(value))), F.lit(0))
        ).alias("_range"),
    )
    before = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(F.col(part).alias("_p"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_rows"))
        .select("_p", "_r", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    above = (
        Window.partitionBy(part, "_range").orderBy(F.col(value).desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = (
        ranged.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
        .join(offsets, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_range") == F.col("_r")))
        .select(
            F.col(part).alias("_p"), F.col(value).alias("_v"),
            (F.col("_before") + F.col("_above") + 1).cast("long").alias(name),
        )
    )
    return df.join(ranks, F.col(part).eqNullSafe(F.col("_p")) & F.col(value).eqNullSafe(F.col("_v"))).drop("_p", "_v")
