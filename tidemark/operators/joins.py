"""Joins on time. Each is an equi-join on (key, time bucket) or one window over a union, never a cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_previous(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value and time of the last right row at or before it (null: none); one sort, no join.

    Times of right are taken as unique within a key; of ties the largest value wins."""
    both = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_s")).unionByName(
        right.select(key, time, F.col(value).alias("_v"), F.lit(0).alias("_s")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(time, "_s", "_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_s") == 0, F.struct(F.col(time).alias("t"), F.col("_v").alias("v"))), True).over(w)
    return both.withColumn("_l", last).where("_s = 1").select(*left.columns, F.col("_l.t").alias("prev_us"), F.col("_l.v").alias("prev_value"))


def _marks(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """left with the times of the last right row at or before (_back) and of the first at or after (_ahead) each row.

    Both frames run from the first row to the current one, in either direction, so each is one pass of a sorted key."""
    both = left.select(*left.columns, F.lit(1).alias("_s")).unionByName(right.select(key, time, F.lit(0).alias("_s")), allowMissingColumns=True)
    mark, w = F.when(F.col("_s") == 0, F.col(time)), Window.partitionBy(key)
    back = F.max(mark).over(w.orderBy(F.asc(time), "_s").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(mark).over(w.orderBy(F.desc(time), "_s").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_back", back).withColumn("_ahead", ahead).where("_s = 1").drop("_s")


def band_semi(left: DataFrame, right: DataFrame, key: str, time: str, delta_us: int) -> DataFrame:
    """Rows of left with a right row of the same key at most delta_us away: the nearest neighbours on both sides decide."""
    near = _marks(left, right, key, time)
    return near.where((F.col(time) - F.col("_back") <= delta_us) | (F.col("_ahead") - F.col(time) <= delta_us)).select(*left.columns)


def asof_next(left: DataFrame, right: DataFrame, key: str, time: str, tolerance_us: int) -> DataFrame:
    """left with next_us, the first right time at or after the row's own if it is less than tolerance_us away (else null)."""
    near = _marks(left, right, key, time)
    return near.select(*left.columns, F.when(F.col("_ahead") - F.col(time) < tolerance_us, F.col("_ahead")).alias("next_us"))


def nearest(left: DataFrame, right: DataFrame, key: str, time: str) -> DataFrame:
    """left with near_us, the right time of the same key closest to the row's (the earlier of two as close; null: none)."""
    near = _marks(left, right, key, time)
    later = F.col("_back").isNull() | (F.col("_ahead") - F.col(time) < F.col(time) - F.col("_back"))
    return near.select(*left.columns, F.coalesce(F.when(later, F.col("_ahead")), F.col("_back")).alias("near_us"))


def overlap(left: DataFrame, right: DataFrame, key: str, bucket_us: int) -> DataFrame:
    """Pairs of intervals of one key with more than a point in common, as (key, l_start, l_end, r_start, r_end).

    Each interval is dealt to the time buckets it touches, and a pair is made only in the bucket where its later start
    lies, so none comes twice; bucket_us should be near the usual length. Empty or unbounded intervals match nothing."""

    def dealt(df: DataFrame, side: str) -> DataFrame:
        first, last = F.floor(F.col("start_us") / bucket_us), F.floor((F.col("end_us") - 1) / bucket_us)
        ok = df.where("start_us < end_us")
        return ok.select(key, F.col("start_us").alias(f"{side}_start"), F.col("end_us").alias(f"{side}_end"), F.explode(F.sequence(first, last)).alias("_b"))

    pairs = dealt(left, "l").join(dealt(right, "r"), [key, "_b"]).where("l_start < r_end and r_start < l_end")
    return pairs.where(F.floor(F.greatest("l_start", "r_start") / bucket_us) == F.col("_b")).drop("_b")


def merge_existing(existing: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge of two tables of the same columns: where both know a key, known values of existing win."""
    rest = [c for c in existing.columns if c not in keys]
    old, new = (df.select(*keys, *[F.col(c).alias(f"{side}{c}") for c in rest]) for df, side in ((existing, "_e_"), (added, "_a_")))
    return old.join(new, keys, "full").select(*keys, *[F.coalesce(f"_e_{c}", f"_a_{c}").alias(c) for c in rest])


def within_one_edit(names: DataFrame, dimension: DataFrame, name: str, known: str) -> DataFrame:
    """(name, known, distance) for distinct names and dimension entries at most one edit apart.

    Two strings that close share themselves or a string with one letter dropped: an equi-join on those, then the exact distance."""

    def keyed(df: DataFrame, col: str) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(1), F.length(col)), lambda i: F.concat(F.substring(col, F.lit(1), i - 1), F.substring(col, i + 1, F.length(col))))
        every = F.when(F.length(col) > 0, F.array_union(F.array(col), cut)).otherwise(F.array(col))
        return df.where(F.col(col).isNotNull()).select(col).distinct().select(col, F.explode(every).alias("_k"))

    d = F.levenshtein(F.col(name), F.col(known), 1)
    return keyed(names, name).join(keyed(dimension, known), "_k").select(name, known, d.alias("distance")).where("distance >= 0").distinct()


def in_interval(events: DataFrame, intervals: DataFrame, key: str, time: str) -> DataFrame:
    """events with the bounds of the (disjoint) interval [start_us, end_us] of the same key they fall in; others drop."""
    starts = intervals.select(key, F.col("start_us").alias(time), F.struct("start_us", "end_us").alias("_i"), F.lit(0).alias("_s"))
    both = events.withColumn("_s", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "_s").rowsBetween(Window.unboundedPreceding, 0)
    now = both.withColumn("_i", F.last("_i", True).over(w)).where("_s = 1")
    return now.where(F.col(time) <= F.col("_i.end_us")).select(*events.columns, "_i.start_us", "_i.end_us")


def mutual_unique(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs whose keys name exactly one row on either side; null keys match nothing."""
    one_l = left.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(left_id).alias(left_id)).where("_n = 1").drop("_n")
    one_r = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(right_id).alias(right_id)).where("_n = 1").drop("_n")
    return one_l.join(one_r, keys)
