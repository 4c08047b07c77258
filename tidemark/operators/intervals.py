"""Sessions and interval algebra on microsecond times. All windows are partitioned by the stream's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(intervals: DataFrame, key: str, start: str = "start_us", end: str = "end_us", aggs: list | None = None) -> DataFrame:
    """Union of each key's intervals, with their number n; touching ones become one. Rows without a bound, or that end before they
    start, are dropped. aggs: further aggregates over the intervals that became one."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    ok = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    new = ok.withColumn("_new", F.when(F.col(start) <= F.max(end).over(before), 0).otherwise(1))
    part = new.withColumn("_part", F.sum("_new").over(upto))
    return part.groupBy(key, "_part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *(aggs or [])).drop("_part")


def sessions(events: DataFrame, key: str, time: str, gap_us: int, pre_us: int = 0, post_us: int = 0) -> DataFrame:
    """Runs of events no further apart than gap_us, padded on both sides and merged where the padding overlaps."""
    w = Window.partitionBy(key).orderBy(time)
    cut = events.withColumn("_cut", F.when(F.col(time) - F.lag(time).over(w) <= gap_us, 0).otherwise(1))
    part = cut.withColumn("_run", F.sum("_cut").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    runs = part.groupBy(key, "_run").agg(F.greatest(F.min(time) - pre_us, F.lit(0)).alias("start_us"), (F.max(time) + post_us).alias("end_us"))
    return merge(runs, key).drop("n")


def gaps(intervals: DataFrame, key: str) -> DataFrame:
    """What lies between a key's merged intervals: the difference of their hull and their union."""
    w = Window.partitionBy(key).orderBy("start_us")
    out = merge(intervals, key).select(key, F.col("end_us").alias("start_us"), F.lead("start_us").over(w).alias("end_us"))
    return out.where(F.col("end_us").isNotNull())


def ranges(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive whole numbers of each key as (key, first, last)."""
    d = rows.select(key, F.col(number).cast("long").alias("_n")).where("_n is not null").distinct()
    g = d.withColumn("_g", F.col("_n") - F.row_number().over(Window.partitionBy(key).orderBy("_n")))
    return g.groupBy(key, "_g").agg(F.min("_n").alias("first"), F.max("_n").alias("last")).drop("_g")


def subtract(kept: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """The parts of kept's intervals that no excluded interval covers: a sweep over the edges of both."""

    def edges(df: DataFrame, a: int, b: int) -> DataFrame:
        m = merge(df, key)
        point = lambda c, sign: F.struct(F.col(c).alias("t"), F.lit(a * sign).alias("a"), F.lit(b * sign).alias("b"))
        return m.select(key, F.inline(F.array(point("start_us", 1), point("end_us", -1))))

    w = Window.partitionBy(key).orderBy("t")
    each = edges(kept, 1, 0).unionByName(edges(excluded, 0, 1)).groupBy(key, "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cover = each.select(key, F.col("t").alias("start_us"), F.lead("t").over(w).alias("end_us"), F.sum("a").over(upto).alias("_a"), F.sum("b").over(upto).alias("_b"))
    return merge(cover.where("_a > 0 and _b = 0"), key).drop("n")


def snap(intervals: DataFrame, marks: DataFrame, key: str, time: str) -> DataFrame:
    """Intervals widened to the mark at or before their start and at or after their end (without one, as they are), then merged."""
    from .joins import _marks

    rows = intervals.select(key, "start_us", "end_us")
    low = _marks(rows.withColumn(time, F.col("start_us")), marks, key, time).select(key, F.coalesce("_back", "start_us").alias("start_us"), "end_us")
    high = _marks(low.withColumn(time, F.col("end_us")), marks, key, time).select(key, "start_us", F.coalesce("_ahead", "end_us").alias("end_us"))
    return merge(high, key).drop("n")
