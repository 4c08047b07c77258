"""Rules that carry state. Keys are cut where the state starts anew, so a scan runs over short pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import scan


def runs(rows: DataFrame, key: list[str], time: str, gap: int, name: str = "_run") -> DataFrame:
    """rows with a number that grows wherever a key's next row comes more than ``gap`` later."""
    w = Window.partitionBy(*key).orderBy(time)
    cut = rows.withColumn("_cut", F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1))
    return cut.withColumn(name, F.sum("_cut").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_cut")


def thin(rows: DataFrame, key: str, time: str, apart_us: int) -> DataFrame:
    """(key, time) of the rows kept when each must come at least apart_us after the last one kept.

    A row that far behind its predecessor is always kept, so each run between such gaps is scanned by itself."""
    d = rows.select(key, time).where(f"{key} is not null and {time} is not null").distinct()

    def step(last, row):
        t = row[time]
        return (t, [(row[key], t)]) if last is None or t - last >= apart_us else (last, [])

    return scan(runs(d, [key], time, apart_us - 1), [key, "_run"], [time], step, f"{key} {d.schema[key].dataType.simpleString()}, {time} long")


def probe_times(rows: DataFrame, key: str, time: str, near_us: int = 5_000_000, far_us: int = 10_000_000, close_us: int = 60_000_000, first: int = 3, most: int = 40) -> DataFrame:
    """(key, time) of the rows to look at: the first three, then one each near_us, after a minute one each far_us, ``most`` in all
    (the count is part of the rule: it bounds what is read, and later rows are no probes)."""
    d = rows.select(key, time).where(f"{key} is not null and {time} is not null").distinct()

    def step(state, row):
        t = row[time]
        begin, last, n = state or (t, None, 0)
        apart = near_us if abs(t - begin) <= close_us else far_us
        if n >= most or (n >= first and abs(t - last) < apart):
            return (begin, last, n), []
        return (begin, t, n + 1), [(row[key], t)]

    return scan(d, [key], [time], step, f"{key} {d.schema[key].dataType.simpleString()}, {time} long")


def increments(rows: DataFrame, key: str, order: list[str], counter: str, reset: str) -> DataFrame:
    """rows with step, by how much the counter's highest value since the last reset row grew; lower readings are misreads (0)."""
    w = Window.partitionBy(key).orderBy(*order)
    part = rows.withColumn("_r", F.sum(F.when(F.col(reset), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_r").orderBy(*order)
    top = F.max(counter).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return part.withColumn("step", F.coalesce(F.greatest(F.col(counter) - top, F.lit(0)), F.lit(0))).drop("_r")


def agreeing(key: list[str], time: str, value: Column, agree, within_us: int) -> Column:
    """How many of the five rows around a row (itself included) agree with it and lie within_us; a window over all rows."""
    w = Window.partitionBy(*key).orderBy(time).rowsBetween(-2, 2)
    near = F.collect_list(F.struct(F.col(time).alias("t"), value.alias("v"))).over(w)
    return F.size(F.filter(near, lambda x: agree(x["v"]) & (F.abs(x["t"] - F.col(time)) <= within_us))).cast("long")


def stable(rows: DataFrame, key: str, order: list[str], time: str, value: str, within_us: int, least: int = 2, inactive: str | None = None) -> DataFrame:
    """rows of the own view whose value at least ``least`` of the five rows around (itself included, any view) show within within_us."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-2, 2)
    near = F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).over(w)
    agree = F.size(F.filter("_w", lambda x: (x["v"] == F.col(value)) & (F.abs(x["t"] - F.col(time)) <= within_us)))
    own = F.col(value).isNotNull() if inactive is None else F.col(value).isNotNull() & ~F.coalesce(F.col(inactive), F.lit(False))
    return rows.withColumn("_w", near).withColumn("agreeing", agree.cast("long")).where(own & (F.col("agreeing") >= least)).drop("_w")
