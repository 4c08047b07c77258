"""Recording times in file names, and the labels of times, days and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# The three forms of a time in a file name; groups in reading order.
STANDARD = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[ T_-]+(\d{2})[-_:]?(\d{2})(?:[-_:]?(\d{2}))?"
NATURAL = r"(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2})点(\d{1,2})分(?:(\d{1,2})秒)?"
MONTH_FIRST = r"(?:[A-Za-z][A-Za-z ]*)[_-](\d{2})-(\d{2})-(\d{4})[_-](\d{2})-(\d{2})-(\d{2})"


def base_name(path: Column) -> Column:
    """What follows the last separator; a path that ends with one stays whole."""
    name = F.regexp_extract(path, r"([^\\/]*)$", 1)
    return F.when(name == "", path).otherwise(name)


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _parts(name: Column) -> Column:
    """[year, month, day, hour, minute, second] as texts (empty: not given) of the form that fits; null if none does."""
    at = lambda pattern, order: F.array(*[F.regexp_extract(name, pattern, i) for i in order])
    return F.when(name.rlike(MONTH_FIRST), at(MONTH_FIRST, (3, 1, 2, 4, 5, 6))).when(name.rlike(STANDARD), at(STANDARD, range(1, 7))).when(name.rlike(NATURAL), at(NATURAL, range(1, 7)))


def _instant(p: Column) -> Column:
    """yyyy-MM-ddTHH:mm[:ss] of the parts, if they are a time at all."""
    pad = lambda i: F.lpad(F.get(p, F.lit(i)), 2, "0")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    day = F.concat_ws("-", F.get(p, F.lit(0)), pad(1), pad(2))
    clock = F.concat(pad(3), F.lit(":"), pad(4), F.when(F.get(p, F.lit(5)) == "", "").otherwise(F.concat(F.lit(":"), pad(5))))
    fits = lambda d: (n(0) >= 100) & F.try_to_date(d, "yyyy-MM-dd").isNotNull() & (n(3) <= 23) & (n(4) <= 59) & (F.coalesce(n(5), F.lit(0)) <= 59)
    return let(day, lambda d: F.when(fits(d), F.concat(d, F.lit("T"), clock)))


def recording_time(path: Column) -> Column:
    """yyyy-MM-ddTHH:mm[:ss] from a file's name; impossible dates and other names: null."""
    return let(base_name(path), lambda name: let(_parts(name), _instant))


def recording_day(recorded: Column, path: Column) -> Column:
    """The calendar day of a recording, from its own time or else its file's name; unknown: the empty text."""
    day = F.regexp_extract(F.coalesce(recorded, recording_time(path), F.lit("")), r"^(\d{4}-\d{2}-\d{2})", 1)
    return let(day, lambda d: F.when(F.try_to_date(F.nullif(d, F.lit("")), "yyyy-MM-dd").isNotNull(), d).otherwise(F.lit("")))


def _plain(day: Column, i: int) -> Column:
    return F.get(F.split(day, "-"), F.lit(i)).cast("int").cast("string")


def time_label(recorded: Column) -> Column:
    """year, month, day and clock of a recording's time for reading; unknown: a dash."""
    form = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}:\d{2}(?::\d{2})?)"
    part = lambda i: F.regexp_extract(recorded, form, i)
    label = F.concat(part(1), F.lit("年"), part(2).cast("int"), F.lit("月"), part(3).cast("int"), F.lit("日 "), part(4))
    return F.when(F.coalesce(recorded.rlike(form), F.lit(False)), label).otherwise("—")


def day_label(day: Column) -> Column:
    return F.when(day == "", "日期待确认").otherwise(F.concat(_plain(day, 0), F.lit("年"), _plain(day, 1), F.lit("月"), _plain(day, 2), F.lit("日")))


def date_filter_label(value: Column) -> Column:
    """Label of a filter by year, month or day; empty: all days."""
    month, day = _plain(value, 1), _plain(value, 2)
    label = F.concat(_plain(value, 0), F.lit("年"), F.coalesce(F.concat(month, F.lit("月")), F.lit("")), F.coalesce(F.concat(day, F.lit("日")), F.lit("")))
    return F.when(value == "", "全部日期").when(value == "unknown", "日期未识别").otherwise(label)


def file_prefix(path: Column, modified_us: Column) -> Column:
    """Head of an exported file's name: the recording's time, or where its name has none the file's own, at UTC+8."""
    form = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[ T_-]+(\d{2})[-_:]?(\d{2})[-_:]?(\d{2})"
    plain = lambda p, i: F.get(p, F.lit(i)).cast("int").cast("string")
    told = lambda p: F.concat(F.get(p, F.lit(0)), F.lit("年"), plain(p, 1), F.lit("月"), plain(p, 2), F.lit("日 "), plain(p, 3), F.lit("点"), F.get(p, F.lit(4)), F.lit("分"))
    named = let(base_name(path), lambda n: F.when(n.rlike(form), let(F.array(*[F.regexp_extract(n, form, i) for i in range(1, 7)]), lambda p: F.when(_instant(p).isNotNull(), told(p)))))
    local = F.timestamp_micros(modified_us + F.lit(8 * 3_600_000_000))
    other = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), local.cast("timestamp_ntz")), "y年M月d日 H点mm分")
    return F.coalesce(named, other)


def clip_file_name(path: Column, modified_us: Column, ordinal: Column, kills: Column, damage: Column, weapons: Column) -> Column:
    """Name of an exported clip: time, ordinal, kills, up to three weapons and damage; unknown numbers are dashes."""
    known = lambda n: F.coalesce(n.cast("string"), F.lit("—"))
    first = F.transform(F.slice(weapons, 1, 3), lambda w: F.when(w == "未知枪", "—枪").otherwise(w))
    listed = F.concat(F.concat_ws("+", first), F.when(F.size(weapons) > 3, "等").otherwise(""))
    safe = F.btrim(F.regexp_replace(listed, r'[<>:"/\\|?*\x00-\x1f]', "_"), F.lit(" ."))
    return F.concat(file_prefix(path, modified_us), F.lit(" 第"), ordinal, F.lit("段 "), known(kills), F.lit("杀 "), F.coalesce(F.nullif(safe, F.lit("")), F.lit("未知枪")), F.lit(" "), known(damage), F.lit("伤.mp4"))


def clock(seconds: Column) -> Column:
    """Minutes and seconds of a duration for reading; negative ones count as 0, unknown: null."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    return F.when(seconds.isNotNull(), F.concat(F.floor(s / 60).cast("string"), F.lit("分"), _two(s % 60), F.lit("秒")))


def long_clock(seconds: Column) -> Column:
    """clock with hours from one hour on; unknown and endless durations: a dash."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    hours = F.concat(F.floor(s / 3600).cast("string"), F.lit("小时"), (F.floor(s / 60) % 60).cast("string"), F.lit("分"), _two(s % 60), F.lit("秒"))
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (F.abs(seconds) == float("inf")), "—").when(s < 3600, clock(seconds)).otherwise(hours)


def byte_range(header: Column, size: Column) -> Column:
    """struct(first, last, partial) of what a request asks of a file of ``size`` bytes; null where it cannot be served."""
    form = r"^bytes=(\d*)-(\d*)$"
    a, b = (F.regexp_extract(header, form, i).try_cast("long") for i in (1, 2))
    whole = F.coalesce(header, F.lit("")) == ""
    first = F.when(whole, 0).when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    last = F.when(whole | a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    fits = whole | (header.rlike(form) & F.when(a.isNull(), b > 0).otherwise((a < size) & (b.isNull() | (b >= a))))
    return F.when((size > 0) & fits, F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"), (~whole).alias("partial")))
