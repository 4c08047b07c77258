"""Counts of a segment from the two ends of its counters, the results seen on screen and a final table, with what is only a lower
bound marked as such.

endpoints: one row for each (segment, field of kills, assists, damage) with baseline, last (null: unread), unconfirmed (a different last
reading that nothing confirms), terminal_unread, baseline_lower, visible_complete, updated_us (of the last change); segments:
(segment, excluded_terminal, settlement: null, 'pending' or 'settled', covered: every frame was looked at); events: (segment, kind,
action, target, t_us, confirmed, own)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tracks import alike, target_key

FIELDS = ("kills", "assists", "damage")


def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(target_key(x), target_key(y)) for x, y in zip(a, b)])


def confirmed_assists(events: DataFrame) -> DataFrame:
    """Own confirmed assists whose player was eliminated: by the natively confirmed action where there is one, else by the line's."""
    native = F.col("native_action") if "native_action" in events.columns else F.lit(None).cast("string")
    return events.where(F.col("confirmed") & F.col("own") & (F.col("kind") == "assist") & (F.coalesce(native, F.col("action")) == "elimination"))


def complete_delta(baseline: Column, last: Column, baseline_frames: Column, end_frames: Column, latest_frame: Column) -> Column:
    """Whether both ends of a counter are proved: two distinct verified frames show the baseline, two the last value, the last frame
    among them, and no frame of the end is of another view. Frames are arrays of struct(t, value, verified, excluded)."""
    shown = lambda frames, value: F.size(F.array_distinct(F.transform(F.filter(frames, lambda f: f["verified"] & ~f["excluded"] & (f["value"] == value)), lambda f: f["t"])))
    fine = (baseline >= 0) & (last >= baseline) & (shown(baseline_frames, baseline) >= 2) & (shown(end_frames, last) >= 2)
    return F.coalesce(fine & ~F.exists(end_frames, lambda f: f["excluded"]) & latest_frame["verified"] & (latest_frame["value"] == last), F.lit(False))


def terminal_unread(frames: Column, known: Column) -> Column:
    """Whether the latest frame shows no value although an earlier one is known."""
    latest = F.element_at(F.array_sort(frames, lambda a, b: F.when(a["t"] < b["t"], -1).when(a["t"] > b["t"], 1).otherwise(0)), -1)
    return F.coalesce(known.isNotNull() & (F.size(frames) > 0) & latest["value"].isNull(), F.lit(False))


def reconciled(endpoints: DataFrame, segments: DataFrame, events: DataFrame) -> DataFrame:
    """(segment, field, count, partial) of kills, assists, damage and knockdowns.

    Both ends known: their difference, which is only a lower bound if the end is unsure or the baseline late. Else the confirmed
    results count, as a lower bound; they also lift a lower bound that they exceed, and never add to it. A pending final table turns
    kills after the last change and assists without an own kill of the same target into lower bounds."""
    sure = events.where(F.col("confirmed") & F.col("own"))
    assists = confirmed_assists(events)
    kills = sure.where("kind = 'elimination'")
    seen = sure.groupBy("segment").agg(F.count_if(F.col("kind") == "elimination").alias("n_kill"), F.count_if(F.col("kind") == "knock").alias("n_knock"))
    helped = assists.groupBy("segment").agg(F.count("*").alias("n_assist"))
    open_knocks = events.where((F.col("kind") == "knock") & F.col("own") & ~F.col("confirmed")).select("segment").distinct().withColumn("open_knock", F.lit(True))
    # assists whose target the player did not eliminate: the two sides meet by segment, a segment has a screen's worth of results
    named = assists.select("segment", "t_us", F.col("target").alias("a")).join(kills.select("segment", F.col("target").alias("b")), "segment")
    own = named.where(F.pandas_udf(_alike, "boolean")("a", "b")).select("segment", "t_us", "a").distinct()
    others = assists.join(own, (assists["segment"] == own["segment"]) & (assists["t_us"] == own["t_us"]) & assists["target"].eqNullSafe(own["a"]), "left_anti").groupBy("segment").agg(F.count("*").alias("n_other"))
    since = endpoints.where("field = 'kills'").select("segment", "updated_us")
    late = kills.join(since, "segment").where(F.col("t_us") > F.col("updated_us") + 1_000_000).groupBy("segment").agg(F.count("*").alias("n_late"))
    s = segments
    for part in (seen, helped, open_knocks, others, late):
        s = s.join(part, "segment", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    e = endpoints.join(s, "segment")
    settled, pending = F.col("settlement").eqNullSafe("settled"), F.col("settlement").eqNullSafe("pending")
    contrary = ~settled & F.coalesce(F.col("unconfirmed") < F.col("last"), F.lit(False))
    end = F.when(~contrary, F.col("last"))
    delta = F.when(end >= F.col("baseline"), end - F.col("baseline"))
    shown = F.when(F.col("field") == "kills", zero("n_kill")).when(F.col("field") == "assists", zero("n_assist")).otherwise(F.lit(0))
    unsure = ~settled & (F.col("unconfirmed").isNotNull() | F.col("terminal_unread") | F.col("excluded_terminal"))
    proved = F.col("visible_complete") & ~settled
    partial = F.when(delta.isNull(), True).otherwise(F.when(proved, False).otherwise(pending | (settled & (F.col("field") == "damage")) | unsure) | F.col("baseline_lower"))
    count = F.coalesce(delta, F.nullif(shown, F.lit(0)))
    e = e.withColumn("_d", delta).withColumn("partial", partial).withColumn("count", count).withColumn("_shown", shown)
    lift = F.col("partial") & F.col("settlement").isNull() & (F.col("_shown") > F.coalesce("count", F.lit(0)))
    e = e.withColumn("count", F.when(lift, F.col("_shown")).otherwise(F.col("count")))
    redo = pending & ~F.col("visible_complete")
    kill = F.when(F.col("_d").isNotNull(), F.col("_d") + zero("n_late")).otherwise(F.nullif(zero("n_kill"), F.lit(0)))
    e = e.withColumn("count", F.when(redo & (F.col("field") == "kills"), kill).when(redo & (F.col("field") == "assists"), F.nullif(zero("n_other"), F.lit(0))).otherwise(F.col("count")))
    e = e.withColumn("partial", F.col("partial") | (redo & F.col("field").isin("kills", "assists")))
    whole = F.col("covered") & F.col("open_knock").isNull()
    knocks = s.select("segment", F.lit("knockdowns").alias("field"), F.when(whole, zero("n_knock")).otherwise(F.nullif(zero("n_knock"), F.lit(0))).cast("long").alias("count"), (~whole).alias("partial"))
    return e.select("segment", "field", F.col("count").cast("long").alias("count"), "partial").unionByName(knocks)


def final_table(rows: DataFrame, keys: list[str], time: str, values: list[str], spaced: int = 500_000, frames: int = 3) -> DataFrame:
    """(keys, values) that at least two of the last ``frames`` readings, ``spaced`` apart or more, show alike; values is a table's row."""
    from .scan import scan

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def step(state, row):
        t, kept = -row["_back"], state or []
        if len(kept) < frames and (not kept or kept[-1] - t >= spaced):
            return [*kept, t], [tuple(row[c] for c in (*keys, *values))]
        return kept, []

    back = rows.select(*keys, *values, (-F.col(time)).alias("_back"))
    out = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *values))
    some = scan(back, keys, ["_back"], step, out).where(" and ".join(f"{v} is not null" for v in values))
    n = some.groupBy(*keys, *values).agg(F.count("*").alias("n")).where("n >= 2")
    return n.select(*keys, *values)


def table_values(cells: DataFrame, frame: str, labels: dict[str, str]) -> DataFrame:
    """(frame, label, value): the number to the right of each label in its line. cells (frame, text, left, right, top, bottom);
    labels: name by pattern. The nearest number counts whose middle lies within half the label's height of the label's."""
    middle = (F.col("top") + F.col("bottom")) / 2
    named = F.lit(None).cast("string")
    for name, pattern in labels.items():
        named = F.when(F.col("text").rlike(pattern), name).otherwise(named)
    c = cells.withColumn("label", named).withColumn("mid", middle)
    heads = c.where("label is not null").select(frame, "label", F.col("right").alias("edge"), F.col("mid").alias("at"), (F.col("bottom") - F.col("top")).alias("h"))
    numbers = c.where(F.col("text").rlike(r"^\d+$")).select(frame, F.col("text").cast("long").alias("value"), "left", "mid")
    near = heads.join(numbers, frame).where((F.col("left") >= F.col("edge")) & (F.abs(F.col("mid") - F.col("at")) <= F.col("h") / 2))
    return near.groupBy(frame, "label").agg(F.min_by("value", "left").alias("value"))


def gaps(packets: DataFrame, stream: str, time: str, order: str) -> DataFrame:
    """(stream, packets, least, most, median, ordered): gaps between a stream's packets in file order, and whether time never falls."""
    w = Window.partitionBy(stream).orderBy(order)
    d = packets.withColumn("_d", F.col(time) - F.lag(time).over(w))
    return d.groupBy(stream).agg(F.count("*").alias("packets"), F.min("_d").alias("least"), F.max("_d").alias("most"), F.median("_d").alias("median"), F.coalesce(F.min("_d") > 0, F.lit(True)).alias("ordered"))


def found_at(source: DataFrame, target: DataFrame, stream: str, order: str, digest: str) -> DataFrame:
    """(stream, offset) where the target's packets stand in the source's as one stretch, the first if there are several; none: no row.

    Orders are numbers from 0 without gaps. The target's digest that is rarest in the source proposes the places, so repeated silent
    packets propose none; a place counts if all packets agree there."""
    n = target.groupBy(stream).agg(F.count("*").alias("n"))
    t = target.select(stream, F.col(order).alias("j"), F.col(digest).alias("h"))
    s = source.select(stream, F.col(order).alias("i"), F.col(digest).alias("h"))
    often = s.groupBy(stream, "h").agg(F.count("*").alias("c"))
    rare = t.join(often, [stream, "h"]).groupBy(stream).agg(F.min(F.struct("c", "h", "j")).alias("r")).select(stream, F.col("r.h").alias("h"), F.col("r.j").alias("j"))
    places = rare.join(s, [stream, "h"]).select(stream, (F.col("i") - F.col("j")).alias("offset")).where("offset >= 0").join(n, stream)
    every = places.join(t, stream).select(stream, "offset", "n", (F.col("offset") + F.col("j")).alias("i"), "h")
    same = every.join(s, [stream, "i", "h"]).groupBy(stream, "offset", "n").agg(F.count("*").alias("m")).where("m = n")
    return same.groupBy(stream).agg(F.min("offset").alias("offset"))


def processing_seconds(own: Column, record: Column, stages: Column) -> Column:
    """Seconds a recording took: its own, else its record's, else the sum of its stages'; only finite numbers of 0 or more count."""
    fine = lambda x: F.when((x >= 0) & ~F.isnan(x) & (x < float("inf")), x)
    some = F.filter(F.transform(F.map_values(stages), fine), lambda x: x.isNotNull())
    total = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x))
    first = F.coalesce(own, record)
    return F.when(first.isNotNull() & fine(first).isNotNull(), first).otherwise(total)


def display_size(width: Column, height: Column, aspect: Column, rotation: Column) -> Column:
    """struct(width, height) of a video as shown: pixel aspect 'a:b' applied, then turned; unknown sizes: null."""
    a, b = (F.regexp_extract(aspect, r"^(\d+):(\d+)$", i).try_cast("double") for i in (1, 2))
    wide = F.when((a > 0) & (b > 0), F.bround(width * a / b)).otherwise(width).cast("long")
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(180)) == 90
    return F.when((width > 0) & (height > 0), F.struct(F.when(turned, height).otherwise(wide).cast("long").alias("width"), F.when(turned, wide).otherwise(height).cast("long").alias("height")))


def clip_events(events: DataFrame, clip: str, lead: int = 2_000_000, unsure: int = 3_000_000) -> DataFrame:
    """events (clip, kind, at: microseconds into the clip, duration_us, begun, basis) with seek_us: where to start playing. The fight's
    start less a lead-in; never at or before an earlier result of the kind."""
    e = events.where(F.col("kind").isin("knock", "assist", "elimination") & F.col("at").between(0, F.col("duration_us")))
    real = F.col("begun").isNotNull() & (F.coalesce("basis", F.lit("")) != "near_result")
    begin = F.coalesce("begun", F.col("at") - unsure) - F.when(real, lead).otherwise(0)
    e = e.withColumn("_s", F.greatest(F.lit(0), F.least("at", begin)))
    prior = F.max("at").over(Window.partitionBy(clip, "kind").orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_p", prior)
    late = F.col("_p").isNotNull() & (F.col("_s") <= F.col("_p"))
    again = F.when(F.col("begun") > F.col("_p"), F.least("at", F.col("_p") + 1000)).otherwise(F.least(F.col("at"), F.greatest(F.col("_p") + 1000, F.col("at") - unsure)))
    shown = F.when(late & ~F.coalesce(F.col("begun") > F.col("_p"), F.lit(False)), "near_result").otherwise(F.coalesce("basis", F.when(F.col("begun").isNull(), F.lit("near_result"))))
    return e.withColumn("seek_us", F.when(late, again).otherwise(F.col("_s"))).withColumn("basis", shown).drop("_s", "_p")


def marker_groups(events: DataFrame, clip: str, width: int, least: int = 36) -> DataFrame:
    """(clip, first_at, n, place): markers on a bar of ``width`` pixels, those under ``least`` pixels after the one before in one."""
    w = Window.partitionBy(clip).orderBy("at")
    share = F.col("at") / F.nullif(F.col("duration_us"), F.lit(0))
    e = events.withColumn("_f", F.coalesce(share, F.lit(0.0)))
    cut = e.withColumn("_c", F.when((F.col("_f") - F.lag("_f").over(w)) * width < least, 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(clip, "_g").agg(F.min("at").alias("first_at"), F.count("*").alias("n"), F.avg("_f").alias("place")).drop("_g")
