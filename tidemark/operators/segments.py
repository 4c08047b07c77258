"""Segments of a recording from its events, and what bounds, joins, classifies and sums them up.

Times are microseconds from the recording's first frame; ``durations`` (key, duration_us) bounds every segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .events import NEAR, _flag
from .folds import agreeing, runs
from .intervals import merge
from .joins import _marks

SECOND = 1_000_000
# The silence that ends a group and the padding before and after it.
GAP, PRE, POST = 35 * SECOND, 10 * SECOND, 15 * SECOND
TAIL = 2 * SECOND


def _reasons() -> Column:
    """The distinct reasons of the intervals that became one; their kinds are few."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("protected_reasons")))).alias("protected_reasons")


def _merged(pieces: DataFrame, key: str) -> DataFrame:
    return merge(pieces, key, aggs=[F.min("first_signal").alias("first_signal"), F.max("last_signal").alias("last_signal"), _reasons()])


def from_events(events: DataFrame, durations: DataFrame, key: str, gap: int = GAP, pre: int = PRE, post: int = POST, protected: DataFrame | None = None) -> DataFrame:
    """(key, start_us, end_us, first_signal, last_signal, protected_reasons): groups of events no further apart than gap, padded,
    clipped to the recording, merged with one another and with the protected intervals (key, start_us, end_us, last_downed, reason)."""
    times = events.select(key, "t_us").join(durations, key).where((F.col("t_us") >= 0) & (F.col("t_us") < F.col("duration_us"))).distinct()
    groups = runs(times, [key], "t_us", gap).groupBy(key, "_run", "duration_us").agg(F.min("t_us").alias("first_signal"), F.max("t_us").alias("last_signal"))
    none = F.array().cast("array<string>").alias("protected_reasons")
    pieces = groups.select(key, F.greatest(F.col("first_signal") - pre, F.lit(0)).alias("start_us"), F.least("duration_us", F.col("last_signal") + post).alias("end_us"), "first_signal", "last_signal", none)
    if protected is not None:
        own = protected.select(key, F.greatest(F.col("start_us") - pre, F.lit(0)).alias("start_us"), "end_us", F.col("start_us").alias("first_signal"), F.coalesce("last_downed", "start_us").alias("last_signal"), F.array("reason").alias("protected_reasons"))
        pieces = pieces.unionByName(own)
    return _merged(pieces, key).drop("n")


def downed(rows: DataFrame, durations: DataFrame, key: str, gap: int = GAP, post: int = POST, tail: int = TAIL) -> DataFrame:
    """(key, start_us, end_us, last_downed, terminal_us, reason): spells of being down, confirmed by neighbours, up to a lasting
    change of view within ``post`` after them or else ``post`` long."""
    own = _flag("downed") & ~_flag("inactive")
    voted = rows.withColumn("_own", own).withColumn("_n", agreeing([key], "t_us", F.col("_own"), lambda v: v, NEAR))
    times = voted.where("_own and _n >= 2").select(key, "t_us")
    groups = runs(times, [key], "t_us", gap).groupBy(key, "_run").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("last_downed")).drop("_run")
    w = Window.partitionBy(key).orderBy("t_us")
    after = rows.withColumn("_next", F.lead(F.struct("t_us", _flag("inactive").alias("i"))).over(w))
    lasting = after.where(_flag("inactive") & F.col("_next.i") & (F.col("_next.t_us") - F.col("t_us") <= NEAR)).select(key, "t_us")
    near = _marks(groups.withColumn("t_us", F.col("last_downed") + 1), lasting, key, "t_us")
    end = F.when(F.col("_ahead") <= F.col("last_downed") + post, F.col("_ahead"))
    out = near.withColumn("terminal_us", end).join(durations, key)
    return out.select(key, "start_us", F.least("duration_us", F.coalesce(F.col("terminal_us") + tail, F.col("last_downed") + post)).alias("end_us"), "last_downed", "terminal_us", F.when(F.col("terminal_us").isNotNull(), "downed_until_terminal").otherwise("downed_recovery_tail").alias("reason"))


def inside(events: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """events with start_us and end_us of the segment (disjoint, half-open) they fall in; others drop. One sort, no join."""
    starts = segments.select(key, F.col("start_us").alias("t_us"), F.struct("start_us", "end_us").alias("_i"), F.lit(0).alias("_s"))
    both = events.withColumn("_s", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("t_us", "_s").rowsBetween(Window.unboundedPreceding, 0)
    now = both.withColumn("_i", F.last("_i", True).over(w)).where("_s = 1")
    return now.where(F.col("t_us") < F.col("_i.end_us")).select(*events.columns, "_i.start_us", "_i.end_us")


def classify(events: DataFrame, segments: DataFrame, key: str, window_us: int = 12 * SECOND, strong: int = 60, shot_us: int = 1_500_000) -> DataFrame:
    """segments with shoot_samples, hit_updates, reasons and classification: confirmed by an own kill, a spell of being down, two
    hits within window_us or a strong hit near a shot; without any of these it needs review."""
    ev = inside(events.select(key, "t_us", "kind", "before", "after"), segments, key)
    grown = F.coalesce(F.col("after"), F.lit(0)) - F.coalesce(F.col("before"), F.lit(0))
    ids, w = [key, "start_us"], Window.partitionBy(key, "start_us", "kind").orderBy("t_us")
    hit = (F.col("kind") == "hit") & (grown > 0)
    hits = ev.where(hit).withColumn("_d", F.col("t_us") - F.lag("t_us").over(w))
    again = hits.groupBy(*ids).agg(F.coalesce(F.bool_or((F.col("_d") > 0) & (F.col("_d") <= window_us)), F.lit(False)).alias("again"))
    part = Window.partitionBy(*ids)
    shot = F.when(F.col("kind") == "shoot", F.col("t_us"))
    back = F.max(shot).over(part.orderBy("t_us").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(shot).over(part.orderBy("t_us").rangeBetween(0, Window.unboundedFollowing))
    near = ev.withColumn("_g", grown).withColumn("_hit", hit).withColumn("_near", (F.col("t_us") - back <= shot_us) | (ahead - F.col("t_us") <= shot_us))
    sums = near.groupBy(*ids).agg(
        F.count_if(F.col("kind") == "shoot").alias("shoot_samples"),
        F.count_if("_hit").alias("hit_updates"),
        F.bool_or((F.col("kind") == "kill") & (F.col("_g") > 0)).alias("killed"),
        F.coalesce(F.bool_or((F.col("kind") == "hit") & (F.col("_g") >= strong) & F.col("_near")), F.lit(False)).alias("strong"),
    )
    out = segments.join(sums, ids, "left").join(again, ids, "left")
    named = [("killed", "own_kill"), (None, "downed_continuation"), ("again", "repeated_hit_feedback"), ("strong", "strong_hit_with_shot")]
    flags = [F.when(F.size("protected_reasons") > 0 if c is None else _flag(c), n) for c, n in named]
    reasons = F.array_compact(F.array(*flags))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("shoot_samples", "hit_updates")]
    return out.select(*segments.columns, *zero, reasons.alias("reasons"), F.when(F.size(reasons) > 0, "confirmed").otherwise("review").alias("classification"))


def summarise(events: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """segments with kills, damage (increments, an unknown base counting as 0) and weapons in the order first fired."""
    ev = inside(events.select(key, "t_us", "kind", "before", "after", "weapon"), segments, key)
    step = F.greatest(F.col("after") - F.coalesce(F.col("before"), F.lit(0)), F.lit(0))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, step)), F.lit(0))
    sums = ev.groupBy(key, "start_us").agg(total("kill").alias("kills"), total("hit").alias("damage"))
    first = ev.where("kind = 'shoot'").groupBy(key, "start_us", F.coalesce("weapon", F.lit("未知枪")).alias("weapon")).agg(F.min("t_us").alias("t"))
    listed = first.groupBy(key, "start_us").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "weapon"))), lambda x: x["weapon"]).alias("weapons"))
    out = segments.join(sums, [key, "start_us"], "left").join(listed, [key, "start_us"], "left")
    return out.select(*segments.columns, F.coalesce("kills", F.lit(0)).alias("kills"), F.coalesce("damage", F.lit(0)).alias("damage"), F.coalesce("weapons", F.array(F.lit("未知枪"))).alias("weapons"))


def cap_ends(segments: DataFrame, outcomes: DataFrame, key: str, tail: int = TAIL) -> DataFrame:
    """segments that end ``tail`` after the first outcome between their last signal and their end, with its time as ended_us."""
    near = _marks(segments.withColumn("t_us", F.col("last_signal")), outcomes.select(key, "t_us"), key, "t_us")
    found = F.when(F.col("_ahead") < F.col("end_us"), F.col("_ahead"))
    rest = [c for c in segments.columns if c != "end_us"]
    return near.withColumn("ended_us", found).select(*rest, F.least("end_us", F.coalesce(F.col("ended_us") + tail, F.col("end_us"))).alias("end_us"), "ended_us")


def keep_watching(segments: DataFrame, rows: DataFrame, outcomes: DataFrame, durations: DataFrame, key: str, tail: int = TAIL) -> DataFrame:
    """Segments extended over the time spent watching a team mate: up to the outcome that follows, or where the own view returns
    first, some seconds beyond that (then needs_review); overlapping ones merged."""
    ask = lambda df, time, marks, name: _marks(df.withColumn("t_us", time), marks.select(key, "t_us"), key, "t_us").withColumnRenamed("_ahead", name).drop("_back", "t_us")
    w = ask(segments, F.col("last_signal"), rows.where(_flag("friend_spectate")), "_watch")
    w = w.withColumn("_watch", F.when(F.col("_watch") <= F.col("end_us") + 2 * SECOND, F.col("_watch")))
    w = ask(w, F.coalesce("_watch", "end_us"), outcomes, "_over")
    w = ask(w, F.coalesce("_watch", "end_us") + SECOND + 1, rows.where(~_flag("inactive")), "_back_again").join(durations, key)
    over = F.col("_over").isNotNull() & (F.col("_back_again").isNull() | (F.col("_over") <= F.col("_back_again") + 3 * SECOND))
    until = F.when(over, F.least("duration_us", F.col("_over") + tail)).otherwise(F.least("duration_us", F.coalesce(F.col("_back_again") + 15 * SECOND, F.col("duration_us"))))
    watched = F.col("_watch").isNotNull()
    reasons = F.when(watched, F.array_union("protected_reasons", F.array(F.lit("friend_team_continuation")))).otherwise(F.col("protected_reasons"))
    items = w.select(key, "start_us", F.when(watched, F.greatest("end_us", until)).otherwise(F.col("end_us")).alias("end_us"), "first_signal", "last_signal", reasons.alias("protected_reasons"), (watched & ~over).alias("needs_review"))
    aggs = [F.min("first_signal").alias("first_signal"), F.max("last_signal").alias("last_signal"), _reasons(), F.bool_or("needs_review").alias("needs_review")]
    return merge(items, key, aggs=aggs).drop("n")


def align(segments: DataFrame, marks: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Segments widened to the key frames around them (without one after the end: to the recording's end) and merged, with the
    bounds first asked for."""
    low = _marks(segments.select(key, "start_us", "end_us").withColumn("t_us", F.col("start_us")), marks, key, "t_us").withColumn("a", F.coalesce("_back", "_ahead")).drop("_back", "_ahead")
    high = _marks(low.withColumn("t_us", F.col("end_us")), marks, key, "t_us").join(durations, key)
    wide = high.select(key, F.col("a").alias("start_us"), F.coalesce("_ahead", "duration_us").alias("end_us"), F.col("start_us").alias("asked"), F.col("end_us").alias("asked_end"))
    return merge(wide, key, aggs=[F.min("asked").alias("requested_start"), F.min_by("asked_end", "asked").alias("requested_end")]).drop("n")


def idle_ranges(rows: DataFrame, outcomes: DataFrame, durations: DataFrame, key: str, keep_us: int = 6 * SECOND, fall: int = 25) -> DataFrame:
    """(key, start_us, end_us) of the time between a round's end and the next own view, less ``keep_us`` on both sides. After a
    loading screen only if the damage counter of three readings after lies ``fall`` below that of three before."""
    shown = rows.where(_flag("friend_spectate") | (~_flag("inactive") & (F.col("ammo").isNotNull() | F.col("counter_offset").isNotNull())))
    ask = outcomes.select(key, F.col("t_us").alias("at"), "kind", (F.col("t_us") + 1).alias("t_us"))
    ask = _marks(ask, shown, key, "t_us").join(durations, key).select(key, "at", "kind", F.col("_ahead").alias("next_us"), "duration_us").withColumn("stop", F.coalesce("next_us", "duration_us"))
    read = rows.where(~_flag("inactive") & F.col("damage").isNotNull()).select(key, "t_us", "damage")
    w = Window.partitionBy(key).orderBy("t_us")
    three = lambda a, b: F.collect_list("damage").over(w.rowsBetween(a, b))
    read = read.withColumn("_before", three(-2, 0)).withColumn("_after", three(0, 2))
    side = lambda df, time, name, back: _asof(df.withColumn("t_us", time), read, key, name, back)
    both = side(side(ask, F.col("at") - 1, "_before", True), F.col("stop"), "_after", False)
    fell = (F.size("_before") >= 2) & (F.size("_after") >= 2) & (F.array_max("_after") <= F.array_min("_before") - fall)
    kept = both.where((F.col("kind") != "loading") | F.coalesce(fell, F.lit(False)))
    end = F.when(F.col("next_us").isNotNull(), F.greatest(F.lit(0), F.col("stop") - keep_us)).otherwise(F.col("duration_us"))
    return kept.select(key, (F.col("at") + keep_us).alias("start_us"), end.alias("end_us")).where("end_us > start_us")


def _asof(left: DataFrame, right: DataFrame, key: str, value: str, back: bool) -> DataFrame:
    """left with ``value`` of the last right row at or before t_us (back) or the first at or after it."""
    both = left.withColumn("_s", F.lit(1 if back else 0)).unionByName(right.select(key, "t_us", value).withColumn("_s", F.lit(0 if back else 1)), allowMissingColumns=True)
    w = Window.partitionBy(key)
    w = w.orderBy("t_us", "_s").rowsBetween(Window.unboundedPreceding, 0) if back else w.orderBy("t_us", "_s").rowsBetween(0, Window.unboundedFollowing)
    pick = F.last if back else F.first
    return both.withColumn(value, pick(value, True).over(w)).where(F.col("_s") == (1 if back else 0)).drop("_s", "t_us")
