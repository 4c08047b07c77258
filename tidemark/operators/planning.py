"""Which parts of a recording deserve a closer look, from its coarse rows, and whether the closer look found what they showed.

Rows (key, t_us, inactive, downed, friend_spectate, damage, kills, ammo, icon) are unique by time; seeds are (key, start_us, end_us,
reason, before, after)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import bitmap_dice
from .events import _flag
from .folds import runs
from .intervals import merge
from .joins import _marks
from .scan import scan

SECOND = 1_000_000
# Reasons that a closer look may not join into long stretches, and reasons that do count as activity.
SWITCHES = ("view_transition", "team_or_downed", "counter_reset_or_uncertain")
STRONG = ("damage", "kills", "ammo_change", "recording_started_in_play")


def _seed(df: DataFrame, key: str, start: Column, end: Column, reason: str, before: Column | None = None, after: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.select(key, start.cast("long").alias("start_us"), end.cast("long").alias("end_us"), F.lit(reason).alias("reason"), (none if before is None else before.cast("long")).alias("before"), (none if after is None else after.cast("long")).alias("after"))


def brackets(rows: DataFrame, key: str) -> DataFrame:
    """Seeds between a row and what came before it: wide gaps, changes of view, counters that grew or fell, rounds fired."""
    w = Window.partitionBy(key).orderBy("t_us")
    r = rows.withColumn("last", F.lag(F.struct("t_us", _flag("inactive").alias("inactive"), "ammo", _flag("friend_spectate").alias("friend"))).over(w))
    r = r.withColumn("first_row", F.row_number().over(w) == 1)
    t, prior = F.col("t_us"), F.col("last.t_us")
    out = _seed(r.where(t - prior > 5 * SECOND), key, prior, t, "wide_gap")
    out = out.unionAll(_seed(r.where(_flag("downed") | _flag("friend_spectate")), key, F.coalesce(prior, t), t, "team_or_downed"))
    turned = (_flag("inactive") != F.col("last.inactive")) & (F.col("last.ammo").isNotNull() | F.col("last.friend"))
    out = out.unionAll(_seed(r.where(turned), key, prior, t, "view_transition"))
    own = r.where(~_flag("inactive"))
    for field in ("damage", "kills"):
        c = own.where(F.col(field).isNotNull()).withColumn("b", F.lag(F.struct("t_us", field)).over(w))
        v, b = F.col(field), F.col(f"b.{field}")
        left = F.coalesce(F.col("b.t_us"), prior, F.greatest(F.lit(0), t - 3 * SECOND))
        grew = (v > 0) & ((v > b) | (F.col("b").isNull() & (t > 15 * SECOND)))
        out = out.unionAll(_seed(c.where(grew), key, left, t, field, F.coalesce(b, F.lit(0)), v))
        out = out.unionAll(_seed(c.where((v < b) & ~grew), key, F.greatest(F.lit(0), t - 8 * SECOND), t, "counter_reset_or_uncertain"))
    part = r.withColumn("_part", F.sum(F.when(_flag("inactive"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    shot = part.where(~_flag("inactive") & F.col("ammo").isNotNull()).withColumn("b", F.lag(F.struct("t_us", "ammo", "icon")).over(Window.partitionBy(key, "_part").orderBy("t_us")))
    shot = shot.where((F.col("ammo") < F.col("b.ammo")) & (t - F.col("b.t_us") <= 12 * SECOND)).where(bitmap_dice(F.col("b.icon"), F.col("icon")) >= 0.5)
    out = out.unionAll(_seed(shot, key, F.col("b.t_us"), t, "ammo_change"))
    ends = rows.groupBy(key).agg(F.max("t_us").alias("end"))
    begin = r.where(F.col("first_row") & ~_flag("inactive") & F.col("ammo").isNotNull()).join(ends, key)
    return out.unionAll(_seed(begin, key, F.lit(0), F.least(F.lit(15 * SECOND), F.col("end")), "recording_started_in_play"))


def strength(rows: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """seeds whose counter only came back to a height it had before renamed counter_rebound_or_uncertain; a zero starts anew."""
    w = Window.partitionBy(key).orderBy("t_us")
    out = None
    for field in ("damage", "kills"):
        c = rows.where(~_flag("inactive") & F.col(field).isNotNull()).select(key, "t_us", F.col(field).alias("v"))
        c = c.withColumn("_part", F.count_if(F.col("v") == 0).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        top = F.max("v").over(Window.partitionBy(key, "_part").orderBy("t_us").rowsBetween(Window.unboundedPreceding, -1))
        again = c.withColumn("top", top).where("v <> 0 and v <= top").select(key, F.col("t_us").alias("end_us"), F.lit(field).alias("reason"))
        out = again if out is None else out.unionAll(again)
    marked = seeds.join(out.withColumn("_again", F.lit(True)), [key, "end_us", "reason"], "left")
    return marked.withColumn("reason", F.when(_flag("_again"), "counter_rebound_or_uncertain").otherwise(F.col("reason"))).select(*seeds.columns)


def padded(pieces: DataFrame, durations: DataFrame, key: str, pad: int = 0) -> DataFrame:
    """The pieces padded on both sides, clipped to the recording and merged."""
    p = pieces.select(key, "start_us", "end_us").join(durations, key)
    p = p.select(key, F.greatest(F.lit(0), F.col("start_us") - pad).alias("start_us"), F.least("duration_us", F.col("end_us") + pad).alias("end_us"))
    return merge(p, key).drop("n")


def grid_ranges(windows: DataFrame, durations: DataFrame, key: str, fps: float) -> DataFrame:
    """(key, first, last) of the samples of a uniform grid whose centres lie in the windows; neighbouring ranges are one."""
    w = windows.join(durations, key)
    count = F.greatest(F.lit(1), F.floor(F.col("duration_us") / 1e6 * fps + 0.5))
    first, last = F.greatest(F.lit(1), F.ceil(F.col("start_us") / 1e6 * fps + 0.5)), F.least(count, F.floor(F.col("end_us") / 1e6 * fps + 0.5))
    some = w.select(key, first.cast("long").alias("start_us"), (last + 1).cast("long").alias("end_us")).where("end_us > start_us")
    return merge(some, key).select(key, F.col("start_us").alias("first"), (F.col("end_us") - 1).alias("last"))


def missing_ranges(rows: DataFrame, totals: DataFrame, key: str, frame: str = "frame") -> DataFrame:
    """(key, first, last) of the frame numbers from 1 to total without a row: the gaps between rows, no grid is built."""
    w = Window.partitionBy(key).orderBy("n")
    edge = totals.select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("total") + 1)).alias("n"))
    here = rows.select(key, F.col(frame).cast("long").alias("n")).join(totals, key).where("n between 1 and total").select(key, "n").distinct().unionByName(edge)
    gaps = here.withColumn("_next", F.lead("n").over(w)).where("_next > n + 1")
    return gaps.select(key, (F.col("n") + 1).alias("first"), (F.col("_next") - 1).alias("last"))


def anchors(rows: DataFrame, key: str, apart: int = 12 * SECOND) -> DataFrame:
    """(key, t_us) of the first row that shows a counter, each later one at least ``apart`` after the last kept, and the last one."""
    seen = rows.where(~_flag("inactive") & (F.col("damage").isNotNull() | F.col("kills").isNotNull())).select(key, "t_us")
    kind = rows.schema[key].dataType.simpleString()

    def step(state, row):
        t = row["t_us"]
        keep = state is None or t - state >= apart
        return (t if keep else state), ([(row[key], t)] if keep else [])

    last = seen.groupBy(key).agg(F.max("t_us").alias("t_us"))
    kept = scan(runs(seen, [key], "t_us", apart - 1), [key, "_run"], ["t_us"], step, f"{key} {kind}, t_us long")
    return kept.unionByName(last).distinct()


def watched_spans(rows: DataFrame, durations: DataFrame, key: str, keep: int = 15 * SECOND) -> DataFrame:
    """(key, start_us, end_us) from the start of watching others (a team mate, or any view soon after being down) until the own
    view shows rounds again."""
    kind = rows.schema[key].dataType.simpleString()

    def step(state, row):
        down, since, _ = state or (None, None, None)
        t, out, away = row["t_us"], [], bool(row["inactive"])
        if row["downed"]:
            down = t
        if away and (row["friend_spectate"] or (down is not None and t - down <= keep)) and since is None:
            since = max(0, t - 3 * SECOND)
        if since is not None and not away and row["ammo"] is not None:
            out, since, down = [(row[key], since, t + 6 * SECOND)], None, None
        return (down, since, row[key]), out

    cols = [key, "t_us", "inactive", "friend_spectate", "downed", "ammo"]
    open_end = lambda s: [(s[2], s[1], None)] if s[1] is not None else []
    spans = scan(rows.select(*cols), [key], ["t_us"], step, f"{key} {kind}, start_us long, end_us long", open_end).join(durations, key)
    return spans.select(key, "start_us", F.least("duration_us", F.coalesce("end_us", "duration_us")).alias("end_us"))


def evidence_windows(rows: DataFrame, seeds: DataFrame, durations: DataFrame, key: str, gap: int = 35 * SECOND) -> DataFrame:
    """(key, start_us, end_us) to look at closely: groups of seeds, the recording's head, anchors of the counters, changes of view,
    spells of being down and of watching others."""
    w = Window.partitionBy(key).orderBy("start_us", "end_us")
    upto = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = seeds.withColumn("_c", F.when(F.col("start_us") - upto <= gap + 5 * SECOND, 0).otherwise(1))
    groups = cut.withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_g").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    piece = lambda df, a, b: df.select(key, a.cast("long").alias("start_us"), b.cast("long").alias("end_us"))
    t = F.col("t_us")
    pieces = piece(groups, F.col("start_us") - 3 * SECOND, F.col("end_us") + 3 * SECOND)
    pieces = pieces.unionAll(piece(durations, F.lit(0), F.lit(1_500_000)))
    pieces = pieces.unionAll(piece(anchors(rows, key), t - SECOND, t + SECOND))
    pieces = pieces.unionAll(piece(seeds.where(F.col("reason").isin(*SWITCHES)), F.col("start_us") - 3 * SECOND, F.col("end_us") + 6 * SECOND))
    pieces = pieces.unionAll(piece(rows.where(_flag("downed")), t - 3 * SECOND, t + 15 * SECOND))
    return padded(pieces.unionAll(watched_spans(rows, durations, key)), durations, key)


def focused_windows(rows: DataFrame, seeds: DataFrame, durations: DataFrame, key: str, gap: int = 35 * SECOND) -> DataFrame:
    """evidence_windows of the strong seeds, the weak ones looked at by themselves so that misreads do not join into long stretches."""
    strong = F.col("reason").isin(*STRONG)
    patches = seeds.where(~strong).select(key, (F.col("start_us") - F.when(F.col("reason") == "team_or_downed", 10 * SECOND).otherwise(3 * SECOND)).alias("start_us"), (F.col("end_us") + 6 * SECOND).alias("end_us"))
    both = padded(evidence_windows(rows, seeds.where(strong), durations, key, gap).unionByName(patches), durations, key)
    return padded(both.withColumn("end_us", F.col("end_us") + 1_100_000), durations, key)


def refinement(rows: DataFrame, seeds: DataFrame, key: str, within: int = 2_500_000) -> DataFrame:
    """Rows without a reading of rounds that lie within ``within`` of a seed: the merged windows decide, no pair is made."""
    windows = merge(seeds.select(key, (F.col("start_us") - within).alias("start_us"), (F.col("end_us") + within).alias("end_us")), key)
    from .joins import in_interval

    return in_interval(rows.where(F.col("ammo").isNull()), windows, key, "t_us").select(*rows.columns)


def audit(coarse: DataFrame, fine: DataFrame, events: DataFrame, outcomes: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """One row for each round and counter that the coarse rows show: (key, start_us, end_us, field, expected, detected, passed).

    A round passes if the coarse rows' last value lies between those of the fine rows within three seconds of it and the events
    add up to at least its growth; without fine rows it fails. A round's edges belong to both of its neighbours."""
    edge = outcomes.where("t_us > 0").select(key, "t_us").distinct().unionByName(durations.select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("duration_us") + SECOND)).alias("t_us")))
    w = Window.partitionBy(key).orderBy("t_us")
    rounds = edge.distinct().select(key, F.col("t_us").alias("start_us"), F.lead("t_us").over(w).alias("end_us")).where("end_us is not null")

    def dealt(df: DataFrame) -> DataFrame:
        """df with the rounds it lies in: the one that starts at or before it, and the one that ends at it."""
        m = _marks(df, rounds.select(key, F.col("start_us").alias("t_us")), key, "t_us").withColumnRenamed("_back", "start_us").drop("_ahead").join(rounds, [key, "start_us"])
        closing = df.join(rounds.withColumn("t_us", F.col("end_us")), [key, "t_us"])
        return m.unionByName(closing.select(*m.columns))

    out = None
    for field, kind in (("damage", "hit"), ("kills", "kill")):
        read = lambda df: dealt(df.where(~_flag("inactive") & F.col(field).isNotNull()).select(key, "t_us", F.col(field).cast("long").alias("v")))  # noqa: B023, E731
        c = read(coarse).groupBy(key, "start_us", "end_us").agg(F.max("t_us").alias("at"), F.max_by("v", "t_us").alias("endpoint"), F.min_by("v", "t_us").alias("opening"))
        f = read(fine).join(c.select(key, "start_us", "at"), [key, "start_us"])
        near = F.when(F.abs(F.col("t_us") - F.col("at")) <= 3 * SECOND, F.col("v"))
        f = f.groupBy(key, "start_us").agg(F.min("t_us").alias("begin"), F.min_by("v", "t_us").alias("base"), F.min(near).alias("low"), F.max(near).alias("high"))
        e = dealt(events.where(F.col("kind") == kind).select(key, "t_us", (F.col("after") - F.coalesce("before", F.lit(0))).alias("step")))
        e = e.groupBy(key, "start_us").agg(F.sum("step").alias("found"))
        x = c.join(f, [key, "start_us"], "left").join(e, [key, "start_us"], "left")
        base = F.when((F.col("begin") - F.col("start_us") < 15 * SECOND) | (F.col("opening") != 0), F.col("base")).otherwise(F.lit(0))
        expected = F.greatest(F.lit(0), F.col("endpoint") - base)
        found = F.coalesce("found", F.lit(0))
        passed = F.coalesce(F.col("endpoint").between(F.col("low"), F.col("high")) & (found >= expected), F.lit(False))
        part = x.select(key, "start_us", "end_us", F.lit(field).alias("field"), F.when(F.col("begin").isNotNull(), expected).alias("expected"), found.alias("detected"), passed.alias("passed"))
        out = part if out is None else out.unionAll(part)
    return out


def candidate_frames(inactive_rows: DataFrame, key: str, before: int = 2, after: int = 9) -> DataFrame:
    """Rows around each start of a spell outside the own view: ``before`` rows before it to ``after`` rows after it."""
    w = Window.partitionBy(key).orderBy("t_us")
    edge = _flag("inactive") & ~F.coalesce(F.lag(_flag("inactive")).over(w), F.lit(False))
    marked = inactive_rows.withColumn("_edge", edge)
    near = F.bool_or("_edge").over(w.rowsBetween(-after, before))
    return marked.withColumn("_near", near).where("_near").drop("_edge", "_near")

