"""Named queries on streams of readings, each with equivalent SQL where SQL can express it.

The readings are made of ``events``: a user is a recording and time runs 40,000 times faster, errors are spells outside the own
view, some signups end a round. Counters grow within a round, with gaps and misreads among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import events, folds, planning, readings, segments
from ..operators.joins import _marks
from ..session import ship
from .catalogue import _t

SCALE, ORIGIN = 40_000, 1_704_067_200_000_000
SECOND = 1_000_000


def hud(spark, sf_dir) -> DataFrame:
    e = _t(ship(spark), sf_dir, "events").select("event_id", "user_id", "event_type", F.floor((F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())) - ORIGIN) / SCALE).cast("long").alias("t_us"))
    first = e.groupBy("user_id", "t_us").agg(F.min_by(F.struct("event_id", "event_type"), "event_id").alias("e")).select("user_id", "t_us", "e.*")
    w = Window.partitionBy("user_id").orderBy("t_us")
    ended = (F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0)
    r = first.withColumn("frame", F.row_number().over(w).cast("long")).withColumn("round_ended", ended)
    r = r.withColumn("round", F.coalesce(F.sum(F.when(F.col("round_ended"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    up = Window.partitionBy("user_id", "round").orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0)
    damage = F.sum(F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 90).otherwise(0)).over(up)
    kills = F.sum(F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), 1).otherwise(0)).over(up)
    return r.select(
        "user_id", "t_us", "event_id", "frame", "round_ended",
        (F.col("event_type") == "error").alias("inactive"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).alias("friend_spectate"),
        (F.col("event_id") % 17 <= 4).alias("downed"),
        F.when(F.col("event_id") % 11 != 0, damage + F.when(F.col("event_id") % 29 == 0, 5000).otherwise(0)).cast("long").alias("damage"),
        F.when(F.col("event_id") % 13 != 0, kills).cast("long").alias("kills"),
        F.when(F.col("event_id") % 6 != 0, 30 - F.col("frame") % 30).cast("long").alias("ammo"),
        F.base64(F.md5((F.col("frame") / 40).cast("long").cast("string")).cast("binary")).alias("icon"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("w"), ((F.col("frame") / 40).cast("long") % 4).cast("string"))).alias("weapon_id"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 2).cast("int")).alias("slot"),
        (F.lit(0.8) + (F.col("event_id") % 20) / 100).alias("weapon_confidence"),
        F.when(F.col("event_id") % 8 == 0, F.lit(0.9)).alias("counter_marker_score"),
        F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("counter_offset"),
    )


HUD = f"""h0 as (select user_id, (epoch_us(ts) - {ORIGIN}) // {SCALE} as t_us, min(event_id) as event_id from events group by 1, 2),
h1 as (select h0.*, e.event_type, row_number() over (partition by h0.user_id order by t_us) as frame, e.event_type = 'signup' and h0.event_id % 5 = 0 as round_ended from h0 join events e using (event_id)),
h2 as (select *, coalesce(sum(round_ended::int) over (partition by user_id order by t_us rows between unbounded preceding and 1 preceding), 0) as round from h1),
h3 as (select *, sum(case when event_id % 4 = 0 then event_id % 90 else 0 end) over (partition by user_id, round order by t_us rows unbounded preceding) as d,
  sum(case when event_type = 'purchase' and event_id % 3 = 0 then 1 else 0 end) over (partition by user_id, round order by t_us rows unbounded preceding) as k from h2),
hud as (select user_id, t_us, event_id, frame, round_ended, event_type = 'error' as inactive, event_type = 'error' and event_id % 3 = 0 as friend_spectate, event_id % 17 <= 4 as downed,
  case when event_id % 11 <> 0 then d + case when event_id % 29 = 0 then 5000 else 0 end end::bigint as damage, case when event_id % 13 <> 0 then k end::bigint as kills, case when event_id % 6 <> 0 then 30 - frame % 30 end::bigint as ammo, event_id % 8 = 0 as marked from h3)"""


def _durations(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg((F.max("t_us") + 1).alias("duration_us"))


def _outcomes(rows: DataFrame) -> DataFrame:
    return rows.where("round_ended").select("user_id", "t_us", F.lit("end").alias("kind"))


def _shot_times(rows: DataFrame) -> DataFrame:
    """Made events for the segment queries: every reading whose id leaves 1 of 7 is one."""
    kind = F.when(F.col("event_id") % 3 == 0, "hit").when(F.col("event_id") % 3 == 1, "shoot").otherwise("kill")
    return rows.where("event_id % 7 = 1").select("user_id", "t_us", kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 50).alias("before"), (F.col("event_id") % 50 + F.col("event_id") % 90).alias("after"), F.concat(F.lit("w"), F.col("event_id") % 4).alias("weapon"))


EVENTS = """ev as (select user_id, t_us, case when event_id % 3 = 0 then 'hit' when event_id % 3 = 1 then 'shoot' else 'kill' end as kind, case when event_id % 2 = 0 then event_id % 50 end as before, event_id % 50 + event_id % 90 as after, 'w' || (event_id % 4) as weapon from hud where event_id % 7 = 1)"""
PARTS = (5 * SECOND, 1 * SECOND, 2 * SECOND)
LEN = "dur as (select user_id, max(t_us) + 1 as duration_us from hud group by 1)"
SEG = f"""sg0 as (select user_id, t_us, case when t_us - lag(t_us) over (partition by user_id order by t_us) <= {PARTS[0]} then 0 else 1 end as c from (select distinct user_id, t_us from ev)),
sg1 as (select user_id, min(t_us) as f, max(t_us) as l from (select *, sum(c) over (partition by user_id order by t_us) as g from sg0) group by user_id, g),
sg2 as (select sg1.user_id, greatest(f - {PARTS[1]}, 0) as s, least(duration_us, l + {PARTS[2]}) as e, f, l from sg1 join dur using (user_id)),
sg3 as (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from sg2),
seg as (select user_id, min(s) as start_us, max(e) as end_us, min(f) as first_signal, max(l) as last_signal from (select *, sum(n) over (partition by user_id order by s, e rows unbounded preceding) as p from sg3) group by user_id, p)"""


def _segments(rows: DataFrame) -> DataFrame:
    return segments.from_events(_shot_times(rows), _durations(rows), "user_id", *PARTS)


def own_events(spark, sf_dir):
    return events.detect(hud(spark, sf_dir), "user_id")


def shot_weapons(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return events.label_shots(events.shots(rows, "user_id").select("user_id", "t_us"), rows, "user_id", 2 * SECOND)


def trusted_captions(spark, sf_dir):
    return events.trusted_weapon(hud(spark, sf_dir), "user_id", 0.95, 4 * SECOND).select("event_id", "trusted")


def combat_segments(spark, sf_dir):
    return _segments(hud(spark, sf_dir)).drop("protected_reasons")


def protected_segments(spark, sf_dir):
    rows = hud(spark, sf_dir)
    down = segments.downed(rows, _durations(rows), "user_id", 3 * SECOND, 2 * SECOND, SECOND)
    return segments.from_events(_shot_times(rows), _durations(rows), "user_id", *PARTS, protected=down)


def segment_verdicts(spark, sf_dir):
    rows = hud(spark, sf_dir)
    out = segments.classify(_shot_times(rows), _segments(rows), "user_id", 3 * SECOND, 60, SECOND)
    return out.select("user_id", "start_us", "shoot_samples", "hit_updates", F.concat_ws(",", "reasons").alias("reasons"), "classification")


def segment_totals(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return segments.summarise(_shot_times(rows), _segments(rows), "user_id").select("user_id", "start_us", "kills", "damage", F.concat_ws(",", "weapons").alias("weapons"))


def capped_segments(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return segments.cap_ends(_segments(rows), _outcomes(rows), "user_id", SECOND // 2).select("user_id", "start_us", "end_us", "ended_us")


def watched_segments(spark, sf_dir):
    rows = hud(spark, sf_dir)
    out = segments.keep_watching(_segments(rows), rows, _outcomes(rows), _durations(rows), "user_id")
    return out.withColumn("protected_reasons", F.concat_ws(",", "protected_reasons"))


def key_frame_segments(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return segments.align(_segments(rows), rows.where("event_id % 9 = 0").select("user_id", "t_us"), _durations(rows), "user_id")


def downed_spells(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return segments.downed(rows, _durations(rows), "user_id", 3 * SECOND, 2 * SECOND, SECOND)


def idle_after_rounds(spark, sf_dir):
    rows = hud(spark, sf_dir)
    ends = _outcomes(rows).withColumn("kind", F.when(F.col("t_us") % 2 == 0, "loading").otherwise("end"))
    return segments.idle_ranges(rows, ends, _durations(rows), "user_id", SECOND // 2, 5)


def scan_seeds(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return planning.strength(rows, planning.brackets(rows, "user_id"), "user_id")


def evidence_windows(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return planning.evidence_windows(rows, planning.brackets(rows, "user_id").where("before % 7 = 0 or reason = 'view_transition'"), _durations(rows), "user_id", SECOND)


def focused_windows(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return planning.focused_windows(rows, planning.brackets(rows, "user_id").where("start_us % 5 = 0"), _durations(rows), "user_id", SECOND)


def refined_rows(spark, sf_dir):
    rows = hud(spark, sf_dir)
    seeds = rows.where("event_id % 20 = 0").select("user_id", F.col("t_us").alias("start_us"), F.col("t_us").alias("end_us"))
    return planning.refinement(rows, seeds, "user_id", SECOND).select("user_id", "t_us", "frame")


def grid_ranges(spark, sf_dir):
    rows = hud(spark, sf_dir)
    wins = planning.padded(rows.where("event_id % 12 = 0").select("user_id", F.col("t_us").alias("start_us"), F.col("t_us").alias("end_us")), _durations(rows), "user_id", SECOND)
    return planning.grid_ranges(wins, _durations(rows), "user_id", 2.0)


def missing_frames(spark, sf_dir):
    rows = hud(spark, sf_dir)
    totals = rows.groupBy("user_id").agg((F.max("frame") + 2).alias("total"))
    return planning.missing_ranges(rows.where("event_id % 4 <> 1"), totals, "user_id")


def counter_audit(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return planning.audit(rows.where("frame % 4 = 0"), rows, events.detect(rows, "user_id"), _outcomes(rows), _durations(rows), "user_id")


def view_edges(spark, sf_dir):
    return planning.candidate_frames(hud(spark, sf_dir), "user_id").select("user_id", "t_us")


def watched_spans(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return planning.watched_spans(rows, _durations(rows), "user_id", SECOND)


def counter_anchors(spark, sf_dir):
    return planning.anchors(hud(spark, sf_dir), "user_id", 3 * SECOND)


def confirmed_counters(spark, sf_dir):
    rows = folds.stable(hud(spark, sf_dir), "user_id", ["t_us"], "t_us", "damage", 4 * SECOND, inactive="inactive")
    return rows.select("event_id", "damage", "agreeing")


def stable_values(spark, sf_dir):
    return readings.stable_value(hud(spark, sf_dir).withColumn("view", F.floor(F.col("frame") / 2)), ["user_id"], "view", "t_us", "damage")


def earliest_values(spark, sf_dir):
    rows = hud(spark, sf_dir).withColumn("view", F.floor(F.col("frame") / 2)).withColumn("begin", F.lit(0))
    return readings.earliest_consistent(rows, ["user_id"], "view", "t_us", "damage", "begin", 2 * SECOND)


def stable_runs(spark, sf_dir):
    return readings.stable_run(hud(spark, sf_dir), ["user_id"], "t_us", "damage", 3, 2 * SECOND)


def endpoint_changes(spark, sf_dir):
    rows = hud(spark, sf_dir)
    sure = readings.stable_value(rows, ["user_id"], "frame", "t_us", "kills").withColumnRenamed("kills", "sure")
    return readings.endpoint_change(rows.join(sure, "user_id"), ["user_id"], "t_us", "kills", "sure")


def segment_samples(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return readings.window_samples(rows.select("user_id", "t_us", "frame"), _segments(rows).select("user_id", "start_us", "end_us"), "user_id", 4 * SECOND, 3, 2)


def zero_windows(spark, sf_dir):
    return readings.zero_window(hud(spark, sf_dir), "user_id", within=20 * SECOND).select("user_id", "t_us")


def probe_moments(spark, sf_dir):
    return folds.probe_times(hud(spark, sf_dir), "user_id", "t_us", 2 * SECOND, 4 * SECOND, 20 * SECOND, 3, 12)


def agreed_numbers(spark, sf_dir):
    reads = hud(spark, sf_dir).select("user_id", F.floor(F.col("frame") / 3).alias("view"), F.concat(F.when(F.col("event_id") % 5 == 0, "0").otherwise(""), (F.col("event_id") % 3).cast("string"), F.when(F.col("event_id") % 31 == 0, "x").otherwise("")).alias("text"), F.col("weapon_confidence").alias("confidence"))
    out = readings.agreed_number(reads, ["user_id", "view"], "text", "confidence", 0.82)
    return out.withColumn("confidence", F.round("confidence", 6))


def unanimous_weapons(spark, sf_dir):
    out = readings.unanimous(hud(spark, sf_dir).withColumn("part", F.floor(F.col("frame") / 6)), ["user_id", "part"], "weapon_id", 2, "weapon_confidence")
    return out.withColumn("confidence", F.round("confidence", 6))


def detail_votes(spark, sf_dir):
    out = readings.detail_vote(hud(spark, sf_dir).withColumn("part", F.floor(F.col("frame") / 6)), ["user_id", "part"], "weapon_id", "slot", "weapon_confidence")
    return out.withColumn("confidence", F.round("confidence", 6))


def neighbour_bounds(spark, sf_dir):
    rows = hud(spark, sf_dir)
    return readings.nearest_confirmed(rows.where("event_id % 5 = 2").select("user_id", "t_us"), rows.where("event_id % 3 = 0").select("user_id", "t_us"), "user_id", "t_us")


def round_numbers(spark, sf_dir):
    """Segments with the number of rounds that ended at or before their start: one window over both."""
    rows = hud(spark, sf_dir)
    both = _segments(rows).select("user_id", F.col("start_us").alias("t_us"), F.lit(1).alias("_s")).unionByName(_outcomes(rows).select("user_id", "t_us", F.lit(0).alias("_s")))
    w = Window.partitionBy("user_id").orderBy("t_us", "_s").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("round_index", F.count_if(F.col("_s") == 0).over(w)).where("_s = 1").select("user_id", F.col("t_us").alias("start_us"), "round_index")


def next_reading(spark, sf_dir):
    """For each requested moment the reading at or after it, under 0.15 s away."""
    rows = hud(spark, sf_dir)
    ask = rows.where("event_id % 6 = 1").select("user_id", (F.col("t_us") - 100_000).alias("t_us"))
    near = _marks(ask, rows.select("user_id", "t_us"), "user_id", "t_us")
    return near.select("user_id", "t_us", F.when(F.col("_ahead") - F.col("t_us") < 150_000, F.col("_ahead")).alias("read_us"))


QUERIES = (own_events, shot_weapons, trusted_captions, combat_segments, protected_segments, segment_verdicts, segment_totals, capped_segments, watched_segments, key_frame_segments, downed_spells, idle_after_rounds, scan_seeds, evidence_windows, focused_windows, refined_rows, grid_ranges, missing_frames, counter_audit, view_edges, watched_spans, counter_anchors, confirmed_counters, stable_values, earliest_values, stable_runs, endpoint_changes, segment_samples, zero_windows, probe_moments, agreed_numbers, unanimous_weapons, detail_votes, neighbour_bounds, round_numbers, next_reading)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    w = f"with {HUD}"
    seg = f"{w}, {EVENTS}, {LEN}, {SEG}"
    inside = "ins as (select ev.*, seg.start_us from ev join seg on ev.user_id = seg.user_id and ev.t_us >= seg.start_us and ev.t_us < seg.end_us)"
    outc = "outc as (select user_id, t_us from hud where round_ended)"
    view = "v as (select *, frame // 2 as view from hud)"
    return {
        "trusted_captions": f"{w}, y as (select *, 0.8::double + (event_id % 20) / 100.0::double as c, case when event_id % 2 = 0 then 'w' || ((frame // 40) % 4) end as w from hud)"
        f" select event_id, coalesce(w is not null and (c >= 0.95 or count(*) over (partition by user_id, w order by t_us range between {4 * SECOND} preceding and {4 * SECOND} following) >= 2), false) as trusted from y",
        "combat_segments": f"{seg} select * from seg",
        "segment_verdicts": f"""{seg}, {inside}, h as (select *, t_us - lag(t_us) over (partition by user_id, start_us order by t_us) as d from ins where kind = 'hit' and after - coalesce(before, 0) > 0),
 ag as (select user_id, start_us, bool_or(d > 0 and d <= {3 * SECOND}) as again, count(*) as n from h group by 1, 2),
 st as (select distinct a.user_id, a.start_us from ins a join ins b on a.user_id = b.user_id and a.start_us = b.start_us and a.kind = 'hit' and b.kind = 'shoot' and a.after - coalesce(a.before, 0) >= 60 and abs(a.t_us - b.t_us) <= {SECOND}),
 k as (select user_id, start_us, count(*) filter (kind = 'shoot') as shots, bool_or(kind = 'kill' and after - coalesce(before, 0) > 0) as killed from ins group by 1, 2),
 r as (select seg.user_id, seg.start_us, coalesce(shots, 0) as shoot_samples, coalesce(ag.n, 0) as hit_updates,
  concat_ws(',', case when killed then 'own_kill' end, case when again then 'repeated_hit_feedback' end, case when st.user_id is not null then 'strong_hit_with_shot' end) as reasons
  from seg left join k on seg.user_id = k.user_id and seg.start_us = k.start_us left join ag on seg.user_id = ag.user_id and seg.start_us = ag.start_us left join st on seg.user_id = st.user_id and seg.start_us = st.start_us)
 select *, case when reasons <> '' then 'confirmed' else 'review' end as classification from r""",
        "segment_totals": f"""{seg}, {inside}, k as (select user_id, start_us, sum(greatest(after - coalesce(before, 0), 0)) filter (kind = 'kill') as kills, sum(greatest(after - coalesce(before, 0), 0)) filter (kind = 'hit') as damage from ins group by 1, 2),
 fw as (select user_id, start_us, weapon, min(t_us) as t from ins where kind = 'shoot' group by 1, 2, 3), l as (select user_id, start_us, string_agg(weapon, ',' order by t, weapon) as weapons from fw group by 1, 2)
 select seg.user_id, seg.start_us, coalesce(kills, 0)::bigint as kills, coalesce(damage, 0)::bigint as damage, coalesce(weapons, '未知枪') as weapons from seg left join k on seg.user_id = k.user_id and seg.start_us = k.start_us left join l on seg.user_id = l.user_id and seg.start_us = l.start_us""",
        "capped_segments": f"{seg}, {outc}, f as (select seg.*, (select min(t_us) from outc where outc.user_id = seg.user_id and t_us >= last_signal and t_us < end_us) as ended_us from seg) select user_id, start_us, least(end_us, coalesce(ended_us + {SECOND // 2}, end_us)) as end_us, ended_us from f",
        "key_frame_segments": f"""{seg}, m as (select user_id, t_us from hud where event_id % 9 = 0), x as (select seg.user_id, start_us as a, end_us as z, coalesce((select max(t_us) from m where m.user_id = seg.user_id and t_us <= start_us), (select min(t_us) from m where m.user_id = seg.user_id)) as s,
  coalesce((select min(t_us) from m where m.user_id = seg.user_id and t_us >= end_us), duration_us) as e from seg join dur using (user_id)),
 y as (select *, case when s <= max(e) over (partition by user_id order by s, e, a rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from x where s is not null and s <= e),
 z2 as (select *, sum(n) over (partition by user_id order by s, e, a rows unbounded preceding) as p from y)
 select user_id, min(s) as start_us, max(e) as end_us, min(a) as requested_start, arg_min(z, a) as requested_end from z2 group by user_id, p""",
        "refined_rows": f"{w} select user_id, t_us, frame from hud h where ammo is null and exists (select 1 from hud s where s.user_id = h.user_id and s.event_id % 20 = 0 and h.t_us between s.t_us - {SECOND} and s.t_us + {SECOND})",
        "missing_frames": f"""{w}, tot as (select user_id, max(frame) + 2 as total from hud group by 1), g as (select user_id, unnest(generate_series(1, total)) as n from tot), x as (select g.* from g left join hud h on h.user_id = g.user_id and h.frame = g.n and h.event_id % 4 <> 1 where h.frame is null)
 select user_id, min(n) as first, max(n) as last from (select *, n - row_number() over (partition by user_id order by n) as k from x) group by user_id, k""",
        "view_edges": f"{w}, e as (select *, inactive and not coalesce(lag(inactive) over (partition by user_id order by t_us), false) as edge from hud), n as (select *, bool_or(edge) over (partition by user_id order by t_us rows between 9 preceding and 2 following) as near from e) select user_id, t_us from n where near",
        "confirmed_counters": f"{w} select a.event_id, a.damage, count(*) as agreeing from hud a join hud b on a.user_id = b.user_id and b.frame between a.frame - 2 and a.frame + 2 and a.damage = b.damage and abs(a.t_us - b.t_us) <= {4 * SECOND} where not a.inactive group by 1, 2 having count(*) >= 2",
        "stable_values": f"{w}, {view}, l as (select * from v qualify row_number() over (partition by user_id, view order by t_us desc) = 1), n as (select user_id, damage, max(t_us) as t from l where damage is not null group by 1, 2 having count(*) >= 2) select user_id, arg_max(damage, t) as damage from n group by 1",
        "earliest_values": f"""{w}, {view}, l as (select * from v where damage is not null qualify row_number() over (partition by user_id, view order by t_us) = 1),
 s as (select *, lead(damage) over (partition by user_id order by t_us) as nx, min(damage) over (partition by user_id order by t_us rows between unbounded preceding and 1 preceding) as lo from l)
 select user_id, arg_min(damage, t_us) as damage, arg_min(t_us > {2 * SECOND} or coalesce(lo < damage, false), t_us) as lower_bound from s where damage = nx group by 1""",
        "stable_runs": f"""{w}, d as (select * from hud where damage is not null), c as (select *, case when damage = lag(damage) over (partition by user_id order by t_us) then 0 else 1 end as c, max(damage) over (partition by user_id order by t_us rows unbounded preceding) as top from d),
 r as (select user_id, damage, min(t_us) as a, max(t_us) as z, count(*) as n, max(top) as top from (select *, sum(c) over (partition by user_id order by t_us rows unbounded preceding) as g from c) group by user_id, g, damage having count(*) >= 3 and max(t_us) - min(t_us) >= {2 * SECOND} and max(top) = damage)
 select user_id, arg_min(damage, a) as damage, min(a) as from_us, arg_min(z, a) as to_us from r group by 1""",
        "endpoint_changes": f"""{w}, n as (select user_id, kills, max(t_us) as t from hud where kills is not null group by 1, 2 having count(*) >= 2), s as (select user_id, arg_max(kills, t) as sure from n group by 1), x as (select hud.*, sure from hud join s using (user_id) where kills is not null),
 o as (select user_id, max(t_us) filter (kills <> sure) as last_other from x group by 1) select x.user_id, min(t_us) filter (kills = sure and (last_other is null or t_us > last_other)) as changed_at, arg_max(kills, t_us) as latest, arg_max(kills, t_us) <> any_value(sure) as unconfirmed, max(kills) > any_value(sure) as regressed from x join o using (user_id) group by 1""",
        "agreed_numbers": f"""{w}, r as (select user_id, frame // 3 as view, case when event_id % 31 = 0 then null else event_id % 3 end as v, 0.8 + (event_id % 20) / 100.0 as c from hud), ok as (select * from r where v is not null and c >= 0.82),
 n as (select user_id, view, v, count(*) as k from ok group by 1, 2, 3), t as (select user_id, view, max(k) as k from n group by 1, 2), b as (select n.* from n join t using (user_id, view, k) where k >= 2 qualify count(*) over (partition by user_id, view) = 1)
 select ok.user_id, ok.view, ok.v::varchar as agreed, round(c::double, 6) as confidence from ok join b on ok.user_id = b.user_id and ok.view = b.view and ok.v = b.v qualify row_number() over (partition by ok.user_id, ok.view order by c desc) = 2""",
        "unanimous_weapons": f"{w}, x as (select user_id, frame // 6 as part, 'w' || ((frame // 40) % 4) as wid, 0.8 + (event_id % 20) / 100.0 as c from hud where event_id % 2 = 0) select user_id, part, min(wid) as agreed, count(*) as votes, round(min(c)::double, 6) as confidence from x group by 1, 2 having min(wid) = max(wid) and count(*) >= 2",
        "neighbour_bounds": f"{w} select h.user_id, h.t_us, (select max(t_us) from hud m where m.user_id = h.user_id and m.event_id % 3 = 0 and m.t_us < h.t_us) as previous_us, (select min(t_us) from hud m where m.user_id = h.user_id and m.event_id % 3 = 0 and m.t_us > h.t_us) as following_us from hud h where event_id % 5 = 2",
        "round_numbers": f"{seg}, {outc} select user_id, start_us, (select count(*) from outc where outc.user_id = seg.user_id and outc.t_us <= seg.start_us) as round_index from seg",
        "next_reading": f"{w}, a as (select user_id, t_us - 100000 as t_us from hud where event_id % 6 = 1) select a.*, (select min(t_us) from hud where hud.user_id = a.user_id and hud.t_us >= a.t_us and hud.t_us - a.t_us < 150000) as read_us from a",
        "grid_ranges": f"""{w}, {LEN}, p as (select user_id, greatest(0, t_us - {SECOND}) as s, least(duration_us, t_us + {SECOND}) as e, duration_us from hud join dur using (user_id) where event_id % 12 = 0),
 f as (select distinct user_id, unnest(generate_series(greatest(1, ceil(s / 1e6 * 2 + 0.5))::bigint, least(greatest(1, floor(duration_us / 1e6 * 2 + 0.5)), floor(e / 1e6 * 2 + 0.5))::bigint)) as n from p)
 select user_id, min(n) as first, max(n) as last from (select *, n - row_number() over (partition by user_id order by n) as k from f) group by user_id, k""",
    }
