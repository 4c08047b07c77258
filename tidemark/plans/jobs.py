"""Named queries on jobs, progress and tracks, over commands, messages and result lines made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import rounded
from ..operators import tracks
from ..session import ship
from ..streaming import jobs
from .catalogue import _t
from .recordings import HUD, hud

SECOND = 1_000_000


def commands(spark, sf_dir) -> DataFrame:
    """Every order is a clip of its customer's job: it is created, then its line items are commands on its fields."""
    o = _t(ship(spark), sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("j"))
    job, clip = F.concat(F.lit("j"), F.col("j").cast("string")), F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    fields = F.array(F.lit("hero"), F.lit("rank"), F.lit("weapons"))
    made = o.select(job.alias("job"), F.lit(0).cast("long").alias("seq"), F.lit("create").alias("command"), clip.alias("clip"), fields.alias("fields"), F.lit("s1").alias("signature"), F.lit("id1").alias("source"), none.alias("input"), (F.col("o_orderkey") % 17 > 0).alias("complete"), none.alias("receipt"), none.alias("error"))
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate") % 1_000_000_007).alias("h")).join(o.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
    clip_l, k = F.concat(F.lit("c"), F.col("l_orderkey").cast("string")), F.abs(F.col("h"))
    what = F.element_at(F.array(*map(F.lit, ("claim", "claim", "commit", "fail", "resume", "claim", "commit"))), (k % 7 + 1).cast("int"))
    some = F.slice(fields, F.lit(1), (F.col("l_partkey") % 3 + 1).cast("int"))
    acts = li.select(job.alias("job"), (k + 2_000_000_000).alias("seq"), what.alias("command"), clip_l.alias("clip"), F.when(what == "resume", fields).otherwise(some).alias("fields"), F.when(k % 5 == 0, "s2").otherwise("s1").alias("signature"), F.when(k % 11 == 0, "id2").otherwise("id1").alias("source"), none.alias("input"), F.lit(True).alias("complete"), F.when(k % 4 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("receipt"), F.lit("failed").alias("error")).dropDuplicates(["job", "clip", "seq"])
    stop = o.select("j").distinct().select(job.alias("job"), F.lit(2_500_000_000).alias("seq"), F.lit("pause").alias("command"), none.alias("clip"), F.lit(None).cast("array<string>").alias("fields"), none.alias("signature"), none.alias("source"), none.alias("input"), F.lit(None).cast("boolean").alias("complete"), none.alias("receipt"), none.alias("error"))
    return made.unionByName(acts).unionByName(stop)


def job_changes(spark, sf_dir):
    return jobs.changes(commands(spark, sf_dir))


def job_states(spark, sf_dir):
    return jobs.states(job_changes(spark, sf_dir))


def job_summary(spark, sf_dir):
    return jobs.summary(job_states(spark, sf_dir))


def job_requests(spark, sf_dir):
    folders = _t(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("clip"), F.concat(F.lit("d"), (F.col("o_orderkey") % 3).cast("string")).alias("directory"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file"))
    r = jobs.requests(job_states(spark, sf_dir), folders)
    return r.select("job", "directory", F.concat_ws(",", "fields").alias("fields"), F.concat_ws(",", "files").alias("files"))


def job_groups(spark, sf_dir):
    now = job_states(spark, sf_dir)
    return jobs.finished_groups(now, now.select("job", "field", "clip", F.substring("clip", -1, 1).alias("group")))


def _messages(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("run", "file", "stage", "progress", "log", "progress", "result", "error", "stage", "progress", "done", "stopped", "log"))), (k % 13 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("user_id", k.alias("at"), kind.alias("type"), F.when(kind == "stage", F.concat(F.lit("s"), (k % 4).cast("string"))).alias("stage"), F.when(k % 3 > 0, (k % 100).cast("double")).alias("progress"), F.when(k % 4 == 0, F.concat(F.lit("m"), k.cast("string"))).alias("message"), F.when(kind == "done", k % 3).alias("failures"), F.lit(2).alias("total"))


def run_progress(spark, sf_dir):
    return jobs.progress(_messages(spark, sf_dir), "user_id", "at")


def log_progress(spark, sf_dir):
    k = F.col("event_id")
    line = F.when(k % 4 == 0, F.concat(F.lit("画面采样: "), (k % 100).cast("string"), F.lit(".5%"))).when(k % 4 == 1, F.concat(F.lit("OCR: "), (k % 50).cast("string"), F.lit("s / "), (k % 5 * 20).cast("string"), F.lit(".0s"))).when(k % 4 == 2, F.concat(F.lit("SMART_PROGRESS: "), (k % 77).cast("string"))).otherwise(F.lit("other"))
    stage = F.element_at(F.array(*map(F.lit, ("sample", "numeric", "smart"))), (k % 3 + 1).cast("int"))
    return _t(spark, sf_dir, "events").select("event_id", F.round(jobs.log_progress(line, stage, F.lit(10.0), F.lit(60.0)), 6).alias("progress"))


def throughput(spark, sf_dir):
    rows = hud(spark, sf_dir).select("user_id", "t_us", F.col("frame").alias("done")).withColumn("total", F.lit(100))
    out = jobs.throughput(rows, "user_id", "t_us", "done", "total", 6 * SECOND, 2 * SECOND)
    return out.select("user_id", "t_us", rounded(F.col("speed"), 6).alias("speed"), rounded(F.col("eta"), 4).alias("eta"))


def active_seconds(spark, sf_dir):
    marks = hud(spark, sf_dir).select("user_id", "t_us", F.when(F.col("event_id") % 3 == 0, "begin").otherwise("end").alias("kind"))
    return jobs.active_seconds(marks, ["user_id"], "t_us", "kind").select("user_id", F.round("seconds", 6).alias("seconds"))


def lines(spark, sf_dir) -> DataFrame:
    """Result lines at the readings' times; a few names, some misread."""
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("PlayerOne", "P1ayerOne", "SecondName", "Second Nane", "ab", ""))), (k % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("knock", "assist", "elimination"))), (k % 3 + 1).cast("int"))
    action = F.when(kind == "assist", F.when(k % 2 == 0, "knock").otherwise("elimination")).otherwise(kind)
    return hud(spark, sf_dir).select("user_id", "t_us", kind.alias("kind"), action.alias("action"), name.alias("target"), (F.lit(0.8) + (k % 20) / 100).alias("confidence"), (F.col("frame") - F.col("frame") % 2).alias("frame"), (k % 5 * 6).cast("double").alias("x"), (k % 2 * 4).cast("double").alias("y"))


def result_tracks(spark, sf_dir):
    return tracks.unique_tracks(lines(spark, sf_dir), "user_id")


def lines_seen_twice(spark, sf_dir):
    return tracks.two_frames(lines(spark, sf_dir), "user_id")


def assist_pairs(spark, sf_dir):
    rows = lines(spark, sf_dir).where("kind = 'assist'").select("user_id", "t_us", F.col("t_us").alias("last_us"), "action", F.concat(F.lit("t"), (F.floor("frame").cast("long") % 3).cast("string")).alias("target"))
    return tracks.pair_phases(rows, "user_id")


def fight_starts(spark, sf_dir):
    rows = hud(spark, sf_dir)
    k = F.col("event_id")
    signals = rows.where("event_id % 3 > 0").select("user_id", "t_us", F.when(k % 3 == 1, "shoot").otherwise("hit").alias("kind"), F.lit(0).cast("long").alias("before"), (k % 4).alias("after"))
    results = lines(spark, sf_dir).where("t_us % 4 = 0").select("user_id", "t_us", "kind", "target")
    return tracks.fight_starts(results, signals, "user_id")


QUERIES = (job_changes, job_states, job_summary, job_requests, job_groups, run_progress, log_progress, throughput, active_seconds, result_tracks, lines_seen_twice, assist_pairs, fight_starts)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "log_progress": "select event_id, round(case when event_id % 3 = 2 then case when event_id % 4 = 2 then (event_id % 77)::double end else 10 + 50 * case when event_id % 3 = 0 and event_id % 4 = 0 then (event_id % 100 + 0.5::double) / 100 when event_id % 3 = 1 and event_id % 4 = 1 then (event_id % 50)::double / nullif(event_id % 5 * 20, 0) end end, 6) as progress from events",
        "active_seconds": f"with {HUD}, n as (select user_id, t_us, event_id % 3 = 0 as b, lead(t_us) over (partition by user_id order by t_us) as nx from hud) select user_id, round(sum(nx - t_us) / 1e6::double, 6) as seconds from n where b and nx is not null group by 1",
        "throughput": f"with {HUD}, w as (select user_id, t_us, frame, min(t_us) over w as t0, min(frame) over w as f0, count(*) over w as n from hud window w as (partition by user_id order by t_us range between {6 * SECOND} preceding and current row)), s as (select *, case when n > 2 and t_us - t0 >= {2 * SECOND} and frame > f0 then (frame - f0) / ((t_us - t0) / 1e6::double) end as sp from w) select user_id, t_us, round(sp, 6) as speed, round(greatest(0, 100 - frame) / sp, 4) as eta from s",
        "run_progress": """with k as (select ['run','file','stage','progress','log','progress','result','error','stage','progress','done','stopped','log'] as ks), m as (select user_id, event_id as i, ks[event_id % 13 + 1] as type, event_id % 4 as s, case when event_id % 3 > 0 then (event_id % 100)::double end as p, case when event_id % 4 = 0 then 'm' || event_id end as msg, event_id % 3 as f from events, k),
 x as (select *, sum((type in ('stage', 'file', 'result', 'done'))::int) over (partition by user_id order by i rows unbounded preceding) as part,
  case when type = 'done' then case when f >= 2 then 'failed' when f > 0 then 'completed_with_errors' else 'completed' end when type in ('run', 'file') then 'running' when type = 'stopped' then 'stopped' end as st,
  case when type = 'stage' then 's' || s when type = 'error' then 'error' when type = 'stopped' then 'stopped' when type = 'done' then case when f > 0 then 'error' else 'completed' end end as sg,
  case when type = 'file' then 0.0 when type in ('result', 'done') then 100.0 when type in ('stage', 'progress', 'log') then p end as v from m),
 t as (select user_id, part, max(v) as v from x group by 1, 2), tv as (select user_id, arg_max(v, part) filter (part is not null) as progress, arg_max(case when v is null then -1 else v end, part) as pv from t group by 1)
 select x.user_id, arg_max(st, i) filter (st is not null) as state, arg_max(sg, i) filter (sg is not null) as stage, nullif(any_value(pv), -1) as progress, arg_max(msg, i) filter (msg is not null) as message, max(case when type = 'done' then f end) as failures from x join tv using (user_id) group by 1""",
    }
