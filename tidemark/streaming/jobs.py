"""Recognition jobs as a log of commands: the state of every field of every clip is what its commands, in order, make of it.

A command is (job, seq, command, clip, fields, signature, source, input, complete, receipt, error): create, claim, commit, fail, pause
or resume. Those of a job as a whole (pause, resume without a clip) are dealt to its clips first. A command that its fields' state
does not allow is refused as a whole and changes nothing. The same step runs over a table and over a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import scan

COMMANDS = "job string, seq long, command string, clip string, fields array<string>, signature string, source string, input string, complete boolean, receipt string, error string"
CHANGES = "job string, clip string, field string, seq long, state string, receipt string, reason string, refused string"


def step(state: dict | None, row: dict) -> tuple[dict, list[tuple]]:
    """state: field -> [state, signature, source, input, complete, receipt, invalidated]."""
    now = dict(state or {})
    what, seq = row["command"], row["seq"]
    fields = list(dict.fromkeys(row["fields"] or []))
    told = lambda f, reason=None: (row["job"], row["clip"], f, seq, now[f][0], now[f][5], reason, None)
    refuse = lambda why: (now, [(row["job"], row["clip"], f, seq, now[f][0] if f in now else None, None, None, why) for f in fields or [None]])
    if what == "create":
        if not row["source"]:
            return refuse("a source identity is required")
        fresh = [f for f in fields if f not in now]
        for f in fresh:
            now[f] = ["pending", row["signature"], row["source"], row["input"], bool(row["complete"]), None, None]
        return now, [told(f) for f in fresh]
    if what in ("claim", "commit", "fail"):
        if not fields or any(f not in now for f in fields):
            return refuse("unknown fields")
        states = {now[f][0] for f in fields}
        if what == "claim":
            if not states <= {"pending", "failed"}:
                return refuse("already running or committed")
            if any(now[f][6] == "source-or-field-unavailable" or not now[f][4] for f in fields):
                return refuse("source, field or algorithm is missing")
        if what == "commit" and (states != {"inflight"} or not row["receipt"]):
            return refuse("only claimed fields with a receipt are committed")
        if what == "fail" and "done" in states:
            return refuse("a committed field cannot fail")
        for f in fields:
            item = list(now[f])
            item[0] = {"claim": "inflight", "commit": "done", "fail": "failed"}[what]
            item[5] = row["receipt"] if what == "commit" else None
            item[6] = None if what == "claim" else item[6]
            now[f] = item
        return now, [told(f, row["error"] if what == "fail" else None) for f in fields]
    if what == "pause":
        running = [f for f in now if now[f][0] == "inflight"]
        for f in running:
            now[f] = ["pending", *now[f][1:]]
        return now, [told(f, "paused") for f in running]
    if what == "resume":
        out = []
        for f, item in list(now.items()):
            reason = None
            if not row["source"] or f not in fields:
                reason = "source-or-field-unavailable"
            elif item[2] != row["source"]:
                reason = "source-changed"
            elif item[3] != row["input"]:
                reason = "field-input-changed"
            elif item[1] != row["signature"] or not (item[4] and row["complete"]):
                reason = "algorithm-changed"
            new = ["pending", *item[1:5], None, reason] if reason else [item[0] if item[0] == "done" else "pending", *item[1:6], None]
            if reason != "source-or-field-unavailable":
                new[1:5] = [row["signature"], row["source"], row["input"], bool(row["complete"])]
            if new[0] != item[0] or reason:
                now[f] = new
                out.append(told(f, reason))
            now[f] = new
        return now, out
    return refuse("unknown command")


def dealt(commands: DataFrame) -> DataFrame:
    """commands with those of a whole job given to each of its clips."""
    clips = commands.where("command = 'create'").select("job", F.col("clip").alias("_clip")).distinct()
    whole = commands.where("clip is null").join(clips, "job").withColumn("clip", F.col("_clip")).drop("_clip")
    return commands.where("clip is not null").unionByName(whole.select(*commands.columns))


def changes(commands: DataFrame) -> DataFrame:
    """(CHANGES) of every command in order: the fields' new states, and refusals with their reason."""
    return scan(dealt(commands), ["job", "clip"], ["seq"], step, CHANGES)


def states(changed: DataFrame) -> DataFrame:
    """(job, clip, field, state, receipt, reason) as the last change left them."""
    last = changed.where("refused is null").groupBy("job", "clip", "field").agg(F.max_by(F.struct("state", "receipt", "reason"), "seq").alias("s"))
    return last.select("job", "clip", "field", "s.*")


def summary(now: DataFrame) -> DataFrame:
    """(job, clips, completed_clips, pending, inflight, done, failed, completed) of each job."""
    by_clip = now.groupBy("job", "clip").agg(F.bool_and(F.col("state") == "done").alias("all_done"), *[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "inflight", "done", "failed")])
    sums = [F.sum(s).alias(s) for s in ("pending", "inflight", "done", "failed")]
    return by_clip.groupBy("job").agg(F.count("*").alias("clips"), F.count_if("all_done").alias("completed_clips"), *sums, F.bool_and("all_done").alias("completed"))


def requests(now: DataFrame, folders: DataFrame) -> DataFrame:
    """(job, directory, fields, files) of the work left: clips of a folder with the same open fields are one request. A request's
    files are listed in one row, as the reader takes them; folders (clip, directory, file)."""
    left = now.where(F.col("state").isin("pending", "failed")).groupBy("job", "clip").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    return left.join(folders, "clip").groupBy("job", "directory", "fields").agg(F.array_sort(F.collect_list("file")).alias("files"))


def covered(now: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (job, clip, field, signature, source) that the saved states of a job do not cover: a job may be reused if none is left."""
    return wanted.join(now.select("job", "clip", "field", "signature", "source"), ["job", "clip", "field", "signature", "source"], "left_anti")


def finished_groups(now: DataFrame, groups: DataFrame) -> DataFrame:
    """(job, group, ready): whether all inputs of a finalisation group (job, group, clip, field) are committed."""
    return groups.join(now, ["job", "clip", "field"], "left").groupBy("job", "group").agg(F.bool_and(F.coalesce(F.col("state") == "done", F.lit(False))).alias("ready"))


def commit_if_unchanged(table: DataFrame, prepared: DataFrame, keys: list[str], value: str, version: str) -> DataFrame:
    """table with the prepared values of rows whose version still is the one they were prepared from; ``refused`` tells the others."""
    p = prepared.select(*keys, F.col(value).alias("_value"), F.col(version).alias("_from"))
    out = table.join(p, keys, "left")
    ok = F.col("_from").isNotNull() & F.col("_from").eqNullSafe(F.col(version))
    return out.select(*[F.when(ok, F.col("_value")).otherwise(F.col(c)).alias(c) if c == value else F.col(c) for c in table.columns], (F.col("_from").isNotNull() & ~ok).alias("refused"))


def live_changes(commands: DataFrame) -> DataFrame:
    """changes over a stream of commands that name their clip; the state of a clip is kept between micro-batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        now, out = json.loads(state.get[0]) if state.exists else None, []
        for row in rows.to_dict("records"):
            row = {k: None if not isinstance(v, (list,)) and not hasattr(v, "__len__") and pd.isna(v) else v for k, v in row.items()}
            row["fields"] = None if row["fields"] is None else list(row["fields"])
            now, put = step(now, row)
            out += put
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")]).astype({"seq": "int64"})

    return commands.groupBy("job", "clip").applyInPandasWithState(run, CHANGES, "state string", "append", "NoTimeout")


# --- progress of a run


def progress(events: DataFrame, key: str, time: str) -> DataFrame:
    """(key, state, stage, progress, message, failures) of each run after all its events: last writer wins, progress within a stage
    only grows. events: (key, time, type, stage, progress, message, failures, total)."""
    from pyspark.sql.window import Window

    states_ = {"run": "running", "file": "running", "stopped": "stopped", "fatal": "failed", "close-request": "stopping"}
    e = events.withColumn("_o", F.struct(time, "type"))
    failed = F.when((F.col("failures") > 0) & (F.col("total") > 0) & (F.col("failures") >= F.col("total")), "failed").when(F.col("failures") > 0, "completed_with_errors").otherwise("completed")
    state = F.when(F.col("type") == "done", failed)
    for name, value in states_.items():
        state = state.when(F.col("type") == name, value)
    stage = F.when(F.col("type") == "stage", F.col("stage")).when(F.col("type").isin("error", "fatal"), "error").when(F.col("type") == "stopped", "stopped").when(F.col("type") == "done", F.when(F.col("failures") > 0, "error").otherwise("completed"))
    w = Window.partitionBy(key).orderBy(time, "type")
    starts = F.col("type").isin("stage", "file", "result", "done")
    e = e.withColumn("_part", F.count_if(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    value = F.when(F.col("type") == "file", 0.0).when(F.col("type").isin("result", "done"), 100.0).when(F.col("type").isin("stage", "progress", "log"), F.col("progress"))
    top = e.withColumn("_v", value).groupBy(key, "_part").agg(F.max("_v").alias("v")).groupBy(key).agg(F.max_by("v", "_part").alias("progress"))
    last = lambda c, name: F.max_by(c, F.when(c.isNotNull(), F.col("_o"))).alias(name)
    out = e.groupBy(key).agg(last(state, "state"), last(stage, "stage"), last(F.col("message"), "message"), F.max("failures").alias("failures"))
    return out.join(top, key).select(key, "state", "stage", "progress", "message", "failures")


# The forms of the log lines that tell progress.
SAMPLED, READ, MARK = r"画面采样: ([\d.]+)%", r"OCR: ([\d.]+)s / ([\d.]+)s", r"SMART_PROGRESS: ([\d.]+)"


def log_progress(line, stage, start, end):
    """Progress that a log line tells of its stage, between ``start`` and ``end``; null where it tells none."""
    number = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit("")).cast("double")
    share = F.when(stage == "sample", number(SAMPLED, 1) / 100).when(stage == "numeric", number(READ, 1) / F.nullif(number(READ, 2), F.lit(0.0)))
    return F.when(stage == "smart", number(MARK, 1)).otherwise(start + (end - start) * share)


def throughput(samples: DataFrame, key: str, time: str, done: str, total: str, window_us: int = 60_000_000, least_us: int = 3_000_000) -> DataFrame:
    """samples with ``speed`` (per second, over the last minute) and ``eta`` (seconds left); null where too little has been seen."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(time).rangeBetween(-window_us, 0)
    first_t, first_n, seen = F.min(time).over(w), F.first(done).over(w), F.count("*").over(w)
    span = F.col(time) - first_t
    gain = F.col(done) - first_n
    s = samples.withColumn("speed", F.when((seen > 2) & (span >= least_us) & (gain > 0), gain / (span / 1e6)))
    return s.withColumn("eta", F.greatest(F.lit(0), F.col(total) - F.col(done)) / F.col("speed"))


def active_seconds(marks: DataFrame, keys: list[str], time: str, kind: str) -> DataFrame:
    """(keys, seconds): the time between each begin and the mark after it (end, pause or another begin), summed; an open one adds none."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys).orderBy(time)
    spans = marks.withColumn("_next", F.lead(time).over(w)).where((F.col(kind) == "begin") & F.col("_next").isNotNull())
    return spans.groupBy(*keys).agg((F.sum(F.col("_next") - F.col(time)) / 1e6).alias("seconds"))
