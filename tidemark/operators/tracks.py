"""Result lines seen in several frames made into tracks, paired and given the moment their fight began.

These rules depend on what they decided before, so each is one pass over a key's rows in order; a key is a segment or a recording,
cut where so much time passes that nothing can be carried over. Similarity of names is that of matching blocks (not edit distance)."""

from __future__ import annotations

import difflib
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import runs
from .scan import scan

SECOND = 1_000_000
# In microseconds; least similarities; least confidence of a line confirmed by one frame.
SAME_LINE, ASSIST_PAIR, TWO_FRAMES = 3 * SECOND, 25 * SECOND, 1_100_000
ALIKE, ALIKE_ENGLISH, SINGLE = 0.78, 0.82, 0.9


def target_key(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").upper() if c.isalnum())


def alike(a: str, b: str, least: float = ALIKE) -> bool:
    """Whether two keys are equal or, from four letters on, similar enough; empty ones never are."""
    if not a or not b:
        return False
    return a == b or (min(len(a), len(b)) >= 4 and difflib.SequenceMatcher(None, a, b).ratio() >= least)


def unique_tracks(lines: DataFrame, key: str) -> DataFrame:
    """(key, start_us, last_us, kind, action, target, confidence, frames, confirmed, single) of results that stay on screen.

    lines: (key, t_us, kind, action, target, confidence, frame, x, y). A line goes on with the latest track of its kind that was seen
    at most 3 s ago and has a like target or, if either was read unsurely or has none, the same place; an assist's elimination also
    goes on with its knock of a like target up to 25 s ago. Two frames confirm a track; so does one, read very surely, of an own knock
    or elimination. The target of a track is that of most frames, then the surest, then the first by name."""
    kind = lines.schema[key].dataType.simpleString()

    def step(state, row):
        open_, out = state or [], []
        live = [t for t in open_ if row["t_us"] - t["last"] <= ASSIST_PAIR]
        out = [done(t) for t in open_ if row["t_us"] - t["last"] > ASSIST_PAIR]
        mine, hit = target_key(row["target"]), None
        for t in reversed(live):
            gap = row["t_us"] - t["last"]
            pair = row["kind"] == "assist" and row["action"] == "elimination" and t["action"] == "knock"
            if t["kind"] != row["kind"] or not (gap <= SAME_LINE or pair):
                continue
            there = None not in (t["x"], t["y"], row["x"], row["y"]) and abs(t["x"] - row["x"]) <= 8 and abs(t["y"] - row["y"]) <= 5
            unsure = not t["key"] or not mine or min(t["confidence"], row["confidence"]) < SINGLE
            if alike(t["key"], mine) or (gap <= SAME_LINE and there and unsure):
                hit = t
                break
        if hit is None:
            hit = {"id": row[key], "start": row["t_us"], "kind": row["kind"], "action": row["action"], "key": mine, "x": row["x"], "y": row["y"], "confidence": 0.0, "reads": {}}
            live.append(hit)
        hit["last"] = row["t_us"]
        hit["confidence"] = max(hit["confidence"], row["confidence"])
        hit["key"] = hit["key"] or mine
        if row["action"] == "elimination":
            hit["action"] = "elimination"
        old = hit["reads"].get(row["frame"])
        if row["frame"] is not None and (old is None or row["confidence"] > old[1]):
            hit["reads"][row["frame"]] = (row["target"] or "", row["confidence"])
        return live, out

    def done(t):
        n, votes = len(t["reads"]), {}
        for name, c in t["reads"].values():
            if name:
                v = votes.setdefault(name, [0, 0.0])
                v[0] += 1
                v[1] = max(v[1], c)
        best = min(votes, key=lambda k: (-votes[k][0], -votes[k][1], k), default="")
        single = n < 2 and t["kind"] in ("knock", "elimination") and t["confidence"] >= SINGLE
        return (t["id"], t["start"], t["last"], t["kind"], t["action"], best, t["confidence"], n, n >= 2 or single, single)

    cols = [key, "t_us", "kind", "action", "target", "confidence", "frame", "x", "y"]
    out = f"{key} {kind}, start_us long, last_us long, kind string, action string, target string, confidence double, frames long, confirmed boolean, single boolean"
    dealt = runs(lines.select(*cols), [key], "t_us", ASSIST_PAIR)
    return scan(dealt, [key, "_run"], ["t_us", "kind", "target", "frame"], step, out, lambda s: [done(t) for t in s])


def two_frames(lines: DataFrame, key: str, least: float = ALIKE) -> DataFrame:
    """lines with ``seen_twice``: another frame at most 1.1 s away shows a line of the kind with a like target. State is the lines of
    the last 1.1 s; a line is put out when no later one can confirm it."""
    kind = lines.schema[key].dataType.simpleString()
    target = "target string"

    def step(state, row):
        now = state or []
        out = [flat(x) for x in now if row["t_us"] - x["t"] > TWO_FRAMES]
        now = [x for x in now if row["t_us"] - x["t"] <= TWO_FRAMES]
        mine = {"k": row[key], "t": row["t_us"], "kind": row["kind"], "target": row["target"], "key": target_key(row["target"]), "twice": False}
        for x in now:
            if x["t"] != mine["t"] and x["kind"] == mine["kind"] and alike(x["key"], mine["key"], least):
                x["twice"] = mine["twice"] = True
        return [*now, mine], out

    flat = lambda x: (x["k"], x["t"], x["kind"], x["target"], x["twice"])
    dealt = runs(lines.select(key, "t_us", "kind", "target"), [key], "t_us", TWO_FRAMES)
    return scan(dealt, [key, "_run"], ["t_us", "kind", "target"], step, f"{key} {kind}, t_us long, kind string, {target}, seen_twice boolean", lambda s: [flat(x) for x in s])


def pair_phases(events: DataFrame, key: str) -> DataFrame:
    """(key, target, knock_us, elimination_us) of assists whose knock and elimination have the same target at most 25 s apart: each
    elimination takes the latest knock no other has taken. events: (key, t_us, last_us, action, target)."""
    kind = events.schema[key].dataType.simpleString()

    def step(state, row):
        open_ = [x for x in state or [] if row["t_us"] - x[1] <= ASSIST_PAIR]
        if row["action"] == "knock":
            return [*open_, (row["t_us"], row["last_us"] if row["last_us"] is not None else row["t_us"])], []
        if row["action"] == "elimination":
            for i in range(len(open_) - 1, -1, -1):
                if row["t_us"] > open_[i][1]:
                    return open_[:i] + open_[i + 1 :], [(row[key], row["target"], open_[i][0], row["t_us"])]
        return open_, []

    named = events.where("target is not null and target <> ''").select(key, "t_us", "last_us", "action", "target")
    return scan(named, [key, "target"], ["t_us", "action"], step, f"{key} {kind}, target string, knock_us long, elimination_us long")


def fight_starts(results: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """results (key, t_us, kind, target) with start_us and basis: when the fight behind a result began.

    An elimination takes over the start of a knock of the same target at most 120 s ago. Else the burst of shots (3 s apart at
    most) that ends at most 12 s before counts, then such a chain of hits that ends at most 3 s before, else one second before.
    No start lies before the last result of the kind, and shots up to the last result on another target don't count. signals: (key,
    t_us, kind, before, after) of one recording; both are one stream, read in order."""
    kind = results.schema[key].dataType.simpleString()
    fired = signals.where((F.col("kind") == "shoot") | ((F.col("kind") == "hit") & (F.col("after") > F.coalesce("before", F.lit(0)))))
    stream = fired.select(key, "t_us", F.col("kind").alias("signal"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(0).alias("_s"))
    stream = stream.unionByName(results.select(key, "t_us", F.lit(None).cast("string").alias("signal"), "kind", "target", F.lit(1).alias("_s")))

    def chain(times, low, reach, now):
        """Start of the last run of times, 3 s apart at most, from ``low`` on, if it ends within ``reach`` of now."""
        some = [t for t in times if t >= low and t <= now]
        if not some or now - some[-1] > reach:
            return None
        i = len(some) - 1
        while i and some[i] - some[i - 1] <= 3 * SECOND:
            i -= 1
        return some[i]

    def step(state, row):
        st = state or {"shoot": [], "hit": [], "last": {}, "knocks": [], "past": []}
        t = row["t_us"]
        if row["_s"] == 0:
            own = st[row["signal"]]
            if own and t - own[-1] > 12 * SECOND:
                own.clear()
            own.append(t)
            return st, []
        name = unicodedata.normalize("NFKC", row["target"] or "").upper()
        prior = st["last"].get(row["kind"])
        floor = max(0, min(t, prior + 1000) if prior is not None else 0)
        start = basis = None
        if row["kind"] == "elimination" and name:
            knock = next((k for k in reversed(st["knocks"]) if k[1] == name and t - k[0] <= 120 * SECOND), None)
            if knock and knock[2] >= floor:
                start, basis = knock[2], knock[3]
        other = next((p[0] for p in reversed(st["past"]) if p[0] < t and (not name or not p[1] or p[1] != name)), None)
        low = floor if other is None else max(floor, other + 1)
        if start is None:
            start = chain(st["shoot"], low, 12 * SECOND, t)
            basis = "shoot" if start is not None else None
        if start is None:
            near = [x for x in st["shoot"] if low <= x <= t]
            start = chain(st["hit"], low, 3 * SECOND, t) if not near or t - near[-1] > 12 * SECOND else None
            basis = "hit" if start is not None else None
        if start is None:
            start, basis = t - SECOND, "near_result"
        start = max(floor, min(t, start))
        st["last"][row["kind"]] = t if prior is None or t > prior else prior
        st["past"] = [p for p in st["past"] if t - p[0] <= 120 * SECOND] + [(t, name)]
        if row["kind"] == "knock":
            st["knocks"] = [k for k in st["knocks"] if t - k[0] <= 120 * SECOND] + [(t, name, start, basis)]
        return st, [(row[key], t, row["kind"], row["target"], start, basis)]

    return scan(stream, [key], ["t_us", "_s", "kind", "target"], step, f"{key} {kind}, t_us long, kind string, target string, start_us long, basis string")
