"""Operators on recordings against plain loops over the same readings."""

import base64
from collections import defaultdict

import numpy as np
import pytest

from tidemark.plans import recordings as R

DIR = "/root/testdata/sf0.001"
S = 1_000_000


@pytest.fixture(scope="module")
def streams(spark):
    out = defaultdict(list)
    for r in R.hud(spark, DIR).collect():
        out[r.user_id].append(r.asDict())
    for rows in out.values():
        rows.sort(key=lambda r: r["t_us"])
    return dict(out)


def got(spark, name, cols=None):
    df = R.queries()[name](spark, DIR)
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def want(streams, loop):
    return sorted((x for u, rows in streams.items() for x in loop(u, rows)), key=repr)


def merged(pieces):
    out = []
    for a, b in sorted(pieces):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b >= a:
            out.append([a, b])
    return [tuple(x) for x in out]


def dice(a, b):
    x, y = (np.unpackbits(np.frombuffer(base64.b64decode(z), np.uint8)) for z in (a, b))
    return 2 * int((x & y).sum()) / max(int(x.sum()) + int(y.sum()), 1)


def confirmed(rows, field):
    out = []
    for i, r in enumerate(rows):
        if r["inactive"] or r[field] is None:
            continue
        near = rows[max(0, i - 2) : i + 3]
        if sum(q[field] == r[field] and abs(q["t_us"] - r["t_us"]) <= 1.1 * S for q in near) >= 2:
            out.append((r["t_us"], r[field]))
    return out


def fired(rows):
    out, old = [], None
    for r in rows:
        if r["inactive"]:
            old = None
        elif r["ammo"] is not None:
            if old and r["t_us"] - old["t_us"] <= 1.1 * S and 1 <= old["ammo"] - r["ammo"] <= 50:
                same = dice(old["icon"], r["icon"]) >= 0.65
                for c in ("weapon_id", "slot"):
                    same = same and (old[c] is None or r[c] is None or old[c] == r[c])
                out.append((r["t_us"], old["ammo"], r["ammo"], same))
            old = r
    return out


def own_events(u, rows):
    out, waiting = [], []
    for field, kind, most in (("damage", "hit", 1000), ("kills", "kill", 3)):
        base = None
        seen = confirmed(rows, field)
        for t, v in seen:
            if base:
                b, bt = base
                if t - bt <= 20 * S and b < v <= b + most:
                    steps = [(k, k + 1) for k in range(b, v)] if kind == "kill" else [(b, v)]
                    out += [(u, t, kind, x, y, f"own_{field}_counter") for x, y in steps]
                if t - bt > 20 * S and v > 0 and any(bt < r["t_us"] < t and r["round_ended"] for r in rows):
                    waiting.append((u, t, kind, 0, v, "new_round_counter"))
            if base is None or t - base[1] > 20 * S or 0 <= v - base[0] <= most:
                base = (v, t)
        if seen and seen[0][1] > 0 and seen[0][0] - rows[0]["t_us"] >= 15 * S:
            waiting.append((u, seen[0][0], kind, None, seen[0][1], "own_counter_became_visible"))
    hits = [e[1] for e in out if e[2] == "hit"]
    shots = [(u, t, "shoot", a, b, "ammo_decrease") for t, a, b, same in fired(rows) if same or any(abs(h - t) <= 1.5 * S for h in hits)]
    return out + shots + [e for e in waiting if any(abs(s[1] - e[1]) <= 12 * S for s in shots)]


def test_own_events(spark, streams):
    assert got(spark, "own_events") == want(streams, own_events)


def made_events(rows):
    out = []
    for r in rows:
        i = r["event_id"]
        if i % 7 == 1:
            out.append((r["t_us"], ("hit", "shoot", "kill")[i % 3]))
    return out


def groups(times, gap):
    out = []
    for t in sorted(set(times)):
        if out and t - out[-1][-1] <= gap:
            out[-1].append(t)
        else:
            out.append([t])
    return out


def joined(pieces):
    """Segments of pieces (start, end, first, last, reasons)."""
    out = []
    for a, b, f, last, why in sorted(pieces):
        if out and a <= out[-1][1]:
            o = out[-1]
            out[-1] = [o[0], max(o[1], b), min(o[2], f), max(o[3], last), sorted({*o[4], *why})]
        else:
            out.append([a, b, f, last, sorted(why)])
    return out


def plain_segments(rows, extra=()):
    gap, pre, post = R.PARTS
    end = rows[-1]["t_us"] + 1
    pieces = [(max(0, g[0] - pre), min(end, g[-1] + post), g[0], g[-1], []) for g in groups([t for t, _ in made_events(rows)], gap)]
    return joined(pieces + [(max(0, a - pre), b, a, last, [why]) for a, b, last, _, why in extra])


def downed(rows, gap=3 * S, post=2 * S, tail=S):
    own = [bool(r["downed"]) and not r["inactive"] for r in rows]
    times = [r["t_us"] for i, r in enumerate(rows) if own[i] and sum(own[j] and abs(rows[j]["t_us"] - r["t_us"]) <= 1.1 * S for j in range(max(0, i - 2), min(len(rows), i + 3))) >= 2]
    out = []
    for g in groups(times, gap):
        last, stop = g[-1], None
        for a, b in zip(rows, rows[1:]):
            if last < a["t_us"] <= last + post and a["inactive"] and b["inactive"] and b["t_us"] - a["t_us"] <= 1.1 * S:
                stop = a["t_us"]
                break
        out.append((g[0], min(rows[-1]["t_us"] + 1, last + post if stop is None else stop + tail), last, stop, "downed_recovery_tail" if stop is None else "downed_until_terminal"))
    return out


def test_downed_spells_and_protected_segments(spark, streams):
    assert got(spark, "downed_spells") == want(streams, lambda u, rows: [(u, *x) for x in downed(rows)])
    assert got(spark, "protected_segments") == want(streams, lambda u, rows: [(u, *x) for x in plain_segments(rows, downed(rows))])


def watched(u, rows):
    end, ends = rows[-1]["t_us"] + 1, [r["t_us"] for r in rows if r["round_ended"]]
    out = []
    for a, b, f, last, why in plain_segments(rows):
        why, review = list(why), False
        seen = [r["t_us"] for r in rows if last <= r["t_us"] <= b + 2 * S and r["friend_spectate"]]
        if seen:
            over = next((t for t in ends if t >= seen[0]), None)
            back = next((r["t_us"] for r in rows if r["t_us"] > seen[0] + S and not r["inactive"]), None)
            if over is not None and (back is None or over <= back + 3 * S):
                b = max(b, min(end, over + 2 * S))
            else:
                b, review = max(b, min(end, back + 15 * S if back is not None else end)), True
            why.append("friend_team_continuation")
        if out and a <= out[-1][2]:
            o = out[-1]
            out[-1] = (u, o[1], max(o[2], b), min(o[3], f), max(o[4], last), sorted({*o[5], *why}), o[6] or review)
        else:
            out.append((u, a, b, f, last, sorted(why), review))
    return [(*x[:5], ",".join(x[5]), x[6]) for x in out]


def test_watched_segments(spark, streams):
    assert got(spark, "watched_segments", ["user_id", "start_us", "end_us", "first_signal", "last_signal", "protected_reasons", "needs_review"]) == want(streams, watched)


def idle(u, rows, keep=S // 2, fall=5):
    end = rows[-1]["t_us"] + 1
    for e in rows:
        if not e["round_ended"]:
            continue
        t = e["t_us"]
        nxt = next((r["t_us"] for r in rows if r["t_us"] > t and (r["friend_spectate"] or not r["inactive"] and (r["ammo"] is not None or r["counter_offset"] is not None))), None)
        if t % 2 == 0:
            d = [(r["t_us"], r["damage"]) for r in rows if not r["inactive"] and r["damage"] is not None]
            before, after = [v for x, v in d if x < t][-3:], [v for x, v in d if x >= (end if nxt is None else nxt)][:3]
            if len(before) < 2 or len(after) < 2 or max(after) > min(before) - fall:
                continue
        a, b = t + keep, end if nxt is None else max(0, nxt - keep)
        if b > a:
            yield u, a, b


def test_idle_after_rounds(spark, streams):
    assert got(spark, "idle_after_rounds") == want(streams, idle)


def seeds(u, rows):
    out, prev, last, shot = [], {}, None, None
    for r in rows:
        t = r["t_us"]
        lt = last and last["t_us"]
        if last and t - lt > 5 * S:
            out.append([u, lt, t, "wide_gap", None, None])
        if r["downed"] or r["friend_spectate"]:
            out.append([u, lt if last else t, t, "team_or_downed", None, None])
        if last and bool(r["inactive"]) != bool(last["inactive"]) and (last["ammo"] is not None or last["friend_spectate"]):
            out.append([u, lt, t, "view_transition", None, None])
        if r["inactive"]:
            shot = None
        else:
            for c in ("damage", "kills"):
                v, b = r[c], prev.get(c)
                if v is None:
                    continue
                if v > 0 and (b and v > b[1] or b is None and t > 15 * S):
                    out.append([u, b[0] if b else lt if last else max(0, t - 3 * S), t, c, b[1] if b else 0, v])
                elif b and v < b[1]:
                    out.append([u, max(0, t - 8 * S), t, "counter_reset_or_uncertain", None, None])
                prev[c] = (t, v)
            if r["ammo"] is not None:
                if shot and r["ammo"] < shot["ammo"] and t - shot["t_us"] <= 12 * S and dice(shot["icon"], r["icon"]) >= 0.5:
                    out.append([u, shot["t_us"], t, "ammo_change", None, None])
                shot = r
        last = r
    if not rows[0]["inactive"] and rows[0]["ammo"] is not None:
        out.append([u, 0, min(15 * S, rows[-1]["t_us"]), "recording_started_in_play", None, None])
    return out


def strength(u, rows):
    again, top = set(), {}
    for r in rows:
        for c in ("damage", "kills"):
            v = r[c]
            if r["inactive"] or v is None:
                continue
            if v == 0:
                top[c] = 0
                continue
            if c in top and v <= top[c]:
                again.add((r["t_us"], c))
            top[c] = max(v, top.get(c, v))
    return [tuple([*s[:3], "counter_rebound_or_uncertain" if (s[2], s[3]) in again else s[3], *s[4:]]) for s in seeds(u, rows)]


def test_scan_seeds(spark, streams):
    assert got(spark, "scan_seeds") == want(streams, strength)


def spans(rows, keep):
    end, down, since, out = rows[-1]["t_us"] + 1, None, None, []
    for r in rows:
        t = r["t_us"]
        if r["downed"]:
            down = t
        if r["inactive"] and (r["friend_spectate"] or down is not None and t - down <= keep) and since is None:
            since = max(0, t - 3 * S)
        if since is not None and not r["inactive"] and r["ammo"] is not None:
            out.append((since, min(end, t + 6 * S)))
            since = down = None
    return out + ([(since, end)] if since is not None else [])


def anchor_times(rows, apart):
    t = [r["t_us"] for r in rows if not r["inactive"] and (r["damage"] is not None or r["kills"] is not None)]
    kept = []
    for x in t:
        if not kept or x - kept[-1] >= apart:
            kept.append(x)
    return sorted({*kept, *t[-1:]})


def windows(rows, found, gap):
    end, g = rows[-1]["t_us"] + 1, []
    for s in sorted(found, key=lambda s: s[1]):
        if g and s[1] - g[-1][1] <= gap + 5 * S:
            g[-1][1] = max(g[-1][1], s[2])
        else:
            g.append([s[1], s[2]])
    p = [(a - 3 * S, b + 3 * S) for a, b in g] + [(0, 1.5 * S)] + [(t - S, t + S) for t in anchor_times(rows, 12 * S)]
    p += [(s[1] - 3 * S, s[2] + 6 * S) for s in found if s[3] in ("view_transition", "team_or_downed", "counter_reset_or_uncertain")]
    p += [(r["t_us"] - 3 * S, r["t_us"] + 15 * S) for r in rows if r["downed"]] + spans(rows, 15 * S)
    return merged([(max(0, a), int(min(end, b))) for a, b in p])


def test_windows(spark, streams):
    pick = lambda s: (s[4] is not None and s[4] % 7 == 0) or s[3] == "view_transition"
    assert got(spark, "evidence_windows") == want(streams, lambda u, rows: [(u, *x) for x in windows(rows, [s for s in seeds(u, rows) if pick(s)], S)])
    assert got(spark, "watched_spans") == want(streams, lambda u, rows: [(u, *x) for x in spans(rows, S)])
    assert got(spark, "counter_anchors") == want(streams, lambda u, rows: [(u, t) for t in anchor_times(rows, 3 * S)])

    def focused(u, rows):
        end, found = rows[-1]["t_us"] + 1, [s for s in seeds(u, rows) if s[1] % 5 == 0]
        strong = [s for s in found if s[3] in ("damage", "kills", "ammo_change", "recording_started_in_play")]
        patches = [(max(0, s[1] - (10 if s[3] == "team_or_downed" else 3) * S), min(end, s[2] + 6 * S)) for s in found if s not in strong]
        both = merged(windows(rows, strong, S) + patches)
        return [(u, *x) for x in merged([(a, min(end, b + 1_100_000)) for a, b in both])]

    assert got(spark, "focused_windows") == want(streams, focused)


def audit(u, rows):
    end, ends = rows[-1]["t_us"] + 1, sorted({r["t_us"] for r in rows if r["round_ended"] and r["t_us"] > 0})
    edges, found = [0, *ends, end + S], own_events(u, rows)
    for a, b in zip(edges, edges[1:]):
        for field, kind in (("damage", "hit"), ("kills", "kill")):
            seen = lambda some: [(r["t_us"], r[field]) for r in some if a <= r["t_us"] <= b and not r["inactive"] and r[field] is not None]  # noqa: B023, E731
            coarse, fine = seen([r for r in rows if r["frame"] % 4 == 0]), seen(rows)
            if not coarse:
                continue
            t, last = coarse[-1]
            near = [v for x, v in fine if abs(x - t) <= 3 * S]
            base = fine[0][1] if fine[0][0] - a < 15 * S or coarse[0][1] else 0
            add = sum(e[4] - (e[3] or 0) for e in found if e[2] == kind and a <= e[1] <= b)
            yield u, a, b, field, max(0, last - base), add, min(near) <= last <= max(near) and add >= max(0, last - base)


def test_counter_audit(spark, streams):
    assert got(spark, "counter_audit") == want(streams, audit)


def test_zero_windows_and_probes(spark, streams):
    def zero(u, rows):
        kept = []
        for r in rows:
            if r["round_ended"]:
                if kept:
                    break
                continue
            if r["inactive"] or r["friend_spectate"]:
                continue
            if (r["counter_marker_score"] or 0) >= 0.78 or kept and r["t_us"] - kept[0][1] > 20 * S:
                break
            kept.append((u, r["t_us"]))
        return kept

    def probes(u, rows):
        kept = []
        for r in rows:
            t = r["t_us"]
            if len(kept) >= 3 and t - kept[-1][1] < (2 if t - kept[0][1] <= 20 * S else 4) * S:
                continue
            if len(kept) < 12:
                kept.append((u, t))
        return kept

    assert got(spark, "zero_windows") == want(streams, zero)
    assert got(spark, "probe_moments") == want(streams, probes)


def test_segment_samples(spark, streams):
    def samples(u, rows):
        for a, b, *_ in plain_segments(rows):
            within = [r for r in rows if a <= r["t_us"] < b]
            for side, some in (("lead", within[:2]), ("tail", within[-3:]), ("before", [r for r in rows if a - 4 * S <= r["t_us"] <= a][-3:])):
                yield from ((u, r["t_us"], r["frame"], a, b, side) for r in some)

    assert got(spark, "segment_samples", ["user_id", "t_us", "frame", "start_us", "end_us", "side"]) == want(streams, samples)


def test_details_and_shot_weapons(spark, streams):
    def details(u, rows):
        parts = defaultdict(list)
        for r in rows:
            if r["weapon_id"] is not None:
                parts[r["frame"] // 6].append(r)
        for p, some in parts.items():
            if len(some) >= 2 and len({r["weapon_id"] for r in some}) == 1:
                slots = [r["slot"] for r in some if r["slot"] is not None]
                yield u, p, some[0]["weapon_id"], len(some), round(min(r["weapon_confidence"] for r in some), 6), slots[0] if len(slots) >= 2 and len(set(slots)) == 1 else None

    assert got(spark, "detail_votes", ["user_id", "part", "agreed", "votes", "confidence", "detail"]) == want(streams, details)

    def weapons(u, rows):
        trusted = {}
        for r in rows:
            same = [q for q in rows if q["weapon_id"] == r["weapon_id"] and abs(q["t_us"] - r["t_us"]) <= 1.1 * S]
            trusted[r["t_us"]] = r["weapon_id"] is not None and (r["weapon_confidence"] >= 0.9 or len(same) >= 2)
        at = {r["t_us"]: r for r in rows}
        for t, *_ in fired(rows):
            r = at[t]
            if trusted[t]:
                yield u, t, r["weapon_id"], round(r["weapon_confidence"], 3), "native_text"
                continue
            near = [q for q in rows if abs(q["t_us"] - t) <= 2 * S and trusted[q["t_us"]] and dice(q["icon"], r["icon"]) >= 0.8]
            best = max(near, key=lambda q: (q["weapon_confidence"], -q["t_us"]), default=None)
            yield (u, t, best["weapon_id"], round(best["weapon_confidence"], 3), "native_text") if best else (u, t, None, 0.0, "unknown")

    assert got(spark, "shot_weapons", ["user_id", "t_us", "weapon_id", "weapon_confidence", "weapon_method"]) == want(streams, weapons)
