"""Numbers that were read, boxes, bitmaps, paths and digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .unicode import casefold

# The letters that readers take for zeros.
ZERO_LIKE = "OØ〇"
# Traditional characters of weapon names and their simplified forms.
TRADITIONAL = "敵轉換衝鋒槍電專輕機噴獵獸擊長萊連發賓雙幫復仇標記莫彈徑"
SIMPLIFIED = "敌转换冲锋枪电专轻机喷猎兽击长莱连发宾双帮复仇标记莫弹径"


def known(x: Column) -> Column:
    """A finite number of 0 or more, else null: unknown is never 0."""
    d = x.cast("double")
    return F.when((d >= 0) & ~F.isnan(d) & (d < float("inf")), x)


def rounded(x: Column, places: int) -> Column:
    """A double to ``places`` decimals as SQL engines on doubles round: times 10 ** places, half away from zero, divided again.
    Spark's round takes the shortest decimal text instead, so the two part where a value lies next to a half."""
    scaled = F.abs(x) * float(10**places)
    whole = F.floor(scaled)
    up = (whole + (scaled - whole >= 0.5).cast("long")) / float(10**places)
    return F.when(F.isnan(x) | (scaled >= float(1 << 52)), x).when(x < 0, -up).otherwise(up)


def read_number(text: Column, confidence: Column, most: int, least: float = 0.88) -> Column:
    """The whole number a reading holds, if it is sure enough and not above ``most``; else null."""
    value = F.btrim(text).try_cast("long")
    return F.when((confidence >= least) & F.btrim(text).rlike(r"^\d+$") & (value <= most), value)


def read_ammo(text: Column, confidence: Column) -> Column:
    """Rounds left: a slashed zero is read as 日 and as letters, each under its own least confidence."""
    sun = read_number(F.replace(text, F.lit("日"), F.lit("0")), confidence, 1000, 0.67)
    letters = read_number(F.translate(text, ZERO_LIKE, "000"), confidence, 1000, 0.80)
    return F.when(text.contains("日") & (confidence >= 0.67), sun).when((confidence >= 0.80) & text.rlike(f"^[0-9{ZERO_LIKE}]+$"), letters).otherwise(read_number(text, confidence, 1000, 0.86))


def agreed_digits(text: Column, confidence: Column, other: Column, other_confidence: Column, digits: int, model: float, check: float, alone: float) -> Column:
    """struct(text, confidence) of a number that two models read alike, or one very sure of it where the other saw no digit; else ('', 0)."""
    second = F.btrim(F.coalesce(other, F.lit("")))
    usable = (text != "") & (F.length(text) <= digits) & (confidence >= model)
    pair = lambda t, c: F.struct(t.alias("text"), c.cast("double").alias("confidence"))
    both = usable & (second == text) & (other_confidence >= check)
    return F.when(both, pair(text, F.least(confidence, other_confidence))).when(usable & (confidence >= alone) & ~second.rlike(r"\d"), pair(text, confidence)).otherwise(pair(F.lit(""), F.lit(0.0)))


def finite_box(box: Column) -> Column:
    """Whether an array is a box [x1, y1, x2, y2] of finite numbers with an area."""
    fine = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(box) == 4) & fine & (F.get(box, F.lit(2)) > F.get(box, F.lit(0))) & (F.get(box, F.lit(3)) > F.get(box, F.lit(1))), F.lit(False))


def _middle(box: Column) -> Column:
    return (box[1] + box[3]) / 2


def same_slot(a: Column, b: Column) -> Column:
    """Whether two lines stand at the same place: their left edges and middles, by the first one's height."""
    height = F.greatest(a[3] - a[1], F.lit(1.0))
    return F.coalesce((F.abs(a[0] - b[0]) <= height * 1.5) & (F.abs(_middle(a) - _middle(b)) <= height * 0.6), F.lit(False))


def near_box(box: Column, hint: Column, scale_x: Column, scale_y: Column) -> Column:
    """Whether a box lies where the hint, scaled to the box's image, says."""
    x1, y1, y2 = hint[0] * scale_x, hint[1] * scale_y, hint[3] * scale_y
    font = F.greatest(y2 - y1, F.lit(1.0))
    return F.coalesce((F.abs(_middle(box) - (y1 + y2) / 2) <= F.greatest(font, F.lit(10.0))) & (F.abs(box[0] - x1) <= F.greatest(font * 0.75, F.lit(12.0))), F.lit(False))


def same_row_support(box: Column, kind: Column, matches: Column) -> Column:
    """The best score of the templates (kind, box, score) of that kind in the line's row; 0 without one."""
    fits = lambda m: (m["kind"] == kind) & (F.abs(_middle(m["box"]) - _middle(box)) <= 10) & m["box"][0].between(box[0] - 5, box[2] + 5)
    return F.coalesce(F.array_max(F.transform(F.filter(matches, fits), lambda m: m["score"])), F.lit(0.0))


def active_slot(first: Column, second: Column, margin: float = 25) -> Column:
    """Which of two slots is lit (0 or 1); null if they differ by less than the margin."""
    return F.when(F.abs(first - second) >= margin, F.when(first > second, 0).otherwise(1))


def grid_indices(start: Column, end: Column, fps: float) -> Column:
    """Numbers, from 1, of the samples of a uniform grid whose cell centres lie in [start, end) seconds."""
    first, last = F.greatest(F.lit(1), F.ceil(start * fps + 0.5)).cast("long"), (F.ceil(end * fps + 0.5) - 1).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def sample_height(width: Column, height: Column, at: int = 1280) -> Column:
    """Even height of a sample of the given width in the recording's proportions."""
    return (F.bround(at * height / width / 2) * 2).cast("long")


def bit_dice(a: Column, b: Column) -> Column:
    """Dice similarity of two bitmaps held in whole numbers; two empty ones: 0."""
    total = F.bit_count(a) + F.bit_count(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.bit_count(a.bitwiseAND(b)) / total)


def words_dice(a: Column, b: Column) -> Column:
    """bit_dice of bitmaps held as arrays of whole numbers, without leaving the JVM."""
    ones = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + F.bit_count(v))
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, v: s + v)
    return 2.0 * both / F.greatest(ones(a) + ones(b), F.lit(1))


def _dice(a: pd.Series, b: pd.Series, strict: bool, size: int) -> pd.Series:
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        if x is None or y is None or (strict and (len(x) != size or len(y) != size)):
            continue
        p, q = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (x, y))
        n = min(len(p), len(q))
        out[i] = 2 * np.count_nonzero(p[:n] & q[:n]) / max(np.count_nonzero(p) + np.count_nonzero(q), 1)
    return pd.Series(out)


def bitmap_dice(a: Column, b: Column, size: int | None = None) -> Column:
    """Dice similarity of two base64 bitmaps; with ``size`` given, 0 unless both have that many bytes. Null or no base64: 0."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return _dice(x, y, size is not None, size or 0)

    return F.pandas_udf(run, "double")(F.try_to_binary(a, F.lit("base64")), F.try_to_binary(b, F.lit("base64")))


def weapon_key(text: Column) -> Column:
    """Upper-case letters and digits of a weapon's caption, traditional characters as simplified ones."""
    from .unicode import letters_digits, nfkc

    return letters_digits(F.upper(F.translate(nfkc(text), TRADITIONAL, SIMPLIFIED)))


def path_key(path: Column) -> Column:
    """The key under which two spellings of a path are one: separators, . and .. resolved, case folded."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "(?<!^)/+", "/")
    p = F.regexp_replace(p, r"(?<=/)(?:\./)+|/\.$", "")
    return casefold(F.regexp_replace(_no_parents(p), "(?<=[^/])/$", ""))


def _no_parents(p: Column) -> Column:
    """p without .. parts that have a parent to leave; at the root they mean nothing."""
    last = lambda done: F.element_at(done, -1)
    up = lambda done: F.when(F.size(done) == 0, F.array(F.lit(".."))).when(last(done) == "..", F.concat(done, F.array(F.lit("..")))).when(last(done) == "", done).otherwise(F.slice(done, F.lit(1), F.size(done) - 1))
    step = lambda done, part: F.when(part == "..", up(done)).otherwise(F.concat(done, F.array(part)))
    return F.when(p.contains(".."), F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")).otherwise(p)


def same_path(a: Column, b: Column) -> Column:
    plain = lambda x: F.lower(F.replace(x, F.lit("\\"), F.lit("/")))
    return plain(a) == plain(b)


def inside(child: Column, parent: Column) -> Column:
    """Whether a path lies under a folder (the folder itself does not)."""
    return F.startswith(path_key(child), F.concat(path_key(parent), F.lit("/")))


def same_video(path: Column, size: Column, mtime_ms: Column, now_path: Column, now_size: Column, now_mtime_ms: Column, aliases: Column) -> Column:
    """Whether evidence about a file still is about the file as it stands: size and time equal, the path its own or a former one."""
    named = same_path(path, now_path) | F.exists(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: same_path(path, a))
    return F.coalesce((path != "") & (now_path != "") & named & (size >= 0) & (mtime_ms >= 0) & (size == now_size) & (mtime_ms == now_mtime_ms), F.lit(False))


def source_tuple(path: Column, size: Column, mtime_ns: Column, mtime_ms: Column) -> Column:
    """struct(path, size, mtime_ms) of a file's identity, nanoseconds as milliseconds; null if any part is missing or negative."""
    ms = F.when(mtime_ns.isNotNull(), F.floor(mtime_ns / 1_000_000)).otherwise(mtime_ms).cast("long")
    key = casefold(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.when((path != "") & (size >= 0) & (F.coalesce(mtime_ns, mtime_ms) >= 0), F.struct(key.alias("path"), size.alias("size"), ms.alias("mtime_ms")))


def event_identity(kind: Column, time: Column, text: Column, box: Column) -> Column:
    """The key under which two records of a result are one."""
    return F.concat_ws("-", kind, time.cast("string"), F.coalesce(text, F.lit("")), F.to_json(F.coalesce(box, F.array().cast("array<double>"))))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON with sorted names: equal contents give equal digests, whatever their order."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def content_key(raw: Column, context: Column) -> Column:
    """SHA-256 of a record's bytes and its context, parted by a zero byte."""
    return F.sha2(F.concat(raw.cast("binary"), F.lit(b"\0"), context.cast("binary")), 256)


def fingerprint_of(content_hash: Column, content_fingerprint: Column) -> Column:
    """The recorded content digest (the newer column first) if it is 64 characters long; else null."""
    value = F.coalesce(content_hash, content_fingerprint)
    return F.when(F.length(value) == 64, value)


def cooldown(active_seconds: Column, duty: float, least: float = 0.0) -> Column:
    """Pause after so many busy seconds that keeps the busy share at ``duty``, never shorter than ``least``; full duty: none."""
    return F.lit(0.0) if duty >= 1 else F.greatest(F.lit(float(least)), F.greatest(active_seconds, F.lit(0.0)) * (1 / duty - 1))
