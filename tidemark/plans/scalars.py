"""Named queries that run the scalar functions over the tables, each with equivalent SQL. Lines and file names are built from the
tables' values, so that what a function must find in them is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines, names, times, values
from ..session import ship
from .catalogue import _events, _t

#: How the made lines begin, by the key's remainder: (text, kind, action, locale).
HEADS = (
    ("KN0CKED D0WN ", "knock", "knock", "en"),
    ("eliminated ", "elimination", "elimination", "en"),
    ("ASSIST, KNOCKED DOWN ", "assist", "knock", "en"),
    ("ASSIST ELIMINATION ", "assist", "elimination", "en"),
    ("已消滅", "elimination", "elimination", "zh-TW"),
    ("撃倒 ", "knock", "knock", "zh-TW"),
    ("助攻，淘汰 ", "assist", "elimination", "zh-CN"),
    ("НОКАУТ ", "knock", "knock", "ru"),
    ("СОДЕЙСТВИЕ В НОКАУТЕ ", "assist", "knock", "ru"),
    ("ASSIST ", "assist", "unknown", "en"),
    ("you were KNOCKED DOWN by ", None, None, None),
)


def _pick(key: Column, texts) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))


def _lines(spark, sf_dir) -> DataFrame:
    p = _t(ship(spark), sf_dir, "part")
    name = F.initcap("p_name")
    tail = F.when(F.col("p_partkey") % 4 == 0, " +1OO XP").otherwise("")
    return p.select("p_partkey", name.alias("name"), F.concat(_pick(F.col("p_partkey"), [h[0] for h in HEADS]), name, tail).alias("line"))


def result_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("p_partkey", lines.result_line(F.col("line")).alias("r")).select("p_partkey", "r.kind", "r.action", F.col("r.target_text").alias("target"), "r.locale")


def line_prefixes(spark, sf_dir):
    return _lines(spark, sf_dir).select("p_partkey", lines.classification_prefix(F.col("line")).alias("r")).select("p_partkey", "r.kind", "r.action", "r.english")


def spoken_lines(spark, sf_dir):
    said = _lines(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat("name", F.lit(": "), "line")).otherwise(F.col("line")).alias("line"))
    return said.select("p_partkey", lines.known_dialogue(F.col("line")).alias("spoken"))


def round_titles(spark, sf_dir):
    texts = ("You are the Ｃhampion!", "squad eliminated", "ranked leagues", "Game over", "nothing")
    p = _t(ship(spark), sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), texts).alias("t"), (F.col("p_partkey") % 2 == 0).alias("away"))
    return p.select("p_partkey", lines.round_result(F.col("t"), F.col("away")).alias("result"), lines.loading_title(F.col("t")).alias("loading"))


def _files(spark, sf_dir) -> DataFrame:
    """File names with the three forms of a time, some of them impossible."""
    k = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    o = _t(ship(spark), sf_dir, "orders").select(k, (k % 14).alias("mo"), (k % 33).alias("d"), (k % 26).alias("h"), (k % 4).alias("form"), (k % 2 == 0).alias("sec"))
    one = F.concat(F.lit("/r/2024-"), two(F.col("mo")), F.lit("-"), two(F.col("d")), F.lit(" "), two(F.col("h")), F.lit("-11"), F.when(F.col("sec"), "-12").otherwise(""), F.lit(".mp4"))
    two_ = F.concat(F.lit("C:\\v\\2024年"), F.col("mo"), F.lit("月"), F.col("d"), F.lit("日 "), F.col("h"), F.lit("点11分"), F.when(F.col("sec"), "12秒").otherwise(""))
    three = F.concat(F.lit("Some Game_"), two(F.col("mo")), F.lit("-"), two(F.col("d")), F.lit("-2024_"), two(F.col("h")), F.lit("-11-12.mp4"))
    return o.withColumn("file", F.when(F.col("form") == 0, one).when(F.col("form") == 1, two_).when(F.col("form") == 2, three).otherwise(F.concat(F.lit("video "), F.col("o_orderkey").cast("string"))))


def recording_times(spark, sf_dir):
    at = times.recording_time(F.col("file"))
    f = _files(spark, sf_dir).select("o_orderkey", at.alias("recorded"), times.recording_day(F.lit(None).cast("string"), F.col("file")).alias("day"))
    return f.select("*", times.time_label(F.col("recorded")).alias("label"), times.day_label(F.col("day")).alias("day_label"), times.date_filter_label(F.substring("day", 1, 7)).alias("month_label"))


def clip_names(spark, sf_dir):
    f = _files(spark, sf_dir)
    k = F.col("o_orderkey")
    weapons = F.slice(F.array(F.lit("a<b"), F.lit("未知枪"), F.lit("c"), F.lit("d")), F.lit(1), (k % 5).cast("int"))
    return f.select(k, times.clip_file_name(F.col("file"), F.lit(1_700_000_000_000_000), k % 3 + 1, F.when(k % 5 > 0, k % 5), F.when(k % 7 > 0, k % 7), weapons).alias("name"))


def clock_labels(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", times.clock(F.col("cents") / 10 - 20).alias("label"), times.long_clock(F.col("cents") * 3).alias("long_label"))


def byte_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    header = F.when(k % 6 == 0, F.concat(F.lit("bytes="), s(k), F.lit("-"), s(k + k % 50))).when(k % 6 == 1, F.concat(F.lit("bytes="), s(k), F.lit("-"))).when(k % 6 == 2, F.concat(F.lit("bytes=-"), s(k % 90))).when(k % 6 == 3, F.lit("bytes=-")).when(k % 6 == 4, F.lit("bytes=5-2"))
    o = _t(spark, sf_dir, "orders").select(k, times.byte_range(header, F.lit(1000)).alias("r"))
    return o.select("o_orderkey", "r.first", "r.last", "r.partial")


def read_numbers(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("日"))).when(k % 5 == 1, F.concat(F.lit("O"), (k % 90).cast("string"))).when(k % 5 == 2, F.concat(F.lit(" "), (k % 70).cast("string"), F.lit(" "))).when(k % 5 == 3, F.lit("x1"))
    e = _t(spark, sf_dir, "events").select(k, text.alias("t"), ((k % 40) / 100 + 0.6).alias("c"), (F.col("value") * F.when(k % 3 == 0, -1).when(k % 3 == 1, float("inf")).otherwise(1)).alias("v"))
    return e.select("event_id", values.read_ammo(F.col("t"), F.col("c")).alias("ammo"), values.read_number(F.col("t"), F.col("c"), 60).alias("number"), values.known(F.col("v")).alias("known"))


def two_models(spark, sf_dir):
    k = F.col("event_id")
    text, other = F.when(k % 7 > 0, (k % 3).cast("string")).otherwise(F.lit("")), F.when(k % 4 == 0, F.lit("no")).otherwise((k % 2).cast("string"))
    e = _t(spark, sf_dir, "events").select(k, values.agreed_digits(text, (k % 50) / 100 + 0.5, other, (k % 30) / 100 + 0.7, 4, 0.7, 0.8, 0.9).alias("r"))
    return e.select("event_id", "r.text", F.round("r.confidence", 6).alias("confidence"))


def places(spark, sf_dir):
    p = F.col("p_partkey")
    box = lambda x, y, h: F.array(*[F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x, y, x + 50, y + h)])
    a, b = box(p % 40, p % 30, p % 9 + 1), box(p % 43, p % 31, p % 7)
    t = _t(spark, sf_dir, "part").select(p, a.alias("a"), b.alias("b"), (p % 300).alias("v"), F.col("p_size").alias("w"))
    return t.select("p_partkey", values.same_slot(F.col("a"), F.col("b")).alias("same"), values.finite_box(F.col("b")).alias("box"), values.near_box(F.col("a"), F.col("b"), F.lit(1.5), F.lit(0.5)).alias("near"), values.active_slot(F.col("v"), F.col("w") * 4).alias("slot"), F.size(values.grid_indices(F.col("w") / 7, F.col("v") / 11, 2.0)).alias("frames"), values.sample_height(F.col("w") + 1000, F.col("v") + 500).alias("height"))


def path_keys(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    c = _t(ship(spark), sf_dir, "customer").select("c_custkey", F.concat(F.lit("C:\\Dir\\.\\sub\\..\\"), k, F.lit("//F.MP4")).alias("p"), F.concat(F.lit("c:/dir/"), k, F.lit("/f.mp4")).alias("q"))
    return c.select("c_custkey", values.path_key(F.col("p")).alias("key"), values.same_path(F.col("p"), F.col("q")).alias("same"), values.inside(F.col("p"), F.lit("c:\\DIR")).alias("inside"))


def digests(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", values.digest(F.col("p_name").alias("a"), F.col("p_size").alias("b")).alias("digest"), values.content_key(F.col("p_name"), F.col("p_brand")).alias("content"), values.fingerprint_of(F.when(F.col("p_size") % 2 == 0, F.sha2("p_name", 256)), F.when(F.col("p_size") % 3 == 0, F.lit("short"))).alias("known"))


def name_keys(spark, sf_dir):
    c = _t(ship(spark), sf_dir, "customer")
    tag = _pick(F.col("c_custkey"), ("[AB] ", "ab] ", "[ABC", "", "[TooLongTag] ", "[xy　"))
    n = c.select("c_custkey", F.concat(tag, F.initcap("c_mktsegment"), F.lit("ﬁ"), (F.col("c_custkey") % 9).cast("string")).alias("n"))
    return n.select("c_custkey", names.strip_clan_tag(F.col("n")).alias("bare"), names.name_key(F.col("n")).alias("key"), names.player_name(F.col("n")).alias("player"), names.word_spaced(F.col("n")).alias("spaced"))


def close_names(spark, sf_dir):
    c = _t(ship(spark), sf_dir, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), (F.col("c_custkey") % 50).cast("string")).alias("n"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.regexp_replace("n", "^.", "")).when(F.col("c_custkey") % 3 == 1, F.concat("n", F.lit("xy"))).otherwise(F.lower(F.reverse("n")))
    return c.select("c_custkey", names.close_name(F.col("n"), other).alias("close"))


def icon_dice(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    a, b = F.col("p_partkey").cast("long"), F.col("p_size").cast("long")
    return p.select("p_partkey", F.round(values.bit_dice(a, b), 6).alias("dice"), F.round(values.words_dice(F.array(a, b), F.array(b, a + 1)), 6).alias("words"))


QUERIES = (result_lines, line_prefixes, spoken_lines, round_titles, recording_times, clip_names, clock_labels, byte_ranges, read_numbers, two_models, places, path_keys, digests, name_keys, close_names, icon_dice)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    n = len(HEADS)
    of = lambda i: f"case p_partkey % {n} " + " ".join(f"when {j} then '{h[i]}'" for j, h in enumerate(HEADS) if h[i] is not None) + " end"
    words = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    prefixed = {0: ("knock", "knock", True), 1: ("elimination", "elimination", True), 2: ("assist", "knock", True), 3: ("assist", "elimination", True), 4: ("elimination", "elimination", False), 5: ("knock", "knock", False)}
    pre = lambda i: f"case p_partkey % {n} " + " ".join(f"when {j} then {str(v[i]).lower() if i == 2 else repr(v[i])}" for j, v in prefixed.items()) + " end"
    day = "try_strptime('2024-' || lpad((k % 14)::varchar, 2, '0') || '-' || lpad((k % 33)::varchar, 2, '0'), '%Y-%m-%d')"
    f = f"f as (select k, k % 14 as mo, k % 33 as d, k % 26 as h, case when k % 4 < 3 and k % 26 <= 23 then {day} end as dt, (k % 4 = 2 or k % 2 = 0) as sec from (select o_orderkey as k from orders)), r as (select *, case when dt is not null then strftime(dt, '%Y-%m-%d') || 'T' || lpad(h::varchar, 2, '0') || ':11' || case when sec then ':12' else '' end end as recorded from f)"
    box = lambda x, y, h: f"[{x}, {y}, {x} + 50, {y} + {h}]"
    return {
        "result_lines": f"select p_partkey, {of(1)} as kind, {of(2)} as action, case when p_partkey % {n} < {n - 1} then {words} end as target, {of(3)} as locale from part",
        "line_prefixes": f"select p_partkey, {pre(0)} as kind, {pre(1)} as action, {pre(2)} as english from part",
        "spoken_lines": f"select p_partkey, case when p_partkey % 3 = 0 then true when p_partkey % {n} = {n - 1} then true else false end as spoken from part",
        "round_titles": "select p_partkey, case when p_partkey % 5 = 0 then 'win' when p_partkey % 2 = 0 and p_partkey % 5 in (1, 3) then 'end' end as result, p_partkey % 5 = 2 as loading from part",
        "recording_times": f"with {f} select k as o_orderkey, recorded, coalesce(strftime(dt, '%Y-%m-%d'), '') as day, case when recorded is null then '—' else strftime(dt, '%Y年%-m月%-d日 ') || recorded[12:] end as label, coalesce(strftime(dt, '%Y年%-m月%-d日'), '日期待确认') as day_label, coalesce(strftime(dt, '%Y年%-m月'), '全部日期') as month_label from r",
        "clip_names": f"with {f} select k as o_orderkey, case when dt is not null and k % 4 = 0 and sec then strftime(dt, '%Y年%-m月%-d日 ') || h || '点11分' else '2023年11月15日 6点13分' end || ' 第' || (k % 3 + 1) || '段 ' || case when k % 5 > 0 then (k % 5)::varchar else '—' end || '杀 ' || ['未知枪', 'a_b', 'a_b+—枪', 'a_b+—枪+c', 'a_b+—枪+c等'][k % 5 + 1] || ' ' || case when k % 7 > 0 then (k % 7)::varchar else '—' end || '伤.mp4' as name from r",
        "clock_labels": "with e as (select event_id, case when event_type <> 'error' then cast(round(value * 100) as bigint) end as c from events), x as (select event_id, c, greatest(floor(c / 10 - 20), 0)::bigint as s, c * 3 as l from e) select event_id, case when c is not null then (s // 60) || '分' || lpad((s % 60)::varchar, 2, '0') || '秒' end as label, case when c is null then '—' when l < 3600 then (l // 60) || '分' || lpad((l % 60)::varchar, 2, '0') || '秒' else (l // 3600) || '小时' || ((l // 60) % 60) || '分' || lpad((l % 60)::varchar, 2, '0') || '秒' end as long_label from x",
        "byte_ranges": "select o_orderkey, case when o_orderkey % 6 in (0, 1) and o_orderkey < 1000 then o_orderkey when o_orderkey % 6 = 2 and o_orderkey % 90 > 0 then 1000 - o_orderkey % 90 when o_orderkey % 6 = 5 then 0 end as first, case when o_orderkey % 6 = 0 and o_orderkey < 1000 then least(o_orderkey + o_orderkey % 50, 999) when (o_orderkey % 6 = 1 and o_orderkey < 1000) or (o_orderkey % 6 = 2 and o_orderkey % 90 > 0) or o_orderkey % 6 = 5 then 999 end as last, case when (o_orderkey % 6 in (0, 1) and o_orderkey < 1000) or (o_orderkey % 6 = 2 and o_orderkey % 90 > 0) then true when o_orderkey % 6 = 5 then false end as partial from orders",
        "read_numbers": "with e as (select event_id as k, (event_id % 40) / 100.0::double + 0.6::double as c, value from events) select k as event_id, case when k % 5 = 0 and c >= 0.67 and k * 10 <= 1000 then k * 10 when k % 5 = 1 and c >= 0.8 then k % 90 when k % 5 = 2 and c >= 0.86 then k % 70 end as ammo, case when k % 5 = 2 and c >= 0.88 and k % 70 <= 60 then k % 70 end as number, case when k % 3 = 2 then value when k % 3 = 0 and value = 0 then -value end as known from e",
        "two_models": "with e as (select event_id as k, case when event_id % 7 > 0 then (event_id % 3)::varchar else '' end as t, case when event_id % 4 = 0 then 'no' else (event_id % 2)::varchar end as o, (event_id % 50) / 100.0::double + 0.5::double as c, (event_id % 30) / 100.0::double + 0.7::double as oc from events), x as (select *, t <> '' and c >= 0.7 as ok from e) select k as event_id, case when ok and o = t and oc >= 0.8 then t when ok and c >= 0.9 and o = 'no' then t else '' end as text, round(case when ok and o = t and oc >= 0.8 then least(c, oc) when ok and c >= 0.9 and o = 'no' then c else 0.0 end, 6) as confidence from x",
        "places": f"with x as (select p_partkey as p, {box('p_partkey % 40', 'p_partkey % 30', '(p_partkey % 9 + 1)')}::double[] as a, {box('p_partkey % 43', 'p_partkey % 31', 'p_partkey % 7')}::double[] as b, p_partkey % 300 as v, p_size as w from part), y as (select *, greatest(a[4] - a[2], 1.0) as h, greatest((b[4] - b[2]) * 0.5, 1.0) as font from x) select p as p_partkey, abs(a[1] - b[1]) <= h * 1.5 and abs((a[2] + a[4]) / 2 - (b[2] + b[4]) / 2) <= h * 0.6 as same, b[4] > b[2] as box, abs((a[2] + a[4]) / 2 - (b[2] + b[4]) * 0.5 / 2) <= greatest(font, 10.0) and abs(a[1] - b[1] * 1.5) <= greatest(font * 0.75, 12.0) as near, case when abs(v - w * 4) >= 25 then case when v > w * 4 then 0 else 1 end end as slot, greatest(0, (ceil(v / 11.0::double * 2 + 0.5) - 1) - greatest(1, ceil(w / 7.0::double * 2 + 0.5)) + 1)::int as frames, (round_even(1280.0::double * (v + 500) / (w + 1000) / 2, 0) * 2)::bigint as height from y",
        "path_keys": "select c_custkey, 'c:/dir/' || c_custkey || '/f.mp4' as key, false as same, true as inside from customer",
        "digests": "select p_partkey, sha256('{\"a\":\"' || p_name || '\",\"b\":' || p_size || '}') as digest, sha256(p_name || chr(0) || p_brand) as content, case when p_size % 2 = 0 then sha256(p_name) end as known from part",
        "name_keys": "with n as (select c_custkey, c_custkey % 6 as t, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || 'fi' || (c_custkey % 9) as b from customer) select c_custkey, case t when 2 then '[ABC' || b when 4 then '[TooLongTag] ' || b else b end as bare, lower(case t when 2 then 'abc' || b when 4 then 'toolongtag' || b else b end) as key, case t when 2 then '[ABC' || b when 4 then '[TooLongTag] ' || b else b end as player, false as spaced from n",
        "close_names": "with n as (select c_custkey, lower(c_mktsegment) || (c_custkey % 50) as n from customer), o as (select *, case c_custkey % 3 when 0 then n[2:] when 1 then n || 'xy' else reverse(n) end as o from n), l as (select *, least(length(n), length(o)) as s, case when least(length(n), length(o)) >= 10 then 2 else 1 end as m from o) select c_custkey, n = o or (s >= 6 and abs(length(n) - length(o)) <= m and levenshtein(n, o) <= m) as close from l",
        "icon_dice": "with p as (select p_partkey, p_partkey::bigint as a, p_size::bigint as b from part) select p_partkey, round(case when bit_count(a) + bit_count(b) = 0 then 0.0::double else 2.0::double * bit_count(a & b) / (bit_count(a) + bit_count(b)) end, 6) as dice, round(2.0::double * (bit_count(a & b) + bit_count(b & (a + 1))) / greatest(bit_count(a) + 2 * bit_count(b) + bit_count(a + 1), 1), 6) as words from p",
    }
