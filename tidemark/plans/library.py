"""Named queries on a clip library made of orders (clips), customers (players) and line items (weapons), each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names, times, values
from ..operators import library as lib
from ..operators import readings
from ..session import ship
from .catalogue import _t

SECOND = 1_000_000


def clips(spark, sf_dir) -> DataFrame:
    o, c = _t(ship(spark), sf_dir, "orders"), _t(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    name = F.when(k % 4 == 0, F.concat(day, F.lit(" 10-11-12.mp4"))).when(k % 4 == 1, F.concat(F.lit("rec_"), day, F.lit("_10-11.mkv"))).when(k % 4 == 2, F.concat(F.date_format("o_orderdate", "y年M月d日"), F.lit(" 9点05分"))).otherwise(F.concat(F.lit("clip "), k.cast("string")))
    money = F.floor("o_totalprice").cast("long")
    base = o.select(
        k.alias("clip_id"), F.concat(F.lit("C:\\Rec/"), k.cast("string"), F.lit("\\"), name).alias("path"), F.concat(F.lit("src"), (k % 7).cast("string")).alias("source"), name.alias("name"),
        F.when(k % 5 == 0, F.concat(day, F.lit("T08:09:10"))).alias("recorded"), (F.unix_micros(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), F.current_timezone())) + k).alias("exported_us"),
        (k % 11).alias("source_index"), (k * 1000 % 7919 * SECOND).alias("start_us"), F.when(k % 9 == 0, float("nan")).when(k % 9 == 1, None).otherwise((k % 60).cast("double")).alias("duration"), "o_custkey",
        F.when(k % 6 != 0, money % 5).alias("kills"), F.when(k % 8 != 0, money % 1700).alias("damage"), F.when(k % 10 != 0, money % 4).alias("assists"), F.when(k % 3 != 0, money % 3).alias("knockdowns"),
        F.when(k % 4 != 0, money % 20).alias("round_kills"), F.when(k % 5 != 0, money % 4000).alias("round_damage"), (k % 7 == 0).alias("partial"),
        F.when(k % 6 != 1, F.element_at(F.array(*map(F.lit, lib.RANKS)), (money % 9 + 1).cast("int"))).alias("rank"), F.when(k % 4 == 2, "odd").alias("hero"),
    )
    w = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("W"), (F.col("l_partkey") % 12).cast("string")))).alias("weapons"))
    player = c.select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("[T"), F.col("c_nationkey").cast("string"), F.lit("] "), F.initcap("c_mktsegment"), (F.col("c_custkey") % 50).cast("string")).alias("account"))
    return base.join(w, "clip_id", "left").join(player, "o_custkey", "left")


RANK_SQL = "['unranked','rookie','bronze','silver','gold','platinum','diamond','master','predator']"
CLIPS = f"""base as (select o_orderkey as clip_id, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as d, floor(o_totalprice)::bigint as m, o_orderdate from orders),
nm as (select *, case clip_id % 4 when 0 then d || ' 10-11-12.mp4' when 1 then 'rec_' || d || '_10-11.mkv' when 2 then strftime(o_orderdate, '%Y年%-m月%-d日') || ' 9点05分' else 'clip ' || clip_id end as name from base),
w as (select l_orderkey as clip_id, list_sort(list(distinct 'W' || (l_partkey % 12))) as weapons from lineitem group by 1),
clips as (select clip_id, 'C:\\Rec/' || clip_id || '\\' || name as path, 'src' || (clip_id % 7) as source, name, case when clip_id % 5 = 0 then d || 'T08:09:10' end as recorded, epoch_us(o_orderdate) + clip_id as exported_us, clip_id % 11 as source_index, clip_id * 1000 % 7919 * {SECOND} as start_us,
 case clip_id % 9 when 0 then 'nan'::double when 1 then null else (clip_id % 60)::double end as duration, o_custkey, case when clip_id % 6 <> 0 then m % 5 end as kills, case when clip_id % 8 <> 0 then m % 1700 end as damage, case when clip_id % 10 <> 0 then m % 4 end as assists, case when clip_id % 3 <> 0 then m % 3 end as knockdowns,
 case when clip_id % 4 <> 0 then m % 20 end as round_kills, case when clip_id % 5 <> 0 then m % 4000 end as round_damage, clip_id % 7 = 0 as partial, case when clip_id % 6 <> 1 then {RANK_SQL}[m % 9 + 1] end as rank, case when clip_id % 4 = 2 then 'odd' end as hero, weapons,
 '[T' || c_nationkey || '] ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || (c_custkey % 50) as account, lower(c_mktsegment) || (c_custkey % 50) as account_key,
 case when clip_id % 5 = 0 then d || 'T08:09:10' when clip_id % 4 = 0 then d || 'T10:11:12' when clip_id % 4 = 1 then d || 'T10:11' when clip_id % 4 = 2 then d || 'T09:05' end as rec_at, case when clip_id % 5 = 0 or clip_id % 4 < 3 then d else '' end as day
 from nm left join w using (clip_id) left join customer on c_custkey = o_custkey)"""


def _named(c: DataFrame) -> DataFrame:
    """Clips whose recording time is looked for in their own name."""
    return c.withColumn("source", F.lit(None).cast("string"))


def library_filter(spark, sf_dir):
    c = clips(spark, sf_dir).withColumn("account_aliases", F.lit(None).cast("array<string>")).withColumn("src", F.col("source"))
    a = lib.matches(_named(c), date="1996", weapon="W3").select("clip_id", F.lit("date and weapon").alias("asked"))
    b = lib.matches(_named(c), date="unknown", rank="unknown").select("clip_id", F.lit("unknown").alias("asked"))
    d = lib.matches(c, source="src3", account="[AB] machinery7", hero="unknown").select("clip_id", F.lit("account").alias("asked"))
    return a.unionAll(b).unionAll(d)


def text_filter(spark, sf_dir):
    return lib.contains_text(clips(spark, sf_dir), " SRC1 w7", ("source",)).select("clip_id")


def duration_filter(spark, sf_dir):
    return lib.at_least_long(clips(spark, sf_dir), 30).select("clip_id")


def threshold_filter(spark, sf_dir):
    c = clips(spark, sf_dir)
    return c.select("clip_id", *[lib.passes(F.col(f), F.col("partial"), m, keep).alias(f"{f}_{str(keep).lower()}") for f, m in (("kills", 3), ("damage", 900)) for keep in (True, False)])


def in_collection(spark, sf_dir):
    files = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.upper(F.concat(F.lit("c:/rec\\"), F.col("o_orderkey").cast("string"))).alias("folder"))
    c = clips(spark, sf_dir).withColumn("folder", F.concat(F.lit("C:\\Rec/./"), F.col("clip_id").cast("string")))
    return lib.in_collection(c, files, "folder").select("clip_id")


def library_orders(spark, sf_dir):
    """Every clip's place in each of the orders: ranked within the whole library, as a table of places."""
    from pyspark.sql.window import Window

    c = _named(clips(spark, sf_dir))
    sorts = [("damage", True), ("kills", False), ("round_damage", True), ("recent", True), ("recorded", True), ("recorded_oldest", True)]
    return c.select("clip_id", *[F.row_number().over(Window.orderBy(*lib.order_keys(s, d))).alias(f"{s}_{'down' if d else 'up'}") for s, d in sorts])


def library_groups(spark, sf_dir):
    c = _named(clips(spark, sf_dir))
    out = None
    for sort in ("damage", "kills", "round_damage", "recorded"):
        g = c.withColumn("_g", lib.group_of(sort)).groupBy(F.lit(sort).alias("sort"), "_g.key", "_g.label", "_g.unknown").agg(F.count("*").alias("n"))
        out = g if out is None else out.unionAll(g)
    return out


def weapon_frequency(spark, sf_dir):
    return lib.frequency(clips(spark, sf_dir), "weapons", F.col("source"))


def rank_shares(spark, sf_dir):
    counts = lib.rank_counts(clips(spark, sf_dir), "rank")
    out = lib.shares(counts, "rank", "n")
    return out.select("rank", "n", "place", F.round("share", 9).alias("share"), F.round("before", 9).alias("before"))


def partners(spark, sf_dir):
    c = clips(spark, sf_dir).select("source", "account", (F.col("clip_id") % 100 / 100).alias("sure"), F.lit("[T1] building1").alias("me"))
    return lib.known_partners(c, "me", "account", "source", "sure", 3, 0.3).select(names.name_key(F.col("name")).alias("key"), "n")


def day_totals(spark, sf_dir):
    c = _named(clips(spark, sf_dir))
    return lib.day_totals(c, times.recording_day(F.col("recorded"), F.col("name")))


def one_or_mixed(spark, sf_dir):
    return lib.one_or_mixed(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linestatus")


def dedupe_nonempty(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.concat_ws("/", "event_type", F.col("user_id").cast("string"))).otherwise("").alias("path"))
    return lib.first_of(e, F.lower("path"), [F.col("event_id")])


def append_new(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("path"))
    return lib.append_new(p.where("ordinal % 40 = 0"), p.withColumn("path", F.when(F.col("ordinal") % 2 == 0, F.upper("path")).otherwise(F.col("path"))))


def evidence_dedupe(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"), "event_type", (F.col("event_id") % 40).alias("t"), F.when(F.col("event_id") % 19 == 0, False).when(F.col("event_id") % 3 > 0, True).alias("confirmed"), (F.col("event_id") % 4 == 0).alias("native"), (F.col("event_id") % 2 == 0).alias("own"))
    return lib.evidence(e, ["user_id"], F.concat_ws("-", "event_type", F.col("t").cast("string"))).select("user_id", "ordinal")


def excluded_players(spark, sf_dir):
    c = clips(spark, sf_dir).select("clip_id", "account")
    gone = c.where("clip_id % 50 = 0").select(F.upper(names.strip_clan_tag(F.col("account"))).alias("account"))
    return lib.without_players(c, gone, "account").select("clip_id")


def merged_reads(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type")
    return lib.merge_reads(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "event_type", ["click", "view"])


def canonical_spelling(spark, sf_dir):
    k = F.col("clip_id")
    look = F.when(k % 13 == 0, F.replace("account", F.lit("l"), F.lit("I"))).when(k % 17 == 0, F.upper("account")).otherwise(F.col("account"))
    c = clips(spark, sf_dir).select("clip_id", "source", F.concat(F.lit("[ab] long"), F.regexp_replace(look, r"\[.*\] ", "")).alias("name"))
    return lib.canonical_names(c, "clip_id", "source", "name")


def nearly_equal_bounds(spark, sf_dir):
    a = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") % 10).alias("k"), (F.col("o_orderkey") * 977 % 100_000).alias("start_us"), (F.col("o_orderkey") * 577 % 50_000).alias("end_us"))
    b = a.select(F.col("a").alias("b"), "k", "start_us", "end_us")
    return lib.tolerance_join(a.where("a % 3 = 0"), b.where("b % 3 = 1"), ["k"], ["start_us", "end_us"], 500).select("a", "b")


def corrected_clips(spark, sf_dir):
    c = clips(spark, sf_dir).select("path", "source", "start_us", F.col("start_us").alias("end_us"), "kills", "damage", "clip_id")
    fixes = c.select("source", (F.col("start_us") + 400).alias("start_us"), (F.col("end_us") - 400).alias("end_us"), F.when(F.col("clip_id") % 2 == 0, F.col("clip_id")).alias("kills"), F.when(F.col("clip_id") % 5 == 0, F.col("clip_id")).alias("damage"), F.col("clip_id").alias("fixed_us")).where("fixed_us % 3 = 0")
    return lib.overlay(c, fixes, ["source"], ["start_us", "end_us"], ["kills", "damage"], 1000).select("clip_id", "kills", "damage")


def moved_files(spark, sf_dir):
    k = F.col("o_orderkey")
    o = _t(ship(spark), sf_dir, "orders").select(F.concat(F.when(k % 2 == 0, "/old/").otherwise("/new/"), k.cast("string")).alias("path"), F.concat(F.when(k % 2 == 0, "n").otherwise("N"), (k % 900 - k % 2).cast("string")).alias("name"), (F.floor("o_totalprice") % 1999).alias("size"), (F.floor("o_totalprice") * 7919 % 60_000).alias("mtime_ms"), F.when(k % 3 > 0, F.lit(9.5)).alias("duration"), k.alias("k"))
    return lib.link_moved(o.where("k % 2 = 0"), o.where("k % 2 = 1"))


def refused_moves(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 900).alias("to"), (F.col("o_orderkey") % 5).alias("size"), (F.col("o_orderkey") % 4).cast("double").alias("duration"))
    m = o.select(F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string")).alias("from_path"), F.concat(F.lit("\\B\\"), F.col("to").cast("string")).alias("to_path"), "size", "duration")
    f = o.where("o_orderkey < 700").select(F.concat(F.lit("/b/"), F.col("o_orderkey").cast("string")).alias("path"), "size", (F.col("duration") + 0.25 * (F.col("o_orderkey") % 4)).alias("duration"))
    return lib.bad_moves(m, f).select("from_path", "reason")


def import_routes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    path = lambda d: F.concat(F.lit(f"/{d}/"), F.col("k").cast("string"))
    files = o.select(path("in").alias("path"), (F.col("k") % 50).alias("size"), (F.col("k") % 9).alias("mtime_ns"), F.concat(F.lit("h"), (F.col("k") % 400).cast("string")).alias("content"), F.when(F.col("k") % 13 != 0, (F.col("k") % 100 - 2).cast("double")).alias("duration"))
    known = o.where("k % 7 = 0").select(F.upper(path("in")).alias("path"))
    recorded = o.where("k < 90").select(F.when(F.col("k") % 2 == 0, path("in")).otherwise(path("out")).alias("path"), F.concat(F.lit("h"), (F.col("k") % 80).cast("string")).alias("content"))
    skipped = o.where("k % 5 = 0").select(path("in").alias("path_key"), (F.col("k") % 25).alias("size"), (F.col("k") % 9).alias("mtime_ns"))
    return lib.route_imports(files, known, recorded, skipped, 60.0)


def relocated(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("D:\\Old\\"), F.col("o_orderkey").cast("string")).alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("d:/x"))).alias("moved_from"))
    moves = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("d:/old/"), F.col("o_orderkey").cast("string")).alias("from_path"), F.concat(F.lit("E:/new/"), F.col("o_orderkey").cast("string")).alias("to_path"))
    out = lib.moved_paths(rows, moves, "path", "moved_from")
    return out.select("o_orderkey", lib.moved_prefix(F.col("path"), "d:/OLD", "F:/kept").alias("path"), F.concat_ws(",", "moved_from").alias("moved_from"))


def clip_rows(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    item = lambda p: F.struct(p.alias("path"), F.col("o_orderkey").alias("clip_id"))
    path = F.concat(F.lit("/c/"), (F.col("o_orderkey") % 700).cast("string"))
    m = o.where("o_orderkey % 4 > 0").groupBy(F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_custkey").alias("ordinal")).agg(F.sort_array(F.collect_list(item(path))).alias("clips"))
    i = o.where("o_orderkey % 4 = 0").agg(F.sort_array(F.collect_list(item(F.upper(path)))).alias("clips"))
    gone = o.where("o_orderkey < 900 and o_orderkey % 9 = 0").select(F.concat(F.lit("\\C\\"), F.col("o_orderkey").cast("string")).alias("path"))
    return lib.clip_rows(m, i, gone).select("source", "clip_index", F.lower("path").alias("path"), "clip_id")


def name_consensus(spark, sf_dir):
    c = clips(spark, sf_dir)
    k = F.col("clip_id")
    read = F.when(k % 9 == 0, F.upper("account")).when(k % 14 == 0, F.lit("[x] a")).otherwise(F.col("account"))
    r = c.select("o_custkey", read.alias("read"), (F.lit(0.75) + (k % 25) / 100).alias("sure"))
    out = readings.consensus_name(r.withColumn("g", F.floor(F.col("o_custkey") / 2)), ["g"], "read", "sure")
    return out.select("g", names.name_key(F.col("name")).alias("key"), F.round("confidence", 6).alias("confidence"), F.round("consensus_confidence", 6).alias("consensus_confidence"), "votes")


def account_prefixes(spark, sf_dir):
    c = clips(spark, sf_dir).where("account is not null")
    cut = F.concat(names.strip_clan_tag(F.col("account")), F.lit("x"))
    seen = c.where("clip_id % 3 = 0").select((F.col("o_custkey") % 40).alias("g"), F.substring(cut, F.lit(1), (F.col("clip_id") % 4 + 8).cast("int")).alias("prefix"), (F.lit(0.8) + (F.col("clip_id") % 20) / 100).alias("sure"))
    out = readings.account_prefixes(c.select("account"), seen, ["g"], "account", "prefix", "sure")
    return out.select("g", "name", F.round("confidence", 6).alias("confidence"), "votes")


QUERIES = (library_filter, text_filter, duration_filter, threshold_filter, in_collection, library_orders, library_groups, weapon_frequency, rank_shares, partners, day_totals, one_or_mixed, dedupe_nonempty, append_new, evidence_dedupe, excluded_players, merged_reads, canonical_spelling, nearly_equal_bounds, corrected_clips, moved_files, refused_moves, import_routes, relocated, clip_rows, name_consensus, account_prefixes)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    c = f"with {CLIPS}"
    last = "source_index, start_us, path"
    at = "try_strptime(rec_at, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M'])"
    rn = lambda keys: f"row_number() over (order by {keys}, {last})"


    def group(sort: str, width: int, label: str) -> str:
        low = f"({sort} // {width} * {width})"
        span = low if width == 1 else f"{low} || '–' || ({low} + {width - 1})"
        return f"select '{sort}' as sort, case when {sort} is null then '{sort}:unknown' else '{sort}:' || {low} end as key, case when {sort} is null then '{label} · 待确认' else '{label} · ' || {span} end as label, {sort} is null as unknown, count(*) as n from clips group by all"

    return {
        "library_filter": f"{c} select clip_id, 'date and weapon' as asked from clips where day like '1996%' and list_contains(weapons, 'W3') union all select clip_id, 'unknown' from clips where day = '' and rank is null union all select clip_id, 'account' from clips where source = 'src3' and account_key = 'machinery7' and hero is null",
        "text_filter": f"{c} select clip_id from clips where contains(lower(source || ' ' || array_to_string(coalesce(weapons, []), ' ')), 'src1 w7')",
        "duration_filter": f"{c} select clip_id from clips where duration is null or isnan(duration) or duration >= 30",
        "threshold_filter": f"{c} select clip_id, case when kills is null or (partial and kills < 3) then true else kills >= 3 end as kills_true, case when kills is null or (partial and kills < 3) then false else kills >= 3 end as kills_false, case when damage is null or (partial and damage < 900) then true else damage >= 900 end as damage_true, case when damage is null or (partial and damage < 900) then false else damage >= 900 end as damage_false from clips",
        "in_collection": "select o_orderkey as clip_id from orders where o_orderkey % 3 = 0",
        "library_orders": f"{c} select clip_id, {rn('damage desc nulls last')} as damage_down, {rn('kills asc nulls last')} as kills_up, {rn('round_damage desc nulls last')} as round_damage_down, {rn('exported_us desc')} as recent_down, {rn(f'{at} desc nulls last, case when {at} is not null then start_us end desc nulls last')} as recorded_down, {rn(f'{at} asc nulls last, case when {at} is not null then start_us end asc nulls last')} as recorded_oldest_down from clips",
        "library_groups": f"{c} {group('damage', 100, '片段伤害')} union all {group('kills', 1, '片段击杀')} union all {group('round_damage', 500, '全局伤害')} union all select 'recorded', 'date:' || day, case when day = '' then '日期待确认' else strftime(day::date, '%Y年%-m月%-d日') end, day = '', count(*) from clips group by all",
        "weapon_frequency": f"{c}, x as (select distinct source, unnest(weapons) as value from clips) select value, count(*) as n from x group by 1",
        "rank_shares": f"{c}, n as (select coalesce(rank, 'unknown') as rank, count(*) as n, coalesce(list_position({RANK_SQL}, rank), 10) as place from clips group by 1, 3) select rank, n, place::int as place, round(n / sum(n) over (), 9) as share, round((sum(n) over (order by n desc, rank rows unbounded preceding) - n) / sum(n) over (), 9) as before from n",
        "partners": f"{c} select account_key as key, count(distinct source) as n from clips where account is not null and clip_id % 100 / 100.0 >= 0.3 and account_key <> 'building1' group by 1 having count(distinct source) >= 3",
        "day_totals": f"{c} select year, month, day, count(*) as n from (select year(day::date) as year, month(day::date) as month, day(day::date) as day from clips where day <> '') group by rollup (year, month, day)",
        "one_or_mixed": "select l_orderkey, case when min(l_linestatus) = max(l_linestatus) then min(l_linestatus) else 'mixed' end as l_linestatus from lineitem group by 1",
        "dedupe_nonempty": "select min(event_id) as event_id, event_type || '/' || user_id as path from events where event_type <> 'view' group by 2",
        "append_new": "with p as (select p_partkey as ordinal, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as path, lower(p_name) as k from part) select min(ordinal) as ordinal, arg_min(path, ordinal) as path from p where k not in (select lower(p_name) from part where p_partkey % 40 = 0) group by k",
        "evidence_dedupe": "with e as (select user_id, event_id as ordinal, event_type || '-' || (event_id % 40) as id, case when event_id % 19 = 0 then false when event_id % 3 > 0 then true end as confirmed, event_id % 4 = 0 as native, event_id % 2 = 0 as own from events) select user_id, ordinal from e a where coalesce(confirmed, true) and not exists (select 1 from e b where a.user_id = b.user_id and a.id = b.id and b.confirmed = false and b.own) qualify row_number() over (partition by user_id, id order by native desc, ordinal desc) = 1",
        "excluded_players": f"{c} select clip_id from clips where account is not null and account_key not in (select account_key from clips where clip_id % 50 = 0 and account is not null)",
        "merged_reads": "select event_id, event_type from events where (event_id % 2 = 0 and event_type not in ('click', 'view')) or (event_id % 3 = 0 and event_type in ('click', 'view'))",
        "nearly_equal_bounds": "with a as (select o_orderkey as a, o_custkey % 10 as k, o_orderkey * 977 % 100000 as s, o_orderkey * 577 % 50000 as e from orders) select x.a, y.a as b from a x join a y on x.k = y.k and x.a % 3 = 0 and y.a % 3 = 1 and abs(x.s - y.s) < 500 and abs(x.e - y.e) < 500",
        "corrected_clips": f"{c}, f as (select source, start_us + 400 as s, start_us - 400 as e, case when clip_id % 2 = 0 then clip_id end as k, case when clip_id % 5 = 0 then clip_id end as d, clip_id as at from clips where clip_id % 3 = 0), p as (select clips.path, arg_max(k, f.at) filter (k is not null) as k, arg_max(d, f.at) filter (d is not null) as d from clips join f on clips.source = f.source and abs(f.s - start_us) < 1000 and abs(f.e - start_us) < 1000 group by 1) select clip_id, coalesce(k, kills) as kills, coalesce(d, damage) as damage from clips left join p using (path)",
        "moved_files": """with o as (select case when o_orderkey % 2 = 0 then '/old/' else '/new/' end || o_orderkey as path, 'n' || (o_orderkey % 900 - o_orderkey % 2) as n, floor(o_totalprice)::bigint % 1999 as size, floor(o_totalprice)::bigint * 7919 % 60000 as t, o_orderkey % 3 > 0 as timed, o_orderkey as k from orders),
 m as (select * from o where k % 2 = 0), f as (select * from o where k % 2 = 1), a as (select m.path as x, f.path as y, 'size_mtime' as basis from m join f on m.size = f.size and abs(m.t - f.t) <= 2000),
 b as (select m.path as x, f.path as y, 'size_name' as basis from m join f on m.size = f.size and m.n = f.n where m.path not in (select x from a)),
 c as (select m.path as x, any_value(f.path) as y, 'size_unique' as basis from m join f on m.size = f.size where m.timed and m.path not in (select x from a union all select x from b) and m.size in (select size from m group by 1 having count(*) = 1) group by m.path having count(*) = 1),
 u as (select * from a union all select * from b union all select * from c), n as (select *, count(*) over (partition by x) as cx, count(*) over (partition by y) as cy from u) select x as from_path, y as to_path, basis from n where cx = 1 and cy = 1""",
        "refused_moves": "with o as (select o_orderkey as k, o_orderkey % 900 as t, o_orderkey % 5 as size, (o_orderkey % 4)::double as dur from orders), f as (select k, size, dur + 0.25 * (k % 4) as dur from o where k < 700), m as (select o.*, count(*) over (partition by t) as claims from o), x as (select '/a/' || m.k as from_path, case when f.k is null then 'missing' when m.size <> f.size then 'size' when abs(m.dur - f.dur) > 0.5 then 'duration' when claims > 1 then 'claimed twice' end as reason from m left join f on f.k = m.t) select * from x where reason is not null",
        "relocated": "select o_orderkey, case when o_orderkey % 3 = 0 then 'E:/new/' || o_orderkey else 'F:/kept\\' || o_orderkey end as path, concat_ws(',', case when o_orderkey % 2 = 0 then 'd:/x' end, case when o_orderkey % 3 = 0 then 'D:\\Old\\' || o_orderkey end) as moved_from from orders",
    }
