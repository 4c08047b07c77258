"""Named queries on counts, versions and packets over records made of the tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import counts, library, versions
from ..session import ship
from .catalogue import _t
from .recordings import HUD, hud


def packet_gaps(spark, sf_dir):
    return counts.gaps(hud(spark, sf_dir).select("user_id", F.when(F.col("event_id") % 50 == 0, F.col("t_us") - 9_000_000).otherwise(F.col("t_us")).alias("t"), "frame"), "user_id", "t", "frame")


def copied_packets(spark, sf_dir):
    """Where a stretch of each user's events stands in all of them; every third digest is that of silence."""
    rows = hud(spark, sf_dir).select("user_id", (F.col("frame") - 1).alias("i"), F.when(F.col("frame") % 3 == 0, "silence").otherwise(F.concat("user_id", F.lit("-"), F.col("event_id") % 9)).alias("h"))
    part = rows.where("i between 6 and 14").select("user_id", (F.col("i") - 6).alias("i"), "h")
    return counts.found_at(rows, part, "user_id", "i", "h").select("user_id", F.col("offset").alias("place"))


def _results(spark, sf_dir):
    rows = hud(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("knock", "assist", "elimination", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    end = rows.groupBy("user_id").agg(F.max("t_us").alias("duration_us"))
    begun = F.when(F.col("event_id") % 3 > 0, F.col("t_us") - F.col("event_id") % 5 * 700_000)
    return rows.join(end, "user_id").select("user_id", kind.alias("kind"), F.col("t_us").alias("at"), "duration_us", begun.alias("begun"), F.when(F.col("event_id") % 3 == 1, "shoot").when(F.col("event_id") % 3 == 2, "near_result").alias("basis"))


def seek_times(spark, sf_dir):
    return counts.clip_events(_results(spark, sf_dir), "user_id").select("user_id", "kind", F.col("at").alias("at_us"), "seek_us", "basis")


def marker_groups(spark, sf_dir):
    out = counts.marker_groups(_results(spark, sf_dir), "user_id", 900)
    return out.select("user_id", "first_at", "n", F.round("place", 9).alias("place"))


def final_tables(spark, sf_dir):
    rows = hud(spark, sf_dir).select("user_id", F.col("t_us").alias("t"), "kills", (F.col("frame") / 4).cast("long").alias("damage"))
    return counts.final_table(rows, ["user_id"], "t", ["kills", "damage"])


def reconciled_counts(spark, sf_dir):
    k = F.col("o_orderkey")
    o = _t(ship(spark), sf_dir, "orders")
    seg = k.cast("string").alias("segment")
    end = lambda field, a, b: o.select(seg, F.lit(field).alias("field"), F.when(k % 13 > 0, k % a).alias("baseline"), F.when(k % 17 > 0, k % a + k % b - 1).alias("last"), F.when(k % 19 == 0, k % 7).alias("unconfirmed"), (k % 23 == 0).alias("terminal_unread"), (k % 29 == 0).alias("baseline_lower"), (k % 31 == 0).alias("visible_complete"), F.when(k % 2 == 0, k * 10).alias("updated_us"))
    ends = end("kills", 5, 4).unionByName(end("assists", 7, 3)).unionByName(end("damage", 11, 9))
    segs = o.select(seg, (k % 37 == 0).alias("excluded_terminal"), F.when(k % 10 == 0, "pending").when(k % 10 == 1, "settled").alias("settlement"), (k % 3 > 0).alias("covered"))
    p = F.col("l_partkey")
    ev = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("segment"), F.element_at(F.array(*map(F.lit, ("elimination", "assist", "knock"))), (p % 3 + 1).cast("int")).alias("kind"), F.when(p % 2 == 0, "elimination").otherwise("knock").alias("action"), F.concat(F.lit("t"), (p % 5).cast("string")).alias("target"), (F.col("l_orderkey") * 10 + p * 20_000).cast("long").alias("t_us"), (p % 7 > 0).alias("confirmed"), (p % 11 > 0).alias("own"))
    return counts.reconciled(ends, segs, ev.dropDuplicates())


def _states(spark, sf_dir):
    k = F.col("o_orderkey")
    f = lambda name, a: F.struct(F.lit(name).alias("field"), F.when(k % a > 1, F.struct(F.lit(1).alias("schema"), (k % 5 > 0).alias("complete"), F.lit(name).alias("algorithm_id"), F.when(k % 3 == 0, "new").otherwise("before").alias("signature"))).alias("saved"), F.when(k % a == 1, F.concat(F.lit("x reader-v"), k % 4)).alias("legacy"))
    rows = _t(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (k % 700).cast("string")).alias("clip"), k.alias("k"), F.explode(F.array(f("hero", 4), f("rank", 6))).alias("f")).select("clip", "k", "f.*")
    now = F.struct(F.lit(1).alias("schema"), F.lit(True).alias("complete"), F.col("field").alias("algorithm_id"), F.lit("new").alias("signature"))
    return rows.withColumn("state", versions.freshness(F.col("saved"), F.col("legacy"), now, F.array(F.lit("reader-v2"), F.lit("other-v1"))))


def field_freshness(spark, sf_dir):
    return _states(spark, sf_dir).groupBy("field", "state").agg(F.count("*").alias("n"))


def clip_freshness(spark, sf_dir):
    return library.one_or_mixed(_states(spark, sf_dir), ["clip"], "state")


def upgrade_clips(spark, sf_dir):
    out = versions.affected(_states(spark, sf_dir), include_unknown=True)
    return out.select("clip", *[F.concat_ws(",", c).alias(c) for c in ("fields", "old_fields", "unknown_fields")])


def upgrade_paths(spark, sf_dir):
    return versions.upgradable(_states(spark, sf_dir).withColumnRenamed("clip", "path"))


QUERIES = (packet_gaps, copied_packets, seek_times, marker_groups, final_tables, reconciled_counts, field_freshness, clip_freshness, upgrade_clips, upgrade_paths)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    st = """with o as (select 'c' || (o_orderkey % 700) as clip, o_orderkey as k from orders), f as (select clip, k, 'hero' as field, k % 4 as a from o union all select clip, k, 'rank', k % 6 from o),
 st as (select clip, k, field, case when a > 1 then case when k % 5 > 0 then case when k % 3 = 0 then 'current' else 'old' end else 'unknown' end when a = 1 and k % 4 <> 2 then 'old' else 'unknown' end as state from f)"""
    res = f"with {HUD}, r as (select user_id, ['knock', 'assist', 'elimination', 'other'][event_id % 4 + 1] as kind, t_us as at_us, max(t_us) over (partition by user_id) as dur, case when event_id % 3 > 0 then t_us - event_id % 5 * 700000 end as begun, case event_id % 3 when 1 then 'shoot' when 2 then 'near_result' end as basis from hud)"
    end = lambda field, a, b: f"select k, '{field}' as field, case when k % 13 > 0 then k % {a} end as b, case when k % 17 > 0 then k % {a} + k % {b} - 1 end as l from o"
    return {
        "packet_gaps": f"with {HUD}, d as (select user_id, frame, case when event_id % 50 = 0 then t_us - 9000000 else t_us end as t from hud), g as (select *, t - lag(t) over (partition by user_id order by frame) as d from d) select user_id, count(*) as packets, min(d) as least, max(d) as most, median(d) as median, coalesce(min(d) > 0, true) as ordered from g group by 1",
        "copied_packets": f"with {HUD}, s as (select user_id, frame - 1 as i, case when frame % 3 = 0 then 'silence' else user_id || '-' || (event_id % 9) end as h from hud), t as (select user_id, list(h order by i) as hs from s where i between 6 and 14 group by 1), a as (select user_id, list(h order by i) as hs from s group by 1), x as (select a.user_id, unnest(range(0, len(a.hs) - len(t.hs) + 1)) as offset_, a.hs as w, t.hs as v from a join t using (user_id)) select user_id, min(offset_) as place from x where list_slice(w, offset_ + 1, offset_ + len(v)) = v group by 1",
        "seek_times": f"""{res}, e as (select *, greatest(0, least(at_us, coalesce(begun, at_us - 3000000) - case when begun is not null and coalesce(basis, '') <> 'near_result' then 2000000 else 0 end)) as s, max(at_us) over (partition by user_id, kind order by at_us rows between unbounded preceding and 1 preceding) as p from r where kind <> 'other')
 select user_id, kind, at_us, case when p is not null and s <= p then case when begun > p then least(at_us, p + 1000) else least(at_us, greatest(p + 1000, at_us - 3000000)) end else s end as seek_us, case when p is not null and s <= p and not coalesce(begun > p, false) then 'near_result' else coalesce(basis, case when begun is null then 'near_result' end) end as basis from e""",
        "marker_groups": f"{res}, c as (select *, at_us / dur as f, case when (at_us / dur - lag(at_us / dur) over (partition by user_id order by at_us)) * 900 < 36 then 0 else 1 end as c from r), g as (select *, sum(c) over (partition by user_id order by at_us rows unbounded preceding) as g from c) select user_id, min(at_us) as first_at, count(*) as n, round(avg(f), 9) as place from g group by user_id, g",
        "reconciled_counts": f"""with o as (select o_orderkey as k from orders), ev as (select distinct l_orderkey as k, ['elimination', 'assist', 'knock'][l_partkey % 3 + 1] as kind, l_partkey % 2 = 0 as elim, l_partkey % 5 as target, l_orderkey * 10 + l_partkey * 20000 as t, l_partkey % 7 > 0 as sure, l_partkey % 11 > 0 as own, l_partkey from lineitem),
 s as (select * from ev where sure and own), kl as (select k, count(*) filter (kind = 'elimination') as nk, count(*) filter (kind = 'knock') as nn, count(*) filter (kind = 'assist' and elim) as na, count(*) filter (kind = 'elimination' and t > k * 10 + 1000000) as late from s group by 1),
 ot as (select k, count(*) as n from s a where kind = 'assist' and elim and not exists (select 1 from s b where b.k = a.k and b.kind = 'elimination' and b.target = a.target) group by 1), op as (select distinct k from ev where kind = 'knock' and own and not sure),
 e as ({end('kills', 5, 4)} union all {end('assists', 7, 3)} union all {end('damage', 11, 9)}),
 x as (select e.*, case when k % 19 = 0 then k % 7 end as u, case when k % 10 = 0 then 'pending' when k % 10 = 1 then 'settled' end as st, coalesce(nk, 0) as nk, coalesce(na, 0) as na, coalesce(case when k % 2 = 0 then late end, 0) as late, coalesce(ot.n, 0) as no, k % 31 = 0 as vc from e left join kl using (k) left join ot using (k)),
 y as (select *, case when not (st is distinct from 'settled' and coalesce(u < l, false)) and l >= b then l - b end as d, case field when 'kills' then nk when 'assists' then na else 0 end as shown from x),
 z as (select *, case when d is null then true else (case when vc and st is distinct from 'settled' then false else coalesce(st = 'pending', false) or (coalesce(st = 'settled', false) and field = 'damage') or (st is distinct from 'settled' and (u is not null or k % 23 = 0 or k % 37 = 0)) end) or k % 29 = 0 end as p, coalesce(d, nullif(shown, 0)) as c from y),
 w as (select *, case when p and st is null and shown > coalesce(c, 0) then shown else c end as c2, coalesce(st = 'pending', false) and not vc as redo from z)
 select k::varchar as segment, field, (case when redo and field = 'kills' then case when d is not null then d + late else nullif(nk, 0) end when redo and field = 'assists' then nullif(no, 0) else c2 end)::bigint as count, p or (redo and field in ('kills', 'assists')) as partial from w
 union all select o.k::varchar, 'knockdowns', case when o.k % 3 > 0 and op.k is null then coalesce(nn, 0) else nullif(coalesce(nn, 0), 0) end, not (o.k % 3 > 0 and op.k is null) from o left join kl using (k) left join op using (k)""",
        "field_freshness": f"{st} select field, state, count(*) as n from st group by 1, 2",
        "clip_freshness": f"{st} select clip, case when min(state) = max(state) then min(state) else 'mixed' end as state from st group by 1",
        "upgrade_clips": f"{st}, g as (select clip, coalesce(string_agg(distinct field, ',' order by field) filter (state = 'old'), '') as o, coalesce(string_agg(distinct field, ',' order by field) filter (state = 'unknown'), '') as u from st group by 1) select clip, case when o <> '' and u <> '' then o || ',' || u else o || u end as fields, o as old_fields, u as unknown_fields from g where o <> '' or u <> ''",
        "upgrade_paths": f"{st} select clip as path, field from st group by 1, 2 having bool_or(state = 'old') and not bool_or(state = 'current')",
    }
