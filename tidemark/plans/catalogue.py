"""Named queries over the test tables, one or more for each operator, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals, joins, readings, verdicts
from ..session import ship

HOUR = 3_600_000_000
GAP, PRE, POST = 6 * HOUR, HOUR, 2 * HOUR


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    known = F.when(F.col("event_type") != "error", cents)
    return _t(spark, sf_dir, "events").select("event_id", F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("t_us"), "user_id", "event_type", known.alias("cents"), F.get_json_object("props", "$.k").cast("int").alias("k"))


EV = """ev as (select event_id, epoch_us(ts) as t_us, user_id, event_type,
  case when event_type <> 'error' then cast(round(value * 100) as bigint) end as cents, cast(json_extract_string(props, '$.k') as int) as k from events)"""
SES = f"""cut as (select *, case when t_us - lag(t_us) over (partition by user_id order by t_us) <= {GAP} then 0 else 1 end as c from ev),
run as (select *, sum(c) over (partition by user_id order by t_us) as r from cut),
pad as (select user_id, greatest(min(t_us) - {PRE}, 0) as s, max(t_us) + {POST} as e from run group by user_id, r),
mk as (select *, case when s <= max(e) over (partition by user_id order by s, e rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from pad),
pt as (select *, sum(n) over (partition by user_id order by s, e rows unbounded preceding) as p from mk),
ses as (select user_id, min(s)::bigint as start_us, max(e)::bigint as end_us from pt group by user_id, p)"""


def sessionize_merge(spark, sf_dir):
    return intervals.sessions(_events(spark, sf_dir), "user_id", "t_us", GAP, PRE, POST).select("user_id", "start_us", "end_us")


def session_increments(spark, sf_dir):
    ev = _events(spark, sf_dir)
    inside = joins.in_interval(ev, intervals.sessions(ev, "user_id", "t_us", GAP, PRE, POST), "user_id", "t_us")
    total, partial = verdicts.bounded_sum(F.col("cents"), F.lit(False))
    return inside.groupBy("user_id", "start_us", "end_us").agg(F.count("*").alias("n_events"), total.alias("cents"), partial.alias("lower_bound"))


def flagship(spark, sf_dir):
    ship(spark)
    s = session_increments(spark, sf_dir)
    tests = [verdicts.at_least(F.col("cents"), 20000, F.col("lower_bound")), verdicts.at_least(F.col("n_events"), 8)]
    return s.withColumn("verdict", verdicts.assess(tests))


def interval_difference(spark, sf_dir):
    return intervals.gaps(sessionize_merge(spark, sf_dir), "user_id")


def contiguous_ranges(spark, sf_dir):
    return intervals.ranges(_t(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


def asof_previous(spark, sf_dir):
    ev = _events(spark, sf_dir)
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "t_us")
    return joins.asof_previous(left, ev.where("event_type = 'click'"), "user_id", "t_us", "cents")


def band_semi_join(spark, sf_dir):
    ev = _events(spark, sf_dir).select("event_id", "user_id", "t_us", "event_type")
    return joins.band_semi(ev.where("event_type = 'error'"), ev.where("event_type = 'signup'"), "user_id", "t_us", 2 * HOUR)


def mutual_unique_match(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").cast("long").alias("bal"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor("s_acctbal").cast("long").alias("bal"))
    return joins.mutual_unique(c.withColumn("bal", F.floor(F.col("bal") / 500)), s.withColumn("bal", F.floor(F.col("bal") / 500)), ["nation", "bal"], "c_custkey", "s_suppkey")


def threshold_three_valued(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    tests = [verdicts.at_least(F.col("n_chars"), 1000), verdicts.at_least(F.col("quality"), 1)]
    return d.select("doc_id", verdicts.assess(tests, "any").alias("any_verdict"), verdicts.assess(tests, "all").alias("all_verdict"))


def sum_lower_bound(spark, sf_dir):
    total, partial = verdicts.bounded_sum(F.col("cents"), F.lit(False))
    return _events(spark, sf_dir).groupBy("user_id").agg(total.alias("cents"), partial.alias("lower_bound"), F.count("cents").alias("known"))


def consensus_vote(spark, sf_dir):
    return readings.vote(_events(spark, sf_dir).withColumn("k", F.col("k") % 7), ["user_id", "event_type"], "k")


def counter_drop_lag(spark, sf_dir):
    ev = _events(spark, sf_dir).where("event_type in ('click', 'view')")
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    ev = ev.select("event_id", "user_id", "event_type", "k", F.lag("k").over(w).alias("before"), F.lag("event_type").over(w).alias("kind_before"))
    return ev.where("k < before and event_type = kind_before").select("event_id", "user_id", "before", F.col("k").alias("after"))


def dedupe_first(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("t_us", "event_id")).alias("event_id"), F.min("t_us").alias("t_us"))


def dedupe_last(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("t_us", "event_id")).alias("event_id"), F.max("t_us").alias("t_us"))


def facet_rollup(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return o.rollup("y", "m").agg(F.count("*").alias("n"))


def unknown_last_rank(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    w = Window.partitionBy("source").orderBy(verdicts.unknown_last("quality"), F.desc("n_chars"), "doc_id")
    return d.select("doc_id", "source", F.row_number().over(w).cast("long").alias("place"))


def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


def bucket_groups(spark, sf_dir):
    b = F.floor(F.col("o_totalprice") / 10000) * 10000
    o = _t(spark, sf_dir, "orders").select(F.concat(F.lit("price:"), F.coalesce(b.cast("long").cast("string"), F.lit("unknown"))).alias("bucket"))
    return o.groupBy("bucket").agg(F.count("*").alias("n"))


def frequency_distinct(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("n"))


def pending_antijoin(spark, sf_dir):
    return _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def state_pivot(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return _events(spark, sf_dir).groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


def queries() -> dict:
    every = (sessionize_merge, session_increments, flagship, interval_difference, contiguous_ranges, asof_previous, band_semi_join, mutual_unique_match, threshold_three_valued)
    every += (sum_lower_bound, consensus_vote, counter_drop_lag, dedupe_first, dedupe_last, facet_rollup, unknown_last_rank, topk_per_group, bucket_groups, frequency_distinct, pending_antijoin, state_pivot)
    return {f.__name__: f for f in every}


INC = f"""with {EV}, {SES}, inc as (select user_id, start_us, end_us, count(*) as n_events, sum(cents)::bigint as cents, bool_or(cents is null) as lower_bound
  from ev join ses using (user_id) where t_us between start_us and end_us group by all)"""
VERDICT = "case when {0} then 'kept' when not ({0}) then 'rejected' else 'review' end"


def oracle_sql() -> dict[str, str]:
    enough = "((case when cents >= 20000 then true when cents is null or lower_bound then null else false end) or n_events >= 8)"
    docs = "documents d left join labels l on d.doc_id = l.doc_id"
    return {
        "sessionize_merge": f"with {EV}, {SES} select * from ses",
        "session_increments": f"{INC} select * from inc",
        "flagship": f"{INC} select *, {VERDICT.format(enough)} as verdict from inc",
        "interval_difference": f"with {EV}, {SES} select * from (select user_id, end_us as start_us, lead(start_us) over (partition by user_id order by start_us) as end_us from ses) where end_us is not null",
        "contiguous_ranges": "select l_suppkey, min(n) as first, max(n) as last from (select l_suppkey, n, n - row_number() over (partition by l_suppkey order by n) as g from (select distinct l_suppkey, l_orderkey as n from lineitem)) group by l_suppkey, g",
        "asof_previous": f"with {EV} select p.event_id, p.user_id, p.t_us, c.t_us as prev_us, c.cents as prev_value from (select * from ev where event_type = 'purchase') p asof left join (select * from ev where event_type = 'click') c on p.user_id = c.user_id and p.t_us >= c.t_us",
        "band_semi_join": f"with {EV} select event_id, user_id, t_us, event_type from ev e where event_type = 'error' and exists (select 1 from ev s where s.event_type = 'signup' and s.user_id = e.user_id and abs(s.t_us - e.t_us) <= {2 * HOUR})",
        "mutual_unique_match": "with c as (select c_nationkey as nation, floor(floor(c_acctbal) / 500)::bigint as bal, min(c_custkey) as c_custkey from customer group by 1, 2 having count(*) = 1), s as (select s_nationkey as nation, floor(floor(s_acctbal) / 500)::bigint as bal, min(s_suppkey) as s_suppkey from supplier group by 1, 2 having count(*) = 1) select nation, bal, c_custkey, s_suppkey from c join s using (nation, bal)",
        "threshold_three_valued": f"select d.doc_id, {VERDICT.format('(n_chars >= 1000 or quality >= 1)')} as any_verdict, {VERDICT.format('(n_chars >= 1000 and quality >= 1)')} as all_verdict from {docs}",
        "sum_lower_bound": f"with {EV} select user_id, sum(cents)::bigint as cents, bool_or(cents is null) as lower_bound, count(cents) as known from ev group by user_id",
        "consensus_vote": f"with {EV}, n as (select user_id, event_type, k % 7 as k, count(*) as votes from ev where k is not null group by all), m as (select user_id, event_type, max(votes) as votes from n group by all) select user_id, event_type, votes, case when votes >= 2 and count(*) = 1 then min(k) end as agreed from m join n using (user_id, event_type, votes) group by user_id, event_type, votes",
        "counter_drop_lag": f"with {EV} select event_id, user_id, before, k as after from (select *, lag(k) over w as before, lag(event_type) over w as kb from ev where event_type in ('click', 'view') window w as (partition by user_id order by t_us, event_id)) where k < before and event_type = kb",
        "dedupe_first": f"with {EV} select user_id, event_type, event_id, t_us from ev qualify row_number() over (partition by user_id, event_type order by t_us, event_id) = 1",
        "dedupe_last": f"with {EV} select user_id, event_type, event_id, t_us from ev qualify row_number() over (partition by user_id, event_type order by t_us desc, event_id desc) = 1",
        "facet_rollup": "select year(o_orderdate)::int as y, month(o_orderdate)::int as m, count(*) as n from orders group by rollup (y, m)",
        "unknown_last_rank": f"select d.doc_id, source, row_number() over (partition by source order by quality desc nulls last, n_chars desc, d.doc_id) as place from {docs}",
        "topk_per_group": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 3",
        "bucket_groups": "select 'price:' || coalesce((floor(o_totalprice / 10000) * 10000)::bigint::varchar, 'unknown') as bucket, count(*) as n from orders group by 1",
        "frequency_distinct": "select event_type, count(distinct user_id) as users, count(*) as n from events group by 1",
        "pending_antijoin": "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
        "state_pivot": "select user_id, " + ", ".join(f"count(*) filter (event_type = '{k}') as n_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    }
