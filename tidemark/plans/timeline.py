"""More named queries: nearest times, overlaps, folds, names, file names and streams, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..session import ship
from ..operators import folds, intervals, joins
from .catalogue import EV, GAP, HOUR, SES, _events, _t

APART, TOLERANCE = 12 * HOUR, 24 * HOUR


def _of(spark, sf_dir, kind):
    return _events(spark, sf_dir).where(F.col("event_type") == kind)


def _sessions(spark, sf_dir, kind):
    return intervals.sessions(_of(spark, sf_dir, kind), "user_id", "t_us", 4 * GAP, HOUR, HOUR)


def asof_next_tolerance(spark, sf_dir):
    left = _of(spark, sf_dir, "purchase").select("event_id", "user_id", "t_us")
    return joins.asof_next(left, _of(spark, sf_dir, "click"), "user_id", "t_us", TOLERANCE)


def nearest_row(spark, sf_dir):
    left = _of(spark, sf_dir, "error").select("event_id", "user_id", "t_us")
    return joins.nearest(left, _of(spark, sf_dir, "signup"), "user_id", "t_us")


def overlap_join(spark, sf_dir):
    return joins.overlap(_sessions(spark, sf_dir, "click"), _sessions(spark, sf_dir, "error"), "user_id", 24 * HOUR)


def interval_subtract(spark, sf_dir):
    return intervals.subtract(_sessions(spark, sf_dir, "click"), _sessions(spark, sf_dir, "error"), "user_id")


def snap_align(spark, sf_dir):
    return intervals.snap(_sessions(spark, sf_dir, "click"), _of(spark, sf_dir, "view"), "user_id", "t_us")


def greedy_thinning(spark, sf_dir):
    return folds.thin(_events(spark, sf_dir), "user_id", "t_us", APART)


def event_fold(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("reset", F.col("event_type") == "signup")
    return folds.increments(ev, "user_id", ["t_us", "event_id"], "k", "reset").where("step > 0").select("event_id", "user_id", "t_us", F.col("step").cast("long").alias("step"))


def stable_counter_vote(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("k", F.col("k") % 5)
    return folds.stable(ev, "user_id", ["t_us", "event_id"], "t_us", "k", 24 * HOUR).select("event_id", "k", "agreeing")


def merge_existing_wins(spark, sf_dir):
    """Labels as known rows; documents add the rows without labels and the verdicts that are null there."""
    known = _t(spark, sf_dir, "labels").select("doc_id", F.nullif("toxic", F.lit(1)).cast("long").alias("flag"), F.col("quality").cast("long").alias("quality"))
    added = _t(spark, sf_dir, "documents").select("doc_id", F.lit(9).cast("long").alias("flag"), (F.col("n_chars") % 7).cast("long").alias("quality"))
    return joins.merge_existing(known, added, ["doc_id"])


def name_canonical(spark, sf_dir):
    c = _t(ship(spark), sf_dir, "customer").select("c_custkey", F.concat(F.lit("[t"), F.col("c_nationkey"), F.lit("] "), F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey") % 50).alias("name"))
    return c.groupBy(names.glyph_family(names.name_key(F.col("name"))).alias("name_key")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


def fuzzy_resolve(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.concat(F.expr("substring(p_name, 1, 2)"), F.expr("substring(p_name, 4)")).alias("name"))
    return joins.within_one_edit(names, _t(spark, sf_dir, "part").select(F.col("p_name").alias("known")), "name", "known")


def rank_distribution(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


def partners_having(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    return li.groupBy("l_suppkey").agg(F.count("*").alias("orders")).where("orders >= 2")


def stream_closed_sessions(spark, sf_dir):
    """The events read as a stream; sessions still open when it ends are not among the rows."""
    from ..streaming import sessions
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.startswith("local-cluster") or not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    base = f"{root.rstrip('/')}/tidemark/stream-{uuid.uuid4().hex}"
    schema = _t(spark, sf_dir, "events").schema
    live = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", True).parquet(sf_dir)
    closed = sessions.closed_sessions(live.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", "6 hours", "1 hour")
    done = sessions.run_to_end(closed, f"{base}/rows", f"{base}/checkpoint")
    return done.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


def queries() -> dict:
    every = (asof_next_tolerance, nearest_row, overlap_join, interval_subtract, snap_align, greedy_thinning, event_fold, stable_counter_vote, merge_existing_wins, name_canonical)
    every += (fuzzy_resolve, rank_distribution, partners_having, stream_closed_sessions)
    return {f.__name__: f for f in every}


def _ses(kind: str, name: str) -> str:
    """CTEs of the sessions of one kind of event, under the given name."""
    sql = SES.replace("from ev)", f"from ev where event_type = '{kind}')").replace(f"<= {GAP}", f"<= {4 * GAP}").replace(f"+ {2 * HOUR}", f"+ {HOUR}")
    for part in ("cut", "run", "pad", "mk", "pt"):
        sql = sql.replace(f"{part} as (", f"{part}_{name} as (").replace(f"from {part} ", f"from {part}_{name} ").replace(f"from {part})", f"from {part}_{name})")
    return sql.replace("ses as (", f"{name} as (")


def _merged(source: str) -> str:
    """Union of intervals. Equal ones are made one first: the two windows may order them differently."""
    return f"""(select user_id, min(start_us)::bigint as start_us, max(end_us)::bigint as end_us from (select *, sum(n) over (partition by user_id order by start_us, end_us rows unbounded preceding) as p from
 (select *, case when start_us <= max(end_us) over (partition by user_id order by start_us, end_us rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from (select distinct user_id, start_us, end_us from {source}))) group by user_id, p)"""


def oracle_sql() -> dict[str, str]:
    two = f"with {EV}, {_ses('click', 'a')}, {_ses('error', 'b')}"
    return {
        "asof_next_tolerance": f"with {EV} select p.event_id, p.user_id, p.t_us, case when c.t_us - p.t_us < {TOLERANCE} then c.t_us end as next_us from (select * from ev where event_type = 'purchase') p asof left join (select * from ev where event_type = 'click') c on p.user_id = c.user_id and p.t_us <= c.t_us",
        "nearest_row": f"with {EV} select e.event_id, e.user_id, e.t_us, s.t_us as near_us from (select * from ev where event_type = 'error') e left join (select * from ev where event_type = 'signup') s using (user_id) qualify row_number() over (partition by e.event_id order by abs(s.t_us - e.t_us), s.t_us) = 1",
        "overlap_join": f"{two} select a.user_id, a.start_us as l_start, a.end_us as l_end, b.start_us as r_start, b.end_us as r_end from a join b on a.user_id = b.user_id and a.start_us < b.end_us and b.start_us < a.end_us",
        "interval_subtract": f"""{two}, pts as (select user_id, unnest([start_us, end_us]) as t from (select * from a union all select * from b)),
 cells as (select user_id, t as start_us, lead(t) over (partition by user_id order by t) as end_us from (select distinct * from pts)),
 free as (select c.* from cells c where end_us is not null and exists (select 1 from a where a.user_id = c.user_id and a.start_us <= c.start_us and a.end_us >= c.end_us)
 and not exists (select 1 from b where b.user_id = c.user_id and b.start_us <= c.start_us and b.end_us >= c.end_us)) select * from {_merged('free')}""",
        "snap_align": f"""with {EV}, {_ses('click', 'a')}, m as (select user_id, t_us from ev where event_type = 'view'),
 lo as (select a.user_id, coalesce(m.t_us, a.start_us) as start_us, a.end_us from a asof left join m on a.user_id = m.user_id and a.start_us >= m.t_us),
 hi as (select lo.user_id, lo.start_us, coalesce(m.t_us, lo.end_us) as end_us from lo asof left join m on lo.user_id = m.user_id and lo.end_us <= m.t_us) select * from {_merged('hi')}""",
        "greedy_thinning": f"""with recursive {EV}, d as (select distinct user_id, t_us, t_us + {APART} as due from ev), nx as (select d.user_id, d.t_us, min(e.t_us) as after from d join d e on d.user_id = e.user_id and d.due <= e.t_us group by 1, 2),
 k as (select user_id, min(t_us) as t_us from d group by 1 union all select k.user_id, nx.after from k join nx using (user_id, t_us)) select user_id, t_us from k""",
        "event_fold": f"""with {EV}, r as (select *, count(*) filter (event_type = 'signup') over (partition by user_id order by t_us, event_id rows unbounded preceding) as r from ev),
 s as (select *, k - max(k) over (partition by user_id, r order by t_us, event_id rows between unbounded preceding and 1 preceding) as step from r) select event_id, user_id, t_us, step::bigint as step from s where step > 0""",
        "stable_counter_vote": f"""with {EV}, n as (select *, row_number() over (partition by user_id order by t_us, event_id) as i, k % 5 as v from ev)
 select a.event_id, a.v as k, count(*) as agreeing from n a join n b on a.user_id = b.user_id and b.i between a.i - 2 and a.i + 2 and a.v = b.v and abs(a.t_us - b.t_us) <= {24 * HOUR} group by 1, 2 having count(*) >= 2""",
        "merge_existing_wins": "select d.doc_id, coalesce(nullif(l.toxic, 1), 9)::bigint as flag, coalesce(l.quality, d.n_chars % 7)::bigint as quality from documents d left join labels l on d.doc_id = l.doc_id",
        "name_canonical": "with n as (select c_custkey, lower(regexp_replace(c_mktsegment || (c_custkey % 50)::varchar, '[^A-Za-z0-9]', '', 'g')) as k from customer) select case when length(k) >= 10 then regexp_replace(k, '[il]+', 'i', 'g') else k end as name_key, count(*) as n, min(c_custkey) as first_key from n group by 1",
        "fuzzy_resolve": "with n as (select distinct substring(p_name, 1, 2) || substring(p_name, 4) as name from part), d as (select distinct p_name as known from part) select name, known, levenshtein(name, known)::int as distance from n, d where levenshtein(name, known) <= 1",
        "rank_distribution": "select o_orderpriority, count(*) as n, count(*) filter (o_orderstatus = 'F') as finished from orders group by 1",
        "partners_having": "select l_suppkey, count(distinct l_orderkey) as orders from lineitem group by 1 having count(distinct l_orderkey) >= 2",
        "stream_closed_sessions": f"""with {EV}, c as (select *, case when t_us - lag(t_us) over (partition by user_id order by t_us) < {GAP} then 0 else 1 end as c from ev),
 r as (select *, sum(c) over (partition by user_id order by t_us) as r from c), s as (select user_id, min(t_us) as start_us, max(t_us) + {GAP} as end_us, count(*) as n from r group by user_id, r)
 select * from s where end_us <= (select max(t_us) from ev) - {HOUR}""",
    }
