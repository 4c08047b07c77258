"""What repeated readings of one thing agree on: values, numbers, names, ranks. Votes are counted by distinct frames, ties decide
nothing, and an agreed value is only as sure as its voters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import close_keys, name_key, strip_clan_tag
from .joins import _marks


def one_a_frame(rows: DataFrame, keys: list[str], frame: str, best: list[Column]) -> DataFrame:
    """The row of each frame that comes first in the order ``best``."""
    w = Window.partitionBy(*keys, frame).orderBy(*best)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stable_value(rows: DataFrame, keys: list[str], frame: str, time: str, value: str, least: int = 2) -> DataFrame:
    """(keys, value) of the latest reading whose value at least ``least`` distinct frames show (the last row of a frame counts)."""
    last = one_a_frame(rows, keys, frame, [F.desc(time)]).where(F.col(value).isNotNull())
    n = last.groupBy(*keys, value).agg(F.count("*").alias("n"), F.max(time).alias("t")).where(F.col("n") >= least)
    return n.groupBy(*keys).agg(F.max_by(value, "t").alias(value))


def earliest_consistent(rows: DataFrame, keys: list[str], frame: str, time: str, value: str, start: str, late: int) -> DataFrame:
    """(keys, value, lower_bound): the earliest reading that the next frame repeats. It is only a lower bound if it comes more than
    ``late`` after the start or if a smaller reading comes before it."""
    first = one_a_frame(rows.where(F.col(value).isNotNull()), keys, frame, [F.asc(time)])
    w = Window.partitionBy(*keys).orderBy(time)
    seen = first.withColumn("_next", F.lead(value).over(w)).withColumn("_low", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same = seen.where(F.col(value) == F.col("_next"))
    bound = (F.col(time) > F.col(start) + late) | F.coalesce(F.col("_low") < F.col(value), F.lit(False))
    got = same.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), bound.alias("b")), time).alias("s"))
    return got.select(*keys, F.col("s.v").alias(value), F.col("s.b").alias("lower_bound"))


def stable_run(rows: DataFrame, keys: list[str], time: str, value: str, frames: int, span: int) -> DataFrame:
    """(keys, value, from_us, to_us) of the earliest run of one value over at least ``frames`` distinct times and ``span``, before which
    no reading was larger."""
    d = rows.where(F.col(value).isNotNull()).groupBy(*keys, time).agg(F.max(value).alias(value))
    w = Window.partitionBy(*keys).orderBy(time)
    cut = d.withColumn("_c", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.withColumn("_top", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy(*keys, "_g", value).agg(F.count("*").alias("n"), F.min(time).alias("from_us"), F.max(time).alias("to_us"), F.max("_top").alias("top"))
    fit = runs.where((F.col("n") >= frames) & (F.col("to_us") - F.col("from_us") >= span) & (F.col("top") == F.col(value)))
    got = fit.groupBy(*keys).agg(F.min_by(F.struct(F.col(value).alias("v"), "from_us", "to_us"), "from_us").alias("s"))
    return got.select(*keys, F.col("s.v").alias(value), "s.from_us", "s.to_us")


def endpoint_change(rows: DataFrame, keys: list[str], time: str, value: str, confirmed: str) -> DataFrame:
    """(keys, changed_at, latest, unconfirmed, regressed): when the confirmed value was first shown for good, the last reading, whether
    that differs from the confirmed value, and whether an earlier reading was larger."""
    known = rows.where(F.col(value).isNotNull())
    other = F.max(F.when(F.col(value) != F.col(confirmed), F.col(time)))
    part = Window.partitionBy(*keys)
    after = known.withColumn("_other", other.over(part)).withColumn("_later", F.col("_other").isNull() | (F.col(time) > F.col("_other")))
    out = after.groupBy(*keys).agg(F.min(F.when(F.col("_later") & (F.col(value) == F.col(confirmed)), F.col(time))).alias("changed_at"), F.max_by(value, time).alias("latest"), F.max(value).alias("top"), F.first(confirmed).alias("_v"))
    return out.select(*keys, "changed_at", "latest", (F.col("latest") != F.col("_v")).alias("unconfirmed"), (F.col("top") > F.col("_v")).alias("regressed"))


def window_samples(rows: DataFrame, segments: DataFrame, key: str, back_us: int, tail: int, lead: int) -> DataFrame:
    """Rows with the segment they are samples of and their ``side``: the last ``tail`` rows in the back_us before it, its first
    ``lead`` and its last ``tail`` rows. Segments of a key are disjoint; rows before one may lie in the one before."""
    from .segments import inside

    ids = [key, "start_us", "end_us"]
    within = inside(rows, segments, key)
    up, down = Window.partitionBy(*ids).orderBy("t_us"), Window.partitionBy(*ids).orderBy(F.desc("t_us"))
    ranked = within.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    parts = ranked.where(F.col("_u") <= lead).withColumn("side", F.lit("lead")).unionByName(ranked.where(F.col("_d") <= tail).withColumn("side", F.lit("tail")))
    w = Window.partitionBy(key).orderBy("t_us")
    starts = segments.select(key, F.col("start_us").alias("t_us"), "start_us", "end_us")
    list_of = F.collect_list(F.struct(*[c for c in rows.columns if c != key])).over(w.rowsBetween(-(tail - 1), 0))
    held = rows.withColumn("_rows", list_of)
    both = held.select(key, "t_us", "_rows", F.lit(0).alias("_s")).unionByName(starts.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    last = F.last("_rows", True).over(Window.partitionBy(key).orderBy("t_us", "_s").rowsBetween(Window.unboundedPreceding, 0))
    before = both.withColumn("_rows", last).where("_s = 1").select(*ids, F.explode("_rows").alias("r")).select(*ids, "r.*")
    before = before.where((F.col("t_us") >= F.col("start_us") - back_us) & (F.col("t_us") <= F.col("start_us"))).withColumn("side", F.lit("before"))
    cols = [*rows.columns, "start_us", "end_us", "side"]
    return parts.select(*cols).unionByName(before.select(*cols))


def take_while(rows: DataFrame, keys: list[str], time: str, skip: Column, stop: Column, reverse: bool = False, within: int | None = None) -> DataFrame:
    """Rows in order (``reverse``: from the end) without those to skip, up to the first that stops or, if ``within`` is given, lies
    further than that from the first row kept."""
    w = Window.partitionBy(*keys).orderBy(F.desc(time) if reverse else F.asc(time))
    marked = rows.withColumn("_skip", F.coalesce(skip, F.lit(False))).withColumn("_stop", F.coalesce(stop, F.lit(False)))
    first = F.first(F.when(~F.col("_skip") & ~F.col("_stop"), F.col(time)), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    far = F.lit(False) if within is None else F.coalesce(~F.col("_skip") & (F.abs(F.col(time) - first) > within), F.lit(False))
    ended = F.max((F.col("_stop") & ~F.col("_skip")) | far).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_end", ended).where("not _end and not _skip").drop("_skip", "_stop", "_end")


def zero_window(rows: DataFrame, key: str, least: float = 0.78, within: int = 300_000_000, reverse: bool = False) -> DataFrame:
    """Rows of the own view, from the start (or the end), in which the counters do not stand yet: a row that ends a round stops the
    window once it has begun, a counter in sight or too long a time ends it; other views are passed over."""
    own = ~F.coalesce(F.col("inactive"), F.lit(False)) & ~F.coalesce(F.col("friend_spectate"), F.lit(False))
    ended = F.coalesce(F.col("round_ended"), F.lit(False))
    w = Window.partitionBy(key).orderBy(F.desc("t_us") if reverse else F.asc("t_us"))
    shown = F.coalesce(F.col("counter_marker_score"), F.lit(0.0)) >= least
    begun = F.coalesce(F.max(F.when(~ended & own & ~shown, F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = rows.withColumn("_begun", begun)
    skip = (ended & ~F.col("_begun")) | (~ended & ~own)
    out = take_while(marked, [key], "t_us", skip, ended | shown, reverse, within)
    return out.drop("_begun")


def vote(rows: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """(keys, votes, agreed): the most frequent value, null if fewer than ``least`` rows agree or two values tie. Two aggregates on
    one partitioning; a tie shows as two values that reach the most votes."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    top = n.groupBy(*keys, "votes").agg(F.count("*").alias("tied"), F.min(value).alias("v"))
    best = top.groupBy(*keys).agg(F.max(F.struct("votes", "tied", "v")).alias("b"))
    return best.select(*keys, F.col("b.votes").alias("votes"), F.when((F.col("b.votes") >= least) & (F.col("b.tied") == 1), F.col("b.v")).alias("agreed"))


def agreed_number(reads: DataFrame, keys: list[str], text: str, confidence: str, least: float = 0.88) -> DataFrame:
    """(keys, agreed, confidence) of numbers that several models read: the one value that more of them (two at least) read than any
    other; as sure as the second surest of its voters."""
    ok = reads.where(F.btrim(F.col(text)).rlike(r"^\d+$") & (F.col(confidence) >= least)).withColumn("_n", F.regexp_replace(F.btrim(F.col(text)), r"^0+(?=\d)", ""))
    best = vote(ok, keys, "_n").where("agreed is not null")
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence))
    second = ok.join(best, keys).where("_n = agreed").withColumn("_r", F.row_number().over(w)).where("_r = 2")
    return second.select(*keys, "agreed", F.col(confidence).alias("confidence"))


def unanimous(rows: DataFrame, keys: list[str], value: str, least: int = 2, confidence: str | None = None, weight: str | None = None) -> DataFrame:
    """(keys, agreed, votes[, confidence]) where at least ``least`` rows have a value and all have the same; as sure as the least sure.
    weight: how many readings a row stands for."""
    known = rows.where(F.col(value).isNotNull())
    more = [F.min(confidence).alias("confidence")] if confidence else []
    g = known.groupBy(*keys).agg(F.min(value).alias("agreed"), F.max(value).alias("_m"), (F.sum(weight) if weight else F.count("*")).alias("votes"), *more)
    return g.where((F.col("agreed") == F.col("_m")) & (F.col("votes") >= least)).drop("_m")


def detail_vote(rows: DataFrame, keys: list[str], value: str, detail: str, confidence: str, least: int = 2) -> DataFrame:
    """unanimous value with its ``detail``, which is kept only if at least ``least`` rows of that value name one and none another."""
    top = unanimous(rows, keys, value, least, confidence)
    part = unanimous(rows.where(F.col(detail).isNotNull()).withColumn("_k", F.col(value)), [*keys, "_k"], detail, least).select(*keys, F.col("_k").alias("agreed"), F.col("agreed").alias("detail"))
    return top.join(part, [*keys, "agreed"], "left")


def consensus_name(reads: DataFrame, keys: list[str], name: str, confidence: str, minimum: int = 2, same_player: bool = False, verified: str | None = None) -> DataFrame:
    """(keys, name, confidence, consensus_confidence, votes) of the name that the readings agree on.

    Readings under 0.8 or without letters do not count. The name key with most votes wins, of equal ones the more confident; but if
    another key with as many votes is not just a close misreading of it, nothing is agreed. Its spelling is the most frequent, then
    most confident one. same_player: readings known to be of one player; then readings seen whole (``verified``) go first where they
    suffice, and a reading that a longer one of two or more sure votes continues by one or two letters is a cut-off reading of it.
    The groups are (keys, name key), so a player with any number of readings is summed before anything is compared."""
    keep = [F.col(k) for k in keys]
    whole = F.coalesce(F.col(verified), F.lit(False)) if verified else F.lit(False)
    v = reads.select(*keep, strip_clan_tag(F.col(name)).alias("n"), F.col(confidence).alias("c"), whole.alias("w")).withColumn("k", name_key(F.col("n")))
    v = v.where((F.col("c") >= 0.8) & (F.col("k") != ""))
    spelled = v.groupBy(*keys, "k", "n", "w").agg(F.count("*").alias("s"), F.max("c").alias("cm"), F.min("c").alias("cl"), F.sum("c").alias("cs"), F.count_if(F.col("c") >= 0.85).alias("sure"))
    if same_player:
        clear = spelled.where("w").groupBy(*keys, "k").agg(F.sum("s").alias("s")).where(F.col("s") >= minimum).select(*keys).distinct().withColumn("_clear", F.lit(True))
        spelled = spelled.join(clear, keys, "left").where("_clear is null or w").drop("_clear")
        full = spelled.groupBy(*keys, "k").agg(F.sum("sure").alias("sure")).where(F.col("sure") >= minimum)
        cut = full.select(*keys, F.explode(F.array(*[F.expr(f"left(k, length(k) - {d})") for d in (1, 2)])).alias("k")).where("k <> ''").distinct()
        spelled = spelled.join(cut, [*keys, "k"], "left_anti")
    spelled = spelled.groupBy(*keys, "k", "n").agg(F.sum("s").alias("s"), F.max("cm").alias("cm"), F.min("cl").alias("cl"), F.sum("cs").alias("cs"))
    by_key = spelled.groupBy(*keys, "k").agg(F.sum("s").alias("votes"), F.sum("cs").alias("sum"), F.min("cl").alias("low"), F.max_by("n", F.struct("s", "cm", "n")).alias("spelling")).where(F.col("votes") >= minimum)
    best = by_key.groupBy(*keys).agg(F.max(F.struct("votes", "sum", "k")).alias("b")).select(*keys, F.col("b.votes").alias("votes"), F.col("b.k").alias("k"))
    rival = by_key.select(*keys, F.col("k").alias("k2"), "votes").join(best, [*keys, "votes"]).where((F.col("k2") != F.col("k")) & ~close_keys(F.col("k2"), F.col("k"))).select(*keys).distinct()
    won = by_key.join(best.select(*keys, "k"), [*keys, "k"]).join(rival, keys, "left_anti")
    middle = v.join(won.select(*keys, "k"), [*keys, "k"], "left_semi").groupBy(*keys).agg(F.median("c").alias("consensus_confidence"))
    return won.join(middle, keys).select(*keys, F.col("spelling").alias("name"), F.col("low").alias("confidence"), "consensus_confidence", "votes")


def canonical_name(name: Column, confidence: Column, votes: Column, reference: Column, ref_confidence: Column, ref_votes: Column, same_player: bool = False) -> Column:
    """The reference's spelling where it is close enough and better proved than the reading itself; else the reading's own."""
    own, ref = strip_clan_tag(name), strip_clan_tag(reference)
    a, b = name_key(name), name_key(reference)
    close = close_keys(a, b, 2 if same_player else 6)
    strong = F.lit(same_player) & (F.coalesce(ref_confidence, F.lit(0.0)) >= 0.86) & (ref_votes >= F.greatest(F.lit(4), 2 * F.coalesce(votes, F.lit(1))))
    weak = (a != b) & ((F.coalesce(confidence, F.lit(0.0)) >= 0.92) | (F.coalesce(ref_confidence, F.lit(0.0)) < 0.86) | (F.coalesce(ref_votes, F.lit(0)) < 3))
    return F.when(name.isNull() | reference.isNull() | ~close, own).when(strong | ~weak, ref).otherwise(own)


def best_of_views(views: DataFrame, keys: list[str], name: str, confidence: str) -> DataFrame:
    """(keys, name, confidence, view_agreement): of several views of one frame, the reading most of them share, then the surest."""
    v = views.where(F.col(name).isNotNull()).withColumn("_k", name_key(F.col(name)))
    n = F.count("*").over(Window.partitionBy(*keys, "_k"))
    return v.withColumn("_n", n).groupBy(*keys).agg(F.max(F.struct(F.col("_n").alias("view_agreement"), F.col(confidence).alias("confidence"), F.col(name).alias("name"))).alias("b")).select(*keys, "b.name", "b.confidence", "b.view_agreement")


def account_prefixes(confirmed: DataFrame, prefixes: DataFrame, keys: list[str], name: str, prefix: str, confidence: str, clips: int = 3) -> DataFrame:
    """(keys, name, confidence, votes): the known account that the visible prefixes of a covered name point to.

    confirmed: one row for each clip with a confirmed account; names of at least ``clips`` clips count. A prefix (its last letter is
    dropped: it may be half covered) votes if it starts exactly one of them and covers half of it; two votes for one name and none
    for another decide. The join is on the prefix itself: every account gives all its prefixes of half its length or more, but a
    start that several accounts share is one row, and so are equal readings: no join makes more rows than there are readings."""
    known = confirmed.groupBy(F.col(name).alias("known")).agg(F.count("*").alias("n")).where(F.col("n") >= clips).select("known", name_key(F.col("known")).alias("k")).where(F.length("k") >= 2)
    cuts = F.transform(F.sequence(F.ceil(F.length("k") / 2).cast("int"), F.length("k")), lambda i: F.substring(F.col("k"), F.lit(1), i))
    one = lambda rows, key: rows.groupBy(key).agg(F.min("known").alias("_name"), F.count("*").alias("_known")).select(key, F.when(F.col("_known") == 1, F.col("_name")).alias(f"{key}_name"), F.lit(True).alias(f"{key}_found"))
    exact = one(known.select("known", F.col("k").alias("_whole")), "_whole")
    begun = one(known.where(F.length("k") >= 4).select("known", F.explode(cuts).alias("_p")), "_p")
    equal = prefixes.where(F.col(confidence) >= 0.85).groupBy(*keys, F.col(prefix).alias("_prefix")).agg(F.min(confidence).alias("_c"), F.count("*").alias("_votes"))
    key = name_key(F.regexp_replace(F.col("_prefix"), r"^\W*[A-Za-z0-9]{2,6}\W*\s+", ""))
    p = equal.select(*keys, "_c", "_votes", name_key(F.col("_prefix")).alias("_whole"), F.substring(key, F.lit(1), F.length(key) - 1).alias("_p"))
    enough = (F.length("_p") >= 3) | ((F.length("_p") >= 2) & ~F.col("_p").rlike(r"^\p{ASCII}*$"))
    both = p.join(exact, "_whole", "left").join(begun, "_p", "left")
    meant = F.when(F.col("_whole_found"), F.col("_whole_name")).when(enough, F.col("_p_name"))
    return unanimous(both.withColumn("_name", meant), keys, "_name", 2, "_c", "_votes").select(*keys, F.col("agreed").alias("name"), "confidence", "votes")


def nearest_confirmed(rows: DataFrame, marks: DataFrame, key: str, time: str) -> DataFrame:
    """rows with the times of the last mark before and the first mark after (of equal time: neither)."""
    early = _marks(rows.withColumn("_t", F.col(time)).withColumn(time, F.col(time) - 1), marks, key, time).drop("_ahead").withColumnRenamed("_back", "previous_us")
    late = _marks(early.withColumn(time, F.col("_t") + 1), marks, key, time).drop("_back").withColumnRenamed("_ahead", "following_us")
    return late.withColumn(time, F.col("_t")).drop("_t")
