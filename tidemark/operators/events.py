"""Own events from a stream of counter readings: hits, kills and shots.

Rows (key, t_us, inactive, round_ended, damage, kills, ammo, icon, weapon_id, slot) of one recording are unique by time. Counters
are confirmed by their neighbours, grow by accepted steps only, start anew after a long silence, and count when they become visible
or after a new round only near a shot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import bitmap_dice
from .folds import runs, stable
from .joins import band_semi
from .scan import scan

# In microseconds; the largest step of each counter, the smallest similarity of icons.
NEAR, SILENCE, SHOT_NEAR_HIT, SHOT_NEAR_START, START = 1_100_000, 20_000_000, 1_500_000, 12_000_000, 15_000_000
STEPS = {"damage": ("hit", 1000), "kills": ("kill", 3)}
DROP, SAME_ICON = (1, 50), 0.65
EVENT = ["t_us", "kind", "before", "after", "evidence"]


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def accepted(rows: DataFrame, key: str, value: str, max_step: int) -> DataFrame:
    """Confirmed rows with ``ok``: whether the reading becomes the counter's new base. A jump over max_step is a misread and does
    not, unless the base is older than SILENCE; so each run without such a silence is scanned by itself."""

    def step(state, row):
        t, v = row["t_us"], row["v"]
        ok = state is None or t - state[1] > SILENCE or 0 <= v - state[0] <= max_step
        return ((v, t) if ok else state), [(row[key], t, v, row["upto"], row["before_own"], ok)]

    kind = rows.schema[key].dataType.simpleString()
    some = rows.select(key, "t_us", F.col(value).cast("long").alias("v"), "upto", "before_own")
    return scan(runs(some, [key], "t_us", SILENCE), [key, "_run"], ["t_us"], step, f"{key} {kind}, t_us long, v long, upto long, before_own long, ok boolean")


def counter_events(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, EVENT, sure) of one counter; ``sure`` is false for events that need a shot nearby: a counter that became visible, and
    one that shows a value right after a round ended."""
    kind, max_step = STEPS[value]
    w = Window.partitionBy(key).orderBy("t_us")
    ended = F.when(_flag("round_ended"), 1).otherwise(0)
    marked = rows.withColumn("upto", F.sum(ended).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before_own", F.col("upto") - ended)
    marked = marked.withColumn("begin", F.min("t_us").over(Window.partitionBy(key)))
    sure = stable(marked, key, ["t_us"], "t_us", value, NEAR, inactive="inactive")
    base = F.last(F.when(F.col("ok"), F.struct("v", "t_us", "upto")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = accepted(sure, key, value, max_step).withColumn("b", base).where("b is not null")
    grown = (F.col("v") > F.col("b.v")) & (F.col("v") - F.col("b.v") <= max_step) & (F.col("t_us") - F.col("b.t_us") <= SILENCE)
    reborn = (F.col("t_us") - F.col("b.t_us") > SILENCE) & (F.col("v") > 0) & (F.col("before_own") > F.col("b.upto"))
    grew = steps.where(grown)
    if kind == "kill":  # one event for each of several kills between two samples
        grew = grew.select(key, "t_us", F.explode(F.sequence(F.col("b.v"), F.col("v") - 1)).alias("before")).withColumn("after", F.col("before") + 1)
    else:
        grew = grew.select(key, "t_us", F.col("b.v").alias("before"), F.col("v").alias("after"))
    grew = grew.select(key, "t_us", F.lit(kind).alias("kind"), "before", "after", F.lit(f"own_{value}_counter").alias("evidence"), F.lit(True).alias("sure"))
    born = steps.where(reborn).select(key, "t_us", F.lit(kind), F.lit(0).cast("long"), F.col("v"), F.lit("new_round_counter"), F.lit(False))
    first = sure.groupBy(key).agg(F.min("t_us").alias("t_us"), F.min_by(F.col(value).cast("long"), "t_us").alias("v"), F.min("begin").alias("begin"))
    shown = first.where((F.col("v") > 0) & (F.col("t_us") - F.col("begin") >= START))
    shown = shown.select(key, "t_us", F.lit(kind), F.lit(None).cast("long"), "v", F.lit("own_counter_became_visible"), F.lit(False))
    return grew.unionAll(born).unionAll(shown)


def shots(rows: DataFrame, key: str) -> DataFrame:
    """(key, EVENT, same_weapon, similarity): rounds fired between two readings close in time; a spell outside the own view resets."""
    w = Window.partitionBy(key).orderBy("t_us")
    part = rows.withColumn("_part", F.sum(F.when(_flag("inactive"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    read = part.where(~_flag("inactive") & F.col("ammo").isNotNull())
    back = Window.partitionBy(key, "_part").orderBy("t_us")
    read = read.withColumn("old", F.lag(F.struct("t_us", "ammo", "icon", "weapon_id", "slot")).over(back))
    drop = F.col("old.ammo") - F.col("ammo")
    near = read.where((F.col("t_us") - F.col("old.t_us") <= NEAR) & drop.between(*DROP))
    alike = lambda c: F.col(f"old.{c}").isNull() | F.col(c).isNull() | (F.col(f"old.{c}") == F.col(c))
    near = near.withColumn("similarity", bitmap_dice(F.col("old.icon"), F.col("icon")))
    same = (F.col("similarity") >= SAME_ICON) & alike("weapon_id") & alike("slot")
    return near.select(key, "t_us", F.lit("shoot").alias("kind"), F.col("old.ammo").cast("long").alias("before"), F.col("ammo").cast("long").alias("after"), F.lit("ammo_decrease").alias("evidence"), same.alias("same_weapon"), F.round("similarity", 3).alias("similarity"))


def detect(rows: DataFrame, key: str) -> DataFrame:
    """(key, EVENT) of all own events."""
    counters = counter_events(rows, key, "damage").unionAll(counter_events(rows, key, "kills"))
    fired = shots(rows, key)
    hits = counters.where("sure and kind = 'hit'").select(key, "t_us")
    sure_shots = fired.where("same_weapon").unionAll(band_semi(fired.where("not same_weapon"), hits, key, "t_us", SHOT_NEAR_HIT)).select(key, *EVENT)
    late = band_semi(counters.where("not sure"), sure_shots.select(key, "t_us"), key, "t_us", SHOT_NEAR_START)
    return counters.where("sure").unionAll(late).select(key, *EVENT).unionAll(sure_shots)


def trusted_weapon(rows: DataFrame, key: str, least: float = 0.9, within_us: int = NEAR) -> DataFrame:
    """rows with ``trusted``: the weapon was read very surely, or twice within the band around the row."""
    w = Window.partitionBy(key, "weapon_id").orderBy("t_us").rangeBetween(-within_us, within_us)
    many = F.count("*").over(w) >= 2
    return rows.withColumn("trusted", F.coalesce(F.col("weapon_id").isNotNull() & ((F.col("weapon_confidence") >= least) | many), F.lit(False)))


def label_shots(fired: DataFrame, rows: DataFrame, key: str, bucket_us: int = 600_000) -> DataFrame:
    """fired with weapon_id, weapon_confidence and weapon_method: the trusted caption read at the shot itself, or the surest one
    of a trusted row within bucket_us whose icon is alike (0.8); else unknown."""
    t = trusted_weapon(rows, key).select(key, "t_us", F.col("weapon_id").alias("wid"), F.col("weapon_confidence").alias("wc"), "icon", "trusted")
    own = fired.join(t, [key, "t_us"], "left")
    good = t.where("trusted").select(key, F.col("t_us").alias("u"), F.col("wid").alias("nid"), F.col("wc").alias("nc"), F.col("icon").alias("nicon"))
    dealt = good.withColumn("_b", F.explode(F.array(*[F.floor(F.col("u") / bucket_us) + d for d in (-1, 0, 1)])))
    need = own.where(~_flag("trusted") & F.col("icon").isNotNull()).withColumn("_b", F.floor(F.col("t_us") / bucket_us))
    near = need.join(dealt, [key, "_b"]).where(F.abs(F.col("t_us") - F.col("u")) <= bucket_us).where(bitmap_dice(F.col("icon"), F.col("nicon")) >= 0.8)
    best = near.groupBy(key, "t_us").agg(F.max_by(F.struct("nid", "nc"), F.struct("nc", -F.col("u"))).alias("n"))
    out = own.join(best, [key, "t_us"], "left")
    weapon = F.when(_flag("trusted"), F.col("wid")).otherwise(F.col("n.nid"))
    sure = F.when(_flag("trusted"), F.col("wc")).otherwise(F.coalesce(F.col("n.nc"), F.lit(0.0)))
    return out.select(*fired.columns, weapon.alias("weapon_id"), F.round(sure, 3).alias("weapon_confidence"), F.when(weapon.isNotNull(), "native_text").otherwise("unknown").alias("weapon_method"))
