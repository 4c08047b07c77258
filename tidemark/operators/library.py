"""The clip library: rows from manifests, overlays, filters, orders, groups, facets, canonical names, moved files.

A clip is a row (path, source, name, recorded, exported_us, start_us, duration_us, account, account_aliases, teammates, weapons, hero,
rank, division, kills, damage, assists, knockdowns, round_kills, round_damage, partial: a map by counter). Operators use the columns
they name and keep all others. Unknown is null and never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import excluded_key, glyph_family, name_key, strip_clan_tag
from ..functions.times import day_label, recording_day, recording_time
from ..functions.values import known, path_key

# Labels of the sorts by a metric and widths of their groups.
METRICS = {"damage": "片段伤害", "kills": "片段击杀", "assists": "片段助攻", "knockdowns": "片段击倒", "round_damage": "全局伤害", "round_kills": "全局击杀"}
WIDTHS = {"damage": 100, "round_damage": 500}
# Ranks from low to high.
RANKS = ("unranked", "rookie", "bronze", "silver", "gold", "platinum", "diamond", "master", "predator")
PLACE = {"recorded", "recorded_newest", "recorded_oldest"}


# --- filters


def matches(clips: DataFrame, source: str = "", date: str = "", account: str = "", teammate: str = "", weapon: str = "", hero: str = "", rank: str = "", division: str = "") -> DataFrame:
    """Clips that fit all filters given; 'unknown' asks for clips without a date, hero or rank, a date may be a year, month or day."""
    test = F.lit(True)
    if source:
        test &= (F.col("source") == source) | F.coalesce(F.col("clip_source") == source, F.lit(False)) if "clip_source" in clips.columns else F.col("source") == source
    if date:
        day = recording_day(F.col("recorded"), F.coalesce(F.col("source"), F.col("name")))
        test &= (day == "") if date == "unknown" else (F.startswith(day, F.lit(date)) & F.lit(date).rlike(r"^\d{4}(?:-\d{2}(?:-\d{2})?)?$"))
    if account:
        names = F.concat(F.array("account"), F.coalesce("account_aliases", F.array().cast("array<string>")))
        test &= F.exists(names, lambda n: n.isNotNull() & (name_key_of(n) == _key(account)))
    if teammate:
        test &= F.coalesce(F.exists("teammates", lambda n: name_key_of(n) == _key(teammate)), F.lit(False))
    if weapon:
        test &= F.coalesce(F.array_contains("weapons", weapon), F.lit(False))
    for value, column in ((hero, "hero"), (rank, "rank"), (division, "division")):
        if value:
            test &= F.col(column).isNull() if value == "unknown" and column != "division" else F.coalesce(F.col(column) == value, F.lit(False))
    return clips.where(test)


def _key(name: str) -> str:
    """name_key of one name given as a parameter."""
    import re
    import unicodedata

    from ..functions.names import TAGS

    bare = unicodedata.normalize("NFKC", name).strip()
    for tag in TAGS:
        bare = re.sub(tag, "", bare)
    return "".join(c for c in bare.casefold() if c.isalnum())


def name_key_of(name: Column) -> Column:
    """name_key inside an array function, where no Python function can run: for names that are stored normalised."""
    from ..functions.names import TAGS

    for tag in TAGS:
        name = F.regexp_replace(name, tag, "")
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def detail_filter(field: str, value: str, division: str = "") -> dict:
    """The filters that a click on a detail of a clip sets."""
    return {"rank": value, "division": division} if field == "rank" else {field: value}


def contains_text(clips: DataFrame, query: str, columns: tuple[str, ...] = ("name", "source"), lists: tuple[str, ...] = ("weapons",)) -> DataFrame:
    """Clips whose columns, put together, contain the text, whatever its case."""
    whole = F.concat_ws(" ", *columns, *lists)
    return clips.where(F.contains(F.lower(whole), F.lower(F.lit(query.strip())))) if query.strip() else clips


def in_collection(clips: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    keys = files.select(path_key(F.col(path)).alias("_k")).distinct()
    return clips.withColumn("_k", path_key(F.col(path))).join(keys, "_k", "left_semi").select(*clips.columns)


def at_least_long(clips: DataFrame, least: float, duration: str = "duration") -> DataFrame:
    """Clips of at least that duration; unknown and endless ones stay."""
    d = F.col(duration).cast("double")
    return clips.where(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d >= least))


def passes(value: Column, partial: Column, least: float, keep_unknown: bool) -> Column:
    """Whether a count reaches a threshold; an unknown one, or a lower bound below it, passes as ``keep_unknown`` says."""
    unsure = value.isNull() | (F.coalesce(partial, F.lit(False)) & (value < least))
    return F.when(unsure, keep_unknown).otherwise(value >= least)


# --- orders and groups


def metric(sort: str) -> Column:
    return F.col(sort) if sort in METRICS else F.lit(None).cast("double")


def _instant(iso: Column) -> Column:
    return F.unix_micros(F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm"))))


def order_keys(sort: str, descending: bool = True) -> list[Column]:
    """Columns to sort clips by: unknown last in either direction; clips of one recording in its order; then path, so that no order
    is left to chance."""
    way = lambda c, down: c.desc_nulls_last() if down else c.asc_nulls_last()
    last = [F.col("source_index").asc(), F.col("start_us").asc(), F.col("path").asc()]
    if sort in METRICS:
        return [way(known(metric(sort)), descending), *last]
    if sort == "recent":
        return [way(F.col("exported_us"), descending), *last]
    newest = descending if sort == "recorded" else sort == "recorded_newest"
    at = _instant(F.coalesce("recorded", recording_time(F.coalesce("source", "name"))))
    return [way(at, newest), way(F.when(at.isNotNull(), F.col("start_us")), newest), *last]


def group_of(sort: str) -> Column:
    """struct(key, label, unknown) of the group a clip stands in under a sort: a day, an exact count, or a range of damage."""
    make = lambda key, label, unknown: F.struct(key.alias("key"), label.alias("label"), unknown.alias("unknown"))
    if sort not in METRICS:
        day = recording_day(F.col("recorded"), F.coalesce("source", "name"))
        return make(F.concat(F.lit("date:"), day), day_label(day), day == "")
    value, name = known(metric(sort)), METRICS[sort]
    if sort in WIDTHS:
        low = (F.floor(value / WIDTHS[sort]) * WIDTHS[sort]).cast("long")
        span = F.concat(low.cast("string"), F.lit("–"), (low + WIDTHS[sort] - 1).cast("string"))
    else:
        low = value.cast("long")
        span = low.cast("string")
    return F.when(value.isNull(), make(F.lit(f"{sort}:unknown"), F.lit(f"{name} · 待确认"), F.lit(True))).otherwise(make(F.concat(F.lit(f"{sort}:"), low.cast("string")), F.concat(F.lit(f"{name} · "), span), F.lit(False)))


def grouped(clips: DataFrame, sort: str, position: str = "position") -> DataFrame:
    """(key, label, unknown, n, first_position) of the groups of clips whose position in the sort is known; the unknown group last."""
    g = clips.withColumn("_g", group_of(sort)).groupBy("_g.key", "_g.label", "_g.unknown").agg(F.count("*").alias("n"), F.min(position).alias("first_position"))
    return g.orderBy("unknown", "first_position")


def rank_order(rank: Column) -> Column:
    """Place of a rank from low to high; other names after all known ones."""
    place = F.array_position(F.array(*map(F.lit, RANKS)), rank)
    return F.when(place > 0, place).otherwise(len(RANKS) + 1)


def numbered(rows: DataFrame, keys: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """rows with their number, from 1, in the order within their key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


# --- facets and totals


def frequency(clips: DataFrame, values: str, match: Column, ignore_case: bool = True) -> DataFrame:
    """(value, n): in how many distinct matches each value occurs; spellings that differ in case are one, shown as its first in order."""
    each = clips.select(match.alias("m"), F.explode(F.array_distinct(values)).alias("value")).where("value is not null")
    key = F.lower("value") if ignore_case else F.col("value")
    return each.groupBy(key.alias("k")).agg(F.min("value").alias("value"), F.countDistinct("m").alias("n")).select("value", "n")


def shares(counts: DataFrame, name: str, n: str) -> DataFrame:
    """counts with each row's share of the sum and the sum of the shares before it, largest first. One row for each name of a facet."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(n), F.asc(name))
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))
    upto = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    return counts.withColumn("share", F.col(n) / total).withColumn("before", upto / total)


def known_partners(seen: DataFrame, me: str, name: str, match: str, confidence: str, least: int = 2, sure: float = 0.8) -> DataFrame:
    """(name, n) of the players seen in at least ``least`` distinct matches, read surely enough and not the player self."""
    other = (F.col(confidence) >= sure) & (name_key(F.col(name)) != name_key(F.col(me)))
    return seen.where(other).groupBy(name_key(F.col(name)).alias("k")).agg(F.min(name).alias("name"), F.countDistinct(match).alias("n")).where(F.col("n") >= least).select("name", "n")


def rank_counts(clips: DataFrame, rank: str) -> DataFrame:
    """(rank, n, place): clips by rank, unknown names as 'unknown' and last."""
    r = F.when(F.col(rank).isin(*RANKS), F.col(rank)).otherwise("unknown")
    return clips.groupBy(r.alias("rank")).agg(F.count("*").alias("n")).withColumn("place", rank_order(F.col("rank")).cast("int"))


def day_totals(clips: DataFrame, day: Column) -> DataFrame:
    """(year, month, day, n) of all levels; unknown days are left out."""
    d = clips.select(F.try_to_date(day, "yyyy-MM-dd").alias("d")).where("d is not null")
    return d.select(F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day")).rollup("year", "month", "day").agg(F.count("*").alias("n"))


def verdict_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of kept, rejected and review counts; null where no row has any."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("kept", "rejected", "review")])


def one_or_mixed(rows: DataFrame, keys: list[str], state: str) -> DataFrame:
    """(keys, state): the one state that all rows of a key have, else 'mixed'; without any known state: null."""
    return rows.groupBy(*keys).agg(F.when(F.min(state) == F.max(state), F.min(state)).when(F.min(state).isNotNull(), "mixed").alias(state))


# --- dedupe and sets


def first_of(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in the order; rows with an empty or unknown key are dropped."""
    keyed = rows.withColumn("_k", key).where("_k is not null and _k <> ''")
    return keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1").drop("_r", "_k")


def append_new(existing: DataFrame, incoming: DataFrame, path: str = "path", order: str = "ordinal") -> DataFrame:
    """Rows of incoming whose path, whatever its case, is neither among existing nor earlier among themselves."""
    fresh = first_of(incoming, F.lower(path), [F.col(order)])
    return fresh.withColumn("_k", F.lower(path)).join(existing.select(F.lower(path).alias("_k")).distinct(), "_k", "left_anti").select(*incoming.columns)


def evidence(events: DataFrame, keys: list[str], identity: Column) -> DataFrame:
    """One event for each identity: those any record marks unconfirmed go, a natively confirmed record goes before others, then the
    last in order (``ordinal``)."""
    e = events.withColumn("_id", identity)
    off = F.max(F.coalesce(~F.col("confirmed"), F.lit(False)) & F.col("own")).over(Window.partitionBy(*keys, "_id"))
    w = Window.partitionBy(*keys, "_id").orderBy(F.desc(F.coalesce(F.col("native"), F.lit(False))), F.desc("ordinal"))
    kept = e.withColumn("_off", off).where(F.coalesce(F.col("confirmed"), F.lit(True)) & ~F.col("_off"))
    return kept.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_off", "_id")


def without_players(seen: DataFrame, excluded: DataFrame, name: str) -> DataFrame:
    keys = excluded.select(excluded_key(F.col(name)).alias("_k")).distinct()
    return seen.withColumn("_k", excluded_key(F.col(name))).join(keys, "_k", "left_anti").select(*seen.columns)


def merge_reads(previous: DataFrame, current: DataFrame, field: str, fields: list[str]) -> DataFrame:
    """Observations of the fields read anew from current, of all others from previous."""
    anew = F.col(field).isin(*fields)
    return previous.where(~anew).unionByName(current.where(anew))


# --- canonical names


def canonical_names(seen: DataFrame, clip: str, source: str, name: str, hits: int = 4, sources: int = 2, dominance: int = 2) -> DataFrame:
    """(key, name, merged): the spelling to show for each name key. A key shows its most frequent spelling. Keys of one glyph family
    become its most frequent key if that has ``hits`` sightings from ``sources`` sources, ``dominance`` times those of all others,
    and no clip shows two of the family at once. Counts are by key and family; no name's rows are gathered."""
    s = seen.select(F.col(clip).alias("clip"), F.col(source).alias("src"), strip_clan_tag(F.col(name)).alias("n")).withColumn("key", name_key(F.col("n"))).where("key <> ''")
    spelled = s.groupBy("key", "n").agg(F.count("*").alias("c"))
    shown = spelled.groupBy("key").agg(F.sum("c").alias("hits"), F.max_by("n", F.struct("c", "n")).alias("spelling"))
    src = s.select("key", "src").distinct().groupBy("key").agg(F.count("*").alias("sources"))
    e = shown.join(src, "key").withColumn("family", glyph_family(F.col("key")))
    best = e.groupBy("family").agg(F.max(F.struct("hits", "key", "spelling", "sources")).alias("b"), F.sum("hits").alias("all"), F.count("*").alias("keys"))
    together = s.withColumn("family", glyph_family(F.col("key"))).select("clip", "family", "key").distinct().groupBy("clip", "family").agg(F.count("*").alias("k")).where("k > 1").select("family").distinct()
    rule = best.join(together.withColumn("_both", F.lit(True)), "family", "left")
    merge = (F.col("keys") > 1) & F.col("_both").isNull() & (F.col("b.hits") >= hits) & (F.col("b.sources") >= sources) & (F.col("b.hits") >= (F.col("all") - F.col("b.hits")) * dominance)
    rule = rule.select("family", merge.alias("merged"), F.col("b.spelling").alias("best"))
    return e.join(rule, "family").select("key", F.when(F.col("merged"), F.col("best")).otherwise(F.col("spelling")).alias("name"), "merged")


def apply_names(seen: DataFrame, canonical: DataFrame, clip: str, name: str, order: str) -> DataFrame:
    """(clip, names): each clip's canonical names in the order first seen, each once."""
    s = seen.select(clip, F.col(name).alias("raw"), F.col(order).alias("o")).withColumn("key", name_key(F.col("raw")))
    named = s.join(canonical.select("key", F.col("name").alias("shown")), "key", "left").withColumn("shown", F.coalesce("shown", "raw"))
    first = named.groupBy(clip, name_key(F.col("shown")).alias("k")).agg(F.min(F.struct("o", "shown")).alias("f"))
    return first.groupBy(clip).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["shown"]).alias("names"))


# --- joins of records that agree only nearly


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], bounds: list[str], tolerance: int, suffix: str = "_r") -> DataFrame:
    """Pairs of rows of equal keys whose whole-numbered bounds all differ by less than the tolerance; right's bounds get the suffix.
    The join's key is the bucket of the first bound: right rows stand in their own and the two neighbouring buckets."""
    lead = bounds[0]
    near = right.withColumn("_b", F.explode(F.array(*[F.floor(F.col(lead) / tolerance) + d for d in (-1, 0, 1)])))
    for b in bounds:
        near = near.withColumnRenamed(b, b + suffix)
    pairs = left.withColumn("_b", F.floor(F.col(lead) / tolerance)).join(near, [*keys, "_b"]).drop("_b")
    for b in bounds:
        pairs = pairs.where(F.abs(F.col(b) - F.col(b + suffix)) < tolerance)
    return pairs


def overlay(clips: DataFrame, fixes: DataFrame, keys: list[str], bounds: list[str], fields: list[str], tolerance: int, newest: str = "fixed_us") -> DataFrame:
    """clips with the fields of the newest correction whose bounds agree, one by one: an unknown field of it leaves the old value."""
    pairs = tolerance_join(clips.select(*keys, *bounds, "path"), fixes, keys, bounds, tolerance)
    last = lambda f: F.max_by(F.col(f + "_fix"), F.when(F.col(f + "_fix").isNotNull(), F.col(newest))).alias(f + "_fix")
    for f in fields:
        pairs = pairs.withColumnRenamed(f, f + "_fix")
    best = pairs.groupBy("path").agg(*[last(f) for f in fields])
    out = clips.join(best, "path", "left")
    return out.select(*[F.coalesce(c + "_fix", c).alias(c) if c in fields else F.col(c) for c in clips.columns])


def link_moved(missing: DataFrame, found: DataFrame, within_ms: int = 2000) -> DataFrame:
    """(from_path, to_path, basis) of files that were moved: missing (path, name, size, mtime_ms, duration), found (path, name, size,
    mtime_ms). A missing file's choices are the files of its size and nearly its time; without any, those of its size and name;
    without any, the only file of its size, if no other missing file has that size and its duration is known. It is linked if it
    has one choice that is no other's choice too. All joins are on size with time, name or uniqueness, never on size alone."""
    m = missing.select(F.col("path").alias("from_path"), F.lower("name").alias("n"), "size", F.col("mtime_ms").alias("t"), "duration", path_key(F.col("path")).alias("mk"))
    f = found.select(F.col("path").alias("to_path"), F.lower("name").alias("n"), "size", F.col("mtime_ms").alias("ft"), path_key(F.col("path")).alias("fk"))
    near = f.withColumn("_b", F.explode(F.array(*[F.floor(F.col("ft") / within_ms) + d for d in (-1, 0, 1)]))).drop("n")
    other = F.col("mk") != F.col("fk")
    option = lambda df, basis: df.select("from_path", "mk", "to_path", "fk", F.lit(basis).alias("basis"))
    timed = option(m.withColumn("_b", F.floor(F.col("t") / within_ms)).join(near, ["size", "_b"]).where(other & (F.abs(F.col("t") - F.col("ft")) <= within_ms)), "size_mtime")
    rest = m.join(timed.select("mk").distinct(), "mk", "left_anti")
    named = option(rest.join(f, ["size", "n"]).where(other), "size_name")
    rest = rest.join(named.select("mk").distinct(), "mk", "left_anti")
    lone = m.groupBy("size").agg(F.count("*").alias("c")).where("c = 1").select("size")
    few = f.groupBy("size").agg(F.count("*").alias("c")).where("c <= 2").select("size")
    of_size = rest.where("duration is not null and not isnan(duration)").join(lone, "size", "left_semi").join(f.drop("n").join(few, "size", "left_semi"), "size").where(other)
    single = option(of_size, "size_unique").withColumn("_n", F.count("*").over(Window.partitionBy("mk"))).where("_n = 1").drop("_n")
    options = timed.unionAll(named).unionAll(single)
    counted = options.withColumn("_c", F.count("*").over(Window.partitionBy("mk"))).withColumn("_v", F.count("*").over(Window.partitionBy("fk")))
    return counted.where("_c = 1 and _v = 1").select("from_path", "to_path", "basis")


def bad_moves(moves: DataFrame, files: DataFrame, seconds: float = 0.5) -> DataFrame:
    """Rows of moves (from_path, to_path, size, duration) that can't be: the target is missing, its size or duration differs, or two
    files claim it. With any such row a batch of moves is refused as a whole."""
    m = moves.withColumn("_k", path_key(F.col("to_path")))
    f = files.select(path_key(F.col("path")).alias("_k"), F.col("size").alias("_size"), F.col("duration").alias("_duration"))
    claims = F.count("*").over(Window.partitionBy("_k"))
    checked = m.withColumn("_claims", claims).join(f, "_k", "left")
    reason = F.when(F.col("_size").isNull(), "missing").when(F.col("size") != F.col("_size"), "size").when(F.abs(F.col("duration") - F.col("_duration")) > seconds, "duration").when(F.col("_claims") > 1, "claimed twice")
    return checked.withColumn("reason", reason).where("reason is not null").select(*moves.columns, "reason")


def known_copies(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, clip_path) of files whose content digest a manifest already has; of several records, one of the same folder first."""
    folder = lambda p: F.lower(F.regexp_extract(F.replace(p, F.lit("\\"), F.lit("/")), "^(.*)/[^/]*$", 1))
    pairs = files.select("path", "content").join(recorded.select(F.col("path").alias("clip_path"), "content"), "content")
    near = F.when(folder(F.col("path")) == folder(F.col("clip_path")), 0).otherwise(1)
    return pairs.groupBy("path").agg(F.min(F.struct(near.alias("d"), "clip_path")).alias("b")).select("path", F.col("b.clip_path").alias("clip_path"))


def route_imports(files: DataFrame, known_paths: DataFrame, recorded: DataFrame, skipped: DataFrame, longest: float) -> DataFrame:
    """(path, route) of files to import: known, too long (now or as noted before, with the file unchanged), restored to a record of
    equal content, unreadable, or added."""
    k = known_paths.select(path_key(F.col("path")).alias("_k")).distinct().withColumn("_known", F.lit(True))
    s = skipped.select("path_key", "size", "mtime_ns").distinct().withColumn("_skip", F.lit(True))
    f = files.withColumn("_k", path_key(F.col("path"))).join(k, "_k", "left")
    f = f.join(s.withColumnRenamed("path_key", "_k"), ["_k", "size", "mtime_ns"], "left").join(known_copies(files, recorded), "path", "left")
    route = F.when(F.col("_known"), "known").when(F.col("_skip"), "skipped").when(F.col("clip_path").isNotNull(), "restored").when(F.col("duration").isNull() | (F.col("duration") <= 0), "rejected").when(F.col("duration") > longest, "too_long").otherwise("added")
    return f.select("path", route.alias("route"), "clip_path")


def moved_paths(rows: DataFrame, moves: DataFrame, path: str, history: str | None = None) -> DataFrame:
    """rows with moved paths replaced; ``history``: an array column that keeps the former ones, each once."""
    m = moves.select(path_key(F.col("from_path")).alias("_k"), "to_path")
    out = rows.withColumn("_k", path_key(F.col(path))).join(m, "_k", "left")
    if history:
        kept = F.coalesce(history, F.array().cast("array<string>"))
        out = out.withColumn(history, F.when(F.col("to_path").isNotNull(), F.array_distinct(F.concat(kept, F.array(path)))).otherwise(kept))
    return out.withColumn(path, F.coalesce("to_path", path)).select(*rows.columns)


def moved_prefix(path: Column, old: str, new: str) -> Column:
    """A path under the folder ``old``, whatever its case and separators, put under ``new`` with its own separators; others stay."""
    plain = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    root = old.replace("\\", "/").rstrip("/").lower()
    tail = F.substring(path, F.lit(len(root) + 1), F.length(path))
    return F.when((plain == root) | F.startswith(plain, F.lit(root + "/")), F.concat(F.lit(new.rstrip("/\\")), tail)).otherwise(path)


def clip_rows(manifests: DataFrame, imported: DataFrame, removed: DataFrame) -> DataFrame:
    """The library: one row for each clip of the manifests (source, ordinal, clips: array of structs with path), then of the imported
    clips that no manifest has, without removed ones; of equal paths the first."""
    m = manifests.select("source", "ordinal", F.posexplode("clips").alias("clip_index", "c")).select("source", "ordinal", "clip_index", "c.*")
    i = imported.select(F.lit(None).cast("string").alias("source"), F.lit(1 << 60).alias("ordinal"), F.posexplode("clips").alias("clip_index", "c")).select("source", "ordinal", "clip_index", "c.*")
    every = first_of(m.unionByName(i, allowMissingColumns=True), path_key(F.col("path")), [F.col("ordinal"), F.col("clip_index")])
    gone = removed.select(path_key(F.col("path")).alias("_k")).distinct()
    return every.withColumn("_k", path_key(F.col("path"))).join(gone, "_k", "left_anti").drop("_k")
