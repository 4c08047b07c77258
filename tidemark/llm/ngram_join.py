"""N-gram Jaccard join by grouped prefixes.

1. Every text becomes a set of 64-bit hashes of its distinct N-word shingles, stored once a task. Texts of equal sets form a class.
2. Shingles are counted over all these sets into CELLS hashed cells, summed by ranges of cells. The at most HOT most frequent
   cells (a fixed bound, whatever the input) are broadcast and order the shingles: those in no hot cell first, by hash. Any such
   order gives right results; this one keeps common passages out of prefixes.
3. A set's prefix is what must meet any partner's. Classes with the same prefix and size form a group, and only groups stand in
   the posting lists. Group pairs pass size and position filters, are expanded to pairs of classes, pass a parity bitmap filter
   (a strict lower bound of the symmetric difference) and are verified on whole sets.
4. Large groups of near copies: in ROUNDS rounds every list names some leaders (LEADERS, more once most members are linked), and each
   member (later only those outside its list's largest component) is compared with the MEETINGS of them that it shares most lists with. From the second round on the lists are those of two, then three tokens in a row, whose members are more alike; after that only pairs whose ends are still in different components are compared, all of them, by bands of
   size. So no link between components is lost,
   and no list of linked texts is expanded into all its pairs.

A pair of sets of n and m shingles is misjudged only if two of its shingles share a 64-bit hash, at odds of n * m / 2**64.

Row semantics: each row is an own document, also with repeated or null doc_id; null or wordless text is an empty set, linked with
nothing, and its component is its doc_id. A component whose ids are all null has a null id. An empty table gives no rows. Other
columns are ignored. Texts are used whole, a slice of a batch at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, BROADCAST_BYTES, components, forget, labels, lean, settle, settle_once, small
from .words import ascii_words, hashed, mix, slices

WORDS, PERCENT = 4, 85
CELLS, RANGES, HOT = 1 << 28, 256, 1 << 20
ROUNDS, LEADERS, MEETINGS, PER_SALT, BITS = 3, (4, 24), 32, 2000, 1024
#: Bitmaps of all classes are broadcast only if smaller; the driver holds a broadcast several times over.
BITMAP_BYTES = 12 << 20
#: Shifts a size above any place in a prefix.
PLACE = 1 << 32
#: Bytes of text whose shingles are made at once.
SLICE = 1 << 20
#: Sets a task remembers, so that it stores equal ones once.
SEEN = 500_000


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    h, ends = hashed(ascii_words(texts))
    starts = np.append(0, ends[:-1])
    windows = []
    for k in range(1, words + 1):  # texts of fewer words are one shingle of all of them
        acc = np.full(max(len(h) - k + 1, 0), k, np.uint64)
        if k < words and not (ends - starts == k).any():
            windows.append(acc)
            continue
        for i in range(k):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        windows.append(acc)
    for a, z in zip(starts.tolist(), ends.tolist()):
        k = min(words, z - a)
        if not k:
            yield np.empty(0, np.uint64)
            continue
        s = np.sort(windows[k - 1][a : z - k + 1])
        yield s[np.append(True, s[1:] != s[:-1])]


def _lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """An Arrow array of lists; None is null."""
    sizes = np.cumsum([0, *(0 if x is None else len(x) for x in arrays)])
    flat = np.concatenate([x for x in arrays if x is not None] or [np.empty(0, np.int64)])
    mask = pa.array([x is None for x in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind), mask=mask)


def _sets(rows: DataFrame, words: int, keep: list[str]) -> DataFrame:
    """(rid, doc_id, digest: of the text, keep, n, cid, set) of every row (rid, doc_id, keep, text); set is null if its task stored an
    equal one."""

    def make(batches):
        seen: set[bytes] = set()
        for b in batches:
            for begin, end in slices(b.column(b.num_columns - 1), SLICE):
                part = b.slice(begin, end - begin)
                n, cids, sets = [], [], []
                for s in shingles(part.column(b.num_columns - 1), words):
                    cid = hashlib.md5(s.tobytes()).digest() if len(s) else None
                    n.append(len(s))
                    cids.append(cid)
                    sets.append(None if cid is None or cid in seen else s.view(np.int64))
                    if cid is not None:
                        seen.add(cid)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(cids, pa.binary()), _lists(sets, pa.int64())], names=["rid", "doc_id", "digest", *keep, "n", "cid", "set"])

    plain = rows.select("rid", F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), *keep, F.coalesce("text", F.lit("")).alias("text"))
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return settle(plain.mapInArrow(lean(make), f"rid long, doc_id long, digest string{kept}, n long, cid binary, set array<long>"), "sets", batch=BATCH_BYTES)


def _cell_counts(sets: DataFrame) -> DataFrame:
    """(cell, n) of all cells counted more than once, over all stored sets."""
    width = CELLS // RANGES

    def count(batches):
        for b in batches:
            cells = np.sort((b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(CELLS)).astype(np.uint32))
            cut = np.searchsorted(cells, np.arange(RANGES + 1) * width)
            rows = [(r, (cells[a:z] - np.uint32(r * width)).tobytes()) for r, (a, z) in enumerate(zip(cut, cut[1:])) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], names=["range", "cells"])

    def total(batches):
        at, sums = None, np.zeros(width, np.int64)
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != at:
                    if at is not None:
                        yield several(at, sums)
                    at, sums = r, np.zeros(width, np.int64)
                cells = np.frombuffer(c, np.uint32)
                first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                sums[cells[first]] += np.diff(np.append(first, len(cells)))
        if at is not None:
            yield several(at, sums)

    def several(r, sums):
        cell = np.flatnonzero(sums > 1)
        return pa.RecordBatch.from_arrays([pa.array(cell + r * width, pa.int64()), pa.array(sums[cell], pa.int64())], names=["cell", "n"])

    parts = sets.where("set is not null").select("set").mapInArrow(lean(count), "range int, cells binary")
    return parts.repartition("range").sortWithinPartitions("range").mapInArrow(lean(total), "cell long, n long")


def hot_cells(sets: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent cells, sorted, with their counts: those above the least power of two that at most ``most`` exceed."""
    counts = settle_once(_cell_counts(sets), "cells", 2 * BATCH_BYTES)
    hist = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()), reverse=True)
    least, seen = 62, 0
    for p, c in hist:
        if seen + c > most:
            break
        least, seen = p, seen + c
    hot = counts.where(F.col("n") >= (1 << least)).toArrow()
    forget(counts)
    cell, n = (hot.column(c).to_numpy() for c in ("cell", "n"))
    order = np.argsort(cell)
    return cell[order], n[order]


def _classes(sets: DataFrame, percent: int) -> DataFrame:
    """(rid: of the class's first stored set, cid, n, gid, prefix, bits) of every distinct set."""
    hot = sets.sparkSession.sparkContext.broadcast(hot_cells(sets))

    def make(batches):
        cells, freq = hot.value
        for b in batches:
            lists = b.column(3)
            flat, cut = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            f = np.zeros(len(flat), np.int64)
            if len(cells):
                own = (flat % np.uint64(CELLS)).astype(np.int64)
                at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                f = np.where(cells[at] == own, freq[at], 0)
            gids, prefixes, bits = [], [], []
            for a, z in zip((cut - cut[0]).tolist(), (cut[1:] - cut[0]).tolist()):
                s, n = flat[a:z], z - a
                p = n - -(-percent * n // 100) + 1
                free = np.flatnonzero(f[a:z] == 0)  # s is in the order of the hashes
                prefix = s[free[:p]] if len(free) >= p else s[np.argsort(f[a:z], kind="stable")[:p]]
                prefixes.append(prefix.view(np.int64))
                bits.append(np.packbits((np.bincount((s >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).view(np.int64))
                gids.append(hashlib.md5(n.to_bytes(8, "little") + prefix.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(gids, pa.binary()), _lists(prefixes, pa.int64()), _lists(bits, pa.int64())], names=["rid", "cid", "n", "gid", "prefix", "bits"])

    made = sets.where("set is not null").select("rid", "cid", "n", "set").mapInArrow(lean(make), "rid long, cid binary, n long, gid binary, prefix array<long>, bits array<long>")
    return settle_once(made.groupBy("cid").agg(F.min("rid").alias("rid"), *[F.min_by(c, "rid").alias(c) for c in ("n", "gid", "prefix", "bits")]), "classes", BATCH_BYTES)


def hot_keys(many: DataFrame, key: str, rows: int | None = None) -> DataFrame | None:
    """(key, k) of the keys with over PER_SALT rows and the number of parts they are dealt to, at most one key in PER_SALT rows; None
    if many is known to have no more rows than that."""
    if rows is not None and rows <= PER_SALT:
        return None
    return small(settle(many.groupBy(key).count().where(F.col("count") > PER_SALT).select(key, F.ceil(F.col("count") / PER_SALT).cast("int").alias("k")), "hot"), 80)


def salted(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, by: list[str]) -> DataFrame:
    """many joined with one (a row for each key); the keys in ``hot`` are dealt over several partitions by the hash of ``by``."""
    if hot is None:
        return many.join(one, key)
    left = many.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("k")), F.lit(0)).cast("int")).drop("k")
    right = one.join(hot, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    return left.join(right, [key, "salt"]).drop("salt")


def _fits(na: Column, nb: Column, percent: int) -> Column:
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def verified(pairs: DataFrame, sets: DataFrame, side: DataFrame, few: bool, percent: int) -> DataFrame | None:
    """The pairs (a, b) of classes whose whole sets link; a is the side with the hot rows. side: (rid, n, bits) of the classes, few:
    whether its size lets it be broadcast. None if there are no pairs."""
    rows = pairs.count()
    if not rows:
        return None
    y, x = (side.select(F.col("rid").alias(k), F.col("n").alias("n" + k), F.col("bits").alias(v)) for k, v in (("b", "y"), ("a", "x")))
    near = pairs.join(F.broadcast(y), "b").join(F.broadcast(x), "a") if few else salted(pairs.join(y, "b"), x, "a", hot_keys(pairs, "a", rows), ["b"])
    apart = F.aggregate(F.zip_with("x", "y", lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
    near = settle(near.where(_fits(F.col("na"), F.col("nb"), percent) & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))).select("a", "b", "na", "nb"), "near")
    rows = near.count()
    need = near.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    need = F.broadcast(need) if rows * 48 <= BROADCAST_BYTES else need
    full = sets.where("set is not null").select("rid", "set").join(need, "rid")
    both = near.join(full.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b")
    both = salted(both, full.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a", hot_keys(near, "a", rows), ["b"])
    common = F.size(F.array_intersect("sa", "sb"))
    links = settle_once(both.where(common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b"), "links")
    forget(near)
    return links


def _filtered(cand: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, n, pos; v, n2, pos2) that may link, by size and by what can still follow their places in the prefixes."""
    bound = F.lit(1) + F.least(F.col("n") - F.col("pos") - 1, F.col("n2") - F.col("pos2") - 1)
    return cand.where(_fits(F.col("n"), F.col("n2"), percent) & (bound * (100 + percent) >= (F.col("n") + F.col("n2")) * percent))


def _links(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes, enough to connect every component."""
    groups = classes.groupBy("gid").agg(F.min("rid").alias("unit"), F.max("rid").alias("last"), F.min_by("prefix", "rid").alias("prefix"), F.min_by("n", "rid").alias("n"))
    groups = settle_once(groups, "groups")
    members = classes.select("gid", "rid", "n").join(groups.where("last > unit").select("gid", "unit"), "gid")
    # in the postings, negative units are classes inside a group, and size and place are one number
    tokens = groups.select("unit", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "unit", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    inner = members.select(F.xxhash64("gid").alias("key"), (-F.col("rid") - 1).alias("unit"), F.shiftleft("n", 32).alias("at"))
    lists = _shared(tokens.unionByName(inner)).select("key", F.when(F.col("unit") < 0, -F.col("unit") - 1).otherwise(F.col("unit")).alias("unit"), F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit(PLACE - 1)).alias("pos"), (F.col("unit") >= 0).alias("group"), "held")
    lists = settle_once(lists, "lists")
    side = classes.select("rid", "n", "bits")
    few = classes.count() * (BITS // 8 + 50) <= BITMAP_BYTES
    found, tagged, comp = [], lists.withColumn("lo", F.col("unit")).withColumn("hi", F.col("unit")), None
    for turn in range(ROUNDS + 1):
        if turn and found:
            at = lists if turn == ROUNDS else settle_once(_chained(lists, turn + 1), "chained")
            linked = _all(found, sets)
            found_so_far = components(linked, name="ngram").withColumnRenamed("node", "rid") if turn == ROUNDS else labels(linked).select(F.col("node").alias("rid"), F.col("label").alias("component"))
            comp = settle(found_so_far, "comp")
            near = small(comp, 24)
            whole = members.select("unit", "rid").join(near, "rid", "left").select("unit", F.coalesce("component", "rid").alias("c")).groupBy("unit").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
            whole = small(settle(whole.withColumn("group", F.lit(True)), "whole"), 48)
            single = near.select(F.col("rid").alias("unit"), F.col("component").alias("c"))
            tagged = at.join(whole, ["unit", "group"], "left").join(single, "unit", "left")
            tagged = tagged.select("key", "unit", "n", "pos", "group", "held", F.coalesce("lo", "c", "unit").alias("lo"), F.coalesce("hi", "c", "unit").alias("hi"))
            spread = tagged.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("key")
            tagged = settle_once(tagged.join(spread, "key", "left_semi"), "tagged")
        if turn < ROUNDS:
            salts = F.ceil(F.col("held") / PER_SALT).cast("int")
            bucket = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(LEADERS[min(turn, 1)]))
            lead = tagged.groupBy("key", "held", bucket.alias("_b")).agg(F.min(F.struct(F.xxhash64("unit", F.lit(turn)).alias("h"), "unit", "n", "pos", "lo", "hi")).alias("l"))
            lead = lead.select("key", "l", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
            asking = tagged
            if turn:  # only what is not yet in its list's largest component
                most = tagged.groupBy("key", "lo").count().groupBy("key").agg(F.max(F.struct("count", "lo")).alias("m")).select("key", F.col("m.lo").alias("main"))
                asking = tagged.join(most, "key").where("lo <> main or hi <> main").drop("main")
            cand = asking.withColumn("salt", F.pmod(F.xxhash64("unit"), salts).cast("int")).join(lead, ["key", "salt"])
            cand = cand.select("unit", "n", "pos", "lo", "hi", F.col("l.unit").alias("unit2"), F.col("l.n").alias("n2"), F.col("l.pos").alias("pos2"), F.col("l.lo").alias("lo2"), F.col("l.hi").alias("hi2"))
            cand = _filtered(cand.where("unit <> unit2 and (lo <> lo2 or hi <> hi2 or lo <> hi)"), percent)
            met = cand.groupBy("unit", F.col("unit2").alias("a")).agg((-F.count("*")).alias("often"))
            best = met.groupBy("unit").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", F.xxhash64("a", F.lit(turn)).alias("h"), "a"))), 1, MEETINGS).alias("l"))
            pairs = best.select(F.explode("l.a").alias("a"), F.col("unit").alias("b"))
        else:
            pairs = _rest(tagged, members, comp if comp is not None else settle(labels(_all(found, sets)).select(F.col("node").alias("rid"), F.col("label").alias("component")), "comp"), percent)
        pairs = settle_once(pairs.distinct() if turn == ROUNDS else pairs, "pairs")
        links = verified(pairs, sets, side, few, percent)
        found += [links] if links is not None else []
        forget(pairs, *([tagged] if turn else []))
    forget(groups, lists)
    return _all(found, sets)


def _shared(rows: DataFrame) -> DataFrame:
    """rows whose key at least two of them have, with the number as ``held``."""
    dealt = rows.repartition("key")
    return dealt.join(dealt.groupBy("key").agg(F.count("*").alias("held")).where("held > 1"), "key")


def _chained(lists: DataFrame, chain: int) -> DataFrame:
    """Lists of groups that share ``chain`` tokens which follow one another among the listed ones of their prefixes: shorter lists of
    more similar groups. They only propose links early; what they miss the last comparison finds."""
    w = Window.partitionBy("unit").orderBy("pos")
    key = F.xxhash64("key", *[F.lead("key", i).over(w) for i in range(1, chain)])
    rows = lists.where("group").select(key.alias("key"), F.lead("key", chain - 1).over(w).alias("_last"), "unit", "n", "pos", "group")
    return _shared(rows.where("_last is not null").drop("_last"))


def _all(found: list[DataFrame], sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, found) if found else sets.sparkSession.createDataFrame([], "a long, b long")


def _rest(tagged: DataFrame, members: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that share a list and stand in different components: each list's main component is not paired
    with itself. Sizes that may link lie in the same or in neighbouring bands, which make up the join's key."""
    of_group = tagged.where("group").join(members.select("unit", "rid"), "unit")
    alone = tagged.join(members.select("unit", F.lit(True).alias("group")).distinct(), ["unit", "group"], "left_anti").withColumn("rid", F.col("unit"))
    every = of_group.select("key", "rid", "n", "pos").unionByName(alone.select("key", "rid", "n", "pos"))
    every = every.join(comp, "rid", "left").select("key", "rid", "n", "pos", F.coalesce("component", "rid").alias("comp"), F.floor(F.log("n") / math.log(100 / percent)).cast("int").alias("band"))
    every = settle(every.distinct(), "rest")
    main = every.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    every = every.join(main, "key")
    few = every.where("comp <> main").select("key", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band"), *[F.col(c).alias(c + "2") for c in ("rid", "n", "pos", "comp")])
    cand = _filtered(every.join(few, ["key", "band"]).where("comp <> comp2 and (comp = main or rid < rid2)"), percent)
    return cand.select(F.col("rid2").alias("a"), F.col("rid").alias("b"))


def linked(rows: DataFrame, words: int = WORDS, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """(rid, doc_id, digest, keep, n, class_id, component: both null without shingles, component_id) of every row (rid, doc_id, keep,
    text)."""
    keep = keep or []
    sets = _sets(rows, words, keep)
    classes = _classes(sets, percent)
    comp = components(_links(sets, classes, percent), name="ngram")
    named = classes.select("cid", "rid").join(comp.withColumnRenamed("node", "rid"), "rid", "left").select("cid", "rid", F.coalesce("component", "rid").alias("component"))
    filled = sets.where("n > 0").select("rid", "doc_id", "digest", *keep, "n", "cid")
    least = settle(filled.groupBy("cid").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")).join(named, "cid"), "least")
    ids = least.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = least.select("component", "cid", F.col("rid").alias("class_id"))
    by_class = salted(by_class, ids, "component", hot_keys(by_class, "component", least.count()), ["cid"])
    hot = small(settle(least.where(F.col("rows") > PER_SALT).select("cid", F.ceil(F.col("rows") / PER_SALT).cast("int").alias("k")), "hot"), 80)
    found = salted(filled, by_class, "cid", hot, ["rid"]).select("rid", "doc_id", "digest", *keep, "n", "class_id", "component", "component_id")
    blank = sets.where("n = 0").select("rid", "doc_id", "digest", *keep, "n", F.lit(None).cast("long"), F.lit(None).cast("long"), "doc_id")
    return found.unionAll(blank)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, component, digest) of every row of docs (doc_id, text)."""
    found = linked(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), words, percent)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id", "component", "digest")


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but one row of each component: the smallest doc_id's (of equal ids, the smallest digest of the text,
    then the first row). Null ids come last. Rows without shingles all stay; other columns stay as they are, whatever their names."""
    names = docs.columns
    at = {c: f"c{k}" for k, c in enumerate(names)}
    held, place = _placed(docs)
    rows = held.select(F.monotonically_increasing_id().alias("rid"), F.col(at["doc_id"]).alias("doc_id"), *place, F.col(at["text"]).alias("text"))
    found = settle(linked(rows, words, percent, place).where("component is not null"), "found")
    head = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "rid")).alias("h"), F.count("*").alias("rows"))
    several = settle(head.where("rows > 1").select("component", F.col("h.rid").alias("head"), "rows"), "heads")
    hot = small(settle(several.where(F.col("rows") > PER_SALT).select("component", F.ceil(F.col("rows") / PER_SALT).cast("int").alias("k")), "hot"), 80)
    gone = settle(salted(found.select("rid", *place, "component"), several.drop("rows"), "component", hot, ["rid"]).where("rid <> head").select(*place), "gone")
    return held.join(small(gone, 250), place, "left_anti").select(*at.values()).toDF(*names)


def _placed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns as c0, c1 ... and columns that name each row alike whenever it is read: the file and the place in it, or,
    where docs is no plain table of files, a number it is written out with."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    try:
        told = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("line"))
        told.schema  # noqa: B018  resolves the columns
        return told, ["file", "line"]
    except AnalysisException:
        return settle(docs.toDF(*names).withColumn("line", F.monotonically_increasing_id()), "rows"), ["line"]
