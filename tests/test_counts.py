"""Counts, proofs, versions, packets and clip events on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import counts, versions

ENDS = "segment string, field string, baseline long, last long, unconfirmed long, terminal_unread boolean, baseline_lower boolean, visible_complete boolean, updated_us long"
SEGS = "segment string, excluded_terminal boolean, settlement string, covered boolean"
EVENTS = "segment string, kind string, action string, target string, t_us long, confirmed boolean, own boolean"


def end(segment, field, baseline, last, unconfirmed=None, unread=False, lower=False, complete=False, updated=None):
    return (segment, field, baseline, last, unconfirmed, unread, lower, complete, updated)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_reconciled(spark):
    ends = [
        end("a", "kills", 1, 3), end("a", "damage", 100, 350, unread=True), end("a", "assists", None, 2),
        end("b", "kills", 2, 4, unconfirmed=3), end("b", "damage", 5, 9, unconfirmed=12), end("b", "assists", 0, 1, lower=True),
        end("c", "kills", 5, 5, updated=10_000_000), end("c", "assists", 0, 3), end("c", "damage", 1, 7, complete=True),
        end("d", "kills", 1, 4), end("d", "damage", 0, 9),
        end("e", "kills", 9, 3), end("e", "damage", 3, 8, unread=True, complete=True),
    ]
    segs = [("a", False, None, True), ("b", False, None, False), ("c", False, "pending", True), ("d", True, "settled", True), ("e", False, None, True)]
    ev = [("a", "assist", "elimination", "X", 1, True, True), ("a", "knock", "knock", "X", 2, True, True), ("a", "elimination", "elimination", "Y", 3, False, True)]
    ev += [("b", "elimination", "elimination", n, i, True, True) for i, n in enumerate("PQR")] + [("b", "knock", "knock", "P", 9, False, True)]
    ev += [("c", "elimination", "elimination", "PlayerOne", 12_000_000, True, True), ("c", "elimination", "elimination", "Z", 10_500_000, True, True), ("c", "assist", "elimination", "P1ayerOne", 5, True, True), ("c", "assist", "elimination", "Other", 6, True, True), ("c", "assist", "knock", "W", 7, True, True)]
    got = counts.reconciled(spark.createDataFrame(ends, ENDS), spark.createDataFrame(segs, SEGS), spark.createDataFrame(ev, EVENTS))
    want = [
        ("a", "kills", 2, False), ("a", "damage", 250, True), ("a", "assists", 1, True), ("a", "knockdowns", 1, False),
        ("b", "kills", 3, True), ("b", "damage", 4, True), ("b", "assists", 1, True), ("b", "knockdowns", None, True),
        ("c", "kills", 1, True), ("c", "assists", 1, True), ("c", "damage", 6, False), ("c", "knockdowns", 0, False),
        ("d", "kills", 3, False), ("d", "damage", 9, True), ("d", "knockdowns", 0, False),
        ("e", "kills", None, True), ("e", "damage", 5, False), ("e", "knockdowns", 0, False),
    ]
    assert rows(got) == sorted(want, key=repr)


def test_proofs(spark):
    f = lambda *x: [dict(t=t, value=v, verified=ok, excluded=out) for t, v, ok, out in x]
    two, four = f((0.0, 2, True, False), (0.1, 2, True, False)), f((8.0, 4, True, False), (9.0, 4, True, False))
    cases = [(2, 4, two, four), (2, 4, two[:1], four), (2, 4, two, f((8.0, 4, True, False), (8.0, 4, True, False))), (2, 4, two, four + f((7.0, 9, True, True))), (5, 4, two, four), (2, None, two, four)]
    schema = "b int, l int, bf array<struct<t:double,value:int,verified:boolean,excluded:boolean>>, ef array<struct<t:double,value:int,verified:boolean,excluded:boolean>>"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + schema).orderBy("i")
    assert [r.v for r in df.select(counts.complete_delta(F.col("b"), F.col("l"), F.col("bf"), F.col("ef"), F.element_at("ef", -1)).alias("v")).collect()] == [True, False, False, False, False, False]
    unread = spark.createDataFrame([([(2.0, None), (1.0, 5)], 5), ([(1.0, None), (2.0, 5)], 5), ([], 5), ([(2.0, None)], None)], "f array<struct<t:double,value:int>>, k int")
    assert [r.v for r in unread.select(counts.terminal_unread(F.col("f"), F.col("k")).alias("v")).collect()] == [True, False, False, False]


def test_final_tables(spark):
    shown = [("a", t, k, d) for t, k, d in ((0, 1, 1), (9_000_000, 3, 900), (9_300_000, 9, 9), (9_600_000, 3, 900), (10_200_000, 4, 900))] + [("b", 1, 2, 3), ("b", 9_000_000, None, 3), ("b", 9_900_000, None, 3)]
    assert rows(counts.final_table(spark.createDataFrame(shown, "s string, t long, kills long, damage long"), ["s"], "t", ["kills", "damage"])) == [("a", 3, 900)]
    cells = [(1, "KILLS", 0, 50, 10, 30), (1, "7", 90, 99, 12, 28), (1, "8", 60, 70, 11, 29), (1, "DAMAGE", 0, 50, 50, 70), (1, "1234", 80, 90, 51, 69), (1, "9", 60, 70, 90, 99), (2, "KILLS", 0, 50, 10, 30)]
    got = counts.table_values(spark.createDataFrame(cells, "frame int, text string, left double, right double, top double, bottom double".replace("double", "long")), "frame", {"kills": "^KILLS$", "damage": "^DAMAGE$"})
    assert rows(got) == [(1, "damage", 1234), (1, "kills", 8)]


def test_packets(spark):
    s = [("v", i, h, t) for i, (h, t) in enumerate(zip("aabcabcd", (0, 10, 20, 35, 45, 55, 65, 80)))] + [("w", i, "z", t) for i, t in enumerate((5, 4, 9))]
    df = spark.createDataFrame(s, "s string, i long, h string, t long")
    assert rows(counts.gaps(df, "s", "t", "i")) == [("v", 8, 10, 15, 10.0, True), ("w", 3, -1, 5, 2.0, False)]
    t = lambda text: spark.createDataFrame([("v", i, h) for i, h in enumerate(text)], "s string, i long, h string")
    for text, at in (("abc", 1), ("bcd", 5), ("aa", 0), ("abd", None), ("aabcabcd", 0), ("x", None)):
        assert rows(counts.found_at(df, t(text), "s", "i", "h")) == ([] if at is None else [("v", at)]), text


def test_clip_events_and_sizes(spark):
    ev = [("c", "knock", 10.0, 9.0, "shoot"), ("c", "knock", 10.5, 9.5, "shoot"), ("c", "knock", 11.0, 10.8, "shoot"), ("c", "assist", 5.0, None, None), ("c", "assist", 99.0, None, None), ("c", "other", 1.0, None, None)]
    df = spark.createDataFrame([(c, k, int(a * 1e6), 20_000_000, None if b is None else int(b * 1e6), s) for c, k, a, b, s in ev], "c string, kind string, at long, duration_us long, begun long, basis string")
    got = counts.clip_events(df, "c")
    assert sorted((r.kind, r.at, r.seek_us, r.basis) for r in got.collect()) == [("assist", 5_000_000, 2_000_000, "near_result"), ("knock", 10_000_000, 7_000_000, "shoot"), ("knock", 10_500_000, 10_001_000, "near_result"), ("knock", 11_000_000, 10_501_000, "shoot")]
    bars = counts.marker_groups(got, "c", 1000, 36)
    assert sorted((r.first_at, r.n) for r in bars.collect()) == [(5_000_000, 1), (10_000_000, 3)]
    size = spark.createDataFrame([(1920, 1080, "4:3", 0), (720, 576, "16:15", -90), (10, 10, None, None), (0, 5, "1:1", 0)], "w int, h int, a string, r int")
    assert [r.v and tuple(r.v) for r in size.select(counts.display_size(*map(F.col, "whar")).alias("v")).collect()] == [(2560, 1080), (576, 768), (10, 10), None]
    secs = spark.createDataFrame([(3.0, 4.0, None), (None, 4.0, None), (None, None, {"a": 1.5, "b": -2.0, "c": 2.0}), (-1.0, None, {"a": 1.0}), (None, None, None)], "o double, r double, s map<string,double>")
    assert [r.v for r in secs.select(counts.processing_seconds(*map(F.col, "ors")).alias("v")).collect()] == [3.0, 4.0, 3.5, 1.0, None]


def test_versions(spark):
    d = versions.descriptor("hero", {"reader": "reader-v2"}, config={"threads": 4, "x": 1}, performance=("threads",))
    assert d["complete"] and d["signature"] == versions.descriptor("hero", {"reader": "reader-v2"}, config={"x": 1})["signature"] != versions.descriptor("hero", {"reader": "reader-v3"}, config={"x": 1})["signature"]
    assert not versions.descriptor("hero", {"reader": ""})["complete"] and not versions.descriptor("hero", {"r": "v1"}, models={"m": {"missing": True}})["complete"]
    schema = "schema int, complete boolean, algorithm_id string, signature string"
    cases = [((1, True, "a", "s"), None, "current"), ((1, True, "a", "t"), None, "old"), ((1, False, "a", "t"), None, "unknown"), (None, "reader-v1", "old"), (None, "reader-v2", "unknown"), (None, "other-v1", "unknown"), (None, None, "unknown")]
    df = spark.createDataFrame([(i, s, v, (1, True, "a", "s"), ["reader-v2"]) for i, (s, v, _) in enumerate(cases)], f"i int, s struct<{schema.replace(' ', ':').replace(',:', ',')}>, v string, c struct<{schema.replace(' ', ':').replace(',:', ',')}>, e array<string>").orderBy("i")
    assert [r.x for r in df.select(versions.freshness(*map(F.col, "svce")).alias("x")).collect()] == [c[2] for c in cases]
    st = spark.createDataFrame([("a", "hero", "old", "1"), ("a", "rank", "unknown", "2"), ("b", "hero", "current", "3"), ("c", "rank", "unknown", "4")], "clip string, field string, state string, signature string")
    assert rows(versions.affected(st).select("clip", "fields")) == [("a", ["hero"])]
    assert rows(versions.affected(st, True).select("clip", "fields")) == [("a", ["hero", "rank"]), ("c", ["rank"])]
    assert rows(versions.upgrade_summary(st)) == [(1, 2, 1)]
    assert rows(versions.notice_key(st, ["clip"])) == [("a", '["hero:1"]'), ("b", "[]"), ("c", "[]")]
    up = spark.createDataFrame([("/A", "hero", "old"), ("/a", "hero", "current"), ("/b", "hero", "old")], "path string, field string, state string")
    assert rows(versions.upgradable(up)) == [("/b", "hero")]


def test_fields(spark):
    schema = "clip string, field string, value string, status string, source string, identity string, state string, detail string, requested boolean, match string"
    f = spark.createDataFrame([("a", "hero", "x", "confirmed", "i", "i", "current", None, True, "m"), ("a", "rank", "gold", "confirmed", "i", "i", "current", None, True, "m"), ("b", "hero", None, "unknown", "j", "j", "current", None, True, "m"), ("b", "rank", "master", "confirmed", "i", "j", "current", None, True, "m"), ("c", "hero", "y", "confirmed", "k", "k", "old", None, True, "n"), ("d", "hero", None, None, None, "l", "current", None, False, None)], schema)
    assert rows(versions.pending_fields(f).select("clip", "field")) == [("a", "rank"), ("b", "hero"), ("b", "rank"), ("c", "hero"), ("d", "hero")]
    assert versions.pending_fields(f, force=True).count() == 6
    assert rows(versions.invalidated(f).where("status = 'stale'").select("clip", "field", "value")) == [("b", "rank", None), ("d", "hero", None)]
    assert rows(versions.shared_fields(f).where("shared").select("clip", "field", "value")) == [("b", "hero", "x")]
    stamps = versions.stamped(f.withColumn("signature", F.lit("old")).withColumn("updated_at", F.lit(1)), spark.createDataFrame([("a", "hero")], "clip string, field string"), spark.createDataFrame([("hero", "new")], "field string, signature string"), F.lit(2))
    assert rows(stamps.where("signature = 'new'").select("clip", "field", "updated_at")) == [("a", "hero", 2)]
    own = spark.createDataFrame([({"hero": "h"}, "hero", "s"), ({"x": "h"}, "hero", "s"), (None, "hero", "s")], "m map<string,string>, f string, s string")
    assert [r.v for r in own.select(versions.own_source(*map(F.col, "mfs")).alias("v")).collect()] == ["h", None, "s"]
    share = spark.createDataFrame([(1, 2), (5, 2), (1, 0)], "d int, t int")
    assert [r.v for r in share.select(versions.progress_share(F.col("d"), F.col("t")).alias("v")).collect()] == [0.5, 1.0, 0.0]
    v = spark.createDataFrame([("a", "rank", None, "old"), ("a", "hero", "v2", "current")], "clip string, field string, version string, state string")
    assert rows(versions.version_details(v, ["clip"])) == [("a", "hero v2 (current); rank ? (old)")]
