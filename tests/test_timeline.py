import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators import folds, intervals, joins
from tidemark.sources import files
from tidemark.streaming import sessions


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def spans(spark, *pairs):
    return spark.createDataFrame([("k", a, b) for a, b in pairs], "key string, start_us long, end_us long")


def test_subtract_and_snap(spark):
    assert rows(intervals.subtract(spans(spark, (0, 100)), spans(spark, (36, 64)), "key")) == [("k", 0, 36), ("k", 64, 100)]
    assert rows(intervals.subtract(spans(spark, (0, 9)), spans(spark), "key")) == [("k", 0, 9)]
    marks = spark.createDataFrame([("k", t) for t in (0, 20, 40, 60, 80)], "key string, t long")
    assert rows(intervals.snap(spans(spark, (11, 31), (39, 55)), marks, "key", "t")) == [("k", 0, 60)]


def test_overlap_gives_each_pair_once(spark):
    import random

    r = random.Random(3)
    a, b = ([(s, s + r.randint(0, 60)) for s in (r.randint(0, 300) for _ in range(40))] for _ in range(2))
    want = sorted({("k", *x, *y) for x in a for y in b if x[0] < x[1] and y[0] < y[1] and x[0] < y[1] and y[0] < x[1]})
    assert sorted(set(rows(joins.overlap(spans(spark, *a).distinct(), spans(spark, *b).distinct(), "key", 25)))) == want
    assert joins.overlap(spans(spark, *a).distinct(), spans(spark, *b).distinct(), "key", 25).count() == len(want)


def test_thin_keeps_by_the_last_kept(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 5, 11, 12, 21, 22, 50, 50)] + [("k", None), (None, 3)], "key string, t long")
    assert [t for _, t in sorted(rows(folds.thin(df, "key", "t", 10)))] == [0, 11, 21, 50]


def test_nearest_takes_the_earlier_of_ties(spark):
    left, right = (spark.createDataFrame([("k", t) for t in ts], "key string, t long") for ts in ((5, 100), (0, 10, 90)))
    assert sorted(rows(joins.nearest(left, right, "key", "t"))) == [("k", 5, 0), ("k", 100, 90)]


@pytest.mark.parametrize("a,b,d", [("anna", "ana", 1), ("anna", "anna", 0), ("ab", "ba", None), ("", "x", 1), ("abc", "abd", 1)])
def test_within_one_edit(spark, a, b, d):
    got = rows(joins.within_one_edit(spark.createDataFrame([(a,)], "n string"), spark.createDataFrame([(b,)], "d string"), "n", "d"))
    assert got == ([] if d is None else [(a, b, d)])


def test_json_lines_keep_the_malformed_apart(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"frame": 1}\n\n{"frame": \nnot json\n{"frame": 2, "more": 3}\n')
    from pyspark.sql.types import StructType

    good, bad = files.json_lines(spark, f"file://{tmp_path}/a.jsonl", StructType().add("frame", "integer"))
    assert rows(good) == [(1,), (2,)] and sorted(r.line for r in bad.collect()) == ['not json', '{"frame": ']


def test_inventory_and_fingerprints(spark, tmp_path):
    for name, body in (("a/x.bin", b"one"), ("b/y.bin", b"one"), ("skip/z.bin", b"two")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    assert files.inventory(spark, f"file://{tmp_path}", "*.bin", ("skip",)).count() == 2
    assert files.fingerprints(spark, f"file://{tmp_path}", "*.bin").select("sha256").distinct().count() == 2


def test_blocks_are_replaced_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([Row(block=1, v=1), Row(block=2, v=2)])
    for part in (df, df.where("block = 2")):
        files.write_blocks(part, f"file://{tmp_path}/out", "block")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_stream_restarts_after_its_last_commit(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def add(name, events):
        (tmp_path / "in" / name).write_text("".join(json.dumps(e) + "\n" for e in events))

    def run():
        live = spark.readStream.schema("id long, ts timestamp").json(f"file://{tmp_path}/in")
        return sessions.run_to_end(sessions.first_seen(live, ["id"], "ts", "1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")

    add("a.json", [{"id": 1, "ts": "2024-01-01 00:00:00"}, {"id": 2, "ts": "2024-01-01 00:01:00"}])
    assert run().count() == 2
    add("b.json", [{"id": 2, "ts": "2024-01-01 00:01:30"}, {"id": 3, "ts": "2024-01-01 00:02:00"}])
    assert sorted(r.id for r in run().collect()) == [1, 2, 3]
