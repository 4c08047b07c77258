"""Sources and sinks on small folders."""

import hashlib
import json

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_json_documents_and_emitted_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_bytes(b"\xef\xbb\xbf" + b'{"n": 1,\n "more": 2}')
    (tmp_path / "d" / "b.json").write_text("{broken")
    got = files.json_documents(spark, f"file://{tmp_path}/d", StructType().add("n", "integer"))
    assert sorted((r.path[-6:], r.n, r.malformed) for r in got.collect()) == [("a.json", 1, False), ("b.json", None, True)]
    files.emit_lines(spark.createDataFrame([(1, None)], "n int, x string"), f"file://{tmp_path}/out", "progress")
    assert [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/out").collect()] == [{"type": "progress", "n": 1, "x": None}]
    good, bad = files.json_lines(spark, f"file://{tmp_path}/out", StructType().add("n", "integer"), longest=5)
    assert good.count() == 0 and bad.count() == 1


def test_journal_keeps_its_valid_prefix(spark, tmp_path):
    path, schema = f"file://{tmp_path}/j", StructType().add("i", "long").add("v", "string")
    assert files.read_journal(spark, path, "s", schema, "i").count() == 0
    files.write_journal(spark.createDataFrame([(0, "a"), (1, "b"), (2, "bad"), (4, "e")], schema), path, "s", "i")
    files.write_journal(spark.createDataFrame([(0, "other")], schema), path, "t", "i")
    (tmp_path / "j" / "signature=s" / "part-torn.txt").write_text('{"i": 3, "v"')
    assert rows(files.read_journal(spark, path, "s", schema, "i")) == [(0, "a"), (1, "b"), (2, "bad")]
    assert rows(files.read_journal(spark, path, "s", schema, "i", F.col("v") != "bad")) == [(0, "a"), (1, "b")]
    files.write_journal(spark.createDataFrame([(3, "d")], schema), path, "s", "i")
    assert len(rows(files.read_journal(spark, path, "s", schema, "i"))) == 5


def test_scans(spark, tmp_path):
    for name in ("a/task.json", "a/b/task.json", "c/d/e/task.json", "c/d/e/f/g/task.json", "Runtime/task.json", "x/v.mp4", "x/y/v.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    short = lambda df: sorted(r.path.split(tmp_path.name + "/")[1] for r in df.collect())
    assert short(files.tasks(spark, f"file://{tmp_path}")) == ["a/task.json", "c/d/e/task.json"]
    assert short(files.inventory(spark, f"file://{tmp_path}", "*.mp4", files.SKIPPED, depth=1)) == ["x/v.mp4"]
    first, more = files.capped(files.inventory(spark, f"file://{tmp_path}", "*"), 3)
    assert first.count() == 3 and more.first().truncated
    ignored = spark.createDataFrame([(f"file:{tmp_path}/A/TASK.json",)], "path string")
    assert short(files.tasks(spark, f"file://{tmp_path}", ignored=ignored)) == ["c/d/e/task.json"]


def test_fingerprints_read_head_and_tail(spark, tmp_path):
    bodies = {"empty": b"", "small": b"abc", "two": bytes(range(20)), "long": bytes(range(200))}
    for name, body in bodies.items():
        (tmp_path / f"{name}.bin").write_bytes(body)
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.size, r.sha256) for r in files.fingerprints(spark, f"file://{tmp_path}", "*.bin", block=10).collect()}
    assert got == {n: (len(b), hashlib.sha256(b[:10] + (b[-10:] if len(b) > 20 else b"")).hexdigest()) for n, b in bodies.items() if b}
    want = spark.createDataFrame([(f"{tmp_path}/small.bin",), (f"{tmp_path}/none.bin",)], "path string")
    assert sorted((r.path[-8:], r.missing) for r in files.resources(spark, want, f"file://{tmp_path}").collect()) == [("mall.bin", False), ("none.bin", True)]
    assert files.receipts(spark, f"file://{tmp_path}").count() == 3


def test_exports(spark, tmp_path):
    clips = spark.createDataFrame([(1, "a.mp4", 0.0, 1.0), (2, "A.mp4", 2.0, 3.0), (3, "b.mp4", 4.0, 5.0), (4, "gone.mp4", 6.0, 7.0)], "ordinal int, output string, start double, end double")
    files.write_manifest(clips, {"source": "s", "fps": 2}, f"file://{tmp_path}/m")
    doc = json.loads(spark.read.text(f"file://{tmp_path}/m").first().value)
    assert doc["mode"] == "segments" and doc["outputs"] == ["a.mp4", "A.mp4", "b.mp4", "gone.mp4"] and doc["clips"][1]["start"] == 2.0
    files.write_segments_csv(clips, f"file://{tmp_path}/c")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/c").collect()][:2] == ["0.0,1.0,交战 1", "2.0,3.0,交战 2"]
    done = spark.createDataFrame([(4.0, 5.0, "sig"), (0.0, 1.0, "old")], "start double, end double, signature string")
    left = files.export_once(clips, done, spark.createDataFrame([("GONE.mp4",)], "output string"), "sig")
    assert sorted((r.ordinal, r.output) for r in left.collect()) == [(1, "a.mp4"), (2, "A (2).mp4")]


def test_prefixes_roots_and_stamps(spark):
    plan = spark.createDataFrame([(i, f"h{i}") for i in range(5)], "position long, sha256 string")
    done = spark.createDataFrame([(0, "h0"), (1, "h1"), (2, "x"), (3, "h3")], "position long, sha256 string")
    assert [r.position for r in files.valid_prefix(plan, done).orderBy("position").collect()] == [0, 1]
    assert files.valid_prefix(plan, plan).count() == 5
    s = lambda *x: spark.createDataFrame(list(x), "name string, path string")
    got = files.first_existing(spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), [s(("a", "/1/a")), s(("a", "/2/a"), ("b", "/2/b"))])
    assert rows(got) == [("a", "/1/a"), ("b", "/2/b"), ("c", None)]
    assert files.config_stamp({"b": [1, {"threads": 2, "x": 1}], "a": None}, ("threads",)) == files.config_stamp({"a": None, "b": [1, {"x": 1, "threads": 9}]}, ("threads",))
