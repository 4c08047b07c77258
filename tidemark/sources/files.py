"""Files as tables: documents, lines with their malformed rows apart, inventories, digests, receipts, idempotent output."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Longest line that is parsed; longer ones are malformed.
LONGEST = 16 << 20
# Folders that no scan of a library enters.
SKIPPED = ("validation", "node_modules", "runtime", ".git", "$recycle.bin", "system volume information", "windows", "program files", "program files (x86)", "programdata", "appdata")


def json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row for each file that holds one JSON document, with or without a byte order mark; (path, schema's columns, malformed)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("body"))
    full = StructType([*schema.fields]).add("_bad", "string")
    read = whole.withColumn("r", F.from_json("body", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return read.select("path", *[F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) for f in schema.fields], bad.alias("malformed"))


def json_lines(spark: SparkSession, path: str, schema: StructType, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): parsed lines, and (path, line) of those that are too long or no JSON of the schema. Blank lines are neither."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("line"))
    full = StructType([*schema.fields]).add("_bad", "string")
    read = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.where("trim(line) <> ''").withColumn("r", F.when(F.octet_length("line") <= longest, read))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.where(bad).select("path", "line")


def emit_lines(df: DataFrame, path: str, kind: str) -> None:
    """Append df's rows as JSON lines, each with its type."""
    df.select(F.to_json(F.struct(F.lit(kind).alias("type"), *df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def write_journal(df: DataFrame, path: str, signature: str, order: str) -> None:
    """Append rows to a journal: JSON lines under the folder of the signature they were made under."""
    df.select(F.lit(signature).alias("signature"), F.to_json(F.struct(*df.columns)).alias("value"), F.col(order).cast("long").alias("_o")).sortWithinPartitions("_o").drop("_o").write.mode("append").partitionBy("signature").text(path)


def read_journal(spark: SparkSession, path: str, signature: str, schema: StructType, order: str, valid: Column | None = None) -> DataFrame:
    """The longest run of valid rows, from the first on, of a journal's signature: rows after a missing, torn or invalid one don't
    count, as a restart would write them again. Rows are numbered from 0 by ``order``. Another signature's rows are never read."""
    try:
        rows, bad = json_lines(spark, f"{path.rstrip('/')}/signature={signature}", schema)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
    good = rows.where(valid) if valid is not None else rows
    one = good.dropDuplicates([order])
    # the first number without a valid row: a gap between neighbours, found without counting through all numbers
    w = Window.orderBy(order)
    ends = one.select(order).unionByName(spark.createDataFrame([(-1,)], f"{order} long").select(F.col(order).cast(schema[order].dataType)))
    gap = ends.withColumn("_next", F.lead(order).over(w)).where((F.col("_next") != F.col(order) + 1) | F.col("_next").isNull()).agg(F.min(order).alias("_last"))
    return one.join(F.broadcast(gap), F.col(order) <= F.col("_last")).drop("_last")


def inventory(spark: SparkSession, root: str, pattern: str = "*", skip: tuple[str, ...] = (), depth: int | None = None) -> DataFrame:
    """(path, size, modified) of the files below root; folders named in skip, whatever their case, are left out, and files more than
    ``depth`` folders down. Contents are not read. Empty files are not listed."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    out = df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    for name in skip:
        out = out.where(~F.contains(F.lower("path"), F.lit(f"/{name.lower()}/")))
    if depth is not None:
        levels = lambda c: F.size(F.split(c, "/"))
        bare = re.sub("^file:/*", "/", root.rstrip("/"))
        out = out.where(levels(F.regexp_replace("path", "^file:/*", "/")) - levels(F.lit(bare)) <= depth + 1)
    return out


def capped(files: DataFrame, most: int, order: str = "path") -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` files, one row with ``truncated``: whether there were more). The cap is the feature: it guards a scan of a
    whole disk by mistake."""
    return files.orderBy(order).limit(most), files.limit(most + 1).agg((F.count("*") > most).alias("truncated"))


def tasks(spark: SparkSession, root: str, registered: DataFrame | None = None, ignored: DataFrame | None = None, depth: int = 3) -> DataFrame:
    """(path) of the task files at most ``depth`` folders down, not below another task's folder, with the registered ones and without
    the ignored, each once whatever its case."""
    own = inventory(spark, root, "task.json", ("validation", "node_modules", "runtime", ".git"), depth).select("path", F.regexp_replace("path", "/task.json$", "").alias("folder"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("folder", "/")) - 1), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))
    nested = own.select("path", F.explode(above).alias("folder")).join(own.select("folder").distinct(), "folder", "left_semi").select("path").distinct()
    found = own.join(nested, "path", "left_anti").select("path")
    found = found.unionByName(registered.select("path")) if registered is not None else found
    one = found.withColumn("_k", F.lower("path")).groupBy("_k").agg(F.min("path").alias("path"))
    return (one.join(ignored.select(F.lower("path").alias("_k")).distinct(), "_k", "left_anti") if ignored is not None else one).select("path")


def _open(path: str):
    """(file system, path in it) of a URI; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":/" in path else f"file://{path}")


def fingerprints(spark: SparkSession, root: str, pattern: str = "*", block: int = 256 * 1024) -> DataFrame:
    """(path, size, sha256) of each file: the digest of its first block and, if it is larger than two blocks, its last. Only these
    ranges are read, so recordings of any size may be listed."""

    def run(batches):
        for batch in batches:
            out = []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = _open(path)
                with system.open_input_file(name) as f:
                    digest = hashlib.sha256(f.read_at(min(block, size), 0) if size else b"")
                    if size > 2 * block:
                        digest.update(f.read_at(block, size - block))
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "size", "sha256"])

    return inventory(spark, root, pattern).select("path", "size").mapInArrow(run, "path string, size long, sha256 string")


def resources(spark: SparkSession, wanted: DataFrame, root: str) -> DataFrame:
    """wanted (path) with size and whole-content sha256, and ``missing`` for those that are not there."""
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return wanted.join(have, "path", "left").withColumn("missing", F.col("sha256").isNull())


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the files of a committed output: a job's step is done only with these."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def first_existing(wanted: DataFrame, roots: list[DataFrame], name: str = "name") -> DataFrame:
    """wanted with the path under the first of several roots (name, path) that has the file; null if none has."""
    out = wanted
    for i, root in enumerate(roots):
        out = out.join(root.select(name, F.col("path").alias(f"_p{i}")), name, "left")
    return out.withColumn("path", F.coalesce(*[f"_p{i}" for i in range(len(roots))])).drop(*[f"_p{i}" for i in range(len(roots))])


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows without a receipt."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def write_blocks(df: DataFrame, path: str, block: str) -> None:
    """Write df in one folder for each block; running it again replaces exactly the blocks it holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)


def write_manifest(clips: DataFrame, source: dict, path: str) -> None:
    """An export's manifest: one JSON document a source, with the ordered clips, put in place as a whole by the writer's commit.

    clips (ordinal, output, start, end, summary...): the rows of one export, which the document holds as one list by its format."""
    item = F.struct("ordinal", *[c for c in clips.columns if c != "ordinal"])
    doc = clips.groupBy().agg(F.array_sort(F.collect_list(item)).alias("clips"))
    whole = doc.select(F.to_json(F.struct(F.lit("segments").alias("mode"), *[F.lit(v).alias(k) for k, v in sorted(source.items())], F.col("clips"), F.transform("clips", lambda c: c["output"]).alias("outputs"))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def write_segments_csv(clips: DataFrame, path: str) -> None:
    """start, end and a numbered label of each clip as CSV without a header."""
    clips.orderBy("ordinal").select("start", "end", F.concat(F.lit("交战 "), F.col("ordinal").cast("string"))).coalesce(1).write.mode("overwrite").csv(path)


def export_once(clips: DataFrame, done: DataFrame, removed: DataFrame, signature: str) -> DataFrame:
    """Clips an export still has to write: without those done under the signature and those the user deleted; of equal names the
    later ones get a number."""
    left = pending(clips, done.where(F.col("signature") == signature), ["start", "end"])
    left = left.join(removed.select(F.lower("output").alias("_k")).distinct(), F.lower("output") == F.col("_k"), "left_anti")
    n = F.row_number().over(Window.partitionBy(F.lower("output")).orderBy("ordinal"))
    stem, dot = F.regexp_extract("output", r"^(.*?)(\.[^./\\]*)?$", 1), F.regexp_extract("output", r"^(.*?)(\.[^./\\]*)?$", 2)
    return left.withColumn("_n", n).withColumn("output", F.when(F.col("_n") > 1, F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), dot)).otherwise(F.col("output"))).drop("_n")


def valid_prefix(plan: DataFrame, committed: DataFrame, position: str = "position", digest: str = "sha256") -> DataFrame:
    """Rows of plan up to the first that is not committed with the same digest: what a restart may keep."""
    state = plan.join(committed.select(position, F.col(digest).alias("_have")), position, "left").withColumn("_bad", ~F.coalesce(F.col("_have") == F.col(digest), F.lit(False)))
    first = state.agg(F.min(F.when(F.col("_bad"), F.col(position))).alias("_first"))
    return state.join(F.broadcast(first), F.col("_first").isNull() | (F.col(position) < F.col("_first"))).select(*plan.columns)


def config_stamp(config: dict, performance: tuple[str, ...] = ()) -> str:
    """Digest of a configuration without its settings that change only the speed, whatever the order of its names."""
    bare = lambda x: {k: bare(v) for k, v in x.items() if k not in performance} if isinstance(x, dict) else [bare(v) for v in x] if isinstance(x, (list, tuple)) else x
    return hashlib.sha256(json.dumps(bare(config), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()
