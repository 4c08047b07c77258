"""What several operators share: work tables in the cluster's shared folder, row keys and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []

#: A table is broadcast only if its measured size is below this many bytes.
BROADCAST_BYTES = 48 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (where that is unset, as in tests) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, _own_root[0], True)
    return "file://" + _own_root[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


#: Spark's setting of the bytes in an Arrow batch sent to Python; the JVM holds a batch outside its heap, the worker several times over.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within, what is run has this setting; then the old one is back."""
    conf, before = spark.conf, spark.conf.get(key, None)
    conf.set(key, value)
    try:
        yield
    finally:
        conf.set(key, before) if before is not None else conf.unset(key)


def settle(df: DataFrame, name: str, path: str | None = None, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends in files that outlive any executor. batch: bytes in an Arrow
    batch, where rows are large or much is made of each."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    with setting(spark, BATCH, str(batch)) if batch else contextlib.nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


#: Spark's setting that deletes a query's shuffle files when the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle_once(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """settle, after which nothing reads df's shuffle files again: they are deleted at its end, not when the driver next collects garbage."""
    with setting(df.sparkSession, CLEAN_UP, "true"):
        return settle(df, name, batch=batch)


#: What operators keep in a worker from task to task, by name.
KEPT: dict[str, dict] = {}


def lean(run: Callable, own: str | None = None) -> Callable:
    """run (of batches), after which its Python worker gives back what it no longer uses: workers wait for the next stage, and what
    they keep counts in their executor's memory. Before run, what other operators than ``own`` have kept there goes."""

    def freed(batches):
        drop_kept(own)
        yield from run(batches)
        give_back()

    return freed


def drop_kept(own: str | None = None) -> None:
    others = [kept for name, kept in KEPT.items() if name != own and kept]
    for kept in others:
        kept.clear()
    if others:
        give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def forget(*tables: DataFrame) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows prove it small enough, else df as it is (a shuffled join)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def contract(edges: DataFrame, a: str = "a", b: str = "b", most: int = 400_000) -> DataFrame:
    """(u, v): for every node but the smallest of what one task has joined, that smallest node. Fewer edges with the same
    components; a task remembers at most ``most`` nodes, then puts out what it has and starts anew."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            r = x
            while (n := up.get(r, r)) != r:
                r = n
            while x != r:
                up[x], x = r, up[x]
            return r

        def flush():
            pairs = [(x, r) for x in up if (r := root(x)) != x]
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                up[x] = up[y] = min(x, y)
            if len(up) > most:
                yield flush()
        yield flush()

    some = edges.select(F.col(a).cast("long"), F.col(b).cast("long")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    return some.mapInArrow(lean(run), "u long, v long")


def labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): nodes of one label are connected; not all connected nodes have one label. Two passes, no loop."""
    once = contract(edges, a, b).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    further = once.select(F.col("node").alias("label"), F.col("label").alias("_next"))
    return once.join(further, "label", "left").select("node", F.coalesce("_next", "label").alias("label"))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """Connected components of undirected edges of whole numbers, as (node, component = smallest node reachable).

    Every task first joins its own edges (contract), then alternating large-star and small-star steps (Kiveris et al., 2014), each
    written to the shared folder, until the edge set no longer changes. Every step is a grouped minimum and an equi-join, so no
    component is ever gathered in one task; a hub's edges can be split by the adaptive skew join. Nodes without a (non-loop) edge
    are left out: they are their own component. Null ends are dropped. No edges: no rows.
    """
    now = settle(contract(edges, a, b).distinct(), f"{name}-edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low2.select("u", F.col("m").alias("v")))
        after = settle(stars.where("u <> v").distinct(), f"{name}-edges")
        new = _mark(after)
        forget(now)
        now, old, mark = after, mark, new
        if old == new:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and two sums over hashes: equal for two steps only if the edge set stayed the same."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first()
    return r[0], str(r[1]), r[2]
