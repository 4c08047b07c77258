"""Near duplicates among embeddings with equal labels, by int8 tile products with exact error bounds.

Vectors that are equal in every component form one class, which travels once with its number of copies. The classes of a
label are dealt at random into tiles of about TILE; every pair of tiles of a label is one group. In a group each unit vector
x is quantised to s*q (q int8); with a = |s*q| and e = |x - s*q|, a pair's cosine differs from s*s'*(q.q') by at most
a*e' + e*a' + e*e'. Pairs whose upper bound is below the threshold are out, pairs whose lower bound is above it are in, and
only the others are computed in double precision. A group returns link counts and a spanning forest, both linear in its
vectors, so a dense group of copies never comes out as pairs.

Row semantics: vectors link only if their labels are equal and not null and their lengths equal. A vector that is null,
empty, all zero or holds a null or non-finite component, or a row without vec_id, links with nothing: n_links 0, it is its
own component and kept. Rows that repeat a vec_id count as vectors of their own. An empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, settle

TILE = 2048
SLACK = 4e-6  # above the rounding of the float32 arithmetic on the bounds


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors and norms of the residuals."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    back = q * s[:, None]
    return q, s, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with cosine >= threshold."""
    (qx, sx, ax, ex), (qy, sy, ay, ey) = quantise(x), quantise(y)
    wide = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # the integer products stay exact
    about = (qx.astype(wide) @ qy.astype(wide).T) * sx[:, None].astype(np.float32) * sy[None, :].astype(np.float32)
    error = ax[:, None].astype(np.float32) * ey[None, :].astype(np.float32) + ex[:, None].astype(np.float32) * (ay + ey)[None, :].astype(np.float32) + np.float32(SLACK)
    sure = about - error >= threshold
    i, j = np.nonzero((about + error >= threshold) & ~sure)
    good = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 17):
        part = slice(k, k + (1 << 17))
        good[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold
    si, sj = np.nonzero(sure)
    return np.concatenate([si, i[good]]), np.concatenate([sj, j[good]])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with by the pairs (i, j)."""
    low = np.arange(n)
    while len(i):
        best = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], best)
        np.minimum.at(low, low[j], best)
        low = np.minimum(low, low[low])
        while (again := low[low]).tolist() != low.tolist():
            low = again
        if (low[i] == low[j]).all():
            break
    return low


def _pair_of_tiles(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        copies = table["copies"].to_numpy()
        side = table["side"].to_numpy()
        v = table["v"].combine_chunks()
        x = unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(right):
            a, b = linked(x[left], x[right], threshold)
            a, b = left[a], right[b]
        else:
            a, b = linked(x, x, threshold)
            a, b = a[a < b], b[a < b]
        n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        low = forest(len(ids), place[a], place[b])
        to = np.flatnonzero(low != np.arange(len(ids)))
        has = np.flatnonzero(n)
        return pa.table(
            {
                "a": np.concatenate([ids[has], ids[order][to]]),
                "b": pa.array(np.concatenate([np.zeros(len(has), np.int64), ids[order][low[to]]]), mask=np.arange(len(has) + len(to)) < len(has)),
                "n": pa.array(np.concatenate([n[has].astype(np.int64), np.zeros(len(to), np.int64)])),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label)."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fine = fine & F.coalesce(F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    rows = settle(vectors.select(F.col("vec_id").cast("long"), F.when(fine, v).alias("v"), "label").withColumns({"h": F.xxhash64("v"), "g": F.hash("v")}), "vectors")
    whole = rows.where("v is not null")
    classes = settle(whole.groupBy("label", "h", "g", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    kinds = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = classes.withColumn("dim", F.size("v")).join(kinds, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("h", "id"), F.col("tiles")).cast("int"))
    grouped = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), F.when(F.col("t") <= F.col("o"), 0).otherwise(1).alias("side"), "id", "copies", "v"
    )
    found = settle(grouped.groupBy("label", "dim", "i", "j").applyInArrow(_pair_of_tiles(threshold), "a long, b long, n long"), "tiles")
    linked_with = settle(found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), "links")
    groups = settle(components(found.where("b is not null")), "components")
    facts = settle(
        classes.select("label", "h", "g", "v", "id", "copies").join(linked_with, "id", "left").join(groups, F.col("id") == F.col("node"), "left").select("label", "h", "g", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")),
        "facts",
    )
    out = whole.join(facts, ["label", "h", "g", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
