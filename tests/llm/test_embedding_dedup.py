"""Embedding near duplicates against brute force in double precision."""

import numpy as np


def brute(rows, threshold=0.93):
    ok = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and v and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v):
            ok.append(k)
    up, links = {k: k for k in range(len(rows))}, [0] * len(rows)

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for n, a in enumerate(ok):
        for b in ok[:n]:
            x, y = np.asarray(rows[a][1], float), np.asarray(rows[b][1], float)
            if rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    low = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            low[top(k)] = min(low.get(top(k), rows[k][0]), rows[k][0])
    comp = [low.get(top(k)) for k in range(len(rows))]
    return sorted(((rows[k][0], links[k], comp[k], rows[k][0] == comp[k]) for k in range(len(rows))), key=str)


def test_against_brute_force(spark):
    from tidemark.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(12, 8))
    for i in range(260):
        v = base[rng.integers(12)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.3, 0.45])
        rows.append((i, [float(np.float32(c)) for c in v * rng.choice([1, 1, 3])], int(rng.integers(3))))
    rows += [(300 + k, rows[5][1], rows[5][2]) for k in range(30)]  # copies
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [None] + [1.0] * 7, 1), (404, [float("nan")] * 8, 1), (405, rows[5][1], None), (None, rows[5][1], rows[5][2]), (5, rows[5][1], rows[5][2]), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n int")
    for tile in (2048, 16):
        assert sorted((tuple(r) for r in near_duplicates(df, tile=tile).collect()), key=str) == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    from tidemark.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (7, 7), (300, 299), (299, 300), (None, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
