import random
import zlib

import numpy as np

from tidemark.llm import toxicity as T


def rows(n=400, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abdegilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 200))]
        bad = rng.random() < 0.4
        if bad:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["zwumpf", "krazzle"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_gradients_equal_differences():
    net, seen = T.Network(3), T.Vocabulary()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vec = net.vectors([seen.ids(w) for w in ("a", "bcd", "efghi")]).astype(np.float64)
    at = np.full((2, T.WINDOW), -1)
    at[0, :5], at[1, :2] = [0, 1, 2, 1, 0], [2, 2]
    weight = np.array([0.7, -1.3])
    _, kept = net.forward(vec, at, True)
    g, dvec = net.backward(weight, kept)
    for k in ("W", "U", "b", "A", "ab", "v", "o"):
        i = tuple(s // 2 for s in net.p[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up = net.forward(vec, at) @ weight
        net.p[k][i] = old - 1e-3
        down = net.forward(vec, at) @ weight
        net.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-4, k
    step = np.zeros_like(vec)
    step[1, 3] = 1e-3
    assert abs((net.forward(vec + step, at) - net.forward(vec - step, at)) @ weight / 2e-3 - dvec[1, 3]) < 2e-4


def test_windows_cover_all_words():
    for n in (0, 1, T.WINDOW, T.WINDOW + 1, 500):
        a = T._index(list(range(n)))
        assert set(a[a >= 0]) == set(range(n))


def test_held_out_accuracy_and_rows(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, None, "x"), (7, "", "x"), (5, "zwumpf " + "la " * 9000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, k) for i, _, k in data] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = T.score(docs, labels).collect()
    assert len(got) == len(data) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    want = {i: k for i, _, k in data}
    test = [r for r in got[: len(data)] if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == want[r.doc_id] for r in test]) > 0.9


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(docs, labels).count() == 0
    assert T.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), labels).first().score == 0.5


def test_windows_of_very_long_texts_as_brute_force():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abdegilnorst") for _ in range(5)) for _ in range(90)]
    net, seen = T.fit(*zip(*[(t, k) for _, t, k in rows(120)]), epochs=1), T.Vocabulary()
    for n in (47, 48, 49, 24_575, 24_576, 24_579, 50_001):
        words = [rng.choice(vocab) for _ in range(n)]
        windows = [words[a : a + T.WINDOW] for a in ([0] if n <= T.WINDOW else [*range(0, n - T.WINDOW, T.STRIDE), n - T.WINDOW])]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.array([[number[w] for w in x] + [-1] * (T.WINDOW - len(x)) for x in windows])
        want = max(net.forward(net.vectors([seen.ids(w) for w in number]), at[i : i + 500]).max() for i in range(0, len(at), 500))
        assert abs(T.scores(net, [" ".join(words)], seen)[0] - 1 / (1 + np.exp(-want))) < 1e-5


def test_contradictory_labels_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "d e"), (None, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    got = T.score(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"] and all(0 <= r.score <= 1 for r in got)
