import math
import random
from collections import Counter

import pytest

from tidemark.llm import lm_scoring as L
from tidemark.llm.common import BATCH


@pytest.mark.parametrize("slice_size", [L.SLICE, 40])
def test_as_brute_force(spark, monkeypatch, slice_size):
    monkeypatch.setattr(L, "SLICE", slice_size)
    rng = random.Random(2)
    rows = [(1, "a b c a b"), (2, "B c d"), (3, None), (4, "..."), (5, "a b c a b"), (None, "é a"), (6, "d d d d"), (8, " ".join(rng.choice("abcdefgh") for _ in range(50_000)))]
    good = {1, 2}
    split = {d: [w for w in (t or "").lower().replace("...", "").split()] for d, t in rows}
    models = []
    for keep in (lambda d: d in good, lambda d: True):
        pairs = Counter((v, w) for d, ws in split.items() if keep(d) for v, w in zip([None, *ws], ws))
        ones, first = Counter(), Counter()
        for (v, w), n in pairs.items():
            ones[w] += n
            first[v] += n
        models.append((pairs, ones, first))
    size = len(models[1][1])

    def p(m, v, w):
        pairs, ones, first = m
        return (pairs[v, w] + L.MU * (ones[w] + 1) / (sum(ones.values()) + size)) / (first[v] + L.MU)

    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in L.score(docs, labels).collect()}
    assert len(got) == len(rows)
    for d, ws in split.items():
        each = [math.log(p(models[0], v, w)) - math.log(p(models[1], v, w)) for v, w in zip([None, *ws], ws)]
        assert got[d].n_words == len(ws)
        assert got[d].score == pytest.approx(sum(each) / len(each) if each else 0)


def test_empty(spark):
    assert L.score(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_repeated_doc_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, "a c")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, round(r.score, 9)) for r in L.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 2), (1, 2), (2, 2)] and got[1] == got[2]


def test_large_rows_travel_in_small_batches(spark, monkeypatch):
    """Slices ask and are answered in batches of bounded bytes, whose setting is gone afterwards, and workers give memory back."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(d, " ".join(f"w{rng.randrange(60_000)}" for _ in range(60_000))) for d in range(12)], "doc_id long, text string").coalesce(1)
    most, back = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    real, answer = L._final, L._answer

    def seen(run):
        def watched(batches):
            def counted():
                for b in batches:
                    most.add(max(0, b.nbytes - 3 * L.BATCH_BYTES))
                    back.add(1)
                    yield b

            return run(counted())

        return watched

    monkeypatch.setattr(L, "_answer", seen(answer))
    monkeypatch.setattr(L, "_final", lambda *a: seen(real(*a)))
    before = spark.conf.get(BATCH)
    assert L.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 12
    assert spark.conf.get(BATCH) == before and back.value > 2 and most.value == 0
