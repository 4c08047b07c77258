import random
import re

from tidemark.llm import ngram_join as J


def brute(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def test_join_as_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocab) for _ in range(60)]
    texts = [None, "", "a", "A", "a b", "one two three four", "One  two\tthree four"]
    base = [rng.choice(vocab) for _ in range(200)]
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(8)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    for i in range(50):
        texts.append(" ".join(common + [rng.choice(vocab) for _ in range(rng.randrange(10, 90))]))
    for i in range(20):
        t = texts[-1 - rng.randrange(30)].split()
        texts.append(" ".join(t + [rng.choice(vocab)] * rng.randrange(6)))
    texts.append(" ".join(rng.choice(vocab) for _ in range(90_000)))  # one very long text and a near copy
    texts += [texts[-1] + " more", "\u0130 \u00c9A \u00e9a x", "\u0130 \u00c9a \u00e9a x"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join(df).collect())
    assert got == brute(rows)


def test_no_rows_and_null_ids(spark):
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = J.join(spark.createDataFrame([(None, "a b c d e"), (9007199254740993, "a b c d e"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 2, 9007199254740993), (9007199254740993, 2, 9007199254740993)]


def test_a_list_shared_by_many_unlinked_texts(spark):
    """Short texts that all hold one of few shingles first in order: nothing links, though all share a list; then a chain."""
    rng = random.Random(8)
    shared = "all of these begin alike"
    rows = [(i, shared + " " + " ".join(f"w{rng.randrange(50)}" for _ in range(6))) for i in range(1500)]
    rows += [(5000, " ".join(f"c{k}" for k in range(60)))]
    rows += [(5000 + j, " ".join(f"c{k}" for k in range(j, 60 + j))) for j in range(1, 12)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_groups_of_equal_prefixes(spark, monkeypatch):
    """With hot cells for everything but the first shingles, many classes share prefix and size; the links are the same."""
    monkeypatch.setattr(J, "PER_SALT", 3)
    monkeypatch.setattr(J, "BITMAP_BYTES", 0)
    rng = random.Random(4)
    head, rows = [f"h{i}" for i in range(30)], []
    for i in range(40):
        tail = [f"t{j}" for j in range(60)]
        for _ in range(rng.randrange(3)):
            tail[rng.randrange(60)] = f"t{rng.randrange(60)}"
        rows.append((i, " ".join(head + tail)))
    rows += rows[:9] + [(None, rows[0][1])]
    got = J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows[:-1])


def test_keep_one(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2, text, 1, 1), (2, text, 2, 1), (None, text, 3, 1), (7, text + " x", 4, 1), (8, "", 5, 1), (8, "", 6, 1), (9, None, 7, 1), (None, "lone text of five words", 8, 1)]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, rid int, _digest int")).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "rid", "_digest"]
    assert sorted(r.rid for r in kept if r.rid > 2) == [5, 6, 7, 8] and len(kept) == 5
    assert J.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    spark.createDataFrame(rows, "doc_id long, text string, line int, file int").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    table = spark.read.parquet(f"file://{tmp_path}/docs")
    again = J.keep_one(table).collect()
    assert again[0].__fields__ == ["doc_id", "text", "line", "file"] and len(again) == 5 and sorted(r.line for r in again if r.line > 2) == [5, 6, 7, 8]
