"""Decontamination against a brute-force search of all windows."""

import hashlib
import random
import re


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for item, text in items:
            b = words(text)
            wins = [b[k : k + size] for k in range(max(len(b) - size, 0) + 1)] if b else []
            for s in range(len(w)):
                for win in wins:
                    if w[s : s + len(win)] == win:
                        hit |= {*range(s, s + len(win))}
                        named |= {str(item)} - {"None"}
        ids = ",".join(sorted(named))
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), ids))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    from tidemark.llm.decontaminate import decontaminate, proximity

    rng = random.Random(6)
    vocab = ["the", "of", "an", "É", "éa", "Qx", "z9", "ßo", "中", "rare", "odd"]
    say = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, say(rng.choice([3, 9, 10, 11, 30]))) for k in range(12)] + [(50, None), (51, ""), (52, "one short"), (52, "one short"), (None, say(15)), (53, "never seen words stand here in this long item of many words")]
    docs = [(k, say(rng.randint(0, 40))) for k in range(60)]
    docs += [(100 + k, say(6) + (t or "") + say(4)) for k, (_, t) in enumerate(items)]
    docs += [(200, items[4][1].upper()), (200, items[4][1].upper()), (201, None), (202, ""), (None, items[3][1]), (203, "one SHORT " * 500), (204, say(5) + " ".join(words(items[5][1])[:10]))]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, pos int, term string")
    b = spark.createDataFrame([(*r, "t") for r in items], "item_id long, text string, win string")
    got = sorted((tuple(r) for r in decontaminate(d, b).collect()), key=str)
    assert got == brute(docs, items)
    assert decontaminate(d.limit(0), b).count() == 0
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate(d, b.limit(0)).collect())
    near = {r.doc_id for r in proximity(d, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")).collect()}
    assert near == set()
    more = spark.createDataFrame([(1, "x beta y alpha z gamma"), (2, "alpha x beta " + "y " * 30 + "gamma"), (3, "gamma beta alpha")], "doc_id long, text string")
    assert {r.doc_id for r in proximity(more, spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")).collect()} == {1, 3}
