import random
import re
from collections import Counter

import pyarrow as pa

from tidemark.llm import licenses as L


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower().replace("licence", "license"))
    return list(zip(w, w[1:])) if len(w) != 1 else [(w[0],)]


def brute(text):
    """Every stretch of every template's size, and whole texts that are shorter, without pruning."""
    g, found = grams(text), []
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            own = Counter(grams(t))
            m = sum(own.values())
            size = min(m, len(g))
            for a in range(len(g) - size + 1 if g else 0):
                common = sum((Counter(g[a : a + size]) & own).values())
                d = 2 * common / (size + m)
                if d >= L.LEAST - 1e-12:
                    found.append((-common, -d, name, a, a + size))
    out, taken = {}, []
    for _, d, name, a, z in sorted(found):
        if all(z <= x or y <= a for x, y in taken):
            taken.append((a, z))
            out[name] = max(out.get(name, 0), -d)
    return out


def rounded(found):
    return {k: round(v, 9) for k, v in found.items()}


def test_as_brute_force():
    rng = random.Random(6)
    pool = [t for ts in L.TEMPLATES.values() for t in ts]
    words = [w for t in pool for w in t.split()]
    texts = [None, "", "license", "MIT", "plain words without any notice"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(pool).split()
            for _ in range(rng.randrange(len(w) // 6 + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            parts += [" ".join(rng.choice(words) for _ in range(rng.randrange(12))), " ".join(w)]
        texts.append("\n# ".join(parts))
    assert [rounded(x) for x in L.Matcher().scan(pa.array(texts, pa.string()))] == [rounded(brute(t)) for t in texts]


def test_standard_texts_wrapped_commented_and_edited():
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + L.TEMPLATES["MIT"][2].replace(", ", ",\n")
    gpl = "# " + (L.TEMPLATES["GPL-3.0"][1] + " You should have received a copy.").replace(" the ", " the\n# ")
    edited = L.TEMPLATES["BSD-3-Clause"][0].replace("the copyright holder", "Example Corp.").replace("conditions", "terms", 1)
    embedded = "words and more and licensed under CC BY-NC 4.0, see the footer of this page"
    got = L.Matcher().scan(pa.array([mit, gpl, edited, embedded, "a license is a license of a work under the terms of the law"]))
    assert [sorted(g) for g in got] == [["MIT"], ["GPL-3.0"], ["BSD-3-Clause"], ["CC-BY-NC-4.0"], []]


def test_rows(spark):
    rows = [(1, "Intro text.\nReleased under the MIT Licence.\nMore"), (2, None), (3, ""), (None, "Some words. Licensed under CC BY-NC 4.0. Other words."), (5, "word " * 30000), (1, "plain text about the license"), (1, "plain text about the license")]
    got = [(r.doc_id, r.n_licenses, r.licenses) for r in L.scan(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, dice double")).collect()]
    assert got == [(1, 1, "MIT"), (2, 0, ""), (3, 0, ""), (None, 1, "CC-BY-NC-4.0"), (5, 0, ""), (1, 0, ""), (1, 0, "")]
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
