"""Base spans against the plain patterns, marked terms against a brute-force count."""

import hashlib
import random
import re

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    from tidemark.llm.pii import luhn

    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_scans_equal_the_plain_patterns():
    from tidemark.llm.pii import base_spans

    rng = random.Random(2)
    pieces = ["a@b.co", "@", ".", "x", "1.2.3.4", "999.1.1.1", "0000255.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-1234", "+", "12", " ", "-", "é@ü", "a.b+c@d-e.f.g", "@b.c", "(", ")", "5"]
    for _ in range(4_000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base_spans(t) == plain(t), t


def test_long_runs_take_linear_time():
    import time

    from tidemark.llm.pii import base_spans

    begin = time.time()
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "1 " * 150_000, "a@" * 150_000, "+1" + " " * 300_000, "1.1.1 " * 50_000):
        base_spans(t)
    assert time.time() - begin < 20


def test_find_and_sanitise(spark):
    from tidemark.llm.pii import find, sanitise

    rng = random.Random(1)
    filler = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, say(30)) for i in range(200)]
    rows += [(200 + i, f"{say(12)} zorblatt ann@example.org {say(12)}") for i in range(6)]  # one rare word always beside it
    rows += [(300, None), (301, ""), (302, "call +1 555 010 1234 now"), (302, "call +1 555 010 1234 now"), (None, "at 10.0.0.7, é 4111 1111 1111 1111")]
    copy = f"{say(9)} onlyincopies bob@example.org {say(9)}"
    rows += [(400 + i, copy) for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, spans string, rid int")
    got = sorted((tuple(r) for r in find(docs).collect()), key=str)
    want = []
    from tidemark.llm.pii import KINDS

    for i, t in rows:
        t = t or ""
        spans = plain(t)
        told = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
        extra = [(m.start(), 4, m.end()) for m in re.finditer("zorblatt", t)]
        want.append((i, *(sum(k == n for _, k, _ in spans) for n in range(4)), hashlib.sha256(told(spans).encode()).hexdigest(), told(sorted(spans + extra)), len(extra), 0, len(spans) + len(extra)))
    assert got == sorted(want, key=str)
    clean = sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[300] is None and texts[301] == "" and texts[302] == "call [PHONE] now" and texts[None] == "at [IP], é [CARD]"
    assert texts[0] == rows[0][1] and "zorblatt" not in texts[200] and "[EMAIL]" in texts[200] and "onlyincopies" in texts[400]
    assert find(docs.limit(0)).count() == 0 and sanitise(docs.limit(0)).count() == 0


def test_terms_of_values_seen_once_or_twice(spark):
    from tidemark.llm.pii import find, sanitise

    rows = [(i, "plain words that stand in every text") for i in range(400)]
    rows += [(500, "plain words zorblatt ann@example.org that stand"), (501, "words krazzle bob@example.org that stand"), (502, "plain krazzle bob@example.org in every text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_term for r in find(docs).collect() if r.n_term} == {500: 1, 501: 1, 502: 1}
    texts = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert texts[500] == "plain words [TERM] [EMAIL] that stand" and texts[501] == "words [TERM] [EMAIL] that stand" and texts[0] == rows[0][1]


def test_terms_are_marked_in_the_whole_text(spark):
    from tidemark.llm.pii import find, sanitise

    far = " plain words that stand in every text" * 9
    rows = [(i, "plain words that stand in every text") for i in range(900)] + [(1500, f"Zorblatt{far} zorblatt ann@example.org{far} zorblatt@x.org, zorblatt"), (1501, "zorblatt in every text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_term for r in find(docs).collect() if r.n_term} == {1500: 3}
    texts = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert texts[1500] == f"[TERM]{far} [TERM] [EMAIL]{far} [EMAIL], [TERM]" and texts[1501] == rows[-1][1]


def test_secrets(spark):
    from tidemark.llm.pii import find, sanitise, secrets

    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    hits = [f'x token = "{key}" y', f"API_KEY={key}", f"aws_secret_access_key: '{key}'", f'"password" : "Abcdefgh12345678"', f"TOKEN:={key}é"]
    for t in hits:
        assert len(secrets(t)) == 1 and t[secrets(t)[0][0] : secrets(t)[0][2]] in (key, "Abcdefgh12345678"), t
    for t in ("the token = broken", "monkey: abcdefghijklmnopqrstuvw", f"id = {key}", "tokens and keys", "token = 1234567890123456789", f"token {key}", "key = ================"):
        assert not secrets(t), t
    begin = __import__("time").time()
    for t in ("token = " * 40_000, "a-" * 150_000 + "token=" + "x1" * 150_000, "key" * 100_000 + "="):
        secrets(t)
    assert __import__("time").time() - begin < 20
    docs = spark.createDataFrame([(1, hits[0] + " and a@b.co"), (2, "no secret: none"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in find(docs).collect()}
    assert got[1].n_secret == 1 and got[1].n_email == 1 and got[1].n_spans == 2 + got[1].n_term
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.split(",")[-1].encode()).hexdigest()
    assert got[2].n_spans == got[3].n_spans == 0
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert clean[1] == 'x token = "[SECRET]" y and [EMAIL]' and clean[2] == "no secret: none" and clean[3] is None
