"""Personal data: base patterns, and terms that reveal the values found.

Base spans (email, ip, card, phone) come from linear scans of whole texts, and so do secrets (kind ``secret``): values of SECRET_MIN or
more signs of at least two kinds, given to a name like token, password or api key. The information-theoretic part then treats each
distinct base value or secret as a protected entity: every occurrence has a context of the WINDOW words on either side. Over the whole
corpus, with n_te the distinct contexts of entity e that hold term t, n_e those of e, n_t the documents that hold t and N all
documents, a term discloses the share PMI(t;e) / IC(e) of the entity's information, PMI = log2(n_te N / ((n_t + UNSEEN) n_e))
and IC = log2(N / n_e). UNSEEN is the rule of three: a term not seen in N documents stands, at 95 % confidence, in
at most 3 of N others. So few contexts lower the share but forbid nothing: of a value with one context, a word of its own is
marked in corpora of 256 documents or more. Terms that disclose DISCLOSURE or more are marked (kind ``term``) wherever
they stand in a document that holds the entity, near it or not. Documents without the entity keep the term: there, nothing stands
beside it that it could reveal. Copies of a text share one context, so they are no evidence.

``sanitise`` replaces base spans by their kind, generalises marked terms, and removes those that disclose REMOVE or more.

Row semantics: each row is a document of its own, also if doc_id repeats; a null text is empty and has no spans; a null
doc_id is kept; texts of any length are scanned whole in linear time; an empty table gives an empty table; other columns are
ignored by ``find`` and kept unchanged by ``sanitise``. Spans are ordered by start, then kind.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, lean, settle, small

KINDS = ("email", "ip", "card", "phone", "term", "secret")
WINDOW, UNSEEN, DISCLOSURE, REMOVE = 8, 3, 0.75, 0.95

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9][0-9.]*+")
QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")
SECRET_MIN = 16
#: A credential's name, a sign of assignment and a value, quoted or not.
SECRET = re.compile(r"(?i)(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,24}[_-]){0,3}(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']?[ \t]{0,4}(?::=|=>|[:=])[ \t]{0,4}([\"']?)([A-Za-z0-9+/_.~=-]{%d,}+)\1" % SECRET_MIN)
HINT = re.compile(r"(?i)token|secret|passw|pwd|key|credential")


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run of its signs before an @ (never further back than the last match), so each @ is tried once."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for run in DOTTED.finditer(text):
        if text.count(".", run.start(), run.end()) >= 3:
            out += [m.span() for m in QUAD.finditer(text, run.start(), run.end()) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, ordered."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        out += [(s, 1, e) for s, e in ips(text)]
        out += [(s, 2, e) for s, e in cards(text)]
        out += [(s, 3, e) for s, e in phones(text)] if "+" in text else []
    return sorted(out)


def secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the values given to names of credentials: digits with letters, or both cases of letters."""
    if not ("=" in text or ":" in text) or not HINT.search(text):
        return []
    mixed = lambda v: any(c.isdigit() for c in v) + any(c.islower() for c in v) + any(c.isupper() for c in v) >= 2
    return [(m.start(2), 5, m.end(2)) for m in SECRET.finditer(text) if mixed(m[2])]


def _value(text: str, span: tuple[int, int, int]) -> str:
    raw = text[span[0] : span[2]]
    return f"{KINDS[span[1]]}:{raw if span[1] == 5 else raw.lower() if span[1] < 2 else re.sub('[^0-9]', '', raw)}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, list[tuple[str, int, int]]]]:
    """For each span: the entity, a hash of its context and the context's words with their places, without words in spans."""
    out = []
    for span in spans:
        around = []
        for begin, end, backwards in ((0, span[0], True), (span[2], len(text), False)):
            words, reach = [], 160
            while True:  # the nearest WINDOW whole words, looking further only if they are long
                lo, hi = (max(begin, end - reach), end) if backwards else (begin, min(end, begin + reach))
                words = [m for m in WORD.finditer(text, lo, hi) if not (backwards and m.start() == lo > begin) and not (not backwards and m.end() == hi < end)]
                if len(words) >= WINDOW or hi - lo == end - begin:
                    break
                reach *= 4
            words = [(m[0].lower(), m.start(), m.end()) for m in words]
            around += words[-WINDOW:] if backwards else words[:WINDOW]
        around = [w for w in around if not any(s < w[2] and w[1] < e for s, _, e in spans)]
        key = hashlib.blake2b(" ".join(w for w, _, _ in around).encode(), digest_size=8).digest()
        out.append((_value(text, span), int.from_bytes(key, "big", signed=True), around))
    return out


def occurrences(text: str, base: list[tuple[int, int, int]], terms: dict[str, float]) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, share disclosed) of every occurrence of the terms outside the base spans."""
    out, ends = [], sorted((s, e) for s, _, e in base)
    at, reach = 0, 0  # the spans that start before the word's end, and the furthest of their ends
    for m in WORD.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            reach, at = max(reach, ends[at][1]), at + 1
        if (t := m[0].lower()) in terms and reach <= m.start():
            out.append((m.start(), 4, m.end(), terms[t]))
    return out


SPAN = pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())])
CONTEXT = pa.struct([("entity", pa.string()), ("ctx", pa.int64()), ("terms", pa.list_(pa.struct([("t", pa.string()), ("s", pa.int32()), ("e", pa.int32())])))])
DDL = "base array<struct<s:int,k:int,e:int>>, secrets array<struct<s:int,k:int,e:int>>, contexts array<struct<entity:string,ctx:bigint,terms:array<struct<t:string,s:int,e:int>>>>"


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns, the base spans, the secrets and the contexts of every row."""
    at = [*keep, text].index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found, hidden = [base_spans(t) for t in texts], [secrets(t) for t in texts]
            near = [contexts(t, sorted(f + h)) if f or h else [] for t, f, h in zip(texts, found, hidden, strict=True)]
            arrays = [*(batch.column(k) for k in range(len(keep))), *(pa.array([[dict(zip("ske", x, strict=True)) for x in f] for f in fs], pa.list_(SPAN)) for fs in (found, hidden))]
            arrays.append(pa.array([[{"entity": v, "ctx": c, "terms": [dict(zip("tse", w, strict=True)) for w in ws]} for v, c, ws in n] for n in near], pa.list_(CONTEXT)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "base", "secrets", "contexts"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) if keep else ""
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), f"{kept}, {DDL}")


def revealing(scanned: DataFrame, texts: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, t, disclosed) of the terms that disclose a share ``disclosure`` or more of an entity, counted over all texts."""
    near = scanned.select(F.explode("contexts").alias("c")).select("c.entity", "c.ctx", F.array_distinct("c.terms.t").alias("ts"))
    n_e = near.groupBy("entity").agg(F.countDistinct("ctx").alias("n_e"))
    n_te = near.select("entity", "ctx", F.explode("ts").alias("t")).distinct().groupBy("entity", "t").agg(F.count("*").alias("n_te"))
    pairs = settle(n_te.join(small(n_e, 100), "entity"), "pairs")
    terms = settle(pairs.select("t").distinct(), "terms")
    if not terms.take(1):
        return pairs.select("entity", "t", F.lit(0.0).alias("disclosed"))
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("t"))
    fits = terms.count() * 100 <= BROADCAST_BYTES
    n_t = (words.join(F.broadcast(terms), "t") if fits else words).groupBy("t").agg(F.count("*").alias("n_t"))
    total = texts.count()
    ic = F.log2(F.lit(float(max(total, 2))) / F.col("n_e"))
    share = 1 - F.log2((F.greatest(F.col("n_t"), F.col("n_te")) + UNSEEN) / F.col("n_te")) / ic
    return settle(pairs.join(n_t, "t").where(ic > 0).select("entity", "t", share.alias("disclosed")).where(F.col("disclosed") >= disclosure), "revealing")


def _marked(scanned: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, terms: marked spans with the share they disclose) of the rows that have any: every occurrence in the whole text."""
    words = scanned.select("rid", F.explode(F.array_distinct(F.split(F.lower("held"), r"[^\p{L}]+"))).alias("t"))
    entities = scanned.select("rid", F.explode(F.array_distinct("contexts.entity")).alias("entity"))
    hit = words.join(small(terms, 150), "t").join(entities, ["rid", "entity"]).groupBy("rid", "t").agg(F.max("disclosed").alias("d"))
    by_row = hit.groupBy("rid").agg(F.collect_list(F.struct("t", "d")).alias("terms"))
    marks = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("d", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = []
            for text, base, ts in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                found.append(occurrences(text, [(x["s"], x["k"], x["e"]) for x in base], {x["t"]: x["d"] for x in ts}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip("sked", x, strict=True)) for x in f] for f in found], marks)], names=["rid", "terms"])

    return scanned.select("rid", "held", "base").join(by_row, "rid").mapInArrow(lean(run), "rid long, terms array<struct<s:int,k:int,e:int,d:double>>")


def _protected(found: DataFrame) -> DataFrame:
    """found with base spans and secrets as ``base``: no term is marked inside either."""
    return found.withColumn("base", F.sort_array(F.concat("base", "secrets")))


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_secret, n_spans) of every row of docs (doc_id, text)."""
    held = F.when(F.size("base") + F.size("secrets") > 0, F.col("text")).alias("held")
    found = settle(scan(docs.select("doc_id", "text"), "text", ["doc_id", "text"]).select("doc_id", held, "base", "secrets", "contexts").withColumn("rid", F.monotonically_increasing_id()), "pii")
    marked = _marked(_protected(found.where("held is not null")), revealing(found, docs, **thresholds))
    bare = F.coalesce(F.transform("terms", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))), F.array().cast("array<struct<s:int,k:int,e:int>>"))
    label = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(label, x.k + 1), x.s, x.e)))
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.join(marked, "rid", "left").select("doc_id", *map(count, range(4)), F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.sort_array(F.concat("base", "secrets", bare))).alias("spans"), F.size(bare).cast("long").alias("n_term"), F.size("secrets").cast("long").alias("n_secret"), (F.size("base") + F.size("secrets") + F.size(bare)).cast("long").alias("n_spans"))


def mask(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    """The text with each span (start, kind, end, share disclosed) replaced; where spans overlap the first, longest one counts."""
    out, at = [], 0
    for s, k, e, d in sorted(spans, key=lambda x: (x[0], -x[2])):
        if s >= at:
            out += [text[at:s], "" if k == 4 and d >= REMOVE else f"[{KINDS[k].upper()}]"]
            at = e
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with the same columns and rows, its ``text`` without the personal data; a null text stays null."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" if c != "text" else "text" for k, c in enumerate(names)])
    found = settle(scan(plain, "text", plain.columns).withColumn("rid", F.monotonically_increasing_id()), "pii")
    hit = _protected(found).where(F.size("base") > 0)
    marked = _marked(hit.withColumn("held", F.col("text")), revealing(found, docs.select("text"), **thresholds))
    spans = F.concat(F.transform("base", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), F.lit(0.0).alias("d"))), F.coalesce("terms", F.array().cast("array<struct<s:int,k:int,e:int,d:double>>")))
    held = hit.select("rid", "text", "base").join(marked, "rid", "left").select("rid", "text", spans.alias("spans"))

    def run(batches):
        for batch in batches:
            new = [mask(t, [(x["s"], x["k"], x["e"], x["d"]) for x in xs]) for t, xs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["rid", "masked"])

    new = held.mapInArrow(lean(run), "rid long, masked string")
    done = found.join(new, "rid", "left").withColumn("text", F.coalesce("masked", "text"))
    return done.select(*plain.columns).toDF(*names)
