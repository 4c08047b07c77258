"""Cross-entropy difference of matched n-gram models.

The target model counts the rows labelled of good quality, the background model all rows. Both are bigram models over one shared
vocabulary (all words of the corpus), smoothed alike: p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V).
A document's score is the mean over its words of log p_target - log p_background: above 0, it is more like the target. All counts
come from all rows and stay distributed. Words are told apart by 64-bit hashes.

Texts are read once, a slice at a time; what is kept of a slice are its distinct words and bigrams, its counts of them and which of
them its documents hold. A slice then asks for the counts over all slices, in one sorted array for each range of hashes; so a word of every text is sent once a slice, not once an occurrence. The
ranges' tasks add up what the slices sent and answer each of them in its order; there are as many ranges as the input's size asks
for. Slice and answers meet again by the slice's number. Arrays travel as differences of sorted numbers in planes of bytes.

Row semantics: each row is scored by itself; null or wordless text has no words and score 0; a null doc_id is never labelled, labels
of a repeated doc_id hold for all its rows; a doc_id labelled both ways is of the target. Without target rows its model is uniform.
Scores have no ties to break; texts of any length are used whole (one over a slice's size is a slice of its own).
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, forget, lean, settle_once, small
from .words import hashed, letter_words, mix, slices

MU = 4.0
#: Bytes of text in a slice, in a range of hashes and in a partition of slices.
SLICE, RANGE, PART = 4 << 20, 16 << 20, 16 << 20
#: Stands before the first word; no word is written like this.
START = pd.util.hash_array(np.array(["^"], object), categorize=False)[0]


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the high bytes of small numbers come together as runs of zeros."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def numbers(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack(x: np.ndarray) -> bytes:
    """The planes of the differences of unsigned numbers."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.cumsum(numbers(raw, kind), dtype=kind)


def pairs_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * np.uint64(0x9E3779B97F4A7C15) + w)


ASK = "slice long, n binary, own binary, pairs binary, codes binary, wc binary, bc binary"


def _ask(batches):
    """Of batches (rid, doc_id, target, text) one row for each slice: its distinct words and bigrams, its own counts of them, and
    which bigrams each of its documents holds."""
    for b in batches:
        for begin, end in slices(b.column(3), SLICE):
            part = b.slice(begin, end - begin)
            h, ends = hashed(letter_words(part.column(3)))
            n = np.diff(ends, prepend=0)
            own, w = np.unique(np.append(h, START), return_inverse=True)
            start, w = w[-1], w[:-1]
            v = np.append(start, w[:-1])[: len(w)]
            v[(ends - n)[n > 0]] = start
            good = np.repeat(part.column(2).to_numpy(), n) == 1
            pairs, code = np.unique(w * np.int64(len(own)) + v, return_inverse=True)
            count = lambda x, size: np.stack([np.bincount(x[good], minlength=size), np.bincount(x, minlength=size)]).astype(np.uint32)  # noqa: B023, E731
            wc, bc = np.concatenate([count(w, len(own)), count(v, len(own))]), count(code, len(pairs))
            codes = np.sort(np.repeat(np.arange(len(n)), n) * np.int64(max(len(pairs), 1)) + code) % max(len(pairs), 1)
            raw = [n.astype(np.uint32).tobytes(), pack(own), pack(pairs.astype(np.uint64)), pack(codes.astype(np.uint32)), planes(wc), planes(bc)]
            ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[0].as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in raw], ids], names=[x.split()[0] for x in ASK.split(", ")] + ["ids"])


def _bigrams(own: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a slice's bigrams, sorted; which bigram each is of)."""
    h = pairs_hash(own[pairs % len(own)], own[pairs // len(own)])
    order = np.argsort(h)
    return h[order], order


def _send(ranges: int):
    """What each slice (slice, own, pairs, wc, bc) asks of the ranges of hashes, one row for each."""

    def cut(h):
        return np.searchsorted((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                key, own, pairs, wc, bc = (c[k].as_py() for c in b.columns)
                own = unpack(own, np.uint64)
                bh, order = _bigrams(own, unpack(pairs, np.uint64).astype(np.int64))
                wc, bc = numbers(wc, np.uint32).reshape(4, -1), numbers(bc, np.uint32).reshape(2, -1)[:, order]
                rows, wat, bat = [], cut(own), cut(bh)
                for r in range(ranges):
                    (a, z), (c, d) = wat[r : r + 2], bat[r : r + 2]
                    if z > a or d > c:
                        rows.append((key, r, pack(own[a:z]), planes(wc[:, a:z]), pack(bh[c:d]), planes(bc[:, c:d])))
                if rows:
                    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["slice", "range", "wh", "wc", "bh", "bc"])

    return run


def _answer(batches):
    """Of one range's requests, in a row: each slice's words and bigrams with their counts over all slices."""
    at, held = None, []

    def sums(at: int, rows: int):
        """Of the hashes at ``at`` of what is held: the totals of their counts and, of each request, where its hashes stand in them."""
        names, where = np.unique(np.concatenate([unpack(x[at], np.uint64) for x in held]), return_inverse=True)
        total, begin, each = np.zeros((rows, len(names)), np.int64), 0, []
        for x in held:  # one request's counts at a time are spread out
            counts = numbers(x[at + 1], np.uint32).reshape(rows, -1).astype(np.int64)
            each.append(where[begin : begin + counts.shape[1]])
            begin += counts.shape[1]
            for t, c in zip(total, counts):
                np.add.at(t, each[-1], c)
        return total, each

    def close():
        words, w_at = sums(1, 4)
        pairs, b_at = sums(3, 2)
        stats = [int((words[1] > 0).sum()), int(words[0].sum()), int(words[1].sum())]
        for k, (x, i, j) in enumerate(zip(held, w_at, b_at)):
            cols = [[x[0]], [at], [planes(words[:, i])], [planes(pairs[:, j])], *[[s if k == 0 else 0] for s in stats]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["slice", "range", "wa", "ba", "v", "nt", "nb"])

    for b in batches:
        for s, r, *rest in zip(*(c.to_pylist() for c in b.columns)):
            if r != at and held:
                yield from close()
                held.clear()
            at = r
            held.append((s, *rest))
    if held:
        yield from close()


def _final(v: int, nt: int, nb: int, mu: float):
    """Of each slice's row and answers, in a row: (doc_id, n_words, score)."""

    def score(own, words, pairs_):
        n, ids, names = np.frombuffer(own["n"], np.uint32).astype(np.int64), own["ids"], unpack(own["own"], np.uint64)
        pairs, codes = unpack(own["pairs"], np.uint64).astype(np.int64), unpack(own["codes"], np.uint32)
        wa = np.concatenate([numbers(x, np.int64).reshape(4, -1) for x in words], axis=1)
        ba = np.concatenate([numbers(x, np.int64).reshape(2, -1) for x in pairs_], axis=1)
        a, w = pairs % len(names), pairs // len(names)
        back = np.empty(len(pairs), np.int64)
        back[_bigrams(names, pairs)[1]] = np.arange(len(pairs))
        ba = ba[:, back]
        p = lambda k, total: np.log(ba[k] + mu * (wa[k, w] + 1.0) / (total + v or 1)) - np.log(wa[2 + k, a] + mu)
        sums = np.append(0.0, np.cumsum((p(0, nt) - p(1, nb))[codes]))
        ends = np.cumsum(n)
        each = np.where(n > 0, (sums[ends] - sums[ends - n]) / np.maximum(n, 1), 0.0)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(each, pa.float64())], names=["doc_id", "n_words", "score"])

    def run(batches):
        own, words, pairs, at = None, [], [], None
        for b in batches:
            col = {name: b.column(k) for k, name in enumerate(b.schema.names)}
            for k, (s, r) in enumerate(zip(col["slice"].to_pylist(), col["range"].to_pylist())):
                if s != at and own is not None:
                    yield score(own, words, pairs)
                if s != at:
                    own, words, pairs, at = None, [], [], s
                if r < 0:
                    own = {c: col[c][k].as_py() for c in ("n", "own", "pairs", "codes")} | {"ids": col["ids"][k].values}
                else:
                    words.append(col["wa"][k].as_py())
                    pairs.append(col["ba"][k].as_py())
        if own is not None:
            yield score(own, words, pairs)

    return run


def score(docs: DataFrame, labels: DataFrame, mu: float = MU) -> DataFrame:
    """(doc_id, n_words, score) of every row of docs (doc_id, text), with labels (doc_id, quality)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(1))
    text = F.coalesce("text", F.lit("")).alias("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = max(8, -(-size // RANGE))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    rows = docs.select("doc_id", text).join(small(good, 16), "doc_id", "left").select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("target", F.lit(0)).alias("target"), "text")
    asked = settle_once(rows.mapInArrow(lean(_ask), f"{ASK}, ids array<{kind}>"), "lm-asked")
    sent = asked.select("slice", "own", "pairs", "wc", "bc").mapInArrow(lean(_send(ranges)), "slice long, range int, wh binary, wc binary, bh binary, bc binary")
    sent = sent.repartition(min(parts, ranges), "range").sortWithinPartitions("range", "slice")
    answers = settle_once(sent.mapInArrow(lean(_answer), "slice long, range int, wa binary, ba binary, v long, nt long, nb long"), "lm-answers", BATCH_BYTES)
    v, nt, nb = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "nt", "nb")]).first()
    both = asked.select("slice", F.lit(-1).alias("range"), "n", "own", "pairs", "codes", "ids").unionByName(answers.select("slice", "range", "wa", "ba"), allowMissingColumns=True)
    both = both.repartition(parts, "slice").sortWithinPartitions("slice", "range")
    out = settle_once(both.mapInArrow(lean(_final(v, nt, nb, mu)), f"doc_id {kind}, n_words long, score double"), "lm-scores", BATCH_BYTES)
    forget(asked, answers)
    return out
