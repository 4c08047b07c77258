"""Toxicity by a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A text's words are cut into windows of WINDOW words, each starting STRIDE after the one before, the last ending with the text, so
all words are seen. A word's input is its hashed embedding beside the mean of its character trigrams' embeddings. Every window
passes both directions of the network and attention pooling; the text's score is that of its most toxic window.

Fitting: the driver takes a fixed sample of at most TRAIN_ROWS labelled rows and TRAIN_BYTES of text (smallest hashes of doc_id, crc32
fold not 0; the first row whatever its length) with their whole texts. Training settings were chosen on fold 1, with folds 2 to 4 learnt. A text's loss counts on its most toxic window, which is chosen anew before each epoch; the first choice, and one
component of the word embeddings to start from, are log odds of words in the sample. Seeds are fixed. The model has a fixed size
(about 2 MB) and is broadcast; scoring is one pass without a shuffle.

Row semantics: each row is scored by itself from its text alone; null or wordless text is one empty window with a constant score;
null doc_id is not held out. Labels that are null or neither 0 nor 1 are left out; of rows with equal doc_id one text is learnt;
contradictory labels of one doc_id count as the larger. Without labels of both classes all scores are the share of label 1
(smoothed). Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean

WINDOW, STRIDE = 48, 24
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, LEAST_TEXTS, BATCH = 4000, 24 << 20, 4, 8, 64
WORD_BUCKETS, CHAR_BUCKETS, WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 1 << 15, 1 << 12, 12, 8, 8, 8
_WORD = re.compile(r"\w+")


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Word strings to (bucket, trigram buckets), kept for up to ``most`` words in this process."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def ids(self, word: str):
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            padded = f"<{word}>"
            grams = np.array([zlib.crc32(padded[i : i + 3].encode("utf-8", "replace")) % CHAR_BUCKETS for i in range(max(1, len(padded) - 2))])
            got = self.known[word] = (zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS, grams)
        return got


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def starts(n: int) -> list[int]:
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    """Parameters by name; forward and backward passes over (windows, WINDOW) arrays of word numbers (-1: padding)."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        shapes = {"word": (WORD_BUCKETS, WORD_DIM), "char": (CHAR_BUCKETS, CHAR_DIM), "W": (2, d, 3 * h), "U": (2, h, 3 * h), "b": (2, 1, 3 * h), "A": (2 * h, ATTENTION), "ab": (ATTENTION,), "v": (ATTENTION,), "o": (2 * h,), "ob": (1,)}
        scale = {"word": 0.05, "char": 0.05, "W": 0.3, "U": 0.3, "A": 0.3, "v": 0.3, "o": 0.5}
        self.p = {k: (g.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def vectors(self, words: list) -> np.ndarray:
        """Input vectors of (bucket, trigrams) pairs."""
        if not words:
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        flat, at = np.concatenate([g for _, g in words]), np.cumsum([0] + [len(g) for _, g in words])
        chars = np.add.reduceat(self.p["char"][flat], at[:-1], axis=0) / np.diff(at)[:, None]
        return np.concatenate([self.p["word"][[w for w, _ in words]], chars], axis=1).astype(np.float32)

    def forward(self, vec: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; vec holds the vectors of the distinct words, at (B, T) points into it. keep: also what backward needs."""
        p, h = self.p, HIDDEN
        B, T = at.shape
        mask = (at >= 0).astype(np.float32)
        table = np.matmul(vec[None], p["W"]) + p["b"]
        table = np.concatenate([table, np.zeros((2, 1, 3 * h), np.float32)], axis=1)
        order = np.stack([at, at[:, ::-1]])
        state, states, saved = np.zeros((2, B, h), np.float32), np.empty((2, B, T, h), np.float32), []
        for t in range(T):
            x = np.stack([table[0][order[0, :, t]], table[1][order[1, :, t]]])
            m = np.stack([mask[:, t], mask[:, T - 1 - t]])[..., None]
            u = np.matmul(state, p["U"])
            zr = _sigmoid(x[..., : 2 * h] + u[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * u[..., 2 * h :])
            new = state + m * ((1 - z) * (n - state))
            if keep:
                saved.append((state, z, r, n, u[..., 2 * h :], m))
            state = new
            states[:, :, t] = new
        both = np.concatenate([states[0], states[1][:, ::-1]], axis=2)
        act = np.tanh(both @ p["A"] + p["ab"])
        e = np.where(mask > 0, act @ p["v"], -1e9)
        w = np.exp(e - e.max(1, keepdims=True)) * mask
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,btk->bk", w, both)
        logit = pooled @ p["o"] + p["ob"][0]
        return (logit, (vec, at, order, saved, both, act, w, pooled)) if keep else logit

    def backward(self, dlogit: np.ndarray, kept) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters after the inputs, and of vec."""
        p, h = self.p, HIDDEN
        vec, at, order, saved, both, act, w, pooled = kept
        B, T = at.shape
        g = {"o": pooled.T @ dlogit, "ob": np.array([dlogit.sum()])}
        dpool = dlogit[:, None] * p["o"]
        dboth = w[..., None] * dpool[:, None]
        dw = np.einsum("bk,btk->bt", dpool, both)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        dact = de[..., None] * p["v"] * (1 - act**2)
        g["v"], g["ab"] = np.einsum("bt,btk->k", de, act), dact.sum((0, 1))
        g["A"] = both.reshape(-1, 2 * h).T @ dact.reshape(-1, ATTENTION)
        dboth = dboth + dact @ p["A"].T
        dstates = np.stack([dboth[..., :h], dboth[:, ::-1, h:]])
        dtable, dU = np.zeros((2, len(vec) + 1, 3 * h), np.float32), np.zeros_like(p["U"])
        d = np.zeros((2, B, h), np.float32)
        for t in reversed(range(T)):
            state, z, r, n, un, m = saved[t]
            d = d + dstates[:, :, t]
            dn, dz = m * d * (1 - z) * (1 - n**2), m * d * (state - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], axis=2)
            dx = np.concatenate([dz, dr, dn], axis=2)
            dU += np.matmul(state.transpose(0, 2, 1), du)
            for k in (0, 1):
                np.add.at(dtable[k], order[k, :, t], dx[k])
            d = d * (1 - m * (1 - z)) + np.matmul(du, p["U"].transpose(0, 2, 1))
        dtable = dtable[:, :-1]
        g["U"], g["b"] = dU, dtable.sum(1, keepdims=True)
        g["W"] = np.matmul(vec.T[None], dtable)
        return g, np.matmul(dtable, p["W"].transpose(0, 2, 1)).sum(0)


def _index(token_ids: list[int]) -> np.ndarray:
    """(windows, WINDOW) of one text's word numbers."""
    n = len(token_ids)
    if n <= WINDOW:
        return np.array([token_ids + [-1] * (WINDOW - n)], np.int32)
    return np.array(token_ids, np.int32)[np.array(starts(n))[:, None] + np.arange(WINDOW)]


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 7, least: int = LEAST_TEXTS) -> Network:
    net, rng, seen = Network(seed), np.random.default_rng(seed), Vocabulary()
    y = np.array(labels, np.float32)
    share = (y.sum() + 1) / (len(y) + 2)
    net.p["ob"][:] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        net.p["o"][:] = 0
        return net
    number: dict[str, int] = {}
    windows = [_index([number.setdefault(w, len(number)) for w in words_of(t)]) for t in texts]
    words = [seen.ids(w) for w in number]
    bucket = np.array([b for b, _ in words], np.int64)
    with_word = np.zeros((2, WORD_BUCKETS), np.float32)
    for a, k in zip(windows, labels):
        with_word[k, np.unique(bucket[a[a >= 0]])] += 1
    odds = np.log((with_word[1] + 0.3) / (y.sum() + 1)) - np.log((with_word[0] + 0.3 * (1 - share) / share) / (len(y) - y.sum() + 1))
    odds = np.where(with_word.sum(0) >= least, odds, 0)
    net.p["word"][:, 0] = np.clip(odds, -3, 6) / 2
    word_odds = np.append(odds[bucket], -9)
    pick = [a[np.argmax(word_odds[a].max(1))] for a in windows]
    first, second = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch >= 2:
            pick = [a[i] for a, i in zip(windows, _best(net, words, windows))]
        deal = rng.permutation(len(y))
        rate = 0.01 * (1 - epoch / epochs)
        for lo in range(0, len(deal), BATCH):
            docs = deal[lo : lo + BATCH]
            used, at = np.unique(np.stack([pick[i] for i in docs]), return_inverse=True)
            pad = int(len(used) > 0 and used[0] < 0)
            some = [words[i] for i in used[pad:]]
            vec = net.vectors(some)
            logit, kept = net.forward(vec, at.reshape(len(docs), WINDOW) - pad, True)
            g, dvec = net.backward((_sigmoid(logit) - y[docs]) / len(docs), kept)
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            if some:
                np.add.at(g["word"], [b for b, _ in some], dvec[:, :WORD_DIM])
                sizes = np.array([len(c) for _, c in some])
                np.add.at(g["char"], np.concatenate([c for _, c in some]), np.repeat(dvec[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, grad in g.items():
                first[k] += 0.1 * (grad - first[k])
                second[k] += 0.01 * (grad * grad - second[k])
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def _best(net: Network, words: list, windows: list[np.ndarray], chunk: int = 2048) -> list[int]:
    """Each text's most toxic window; the words' vectors are made for one chunk of windows at a time."""
    flat, logit = np.concatenate(windows), []
    for i in range(0, len(flat), chunk):
        used, at = np.unique(flat[i : i + chunk], return_inverse=True)
        pad = int(used[0] < 0)
        logit.append(net.forward(net.vectors([words[k] for k in used[pad:]]), at.reshape(-1, WINDOW) - pad))
    logit = np.concatenate(logit)
    at = np.cumsum([0] + [len(a) for a in windows])
    return [int(np.argmax(logit[a:z])) for a, z in zip(at, at[1:])]


def scores(net: Network, texts: Iterator[str | None], seen: Vocabulary, chunk: int = 1024) -> np.ndarray:
    """Scores of whole texts; at most ``chunk`` windows, of whatever texts, are in memory as states at a time."""
    number, words, best, queue, owner = {}, [], [], [], []

    def run():
        nonlocal number, words, queue, owner
        logit = net.forward(net.vectors(words), np.concatenate(queue))
        np.maximum.at(tops, np.concatenate(owner), logit)
        number, words, queue, owner = {}, [], [], []

    texts = list(texts)
    tops = np.full(len(texts), -np.inf, np.float64)
    waiting = 0
    for i, text in enumerate(texts):
        tokens = words_of(text)
        at = starts(len(tokens))
        for lo in range(0, len(at), chunk):
            some = at[lo : lo + chunk]
            ids = []
            for w in tokens[some[0] : some[-1] + WINDOW]:
                k = number.get(w)
                if k is None:
                    k = number[w] = len(words)
                    words.append(seen.ids(w))
                ids.append(k)
            ids += [-1] * (WINDOW - len(ids))
            queue.append(np.array(ids)[np.array(some)[:, None] - some[0] + np.arange(WINDOW)])
            owner.append(np.full(len(some), i))
            waiting += len(some)
            if waiting >= chunk:
                run()
                waiting = 0
    if queue:
        run()
    return _sigmoid(tops)


def held_out(doc_id):
    """True where crc32 of doc_id as text is 0 mod 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Network:
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    size = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("_size", size).where((F.col("_size") <= TRAIN_BYTES) | (F.col("_size") == F.octet_length("text"))).drop("_size").toPandas().sort_values("doc_id")
    return fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist())


def score(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(net or learn(docs, labels))

    def run(batches):
        seen = Vocabulary()
        for b in batches:
            out = b.drop(columns="_text")
            for lo in range(0, len(b), 256):
                yield out.iloc[lo : lo + 256].assign(score=scores(model.value, b["_text"].iloc[lo : lo + 256], seen))

    # ids go through pandas as text: it would make long ids of a batch with nulls inexact
    packed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    out = packed.mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """docs, all columns, without the rows predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(net or learn(docs, labels))

    def score_all(texts):
        seen = Vocabulary()
        for t in texts:
            yield pd.Series(np.concatenate([scores(model.value, t.iloc[lo : lo + 256], seen) for lo in range(0, len(t), 256)] or [np.empty(0)]))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(score_all)(texts)

    return docs.where(F.pandas_udf(run, "double")(F.coalesce("text", F.lit(""))) < 0.5)
