"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

A text's symbols lie in one flat numpy array for many words at once. Each round finds the lowest pair rank of every word
(a segmented minimum), merges its leftmost pairs of that rank simultaneously, and compacts the arrays; words in which no
pair remains leave. The result equals the library's priority queue:

* words are cut where no vocabulary entry spans two characters, so no merge crosses a cut;
* pairs of the lowest rank are merged together only if no merge that uses the new symbol ranks lower or equal (checked for
  every entry when the model is loaded); otherwise only the leftmost one is, as the queue would;
* in a run of overlapping pairs of one rank every second one is merged, as leftmost-first gives.

Symbols outside the vocabulary become their UTF-8 bytes (byte fallback).

Row semantics: every row is encoded by itself, repeated rows alike; a null text is empty and gives no ids; very long texts
are handled whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, give_back, lean

NONE = np.int32(2**31 - 1)
CACHE = 600_000
SPACE = "▁"

#: Codecs by path, which a worker keeps until another operator's task begins there.
OWN = "codecs"
_codecs: dict[str, Codec] = KEPT.setdefault(OWN, {})


class PairTable:
    """(left, right) -> merged symbol, an open-addressing hash table read by vectors."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(10, int(np.ceil(np.log2(max(2, len(pairs)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left, right = (np.fromiter((p[k] for p in pairs), np.int64, len(pairs)) for k in (0, 1))
        key, value = left << 32 | right, np.fromiter(pairs.values(), np.int32, len(pairs))
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[at[todo]] < 0
            first = todo[free]
            self.keys[at[first]] = key[first]  # the last of those that share a slot stays
            won = self.keys[at[todo]] == key[todo]
            self.values[at[todo[won]]] = value[todo[won]]
            todo = todo[~won]
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged symbols, -1 where the pair has none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], np.int32(-1))
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            there = self.keys[at[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        return out


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = [i for i in range(n) if sp.is_byte(i)]
        if any(sp.is_unused(i) for i in range(n)) or len(self.byte_ids) != 256 or sp.normalize("ﬁ Ａ  x") != SPACE + "ﬁ▁Ａ▁▁x":
            raise ValueError("this codec needs byte fallback, no unused pieces and the identity normaliser with a leading blank")
        symbol = {self.pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in self.pieces[i]} - set(symbol)):
            symbol[c] = len(symbol) + n  # a character that only occurs inside longer pieces
        self.n, size = n, max(symbol.values()) + 1
        score = np.zeros(size)
        score[:n] = [sp.get_score(i) for i in range(n)]
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        pairs, lowest = {}, np.full(size, NONE, np.int32)
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                    for x in (a, b):
                        lowest[x] = min(lowest[x], self.rank[i])
        self.pairs = PairTable(pairs)
        self.together = lowest > self.rank
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.spanned = np.zeros(1 << 20, bool)
        two = np.asarray(sorted({(ord(x), ord(y)) for i in normal for x, y in zip(self.pieces[i], self.pieces[i][1:], strict=False)}), np.uint32).reshape(-1, 2)
        self.spanned[self._span(two[:, 0], two[:, 1])] = True
        if any("\n" in self.pieces[i] or any(x != SPACE and y == SPACE for x, y in zip(self.pieces[i], self.pieces[i][1:], strict=False)) for i in normal):
            raise ValueError("a piece holds a line feed, or a blank after another character")
        self.text = [self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.text[i] = bytes([b])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_ids] = True
        for i in range(n):
            if sp.is_control(i):
                self.text[i] = b""
            elif sp.is_unknown(i):
                self.text[i] = sp.decode([i]).encode()
        self.digits = [str(i) for i in range(n)]
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _span(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((x.astype(np.uint64) << np.uint64(21) | y.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    # -- encoding -----------------------------------------------------------------------------------------------

    @staticmethod
    def words(text: str) -> list[str]:
        """A text's words as cache keys: a word stands for itself after one blank, or, if it starts with a line feed, for
        itself alone; further blanks before it are kept. No merge crosses from one word to the next."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
        if "" not in parts:
            return parts
        out, blanks = [], 0
        for p in parts:
            if p and (not blanks or p[0] != "\n"):
                out.append(" " * blanks + p)
                blanks = 0
            elif p:
                out += [" " * (blanks - 1), p]
                blanks = 0
            else:
                blanks += 1
        return out + [" " * (blanks - 1)] * bool(blanks)

    def encode_batch(self, texts: list) -> list[np.ndarray]:
        """The ids of each text (None: no text)."""
        split, cache = [self.words(t or "") for t in texts], self.cache
        new = list({w for ws in split for w in ws if w not in cache})
        todo = iter(new)
        while part := list(islice(todo, 20_000)):
            cache.update(zip(part, self._merge(part), strict=True))
        out = [np.frombuffer(b"".join([cache[w] for w in ws]), np.int32) for ws in split]
        if len(cache) > CACHE:
            self.cache = {}
        return out

    def _merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of int32."""
        full = [w if w[:1] == "\n" else SPACE + w.replace(" ", SPACE) for w in words]
        length = np.fromiter(map(len, full), np.int64, len(full))
        chars = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.char[chars]
        unknown = sym < 0
        sym = np.where(unknown, -1 - chars.astype(np.int64), sym).astype(np.int32)
        ends = np.cumsum(length)
        first = np.zeros(len(chars), bool)
        first[ends[:-1]] = True
        first[:1] = True
        first[1:] |= ~self.spanned[self._span(chars[:-1], chars[1:])]
        flat, keep = self._rounds(sym, first)
        left = np.add.reduceat(keep, ends - length) if len(keep) else keep
        return self._bytes(flat, left)

    def _rounds(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges within the segments that begin where ``first`` is set. Returns the symbols left over, and for each of the
        original symbols whether one that is left over begins there."""
        result, alive = sym.copy(), np.ones(len(sym), np.int64)
        where = np.arange(len(sym))
        last = np.append(first[1:], True)
        merged = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(~last)
        inner = inner[(sym[inner] >= 0) & (sym[inner + 1] >= 0)]
        merged[inner] = self.pairs.get(sym[inner], sym[inner + 1])
        while len(sym):
            rank = np.where(merged >= 0, self.rank[merged], NONE)
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            if not (low < NONE).all():  # finished segments leave
                stay = np.repeat(low < NONE, sizes)
                gone = ~stay
                result[where[gone]] = sym[gone]
                sym, first, where, merged, rank = sym[stay], first[stay], where[stay], merged[stay], rank[stay]
                if not len(sym):
                    break
                sizes, low = sizes[low < NONE], low[low < NONE]
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            segment = np.searchsorted(np.flatnonzero(first), hits, "right")
            lead = np.append(True, segment[1:] != segment[:-1])
            run = np.append(True, hits[1:] != hits[:-1] + 1) | lead
            at = np.arange(len(hits))
            even = (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0
            hits = hits[lead | (even & self.together[merged[hits]] & self._follows(lead, self.together[merged[hits]]))]
            sym[hits] = merged[hits]
            dead = np.zeros(len(sym), bool)
            dead[hits + 1] = True
            alive[where[dead]] = 0
            keep = ~dead
            moved = hits - np.searchsorted(hits, hits, "left")
            sym, first, where, merged = sym[keep], first[keep], where[keep], merged[keep]
            for i in (moved, moved[~first[moved]] - 1):
                ok = i + 1 < len(sym)
                j = i[ok]
                can = ~first[j + 1] & (sym[j] >= 0) & (sym[j + 1] >= 0)
                merged[i] = -1
                j = j[can]
                merged[j] = self.pairs.get(sym[j], sym[j + 1])
        return result[alive > 0], alive

    @staticmethod
    def _follows(lead: np.ndarray, together: np.ndarray) -> np.ndarray:
        """Whether a segment's first hit is of a kind that may be merged with others."""
        heads = np.flatnonzero(lead)
        return np.repeat(together[heads], np.diff(np.append(heads, len(lead))))

    def _bytes(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        ends = np.cumsum(counts)
        odd = (flat < 0) | (flat >= self.n)
        strange = set(np.searchsorted(ends, np.flatnonzero(odd), "right").tolist())
        raw, out, begin = flat.astype(np.int32).tobytes(), [], 0
        for k, end in enumerate(ends.tolist()):
            if k in strange:
                ids: list[int] = []
                for s in flat[begin:end].tolist():
                    if 0 <= s < self.n:
                        ids.append(s)
                    else:
                        c = chr(-1 - s) if s < 0 else chr(int(np.flatnonzero(self.char == s)[0]))
                        ids += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                out.append(np.asarray(ids, np.int32).tobytes())
            else:
                out.append(raw[begin * 4 : end * 4])
            begin = end
        return out

    # -- decoding -----------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library's decode gives it."""
        text = self.text
        raw = b"".join([text[i] for i in ids])
        if raw[:1] == b" " and self._leading_blank(ids):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_slowly(ids)

    def _leading_blank(self, ids: list[int]) -> bool:
        for i in ids:
            if self.is_byte[i]:
                return False
            if self.text[i]:
                return self.pieces[i][:1] == SPACE
        return False

    def _decode_slowly(self, ids: list[int]) -> str:
        """With bytes that are no UTF-8: each run of byte pieces by itself, each wrong byte one replacement character."""
        out, run, drop = [], bytearray(), self._leading_blank(ids)
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.text[i]
                continue
            at = 0
            while at < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + k]).decode())
                        at += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run = bytearray()
            if i is not None:
                out.append(self.text[i].decode())
        whole = "".join(out)
        return whole[1:] if drop else whole


def codec(path: str) -> Codec:
    """The codec of a model file, loaded once in each worker of a stage."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _slices(batch: pa.RecordBatch, chars: int = 1 << 20):
    """A batch in slices of about so many characters: bounds the symbol arrays."""
    texts, begin, held = batch.column(1).to_pylist(), 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or k + 1 == len(texts):
            yield batch.column(0).slice(begin, k + 1 - begin), texts[begin : k + 1]
            begin, held = k + 1, 0


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs (doc_id, text)."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for keys, texts in _slices(batch):
                yield pa.RecordBatch.from_arrays([keys, pa.array(c.encode_batch(texts), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of every row of tokens (doc_id, ids); null ids give an empty text."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded, as digests."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for keys, texts in _slices(batch):
                rows = []
                for a in c.encode_batch(texts):
                    ids = a.tolist()
                    rows.append((len(ids), hashlib.sha256(",".join([c.digits[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
                n, s, d = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(s), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            give_back()  # the merge rounds' arrays of a few MB leave gaps that add up

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, OWN), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
