"""Token ids in a content-addressed store.

Layout of a store folder (all Parquet, so any store Spark can reach will do):

* ``chunks``   one row per distinct chunk: ``digest`` (BLAKE2b-128 of the payload), ``n``, ``payload`` (little-endian
  unsigned ids of ``width`` bytes);
* ``recipes``  documents in ascending doc_id (nulls first): ``shard``, ``seq``, ``doc_id``, ``start`` (within the shard),
  ``n_tokens``, ``digests`` (its chunks in order), ``root`` (Merkle root of these);
* ``manifest`` one row per shard: documents, tokens and the Merkle root over its documents' roots. ``store_root`` folds
  the shards' roots in order.

A rolling hash over the last WINDOW ids cuts every stream where its top bits are all ones, so equal passages are cut
alike wherever they stand. A chunk has MIN to MAX ids (the last of a document may be shorter).

Row semantics: every row is a document of its own, also if doc_id or text repeat; a null text is empty; a null doc_id is
kept and sorts first; an empty table gives an empty store. Texts of any length are cut into bounded chunks. Columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, settle

WINDOW, MIN, MAX, MASK_BITS = 8, 64, 2048, 8
CACHE = 700_000
#: A stop or comma that belongs to a longer run of signs.
JOINED = r"[^\p{L}\p{N}\s][.,]"
#: A character outside Latin-1.
WIDE = r"[^\x{0}-\x{FF}]"

_state: dict = {}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, looked up by blank-separated part.

    The tokenizer's own pre-tokenisation never joins across a blank or line feed, so a text's ids are those of its parts
    in order; parts seen before come from a bounded cache. New parts that
    are plain words go to the library many to a call; each ends with the one id that closes a word.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cache = Tokenizer.from_file(path), {}
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _words(self, words: list[str]) -> None:
        """Caches lower-case words of letters only."""
        for k in range(0, len(words), 500):
            some = words[k : k + 500]
            ids = np.asarray(self._ids(" ".join(some)), self.kind)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) == len(some):
                raw = ids.tobytes()
                self.cache.update(zip(some, [raw[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                self.cache.update((w, self._bytes(self._ids(w))) for w in some)

    def _add(self, new: set[str]) -> None:
        words = [w for w in new if w.isalpha() and max(w) < "\u0130"]  # below the first letter that lower-cases to two
        self._words(words)
        hard = [w for w in new if w not in self.cache]
        for k in range(0, len(hard), 20_000):
            some = hard[k : k + 20_000]
            for w, e in zip(some, self.tok.encode_batch(some, add_special_tokens=False), strict=True):
                self.cache[w] = self._bytes(e.ids)

    @staticmethod
    def _parts(texts: pa.Array) -> pa.ListArray:
        """Each text's parts. In Latin-1 text letters are lower-cased at once, and stops and commas after a letter, digit or
        blank are cut off the word before them, as the tokenizer itself would do: fewer distinct parts."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        plain = pc.invert(pc.or_(pc.match_substring_regex(texts, WIDE), pc.match_substring(texts, "<|")))
        texts = pc.if_else(plain, pc.utf8_lower(texts), texts)
        free = pc.and_(plain, pc.invert(pc.match_substring_regex(texts, JOINED)))
        return pc.split_pattern(pc.if_else(free, pc.replace_substring(pc.replace_substring(texts, ".", " ."), ",", " ,"), texts), " ")

    def batches(self, texts: pa.Array, chars: int = 12 << 20):
        """The ids of the texts in order, as (number of texts, their ids in one array, ends of each text's ids)."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + chars, "right")))
            yield (end - begin, *self._encode(texts.slice(begin, end - begin)))
            begin = end

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = self._parts(texts)
        coded = parts.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self._add({w for w in distinct if w not in self.cache})
        raw = [self.cache[w] for w in distinct]
        if len(self.cache) > CACHE:
            self.cache = {}
        flat = np.frombuffer(b"".join(raw), self.kind)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // flat.itemsize
        n = size[codes]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()]

    def __call__(self, texts: list) -> list[np.ndarray]:
        """The ids of each text."""
        out = []
        for _, ids, ends in self.batches(pa.array(texts, pa.string())):
            out += np.split(ids, ends[:-1])
        return out


def encoder(path: str) -> Encoder:
    if ("enc", path) not in _state:
        _state["enc", path] = Encoder(path)
    return _state["enc", path]


def _gear() -> np.ndarray:
    """A 64-bit value for each id (splitmix64), the table of the rolling hash."""
    if "gear" not in _state:
        z = (np.arange(1 << 17, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        _state["gear"] = z ^ (z >> np.uint64(31))
    return _state["gear"]


def cut(ids: np.ndarray) -> list[int]:
    """Ends of a stream's chunks, by the rolling hash of the last WINDOW ids."""
    n = len(ids)
    if n <= MIN:
        return [n] if n else []
    g = _gear()[ids.astype(np.int64) & 0x1FFFF]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint64(k * 64 // WINDOW)
    at = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == np.uint64((1 << MASK_BITS) - 1)) + 1
    ends, last = [], 0
    for e in at.tolist():
        while e - last > MAX:
            last += MAX
            ends.append(last)
        if e - last >= MIN and e < n:
            ends.append(e)
            last = e
    while n - last > MAX:
        last += MAX
        ends.append(last)
    return [*ends, n]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves; an odd last node moves up unchanged."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b"\0" * 16


class RunningRoot:
    """The Merkle root of leaves that arrive one by one, in memory of the tree's height."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, hashlib.blake2b(b"\0" + leaf, digest_size=16).digest())
        while self.peaks and self.peaks[-1][0] == node[0]:
            node = (node[0] + 1, hashlib.blake2b(b"\1" + self.peaks.pop()[1] + node[1], digest_size=16).digest())
        self.peaks.append(node)

    def root(self) -> bytes:
        nodes = [x for _, x in self.peaks]
        while len(nodes) > 1:
            nodes[-2:] = [hashlib.blake2b(b"\1" + nodes[-2] + nodes[-1], digest_size=16).digest()]
        return nodes[0] if nodes else b"\0" * 16


STAGED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])


def _stage(path: str, end_id: int | None, width: int):
    """Each document's recipe, and each chunk the first time a task meets it."""

    def run(batches):
        enc, seen, kind = encoder(path), set(), f"<u{width}"
        tail = np.asarray([] if end_id is None else [end_id], enc.kind)
        for batch in batches:
            keys, done = batch.column(0).to_pylist(), 0
            for n, flat, ends in enc.batches(batch.column(1)):
                rows: list[tuple] = []
                for doc, own_ids in zip(keys[done : done + n], np.split(flat, ends[:-1]), strict=True):
                    ids = np.concatenate([own_ids, tail])
                    data, begin, own = ids.astype(kind, copy=False), 0, []
                    for end in cut(ids):
                        body = data[begin:end].tobytes()
                        key = hashlib.blake2b(body, digest_size=16).digest()
                        own.append(key)
                        if key not in seen:
                            seen.add(key)
                            rows.append((None, None, None, key, end - begin, body))
                        begin = end
                    rows.append((doc, len(ids), own, None, None, None))
                done += n
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), STAGED, strict=True)], schema=STAGED)

    return run


RECIPE = pa.schema([("kind", pa.int8()), ("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("root", pa.binary())])


def _order(batches):
    """Numbers a sorted shard's documents and closes it with a manifest row."""
    seq, start, top, shard = 0, 0, RunningRoot(), None
    for batch in batches:
        rows = []
        for shard, doc, n, digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
            root = merkle(digests)
            top.add(root)
            rows.append((0, shard, seq, doc, start, n, digests, root))
            seq, start = seq + 1, start + n
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), RECIPE, strict=True)], schema=RECIPE)
    if shard is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((1, shard, seq, None, 0, start, None, top.root()), RECIPE, strict=True)], schema=RECIPE)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, width: int = 2) -> None:
    """Encode docs (doc_id, text) and write the store to the folder ``path``. ``width``: bytes an id takes (2 or 4)."""
    staged = settle(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stage(tokenizer, end_id, width), "doc_id long, n_tokens long, digests array<binary>, digest binary, n int, payload binary"),
        "staged",
        f"{path}/staged",
    )
    staged.where("digest is not null").select("digest", "n", "payload").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    (
        staged.where("n_tokens is not null")
        .select("doc_id", "n_tokens", "digests")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "n_tokens", "digests")
        .select(F.spark_partition_id().alias("shard"), "doc_id", "n_tokens", "digests")
        .mapInArrow(_order, "kind byte, shard int, seq long, doc_id long, start long, n_tokens long, digests array<binary>, root binary")
        .write.option("compression", "zstd")
        .parquet(f"{path}/ordered")
    )
    from .common import forget

    forget(staged)


class Store:
    """A written store, read back."""

    def __init__(self, spark: SparkSession, path: str):
        ordered = spark.read.schema("kind byte, shard int, seq long, doc_id long, start long, n_tokens long, digests array<binary>, root binary").parquet(f"{path}/ordered")
        self.recipes = ordered.where("kind = 0").drop("kind")
        self.manifest = ordered.where("kind = 1").select("shard", F.col("seq").alias("n_docs"), "n_tokens", "root")
        self.chunks = spark.read.schema("digest binary, n int, payload binary").parquet(f"{path}/chunks")

    def offsets(self) -> DataFrame:
        """Where each shard starts in the whole id stream: (shard, offset). One row per shard."""
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return self.manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))

    def documents(self, width: int = 2) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32, verified) of every document, from the files alone.

        Each stored chunk is read once, held against its digest and summed up as the CRC of its ids at four bytes; a
        document's CRC is its chunks' combined in recipe order. ``verified`` is false if a chunk is missing or altered,
        or the lengths disagree.
        """
        sums = self.chunks.mapInArrow(_sum(width), "digest binary, crc long, m int")
        parts = self.recipes.select("shard", "seq", F.posexplode("digests").alias("k", "digest")).join(sums, "digest", "left")
        by_doc = parts.groupBy("shard", "seq").agg(F.sort_array(F.collect_list(F.struct("k", "crc", "m"))).alias("parts"))
        crcs = by_doc.select("shard", "seq", F.col("parts.crc").alias("crc"), F.col("parts.m").alias("m")).mapInArrow(_combine, "shard int, seq long, ids_crc32 long, found long")
        own = self.recipes.select("shard", "seq", "doc_id", "start", "n_tokens")
        return (
            own.join(crcs, ["shard", "seq"], "left")
            .join(self.offsets(), "shard")
            .select(
                "doc_id",
                (F.col("start") + F.col("offset")).alias("start"),
                "n_tokens",
                F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"),
                (F.coalesce("found", F.lit(0)) == F.col("n_tokens")).alias("verified"),
            )
        )

    def ids(self, width: int = 2) -> DataFrame:
        """(doc_id, start, ids binary: little-endian, four bytes each): whole documents rebuilt from their recipes."""
        wide = self.chunks.mapInArrow(_widen(width), "digest binary, body binary")
        parts = self.recipes.select("shard", "seq", F.posexplode("digests").alias("k", "digest")).join(wide, "digest", "left")
        by_doc = parts.groupBy("shard", "seq").agg(F.sort_array(F.collect_list(F.struct("k", "body"))).alias("p"))
        joined = by_doc.select("shard", "seq", F.aggregate("p.body", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
        return self.recipes.select("shard", "seq", "doc_id", "start").join(joined, ["shard", "seq"], "left").join(self.offsets(), "shard").select("doc_id", (F.col("start") + F.col("offset")).alias("start"), F.coalesce("ids", F.lit(b"")).alias("ids"))

    def store_root(self) -> bytes:
        """One root for the whole store: the shards' roots (one short row each) folded in order."""
        return merkle([bytes(r.root) for r in self.manifest.orderBy("shard").select("root").toLocalIterator()])


def _sum(width: int):
    def run(batches):
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            good = [hashlib.blake2b(x, digest_size=16).digest() == k for k, x in zip(keys, bodies, strict=True)]
            crcs = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4")) for x in bodies]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(crcs, pa.int64()), pa.array([len(x) // width if ok else 0 for x, ok in zip(bodies, good, strict=True)], pa.int32())], names=["digest", "crc", "m"]
            )

    return run


def _widen(width: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in batch.column(2).to_pylist()], pa.binary())], names=["digest", "body"])

    return run


def _shift_tables() -> np.ndarray:
    """For each number of ids up to MAX: what 4 zero bytes for each of them do to a CRC, as 32 columns over GF(2)."""
    if "crc" not in _state:
        one = np.asarray([zlib.crc32(b"\0\0\0\0", 1 << k) ^ zlib.crc32(b"\0\0\0\0", 0) for k in range(32)], np.uint32)
        t = np.zeros((MAX + 1, 32), np.uint32)
        t[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for n in range(1, MAX + 1):
            t[n] = _apply(np.broadcast_to(one, (32, 32)), t[n - 1])
        _state["crc"] = t
    return _state["crc"]


def _apply(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint32)
    for k in range(32):
        out ^= np.where(x >> np.uint32(k) & np.uint32(1), columns[:, k], np.uint32(0)).astype(np.uint32)
    return out


def _combine(batches):
    """CRC of each document from its chunks' CRCs and lengths, one chunk position at a time over the batch."""
    table = _shift_tables()
    for batch in batches:
        crc_lists, len_lists = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n = len(crc_lists)
        total, found = np.zeros(n, np.uint32), np.zeros(n, np.int64)
        counts = np.asarray([len(x) for x in crc_lists])
        order = np.argsort(-counts, kind="stable")
        for k in range(counts.max(initial=0)):
            live = order[: int(np.searchsorted(-counts[order], -k, side="left"))]
            c = np.asarray([crc_lists[i][k] or 0 for i in live], np.uint32)
            m = np.asarray([len_lists[i][k] or 0 for i in live], np.int64)
            total[live] = _apply(table[m], total[live]) ^ c
            found[live] += m
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total.astype(np.int64)), pa.array(found)], names=["shard", "seq", "ids_crc32", "found"])


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write docs to a store in the shared folder, read it back and return (doc_id, start, n_tokens, ids_crc32, verified)."""
    path = path or fresh_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, path, end_id)
    return Store(docs.sparkSession, path).documents()
