"""SentencePiece coding and the token store, against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

ODD = [None, "", " ", "  ", "\n", " \n", "\na", " a  b\n c ", "é中文字", "▁x ▁", "\x00y\tz\r\n <s> <unk> <0x0A>", "a" * 300, "👍🏽 ok", "in ininin", "x" * 50_000 + " " + "ab" * 20_000]


def _texts(n=300):
    rng = random.Random(4)
    alphabet = "abcde  \n\nthe and ▁éß中👍.,-=01\t'\"(){}"
    return [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(n))]


def test_codec_equals_library():
    import sentencepiece

    from tidemark.llm.sentencepiece_bpe import codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, c, texts = sentencepiece.SentencePieceProcessor(model_file=path), codec(path), _texts()
    got = [a.tolist() for a in c.encode_batch(texts)]
    assert got == [sp.encode(t or "") for t in texts]
    assert [c.decode(x) for x in got] == [sp.decode(x) for x in got]
    rng = random.Random(7)
    for _ in range(500):  # any ids, also bytes that are no UTF-8
        ids = [rng.choice((rng.randint(0, 300), rng.randint(0, 31_999))) for _ in range(rng.randint(0, 9))]
        assert c.decode(ids) == sp.decode(ids)


def _docs(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "no id", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_digest_query(spark):
    import sentencepiece

    from tidemark.llm.sentencepiece_bpe import decode, digests, encode

    path, texts = public_tokenizers.path("piece_bpe_32k.model"), _texts(40)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = _docs(spark, texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in [*enumerate(texts), (3, texts[3]), (None, "no id")]:
        ids = sp.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in digests(docs, path).collect()), key=key) == sorted(want, key=key)
    assert digests(docs.limit(0), path).count() == 0
    back = {r.doc_id: r.text for r in decode(encode(docs, path), path).collect()}
    assert all(back[i] == sp.decode(sp.encode(t or "")) for i, t in enumerate(texts))


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm.token_store import Store, merkle, token_store, write

    path, texts = public_tokenizers.path("word_bpe_49k.json"), _texts(60)
    tok = Tokenizer.from_file(path)
    docs = _docs(spark, [*texts, "<|endoftext|> x", *[" ".join(map(str, range(9_000)))] * 3])
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    start, want = 0, []
    for i in [None, 0, 1, 2, 3, 3, *range(4, len(ids) - 1)]:
        raw = np.asarray(ids[i], "<u4").tobytes()
        want.append((i, start, len(ids[i]), zlib.crc32(raw)))
        start += len(ids[i])
    got = token_store(docs, path).collect()
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == want
    assert all(r.verified for r in got)
    write(docs, path, f"file://{tmp_path}/s")
    store = Store(spark, f"file://{tmp_path}/s")
    for r in store.ids().collect():
        assert bytes(r.ids) == np.asarray(ids[r.doc_id], "<u4").tobytes()
    long = [r for r in store.recipes.collect() if r.n_tokens > 5_000]
    assert len(long) >= 3 and len({bytes(r.root) for r in long[-3:]}) == 1 and bytes(long[-1].root) == merkle([bytes(x) for x in long[-1].digests])
    assert store.chunks.count() == store.chunks.select("digest").distinct().count()
    assert len(store.store_root()) == 16
    assert token_store(docs.limit(0), path).count() == 0


def test_altered_chunk_is_found(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.llm.token_store import Store, write

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "some words"), (2, "other words here")], "doc_id long, text string")
    write(docs, path, f"file://{tmp_path}/s")
    store = Store(spark, f"file://{tmp_path}/s")
    store.chunks = store.chunks.withColumn("payload", F.when(F.col("n") == 3, F.lit(b"\x01\x00\x02\x00\x02\x00")).otherwise(F.col("payload")))
    assert {r.doc_id: r.verified for r in store.documents().collect()} == {1: False, 2: True}


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    from tidemark.llm.token_store import encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), encoder(path)
    texts = [*_texts(), "It's they'll İstanbul, ÀÉ. ét. ... a.. b., x.y Σας ΟΔΟΣ. ǅ, ß! 12. 1a, don't.", "Thble, thble. THBLE\u0085x\x1cy z　w <|startoftext|>a.", "ÿ. µ, a_. ...x", "１. ½, ² ."]
    assert [x.tolist() for x in enc(texts)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
