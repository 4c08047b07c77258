import random

import corpus_pipeline
from test_toxicity import rows
from tidemark.llm import sentencepiece_bpe
from tidemark.llm.common import BATCH, BATCH_BYTES, lean
from tidemark.llm.registry import tokenizer_path


def test_each_stage_decides(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(6))
    texts = {i: t for i, t, _ in rows(300)}
    clean = [" ".join(word() for _ in range(60)) for _ in range(6)]
    item = " ".join(word() for _ in range(14))
    special = {1000: clean[0], 1001: clean[0], 1002: clean[0] + " more", 1003: clean[1] + " " + item.upper() + " " + clean[2], 1004: clean[3] + " mail me@example.org now", 1005: None, 1006: "", 1007: clean[4] + " zwumpf krazzle zwumpf"}
    docs = [(d, t, "en", "s", len(t or "")) for d, t in (texts | special).items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, k) for i, _, k in rows(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "sentencepiece":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 1007 not in seen["toxicity"] and {1000, 1001, 1002, 1003, 1004, 1005, 1006} <= set(seen["toxicity"])
    assert set(seen["toxicity"]) - set(seen["ngram_join"]) == {1001, 1002}
    assert set(seen["ngram_join"]) - set(seen["decontamination"]) == {1003}
    assert "me@example.org" not in seen["pii"][1004].text and seen["pii"][1004].n_chars == len(seen["pii"][1004].text)
    assert set(seen["sentencepiece"]) == set(seen["pii"]) == set(seen["decontamination"])


def test_copies_between_the_two_thresholds(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(110))
    docs = spark.createDataFrame([(1, text), (2, text + "".join(f" x{i}" for i in range(22))), (3, text + "".join(f" y{i}" for i in range(40)))], "doc_id long, text string")  # Jaccard 0.83 and 0.73
    assert sorted(r.doc_id for r in corpus_pipeline.without_copies(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_a_stage_drops_what_the_tokenizer_kept_in_its_worker():
    path = tokenizer_path("piece_bpe_32k.model")
    kept = sentencepiece_bpe.codec(path)
    assert list(lean(iter, sentencepiece_bpe.OWN)([1, 2])) == [1, 2] and sentencepiece_bpe.codec(path) is kept
    assert list(lean(iter)([1, 2])) == [1, 2] and not sentencepiece_bpe._codecs


def test_stages_send_small_batches_unless_told_otherwise(spark, tmp_path):
    for asked in (None, 1 << 20):
        own = spark.newSession()
        if asked:
            own.conf.set(BATCH, str(asked))
        docs = own.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
        corpus_pipeline.token_ids(own, docs, str(tmp_path))
        assert own.conf.get(BATCH) == str(asked or BATCH_BYTES)
