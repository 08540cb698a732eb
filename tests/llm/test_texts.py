"""Encoding, packing and skeletons against the public tokenizer, invariants and stated cases."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from massloom.llm import encode as enc
from massloom.llm.pack import CAPACITY, OpenBins, pack
from massloom.llm.skeleton import LOOK_ALIKES, same_look_classes, same_look_pairs, skeleton, skeletons, with_skeleton

VOCABULARY = Path(enc.TOKENIZER_DIR, "byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "   \n\n  a", "Hello world's 12345  x", "naïve café é 🙂👩‍👧", "<|endoftext|> is text", "Σ" * 700, "x" * 5000,
    "  b 　c\u0085d\u001ce", "日本語の要約 नमस्ते مرحبا", "they're we'll I'd 'S 's", "tab\t\tend \r\n", "a" + " " * 300 + "b", "﻿​",
]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, n int, words string")


def exact(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    return {i: e.ids for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizer files here")
@pytest.mark.parametrize(("rows", "words", "frequent"), [(enc.SLICE, enc.SLICE_WORDS, enc.FREQUENT), (3, enc.SLICE_WORDS, 2), (enc.SLICE, 4, 0)])
def test_ids_equal_the_tokenizer(spark, monkeypatch, rows, words, frequent):
    monkeypatch.setattr(enc, "SLICE", rows)  # 3: several slices in a task, some without a word
    monkeypatch.setattr(enc, "SLICE_WORDS", words)  # 4: most texts are longer than a slice
    monkeypatch.setattr(enc, "FREQUENT", frequent)
    texts = TEXTS + ["the same words again and again the same words", TEXTS[4]]
    got = {r["doc_id"]: list(r["ids"]) for r in enc.encode_texts(documents(spark, texts), "doc_id", "text").collect()}
    assert got == exact(texts)


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizer files here")
def test_round_trip_repeats_and_empty(spark):
    docs = documents(spark, TEXTS)
    back = {r["doc_id"]: r["text"] for r in enc.decode_ids(enc.encode_texts(docs, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert enc.encode_texts(docs.limit(0), "doc_id", "text").count() == 0
    assert enc.encode_texts(docs.unionAll(docs), "doc_id", "text").count() == 2 * len(TEXTS)


def test_words_join_to_the_text(spark):
    rows = documents(spark, TEXTS).select("text", F.array_join(enc.split_words(F.col("text")), "").alias("again")).collect()
    assert all((r["text"] or "") == r["again"] for r in rows)


def check_layout(rows, sizes):
    used, parts = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        if r["container"] is None:
            assert r["length"] == 0
        else:
            used[r["container"]] = used.get(r["container"], 0) + r["length"]
    assert set(parts) == set(sizes) and max(used.values()) <= CAPACITY
    for k, n in sizes.items():
        own = sorted(parts[k])
        assert sum(length for _, length in own) == (n or 0) and len(own) == max(1, -(-(n or 0) // CAPACITY))
        assert all(a + length == b for (a, length), (b, _) in zip(own, own[1:], strict=False))
    return sum(used.values()) / (len(used) * CAPACITY)


def test_packing(spark, monkeypatch):
    rng = random.Random(2)
    sizes = {i: rng.choice([rng.randint(1, 600), rng.randint(1, 2048), 2048, 0]) for i in range(3000)} | {9000: 2049, 9001: 6000, 9002: None, 9003: 4096}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "doc_id long, n int, start int")
    assert check_layout(pack(df, "doc_id", "n").collect(), sizes) > 0.97
    monkeypatch.setattr("massloom.llm.pack.ITEMS_PER_TASK", 400)  # several tasks: what they leave open is laid together
    assert check_layout(pack(df, "doc_id", "n").collect(), sizes) > 0.9
    assert pack(df.limit(0), "doc_id", "n").count() == 0


def test_open_bins_best_fit():
    bins = OpenBins(10, 2, 0)
    assert [bins.place(s) for s in (6, 7, 3, 4, 9)] == [0, 1, 1, 0, 2]
    bins = OpenBins(10, 2, 0)
    assert [bins.place(s) for s in (6, 7, 8, 4, 3)] == [0, 1, 2, 0, 3]  # the fullest (of 7) closed for the third
    assert sum(bins.open_bins().values()) == 8 + 3


SAME = [
    ("ｆｕｌｌ　ｗｉｄｔｈ．", "full width."), ("café", "café"), ("ze​ro wid⁠th", "zero width"), ("no break thin", "no break thin"),
    ("Мoscоw раs", "Moscow pas"), ("Ζοο ν", "Zoo v"), ("line\r\nend", "line\nend"), ("so­ft", "soft"), ("ї", "ї"), ("Å", "Å"), ("ό", "о́"),
]
DIFFERENT = [("cafe", "café"), ("Case", "case"), ("x2", "x²"), ("1", "①"), ("a-b", "a–b"), ("a b", "a  b"), ("0", "O"), ("end.", "end"), ("Ł", "L"), ("ß", "ss")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert skeleton(a) == skeleton(b) and skeletons([a, b])[0] == skeletons([a, b])[1] == skeleton(a)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(a, b):
    assert skeleton(a) != skeleton(b)


PROTOTYPES = {"𝐀": "A", "ℂ": "C", "ℓ": "l", "Ⅰ": "I", "ⅳ": "iv", "Ꭺ": "A", "ι": "i", "υ": "u", "γ": "y", "σ": "o", "ɑ": "a", "ɡ": "g", "ı": "i", "ѵ": "v", "ո": "n", "ս": "u", "ց": "g",
              "հ": "h", "Ϲ": "C", "Ϳ": "J", "𝟎": "0", "𝛂": "a", "ꓐ": "B", "ﬁ": "fi"}


def test_prototypes():
    assert {c: skeleton(c) for c in PROTOTYPES} == PROTOTYPES and len(LOOK_ALIKES) < 200
    assert [skeleton(c) for c in "²ª①₂☎"] == list("²ª①₂☎") and skeleton("a\U000e0061b") == "ab"


def test_same_look_classes(spark):
    texts = ["a b", "a b", "а b", None, "", " ", "other", "A b"]
    docs = documents(spark, texts)
    got = sorted(map(tuple, same_look_classes(docs, "doc_id", "text").collect()))
    assert got == [(0, 0, 3, 2), (1, 0, 3, 2), (2, 0, 3, 2), (6, 6, 1, 1), (7, 7, 1, 1)]
    assert same_look_classes(docs.limit(0), "doc_id", "text").count() == 0


def test_same_look_pairs(spark):
    texts = ["a b", "a b", "a b", "а b", None, "", " ", "​", "A b", "alone"]
    got = sorted(map(tuple, same_look_pairs(documents(spark, texts), "doc_id", "text").collect()))
    forms = {i: t for i, t in enumerate(texts) if i in (0, 1, 2, 3)}
    assert got == sorted((i, j) for i in forms for j in forms if i < j and forms[i] != forms[j])
    assert same_look_pairs(documents(spark, texts).limit(0), "doc_id", "text").count() == 0
    forms = {r["doc_id"]: r["skeleton"] for r in with_skeleton(documents(spark, texts), "doc_id", "text").collect()}
    assert forms[4] is None and forms[5] == "" and forms[1] == "a b"
