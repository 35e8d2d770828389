import random
import zlib

import numpy as np
import pytest

from lodestar.llm import language
from lodestar.llm.language import Settings


def brute_symbols(text):
    out = []
    for c in text or "":
        if c.isalpha():
            low = c.lower()
            out.append(low if len(low) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out)


def brute_phrases(sample, text):
    n = at = 0
    while at < len(text):
        length = 1
        while at + length <= len(text) and text[at : at + length] in sample:
            length += 1
        at += max(1, length - 1)
        n += 1
    return n


def test_phrases_match_brute_force():
    rng = random.Random(3)
    words = {"aa": ["la", "él", "maison", "ou"], "bb": ["the", "house", "of", "that"]}
    samples = {k: " ".join(rng.choices(v, k=200)) for k, v in words.items()}
    model = language.build(samples)
    texts = [" ".join(rng.choices(words["aa"] + words["bb"] + ["Ж", "42", "?!", "ÉL"], k=rng.randrange(0, 40))) for _ in range(50)]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, cut = language.symbols(np.frombuffer(data, np.uint8), bounds)
    got = language.phrases(model, found, cut, 10**6)
    plain = {k: brute_symbols(v) for k, v in samples.items()}
    for i, text in enumerate(texts):
        own = brute_symbols(text)
        assert cut[i + 1] - cut[i] == len(own)
        for k, lang in enumerate(model.languages):
            assert got[i, k] == brute_phrases(plain[lang], own)


@pytest.mark.parametrize("block", [Settings().block, 1, 7])
def test_phrases_do_not_depend_on_blocks(block):
    """Texts longer than a block, some that repeat a letter or the sample so that guesses of states stay wrong."""
    rng = random.Random(5)
    words = ["la", "él", "maison", "ou", "the", "house"]
    samples = {"aa": " ".join(rng.choices(words[:4], k=300)), "bb": "a" * 37 + " " + " ".join(rng.choices(words[2:], k=300))}
    model = language.build(samples)
    plain = {k: brute_symbols(v) for k, v in samples.items()}
    long = 5 if block > 100 else 1
    texts = ["a" * 1000 * long, "", samples["aa"] * long, " ".join(rng.choices(words, k=900 * long)), "x", "ma" * 500 * long, "42"]
    data = "".join(texts).encode()
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, cut = language.symbols(np.frombuffer(data, np.uint8), bounds)
    got = language.phrases(model, found, cut, block)
    for i, text in enumerate(texts):
        assert [got[i, k] for k in range(2)] == [brute_phrases(plain[lang], brute_symbols(text)) for lang in model.languages]


def test_learns_from_whole_rows(spark):
    """The sample is made of whole texts: what only the end of a text tells is learned, and a language whose texts are all long is too."""
    rows = [(i, f"{'und so weiter ' * 9} ende{'xyz'[i % 3]}", "de") for i in range(40)] + [(i, "je ne sais pas " * 900, "fr") for i in range(40, 60)] + [(i, "ok", "fr") for i in range(60, 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, Settings(sample_chars=6000))
    assert model.languages == ["de", "fr"]
    asked = spark.createDataFrame([(0, "endex endey"), (1, "je ne sais pas")], "doc_id long, text string")
    assert {(r.doc_id, r.lang_pred) for r in language.predict(asked, model).collect()} == {(0, "de"), (1, "fr")}
    lone = language.fit(docs.filter("lang = 'fr' and doc_id < 60"), Settings(sample_chars=6000))
    assert lone.languages == ["fr"] and lone.bits[0] > np.log2(13_000)


def test_edge_cases(spark):
    rows = [(0, "the house of that", "en"), (1, "la maison ou la", "fr"), (2, None, "en"), (3, "", None), (4, "123 !?", "fr"), (5, "the that", None), (5, "the that", None), (None, "maison", "fr"), (6, "the " * 30_000, "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in language.predict(docs, language.build({"en": "the house of that", "fr": "la maison ou la"})).collect()}
    assert got == {(0, "en"), (1, "fr"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (None, "fr"), (6, "en")}
    empty = docs.limit(0)
    assert language.predict(empty, language.fit(empty)).collect() == []
    assert {r.lang_pred for r in language.predict(docs, language.fit(empty)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    import os

    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(path)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [truth[r.doc_id] == r.lang_pred for r in got if r.held_out]
    print(sum(held) / len(held))
    assert sum(held) / len(held) > 0.97
