import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing
from lodestar.llm.queries import tokenizer_files

FILES = tokenizer_files()


PLAIN = Tokenizer.from_file(FILES["tokenizer"])
PLAIN.encode_special_tokens = True


def plain_ids(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


def check_round_trip(rows, pieces, window):
    """rows: (id, text) with distinct ids."""
    own = defaultdict(list)
    sequences = defaultdict(list)
    for p in pieces:
        own[p.doc_id].append((p.start, p.length, bytes(p.ids), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(own) == {i for i, _ in rows}
    for i, text in rows:
        ids = np.array(plain_ids(text), dtype="<u4")
        at = 0
        for start, length, got, total in sorted(own[i]):
            assert (start, total) == (at, len(ids)) and length > 0
            assert got == ids[start : start + length].tobytes()
            at += length
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, found in sequences.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or (k == len(sequences) - 1 and at <= window)


@pytest.mark.parametrize("window", [7, 2048])
def test_round_trip(spark, window):
    rng = random.Random(2)
    words = ["the", "straße", "Ünï", "日本語", "🙂", "<|endoftext|>", "1234567", "\n\n", "it's", " ", "\u0085", "Ж"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, " ".join(words * 900))]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, start int").repartition(3)
    pieces = packing.pack(docs, **FILES, window=window)
    check_round_trip(rows, pieces.collect(), window)
    got = packing.digest(packing.pack(docs, **FILES, window=window)).collect()
    assert sum(r.length for r in got) == sum(len(plain_ids(t)) for _, t in rows)
    whole = {r.doc_id: r.ids_crc32 for r in got if r.length == r.doc_tokens}
    for i, text in rows:
        assert whole.get(i) in (None, zlib.crc32(np.array(plain_ids(text), dtype="<u4").tobytes()))


def test_fast_encoder_agrees():
    rng = random.Random(4)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 0x240), rng.randrange(32, 127), 32])) for _ in range(rng.randrange(80))) for _ in range(3000)]
    for text, ids in zip(texts, packing.encode(pa.array(texts), **{"path": FILES["tokenizer"], "ranks_path": FILES["ranks"]}), strict=True):
        assert ids == PLAIN.encode(text, add_special_tokens=False).ids, text


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b c"), (1, "b c")], "doc_id long, text string")
    got = packing.pack(docs, **FILES).collect()
    assert sorted((r.doc_id or -1, r.length, r.sequence_id) for r in got) == [(-1, 2, 0), (1, 3, 0), (1, 3, 0)]
    assert sorted(r.offset for r in got) in ([0, 2, 5], [0, 3, 5], [0, 3, 6])


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), **FILES).collect() == []


def test_very_long_word(spark):
    rows = [(1, "a" * 200_000), (2, "日" * 20_000), (3, "x"), (4, "x")]
    docs = spark.createDataFrame([(*r, b"") for r in rows], "doc_id long, text string, ids binary")
    check_round_trip(rows, packing.pack(docs, **FILES).collect(), 2048)
