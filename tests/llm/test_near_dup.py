import random
import re

import pytest

from lodestar.llm.near_dup import Settings, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, pct):
    """rows: (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= pct * max(len(a), len(b)):
                if 100 * len(a & b) >= pct * len(a | b):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def got(spark, rows, pct, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in near_duplicates(df, Settings(similarity_pct=pct, **more)).collect())


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("short_list", [64, 4])
def test_matches_brute_force(spark, short_list):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 90))) for _ in range(60)]
    texts += copies(rng, rng.choices(vocabulary, k=120), 50, 6)
    texts += copies(rng, rng.choices(vocabulary, k=60), 20, 3) + [texts[3]] * 5
    texts += ["", None, "  \n\t", "one two", "ONE  two", "É é", "é é", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(spark, rows, 85, short_list=short_list, block=16) == brute(rows, 85)
    assert got(spark, rows, 80, short_list=short_list, block=16) == brute(rows, 80)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (2, None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, component_id int")
    found = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert found == sorted([(None, 2, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True)], key=str)


def test_empty(spark):
    assert got(spark, [], 85) == []


def test_test_table(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in near_duplicates(docs, Settings(similarity_pct=85)).collect()) == brute(rows, 85)


def test_one_set_of_many_ids_in_a_long_list(spark):
    """Posting lists much longer than a block, with equal sets among near ones, some of which link and some do not."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)] * 30 + copies(rng, base, 60, 14) + [" ".join(base[:40] + [f"x{k}{i}" for i in range(40)]) for k in range(10)] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(spark, rows, 80, short_list=3, block=8) == brute(rows, 80)


def test_long_text_and_word(spark):
    rng = random.Random(7)
    long = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 400_000), (4, "X" * 400_000 + "\n"), (5, long[: len(long) // 2])]
    assert [(i, c, k) for i, _, c, k in got(spark, rows, 85)] == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False), (5, 5, True)]
