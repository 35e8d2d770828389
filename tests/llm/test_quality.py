import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import boosting, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*counts, len(words) < 10 or 100 * len(covered) > 20 * len(words))


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\n\t", "a", "a b c d e a b c d e", "x x x x x x x", "l é ñ\nl é ñ\n\nl é ñ \n", "日本 # $ <b>|&", "a\x0bb\x0cc\rd e f"]
    for _ in range(60):
        line = lambda: " ".join(rng.choices(["a", "bb", "ß", "Ü#", "|", "😀", "c\t"], k=rng.randrange(0, 9)))
        out.append("\n".join(rng.choices([line(), line(), line(), line()], k=rng.randrange(1, 12))))
    return [*out, *out[:5]]


def test_counts_match_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "again")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    model = boosting.train(np.zeros((0, 8)), np.zeros(0), list(quality.FEATURES.values()))
    got = quality.judge(docs, model).collect()
    expected = sorted(((i, *brute(t), not brute(t)[-1]) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=str) == expected
    assert sorted(map(str, quality.keep_good(docs, model).collect())) == sorted(str(r) for r in docs.collect() if not brute(r.text)[-1])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs, quality.fit(docs, labels)).collect() == []


def test_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    model = boosting.train(x, y, [-1, 0, 0])
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    wavy = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) < 0.5) & (x[:, 1] > 0.2)).astype(float)  # no monotone model fits this one
    model = boosting.train(x, wavy, [-1, 0, 0])
    grid = np.repeat(rng.uniform(size=(50, 3))[:, None, :], 40, 1)
    grid[:, :, 0] = np.linspace(0, 1, 40)
    p = model.probability(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(p, axis=1) <= 1e-12).all()


def test_held_out_labels(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality.judge(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("kept", "quality", "base_failed").toPandas()
    good = rows[rows.quality == 1]
    assert good[~good.base_failed].kept.mean() > 0.99
    assert rows[rows.quality == 0].kept.mean() < 0.05


def walked(model, row):
    """A node at a time, as the trees read."""
    score = model.base
    for node in model.root:
        while model.left[node] != node:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        score += model.value[node]
    return 1 / (1 + np.exp(-score))


def plain_features(text):
    n_words, chars, symbols, dup, repeat, _ = brute(text)
    text = text or ""
    lines = max(1, sum(bool(WORD.search(x)) for x in text.split("\n")))
    words, chars = max(1, n_words), max(1, chars)
    return [n_words, chars / words, symbols / words, dup / lines, repeat / words, len(re.findall("[0-9]", text)) / chars, len(re.findall("[A-Z]", text)) / chars, words / lines]


def test_verdict_matches_a_walk_of_the_trees(spark):
    """Trained on random labels, so that trees are deep and many rows are near the edge."""
    rng = np.random.default_rng(2)
    own = [*texts(), *(" ".join(rng.choice(["a", "B1", "ccc", "#", "d\n", "4"], size=rng.integers(10, 60))) for _ in range(200))]
    x = np.array([plain_features(t) for t in own])
    model = boosting.train(x, rng.integers(0, 2, len(x)).astype(float), list(quality.FEATURES.values()), least_weight=0.2)
    assert len(model.root) == 40 and (model.left != np.arange(len(model.left))).sum() > 60
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    for i, text in enumerate(own):
        p = walked(model, plain_features(text))
        assert abs(got[i].probability - p) < 1e-9 and (abs(p - 0.5) < 1e-9 or got[i].kept == (not brute(text)[-1] and p >= 0.5))
    assert 0 < sum(r.kept for r in got.values()) < sum(not r.base_failed for r in got.values())


def test_very_long_text(spark):
    text = "same five words here now\n" * 60_000 + "#" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "z" * 500_000)], "doc_id long, text string")
    model = boosting.train(np.zeros((0, 8)), np.zeros(0), list(quality.FEATURES.values()))
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    assert (got[1].n_words, got[1].n_dup_lines, got[1].n_repeat_words, got[1].n_symbols) == (300_001, 59_999, 300_000, 100_000)
    assert (got[2].n_words, got[2].word_chars, got[2].base_failed) == (1, 500_000, True)


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS o(k) WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def test_base_columns_agree_with_sql(spark):
    import os

    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    model = boosting.train(np.zeros((0, 8)), np.zeros(0), list(quality.FEATURES.values()))
    got = quality.judge(spark.read.parquet(path), model).select("doc_id", *quality.COUNTS, "base_failed").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(BASE_SQL).fetchall())
