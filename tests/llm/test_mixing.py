import math
import random
from collections import Counter, defaultdict

import pytest

from lodestar.llm.mixing import Settings, mix, mixed_documents


def table(spark, sizes, seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randrange(0, 40)), source, 0.5))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"), rows


def weights(totals, a):
    powers = {s: (t / sum(totals.values())) ** a for s, t in totals.items()}
    return {s: x / sum(powers.values()) for s, x in powers.items()}


def brute_exponent(totals, holds):
    grid = [k / 20000 for k in range(20001)]
    return min((a for a in grid if holds(weights(totals, a))), default=1.0)


@pytest.mark.parametrize("settings", [Settings(entropy=0.9), Settings(most_repeats=2.0), Settings(most_repeats=1.25, budget="cover"), Settings(most_repeats=3.0, budget=30_000, block_docs=16), Settings()])
def test_budgets(spark, settings):
    docs, rows = table(spark, {"big": 700, "mid": 200, "small": 60, None: 40})
    totals, sizes = Counter(), {}
    for i, text, source, _ in rows:
        totals[source] += len(text.split())
        sizes[i] = (source, len(text.split()))
    all_tokens = sum(totals.values())
    entropy = lambda w: -sum(x * math.log(x) for x in w.values())
    budget = lambda w: max(t / w[s] for s, t in totals.items()) if settings.budget == "cover" else settings.budget or all_tokens
    if settings.entropy:
        a = max(k / 20000 for k in range(20001) if entropy(weights(totals, k / 20000)) >= settings.entropy * math.log(4))
    elif settings.most_repeats:
        a = brute_exponent(totals, lambda w: max(w[s] * budget(w) / t for s, t in totals.items()) <= settings.most_repeats + 1e-9)
    else:
        a = 1.0
    w = weights(totals, a)
    got = mix(docs, settings).collect()
    spent, copies = Counter(), defaultdict(list)
    for r in got:
        assert sizes[r.doc_id] == (r.source, r.tokens) and abs(r.weight - w[r.source]) < 1e-3
        spent[r.source] += r.tokens
        copies[r.doc_id].append(r.epoch)
    for source in totals:
        assert -0.002 * all_tokens <= spent[source] - w[source] * budget(w) <= 40 + 0.002 * all_tokens
    assert all(sorted(e) == list(range(len(e))) for e in copies.values())
    for source in totals:
        n = {len(copies[i]) for i, (s, _) in sizes.items() if s == source}
        assert max(n) - min(n) <= 1
    again = Counter(r.doc_id for r in mixed_documents(docs.repartition(3), settings).collect())
    assert again == Counter({i: len(e) for i, e in copies.items()})
    assert mixed_documents(docs, settings).schema.names == docs.schema.names


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(empty, Settings(entropy=0.9)).collect() == []
    docs = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (2, "x", "b"), (2, "x", "b")], "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.source, r.epoch) for r in mix(docs).collect())
    assert got == {(1, "a", 0): 2, (None, "b", 0): 1, (2, "b", 0): 2}
