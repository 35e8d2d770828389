import random
import re

import pytest

from lodestar.operators import chunking

WHITE = " \t\n\x0b\f\r"


def model(text, size, overlap):
    size = max(1, size)
    stride = size - min(overlap, size - 1)
    spans = [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]
    out, i = [], 0
    while spans:
        part = spans[i : i + size]
        out.append((len(out), text[part[0][0] : part[-1][1]], len(part)))
        if i + size >= len(spans):
            break
        i += stride
    return out


@pytest.mark.parametrize(("size", "overlap"), [(3, 1), (10, 2), (0, 0), (4, 9), (200, 40)])
def test_window(spark, size, overlap):
    rng = random.Random(size)
    texts = ["k l m n o p q", "rain falls on stone", "", "\t \n \x0c", None, " u v  w\x0bx "] + ["".join(rng.choices("ab é\t\n\x0c🙂", k=rng.randrange(600))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in chunking.chunk_window(df, size=size, overlap=overlap).collect():
        got.setdefault(r.id, []).append((r.ordinal, r.content, r.token_count))
    assert {i: sorted(v) for i, v in got.items()} == {i: m for i, t in enumerate(texts) if (m := model(t, size, overlap))}


def contents(text, size, overlap):
    return [(c["content"], c["token_count"]) for c in chunking.recursive(text, size, overlap)]


def test_recursive():
    assert [c for c, _ in contents("red fox\n\nold oak\n\nwet sand", 2, 0)] == ["red fox", "old oak", "wet sand"]
    assert [c for c, _ in contents("we sail at dawn. they row by night", 4, 0)] == ["we sail at dawn", "they row by night"]
    assert [n for _, n in contents("p\nq\nr\ns\nt\nu\nv", 3, 0)] == [3, 3, 1]
    assert contents(None, 3, 0) == contents(" \n", 3, 0) == []
    assert contents("p\nq\nr\ns\nt", 4, 2) == [("p\nq\nr\ns", 4), ("r\ns\nt", 3)]


def plain_pieces(text, size, level=0):
    text = text.strip(WHITE)
    if not text or level == 4 or len(re.findall(r"[^ \t\n\x0b\f\r]+", text)) <= size:
        return [text] if text else []
    return [p for part in text.split(("\n\n", "\n", ". ", " ")[level]) for p in plain_pieces(part, size, level + 1)]


def test_recursive_against_a_plain_version():
    """Every choice of first and last piece is tried for each chunk."""
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choices(["a", "bb", ".", " ", "\n", "\n\n", ". ", "ccc "], k=rng.randrange(100)))
        size = rng.randrange(1, 9)
        overlap = rng.randrange(size)
        pieces = plain_pieces(text, size)
        n = [len(p.split()) for p in pieces]
        want, first = [], 0
        while first < len(pieces):
            last = max([e for e in range(first + 1, len(pieces) + 1) if sum(n[first:e]) <= size], default=first + 1)
            want.append((pieces[first], pieces[last - 1], sum(n[first:last])))
            first = len(pieces) if last == len(pieces) else min(b for b in range(first + 1, last + 1) if sum(n[b:last]) <= overlap or b == last)
        got = contents(text, size, overlap)
        assert [c for _, c in got] == [c for *_, c in want]
        assert all(g.startswith(a) and g.endswith(b) and g in text for (g, _), (a, b, _) in zip(got, want, strict=True))


def test_recursive_properties():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices(["a", "bb", " ", "\n", "\n\n", ". ", "ccc "], k=rng.randrange(120)))
        size = rng.randrange(1, 9)
        chunks = chunking.recursive(text, size, rng.randrange(size))
        assert [c["ordinal"] for c in chunks] == list(range(len(chunks)))
        assert all(c["content"] in text and 0 < c["token_count"] <= size for c in chunks)


def test_parent_child(spark):
    text = "\n\n".join(f"p{i} " + " ".join("abcdefghij"[:7]) for i in range(12))
    df = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    rows = sorted(chunking.chunk_parent_child(df, parent_size=16, child_size=5, child_overlap=2).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(len(rows))) and {r.id for r in rows} == {1}
    assert all(r.content in r.parent_content and r.parent_content in text and r.token_count <= 5 for r in rows)
