import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text, vectors
from lodestar.plans.cache import SemanticCache
from lodestar.plans.config import TIERS, Limits, number, tier, whole


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "query", "hit"), [("ABCé", "abc", True), ("É", "é", False), ("a\\b", "a\\b", True), ("a~b", "A~B", True), ("axb", "a_b", True), ("a-x-b", "a%b", True), ("ab", "b%a", False), ("it's", "t's", True), ("", "", True)])
def test_like(spark, value, query, hit):
    assert one(spark, text.like_contains(F.lit(value), query)) is hit


def test_text(spark):
    assert one(spark, text.count_tokens(F.lit(" a\tb c \n"))) == 2 and one(spark, text.count_tokens(F.lit(None).cast("string"))) == 0
    assert one(spark, text.trim_space(F.lit("\t f a \x0b"))) == "f a"
    assert one(spark, text.string_list(F.lit('["a","b"]'))) == ["a", "b"] and one(spark, text.string_list(F.lit("no"))) == []
    assert one(spark, text.is_json_number(F.lit("-1.5e3"))) and not one(spark, text.is_json_number(F.lit("01")))
    hashes = {one(spark, text.content_hash(F.lit(a), F.lit(b))) for a, b in (("a", "bc"), ("ab", "c"), ("", "abc"))}
    assert len(hashes) == 3


def test_distances(spark):
    a, b = [1.0, 2.0, 2.0], [2.0, 1.0, -2.0]
    assert one(spark, vectors.euclidean(vectors.literal(a), vectors.literal(b))) == pytest.approx(18**0.5)
    assert one(spark, vectors.cosine(vectors.literal(a), vectors.literal(b))) == pytest.approx(0)
    assert one(spark, vectors.cosine(vectors.literal([0.0, 0.0]), vectors.literal([1.0, 0.0]))) == 0
    assert one(spark, vectors.euclidean(vectors.literal([1.0, 2.0, 9.0]), vectors.literal([1.0, 2.0]), same_length=False)) == 0
    assert one(spark, vectors.hamming(vectors.to_bits(vectors.literal([1.0, -1.0] * 40)), vectors.to_bits(vectors.literal([1.0] * 80)))) == 40


@pytest.mark.parametrize("scheme", list(vectors.SCHEMES))
def test_codec(spark, scheme):
    v = np.array([-6, 0.75, 0, -88.25, 12.5, 31, -0.1, 2, 64], dtype=np.float32)
    blob = vectors.encode(v, scheme)
    assert len(blob) == 5 + vectors.payload_length(scheme, len(v))
    back = vectors.decode(blob)
    if scheme == "binary":
        assert back.tolist() == [-1, 1, 1, -1, 1, 1, -1, 1, 1]
    else:
        assert np.abs(back - v).max() <= {"f32": 0, "f16": 0.05, "int8": 88.25 / 127}[scheme]
    assert list(one(spark, vectors.decoded(vectors.encoded(vectors.literal(v.tolist()), scheme)))) == back.tolist()
    with pytest.raises(ValueError):
        vectors.decode(blob[:-1])


def test_cache():
    cache = SemanticCache(2, 0.97)
    cache.put("p", (3, 4), ["r"])
    assert cache.get("p", (30, 41)) == ["r"] and cache.get("other", (3, 4)) is None and cache.get("p", (4, -3)) is None
    cache.put(1, (1,), ["a"])
    cache.put(2, (1,), ["b"])
    assert cache.get("p", (3, 4)) is None
    cache.at_version(5)
    assert cache.get(2, (1,)) is None
    assert cache.through(3, (1,), lambda: ["c"]) == ["c"] == cache.through(3, (1,), lambda: ["d"])


def test_limits():
    assert tier(0.5) == "mobile" and tier(0.5, 4) == "edge" and tier(2) == "edge" and tier(8) == "server" and tier(128) == "dc"
    assert TIERS["mobile"].k(50) == 20 and Limits().candidates(-1) == 0
    assert whole("7", 1) == whole(7, 1) == 7 and whole("x", 3) == whole(None, 3) == 3 and number("0.5", 1) == 0.5
    with pytest.raises(PermissionError):
        Limits(restricted=True).may_write()
