import random
import re

import pytest

from lodestar.llm import url_filters
from lodestar.llm.url_filters import evaluate

DAY = 86_400


def brute(captures, entries):
    out = []
    for i, url, at in captures:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*([^?#]*)", url or "")
        keys = set()
        if m:
            labels = m[1].lower().rstrip(".").split(".")
            keys = {"domain:" + ".".join(labels[k:]) for k in range(len(labels))}
            parts = [p for p in m[2].split("/") if p]
            keys |= {"prefix:" + ".".join(labels) + "/" + "/".join(parts[: k + 1]) for k in range(len(parts))}
        n = 0
        for key in keys:
            past = [(t, listed) for a, listed, t in entries if a == key and t is not None and at is not None and t <= at]
            n += bool(past) and max(past)[1]
        out.append((i, at, n, n > 0))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.org", "www.x.org"]
    entries = [(f"{k}{h}", rng.random() < 0.6, rng.randrange(0, 900 * DAY)) for h in hosts for k in ("domain:",) for _ in range(12)]
    entries += [(f"prefix:{h}/{p}", rng.random() < 0.7, rng.randrange(0, 900 * DAY)) for h in hosts for p in ("a", "a/b") for _ in range(4)]
    entries += [("domain:x.org", True, 5 * DAY), ("domain:x.org", False, 5 * DAY), (None, True, 1), ("domain:com", True, None)]
    urls = [f"https://{h}{p}" for h in hosts for p in ("", "/", "/a", "/a/b?x=1", "/ab", "/a//b#f", ":80/a")] + ["HTTP://u:p@A.Example.COM./a", None, "", "nonsense", "//x.org"]
    captures = [(i, rng.choice(urls), rng.choice([None, rng.randrange(-5 * DAY, 1000 * DAY), 5 * DAY])) for i in range(400)]
    captures += [(3, urls[0], 7 * DAY)] * 2 + [(None, urls[1], 700 * DAY), (9, "http://x.org/" + "s/" * 300, 800 * DAY)]
    c = spark.createDataFrame([(*r, 1) for r in captures], "page_id long, url string, fetched_at long, blocked int")
    e = spark.createDataFrame(entries, "address string, listed boolean, at long")
    assert sorted(map(tuple, evaluate(c, e).collect()), key=str) == brute(captures, entries)
    assert evaluate(c.limit(0), e).collect() == []
    assert not any(r.blocked for r in evaluate(c, e.limit(0)).collect())


@pytest.mark.parametrize(("slices", "often"), [(0, 5), (30, 5), (0, 10**6)])
def test_shuffle_matches_brute_force(spark, monkeypatch, slices, often):
    """Beyond the broadcast bound, with and without addresses that are asked for often."""
    monkeypatch.setattr(url_filters, "BROADCAST_SLICES", slices)
    monkeypatch.setattr(url_filters, "MOST_OFTEN", often)
    rng = random.Random(8)
    entries = [(f"domain:{h}", rng.random() < 0.7, rng.randrange(0, 300 * DAY)) for h in ("com", "a.com", "b.com", "h3.com") for _ in range(5)]
    captures = [(i, f"https://h{i % 90}.com/x" if i % 3 else "https://a.com", rng.randrange(0, 400 * DAY)) for i in range(300)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at long")
    e = spark.createDataFrame(entries, "address string, listed boolean, at long")
    assert sorted(map(tuple, evaluate(c, e).collect()), key=str) == brute(captures, entries)


def test_times_far_off(spark):
    far = [1_704_067_200_000_000, 2**63 - 1, -(2**63), 0]
    entries = [("domain:x.org", True, 10 * DAY), ("domain:x.org", False, 60 * DAY), ("domain:y.org", True, -90 * DAY), ("domain:z.org", True, 50 * DAY)]
    captures = [(i, f"http://{h}/", at) for i, (h, at) in enumerate((h, at) for h in ("x.org", "y.org", "z.org") for at in [*far, 9 * DAY, 20 * DAY, 70 * DAY, 2000 * DAY])]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at long")
    e = spark.createDataFrame(entries, "address string, listed boolean, at long")
    assert sorted(map(tuple, evaluate(c, e).collect()), key=str) == brute(captures, entries)
