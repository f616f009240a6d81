import random

import numpy as np
import pytest

from fotolake.llm import spans as s


def run(spark, docs, n=20):
    d = spark.createDataFrame(docs, "doc_id long, text string, shard string")
    return {r.doc_id: r.shared_chars for r in s.shared_spans(d, min_chars=n).collect()}


def brute(docs, n):
    where = {}
    for d, t, _ in docs:
        for p in range(len(t or "") - n + 1):
            where.setdefault(t[p : p + n], set()).add(d)
    out = {}
    for d, t, _ in docs:
        on = set()
        for p in range(len(t or "") - n + 1):
            if len(where[t[p : p + n]]) > 1:
                on |= set(range(p, p + n))
        if on:
            out[d] = len(on)
    return out


def test_edges(spark):
    a = "the exact passage ééé 写真 of text"
    docs = [(1, "x" + a + "y", ""), (2, a + "zzz", ""), (3, a[:19], ""), (4, None, ""), (5, "", ""), (6, "rep rep rep rep rep rep rep rep rep rep", ""), (2, a + "zzz", "")]
    got = run(spark, docs)
    assert got == {1: len(a), 2: len(a)}
    assert run(spark, []) == {}


@pytest.mark.parametrize("shard_chars,many", [(2_000_000, 1), (300, 100), (300, 1)])
def test_equals_brute_force(spark, shard_chars, many, monkeypatch):
    monkeypatch.setattr(s, "SHARD_CHARS", shard_chars)
    monkeypatch.setattr(s, "MANY_SHARDS", many)
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("ab cdeé") for _ in range(k))
    pool = [text(60) for _ in range(6)]
    docs = []
    for k in range(60):
        parts = [text(rng.randrange(0, 50))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(pool)
            a, b = sorted(rng.sample(range(61), 2))
            parts += [p[a:b], text(rng.randrange(0, 30))]
        docs.append((k, "".join(parts), ""))
    docs += [(100 + k, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" + "b" * k, "") for k in range(5)]
    assert run(spark, docs) == brute(docs, 20)


def test_long_text_and_hot_passage(spark):
    rng = random.Random(1)
    hot = "".join(rng.choice("abcdefgh ") for _ in range(700))
    filler = lambda k: "".join(rng.choice("ijklmnop ") for _ in range(k))
    mark = lambda k: chr(0x4E00 + k)  # noqa: E731 - of one document only, so nothing is shared beyond the passage
    docs = [(k, filler(50) + mark(k) + hot[k % 5 :] + mark(k) + filler(20), "") for k in range(80)] + [(500, filler(200_000) + mark(500) + hot, "")]
    got = run(spark, docs, 300)
    assert got == {k: 700 - k % 5 for k in range(80)} | {500: 700}


def test_rolling_hash_and_sampling():
    rng = random.Random(2)
    t = "".join(rng.choice("xyz") for _ in range(400))
    h = s.Rolling(s.code_points(t)).windows(8)
    seen = {}
    for p in range(len(h)):
        assert seen.setdefault(t[p : p + 8], h[p]) == h[p]
    assert len(set(seen.values())) == len(seen)
    at, _ = s.sampled(t, 30, 15)
    gaps = np.diff(np.concatenate(([-1], at, [len(t) - 14])))
    assert gaps.max() <= 16


def test_windows_are_told_apart_by_both_hashes():
    w1, w2 = np.array([2, 5, 5, 5, 7]), np.array([9, 1, 3, 8, 1])
    h1, h2 = np.array([5, 5, 5, 7, 2, 8, 1, 5]), np.array([3, 2, 8, 1, 8, 1, 1, 1])
    assert s.among(h1, h2, w1, w2).tolist() == [True, False, True, True, False, False, False, True]
    assert not s.among(h1, h2, w1[:0], w2[:0]).any()
    points = s.code_points("ab" * 300)
    a, b = (s.Rolling(points, base).windows(20) for base in s.BASES)
    assert len(np.unique(a)) == len(np.unique(b)) == 2 and not set(a.tolist()) & set(b.tolist())


def test_a_passage_in_every_shard(spark, monkeypatch):
    monkeypatch.setattr(s, "SHARD_CHARS", 500)
    rng = random.Random(6)
    hot = "".join(rng.choice("abcdefgh ") for _ in range(320))
    docs = [(k, chr(0x4E00 + k) + hot + chr(0x4E00 + k), "") for k in range(60)]
    assert run(spark, docs, 300) == dict.fromkeys(range(60), 320)
