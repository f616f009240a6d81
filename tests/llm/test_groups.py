import random

import pytest

from fotolake.llm.groups import connected_groups, counted_pairs


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    least = {}
    for x in root:
        r = find(x)
        least[r] = min(least.get(r, x), x)
    return {x: least[find(x)] for x in root}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "left_id long, right_id long")
    return {r.id: r.group_id for r in connected_groups(df).collect()}


def test_chains_stars_and_cliques(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 260)]  # a long chain
    pairs += [(1000, k) for k in range(1001, 1200)]  # a star
    pairs += [(a, b) for a in range(2000, 2012) for b in range(2000, 2012)]  # a clique with self-pairs
    pairs += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(300)]
    pairs += [(b, a) for a, b in pairs[:50]] + pairs[:50] + [(None, 1), (7, None)]
    assert run(spark, pairs) == union_find(pairs)


def test_negative_and_tiny(spark):
    assert run(spark, [(-5, 3), (3, 9)]) == {-5: -5, 3: -5, 9: -5}
    assert run(spark, []) == {}
    assert run(spark, [(1, 1), (None, None)]) == {}


def test_salted_hub(spark, monkeypatch):
    import fotolake.llm.groups as g

    monkeypatch.setattr(g, "EDGES_PER_SALT", 10)
    pairs = [(1, k) for k in range(2, 120)] + [(k, k + 1000) for k in range(50, 60)]
    assert run(spark, pairs) == union_find(pairs)


@pytest.mark.parametrize("beta,radius", [(0.5, 2), (0.02, 1)])
def test_any_rate_gives_the_same_groups(spark, beta, radius):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    df = spark.createDataFrame(pairs, "left_id long, right_id long")
    assert {r.id: r.group_id for r in connected_groups(df, beta=beta, radius=radius).collect()} == union_find(pairs)


def test_counted_pairs(spark, media):
    rows = media({}, {}, {}, {"missing": True})
    p = spark.createDataFrame([(1, 2, " EXACT ", None), (2, 3, "near", 7), (1, 3, "Near", 6), (1, 4, "exact", 0), (2, 2, "exact", 0), (2, 3, None, None), (1, 99, "exact", 0)], "left_id long, right_id long, match_method string, distance int")
    assert sorted((r.left_id, r.right_id) for r in counted_pairs(p, rows).collect()) == [(1, 2), (1, 3)]
