import random
from math import comb

import pytest
from pyspark.sql import functions as F

from fotolake.operators import dupes as d
from fotolake.operators import similarity
from fotolake.operators.scan import scan_pairs
from fotolake.operators.similarity import choose_blocks, components, hamming_pairs


@pytest.fixture()
def rows(media):
    return lambda *r: media(*r).withColumn("kind", F.lit(None).cast("string"))


def groups_of(df):
    out = {}
    for r in df.select("group_key", "id").collect():
        out.setdefault(r.group_key, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_exact(rows):
    r = rows({"path": "/lib/a.jpg", "content_hash": "h1"}, {"path": "/lib/copy/a.jpg", "content_hash": "h1"}, {"content_hash": "h2"}, {}, {})
    g = d.groups(d.exact_members(r)).collect()
    assert len(g) == 1 and g[0].reclaimable == 100 and g[0].keeper_id == 1 and g[0].n == 2
    three = rows(*[{"content_hash": "x"}] * 3)
    t = d.totals(d.groups(d.exact_members(three))).first()
    assert (t.groups, t.reclaimable, t.removable) == (1, 200, 2)


def test_near_radius_boundary_and_chains(rows):
    r = rows({"phash": 0}, {"phash": 0b11}, {"phash": -1}, {})
    g = d.groups(d.near_members(r, 4)).collect()
    assert len(g) == 1 and g[0].spread == 2
    four = rows({"phash": 0}, {"phash": 0b1111})
    assert d.near_members(four, 3).count() == 0 and d.near_members(four, 4).count() == 2
    chain = d.groups(d.near_members(rows({"phash": 0}, {"phash": 0b111}, {"phash": 0b111111}), 3)).collect()
    assert len(chain) == 1 and chain[0].n == 3 and chain[0].spread == 6


def test_identical_files_are_no_near_group(rows):
    assert d.near_members(rows({"phash": 1, "content_hash": "a"}, {"phash": 1, "content_hash": "a"})).count() == 0
    assert d.near_members(rows({"phash": 1, "content_hash": "a"}, {"phash": 1})).count() == 2
    assert d.near_members(rows({"phash": 1, "content_hash": "a"}, {"phash": 0, "content_hash": "b"})).count() == 2


def test_bursts(rows):
    r = rows(*[{"camera_model": "R5", "date_taken": t} for t in (1000, 1001, 1002, 3000)], {"camera_model": "Pixel", "date_taken": 1000})
    assert groups_of(d.burst_members(r, 2)) == [[1, 2, 3]]
    edge = lambda b: d.burst_members(rows({"date_taken": 100}, {"date_taken": b, "camera_model": ""}), 2).count()
    assert (edge(102), edge(103)) == (2, 0)
    midnight = rows(*[{"date_taken": 86400 * 3 + k} for k in (-3, -1, 0, 1, 4)])
    assert groups_of(d.burst_members(midnight, 2)) == [[1, 2, 3, 4]]


def test_keeper_order(rows):
    best = lambda *r: d.groups(d.exact_members(rows(*[{"content_hash": "h"} | x for x in r]))).first().keeper_id
    assert best({"width": 6000, "height": 4000, "size": 500}, {"width": 800, "height": 600, "size": 9000}) == 1
    assert best({"size": 5}, {"size": 9}) == 2
    assert best({"mtime": 9}, {"mtime": 5}) == 2
    assert best({"path": "/lib/é.jpg"}, {"path": "/lib/aa.jpg"}, {"path": "/lib/a.jpg"}) == 3


def test_scoping_and_report_order(rows):
    r = rows({"content_hash": "h", "camera_model": "x"}, {"content_hash": "h"})
    assert d.exact_members(r, by_kind=True).count() == 0 and d.exact_members(r).count() == 2
    r = rows({"phash": 0, "size": 10}, {"phash": 1, "size": 10}, {"content_hash": "e", "size": 5000}, {"content_hash": "e", "size": 5000})
    got = d.report(d.all_members(r)).orderBy("rank").collect()
    assert [g.dup_kind for g in got] == ["exact", "near"]
    assert [x.id for x in d.removal_selection(d.all_members(r)).collect()] == [4]


@pytest.mark.parametrize("radius", [0, 3, 6, 12, 16])
def test_hamming_join_equals_brute_force(spark, radius):
    rng = random.Random(radius)
    codes = [(i * 0x9E3779B97F4A7C15) % 2**64 for i in range(150)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes[:100]]
    signed = sorted({c - 2**64 if c >= 2**63 else c for c in codes})
    got = {(r.a, r.b) for r in hamming_pairs(spark.createDataFrame([(c,) for c in signed] * 2 + [(None,)], "phash long"), radius).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= radius}


def test_blocks_grow_with_rows():
    assert choose_blocks(100, 6) == (7, 1) and choose_blocks(50_000, 6) == (8, 2)
    pairs = lambda n, t: n * n / 2 ** (64 * choose_blocks(n, t)[1] / choose_blocks(n, t)[0]) * comb(*choose_blocks(n, t))
    assert pairs(10**8, 6) < 1000**1.4 * pairs(10**5, 6)
    # keys go on growing with the rows, for any radius
    assert choose_blocks(10**10, 6)[1] > choose_blocks(10**8, 6)[1] and choose_blocks(10**7, 12)[1] > choose_blocks(10**5, 12)[1]


@pytest.mark.parametrize("radius, m", [(0, 3), (2, 4), (6, 3), (12, 0), (12, 4), (12, 5), (12, None), (20, 6), (40, None)])
def test_hamming_scan_equals_brute_force(spark, radius, m):
    rng = random.Random(radius)
    codes = {rng.getrandbits(64) for _ in range(60)} | set(range(20)) | {2**64 - 1, 2**63}
    for c in sorted(codes):
        codes.add(c ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 15))))
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    rows = sorted({(rng.choice(["x", "y", None]), signed(c)) for c in codes}, key=str) + [("y", 5), ("x", 5), ("alone", 0)]
    rows = spark.createDataFrame(sorted(set(rows), key=str), "kind string, phash long")
    near = lambda u, v: bin((u ^ v) & (2**64 - 1)).count("1")
    true = lambda h: sorted((s, a, b, near(a, b)) for s, a in h for t, b in h if s == t and a < b and near(a, b) <= radius)
    got = scan_pairs(rows, rows.count(), radius, scope="kind", chunk=70, packed=16, m=m)
    assert got.columns == ["kind", "a", "b", "distance"]
    assert sorted(map(tuple, got.collect())) == true([tuple(x) for x in rows.where("kind is not null").collect()])
    plain = rows.select("phash").distinct()
    got = scan_pairs(plain, plain.count(), radius, chunk=70, packed=16, m=m)
    assert sorted(("", *x) for x in map(tuple, got.collect())) == true([("", x.phash) for x in plain.collect()])


def test_a_wide_radius_moves_no_keys(spark, monkeypatch):
    assert similarity.join_cost(3_300, *choose_blocks(3_300, 12)) < similarity.MOST_COST < similarity.join_cost(330_000, *choose_blocks(330_000, 12))
    assert similarity.join_cost(10**7, *choose_blocks(10**7, 6)) < similarity.MOST_COST
    # hundreds of keys a hash on both sides of a join filled the disk at 330,000 hashes
    monkeypatch.setattr(similarity, "choose_blocks", lambda n, radius: choose_blocks(330_000, radius))
    rows = spark.range(300).select(F.xxhash64("id").alias("phash"))
    plan = hamming_pairs(rows, 12)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_spread_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    groups = {str(g): {rng.getrandbits(64)} for g in range(6)}
    for g, codes in groups.items():
        for _ in range(int(g) * 25):
            codes.add(rng.choice(sorted(codes)) ^ (1 << rng.randrange(64)))
    rows = [("near", "all", g, signed(c)) for g, codes in groups.items() for c in codes] + [("near", "all", "none", None), ("near", "all", "0", signed(min(groups["0"])))]
    got = {r.group_key: r.spread for r in d.spreads(spark.createDataFrame(rows, "dup_kind string, scope string, group_key string, phash long")).collect()}
    assert got == {g: max(bin(a ^ b).count("1") for a in codes for b in codes) for g, codes in groups.items() if len(codes) > 1}


def test_a_hub_is_spread_over_salts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "EDGES_PER_SALT", 20)
    pairs = [(7, k) for k in range(100, 400)] + [(399, 400), (1, 2)]
    assert similarity.salted_arcs(spark.createDataFrame(pairs, "a long, b long")).where("src = 7 and hop = 1").select("salt").distinct().count() == 15
    got = {r.v: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {7: 7, 1: 1, 2: 1} | {k: 7 for k in range(100, 401)}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5050)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.v: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    least = {}
    for x in linked:
        least[find(x)] = min(least.get(find(x), x), x)
    assert got == {x: least[find(x)] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
