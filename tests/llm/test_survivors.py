import itertools
import random

import pytest
from pyspark.sql import functions as F

from fotolake.llm import survivors as s

B = s.Bundle


def flat(media, spark, rows, members):
    m = media(*rows).withColumn("group", F.lit("clash"))
    g = spark.createDataFrame(members, "group_id long, members array<long>")
    return s.members_of(g, m, "group_id", "members", "id")


def pick(df, bundles, **kw):
    return {(r.group_id, r.field_name): r.media_id for r in s.choose_survivors(df, bundles, **kw).collect()}


BUNDLES = [B("keeper", "true"), B("date", "date_taken > 0"), B("cam", "trim(camera_model) <> ''")]


def test_fields_come_from_the_best_member_that_has_them(spark, media):
    rows = [{"width": 10, "height": 10}, {"width": 9, "height": 9, "date_taken": 5, "camera_model": "  "}, {"width": 1, "height": None, "size": 10**6, "date_taken": 9, "camera_model": "c"}]
    df = flat(media, spark, rows, [(7, [3, 2, 1, 1, None, 99]), (8, [1]), (9, None), (None, [1, 2]), (10, [])])
    assert pick(df, BUNDLES) == {(7, "keeper"): 1, (7, "date"): 2, (7, "cam"): 3}


def test_ties(spark, media):
    rows = [{"path": "/é"}, {"path": "/ab"}, {"path": "/aa"}, {"path": "/aaa", "mtime": 1}]
    df = flat(media, spark, rows, [(1, [1, 2, 3]), (2, [1, 2, 3, 4])])
    assert pick(df, BUNDLES[:1]) == {(1, "keeper"): 3, (2, "keeper"): 4}


def test_empty(spark, media):
    assert pick(flat(media, spark, [{}], []), BUNDLES) == {}


def test_branch_and_bound_equals_enumeration():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 5)
        cands = [[(r, 10 * i + r, rng.randrange(3)) for r in range(rng.randrange(0, 5))] for i in range(n)]
        w = [rng.choice([1.0, 2.0, 3.0]) for _ in range(n)]
        clash = lambda i, a, j, b: a[2] != b[2] and (i + j) % 2 == 1
        best = None
        for combo in itertools.product(*[[*c, None] for c in cands]):
            if any(combo[i] and combo[j] and clash(i, combo[i], j, combo[j]) for i in range(n) for j in range(i)):
                continue
            ranks = tuple(c[0] if c else 6 for c in combo)
            key = (sum(w[i] * r for i, r in enumerate(ranks) if cands[i]), ranks)
            best = min(best or (key, combo), (key, combo), key=lambda t: t[0])
        got, cost = s.branch_and_bound(cands, w, clash, 6)
        assert tuple(got) == best[1] and abs(cost - best[0][0]) < 1e-9


def test_branch_and_bound_takes_any_number_of_candidates():
    clash = lambda i, a, j, b: a[2] != b[2]
    many = [(r, 100 + r, "y" if r < 5 else "x") for r in range(9)]
    # the first that agrees has rank 5: empty is cheaper below that, and only below
    for patience, pick, cost in ((2, None, 2.0), (4, None, 4.0), (5, many[5], 5.0), (7, many[5], 5.0), (50, many[5], 5.0)):
        assert s.branch_and_bound([[(0, 1, "x")], many], [10.0, 1.0], clash, patience) == ([(0, 1, "x"), pick], cost)
    rng = random.Random(3)
    for _ in range(300):
        n, patience = rng.randrange(1, 4), rng.randrange(0, 5)
        cands = [[(r, 10 * i + r, rng.randrange(3)) for r in range(rng.randrange(0, 8))] for i in range(n)]
        w = [rng.choice([0.0, 1.0, 2.0]) for _ in range(n)]
        keys = []
        for combo in itertools.product(*[[*c, None] for c in cands]):
            if not any(combo[i] and combo[j] and clash(i, combo[i], j, combo[j]) for i in range(n) for j in range(i)):
                ranks = tuple(c[0] if c else patience for c in combo)
                keys.append((sum(w[i] * r for i, r in enumerate(ranks) if cands[i]), ranks, tuple(c is None for c in combo), list(combo)))
        least = min(keys, key=lambda k: k[:3])
        assert s.branch_and_bound(cands, w, clash, patience) == (least[3], least[0])


PAIR = [B("identity", "content_hash is not null", ("content_hash",), 4.0), B("picture", "width is not null and height is not null", ("width", "height"), 1.0)]
DEPS = [s.Dependency("content_hash", "width")]


def test_dependency_moves_the_whole_bundle(spark, media):
    # the trusted identity vouches for width 50, which only the very last member has; forty copies of another width are one candidate
    rows = [{"content_hash": "h", "width": 50}] + [{"size": 900 - i, "width": 7, "height": 9} for i in range(40)] + [{"size": 1, "width": 50, "height": 1}]
    df = flat(media, spark, rows, [(1, list(range(1, 43)))])
    assert pick(df, PAIR, dependencies=DEPS) == {(1, "identity"): 1, (1, "picture"): 42}
    assert pick(df, PAIR) == {(1, "identity"): 1, (1, "picture"): 2}


def test_a_clash_costs_a_field_and_no_survivor(spark, media):
    rows = [{"content_hash": "h", "width": 100}, {"width": 200, "height": 5}]
    df = flat(media, spark, rows, [(1, [1, 2])])
    # empty costs 4 x 8 for the identity and 1 x 8 for the picture
    assert pick(df, PAIR, dependencies=DEPS) == {(1, "identity"): 1}
    heavy = [PAIR[0], B("picture", PAIR[1].known, PAIR[1].fields, 9.0)]
    assert pick(df, heavy, dependencies=DEPS) == {(1, "picture"): 2}


@pytest.mark.parametrize("before, kept", [(7, True), (8, True), (9, False)])
def test_a_candidate_that_costs_as_much_as_an_empty_bundle_is_kept(spark, media, before, kept):
    # so many distinct pictures clash before the one of width 50 that the identity vouches for; at rank 8 it ties with an empty bundle
    rows = [{"content_hash": "h", "width": 50, "size": 9_000}] + [{"size": 900 - i, "width": 1_000 - i, "height": 9} for i in range(before)] + [{"size": 1, "width": 50, "height": 1}] * 2
    df = flat(media, spark, rows, [(1, list(range(1, len(rows) + 1)))])
    assert pick(df, PAIR, dependencies=DEPS) == {(1, "identity"): 1} | ({(1, "picture"): before + 2} if kept else {})
    with pytest.raises(ValueError):
        pick(df, [PAIR[0], B("picture", PAIR[1].known, PAIR[1].fields, -1.0)], dependencies=DEPS)


def test_each_bundle_has_its_trust(spark, media):
    rows = [{"width": 9, "height": 9, "lat": 1.0, "mtime": 5}, {"lat": 2.0, "mtime": 9}, {"lat": 3.0, "mtime": None}]
    df = flat(media, spark, rows, [(1, [1, 2, 3])])
    assert pick(df, [B("keeper", "true"), B("place", "lat is not null", ("lat",), 1.0, ("-mtime", "id"))]) == {(1, "keeper"): 1, (1, "place"): 2}


def test_repeated_rows_and_unknown_fields(spark, media):
    df = flat(media, spark, [{}, {}], [(1, [1, 2])])
    twice = s.members_of(spark.createDataFrame([(1, [1, 2])], "group_id long, members array<long>"), media({}, {}).unionByName(media({}, {})), "group_id", "members", "id")
    assert twice.count() == 2 and pick(twice, BUNDLES) == pick(df, BUNDLES) == {(1, "keeper"): 1}
    with pytest.raises(ValueError):
        pick(df, BUNDLES, dependencies=[s.Dependency("nothing", "width")])
    # one group that holds nearly all rows
    big = s.members_of(spark.createDataFrame([(1, list(range(1, 3001))), (2, [1, 2])], "group_id long, members array<long>"), media(*[{"width": k % 50, "height": 1} for k in range(3000)]), "group_id", "members", "id")
    assert pick(big, PAIR, dependencies=DEPS) == {(1, "picture"): 50, (2, "picture"): 2}
