import numpy as np
import pytest

from fotolake.llm import history as h


def codes(n, seed=1):
    return np.unique(np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64))


def near(code, rng, most=6):
    for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
        code = code ^ np.uint64(1 << int(b))
    return code


def test_graph_recall_against_brute_force():
    c = codes(6000)
    np.random.default_rng(0).shuffle(c)
    own, links = h.build_graph(c)
    assert (np.sort(h.both_ways(c, own), axis=1) == np.sort(links, axis=1)).mean() > 0.9
    beam, recall = h.tuned_beam(c, links, 6)
    assert recall >= 0.99
    rng = np.random.default_rng(2)
    q = np.array([near(x, rng) for x in c[:600]])
    got = set(zip(*(x.tolist() for x in h.within(q, c, links, beam, 6))))
    truth = {(i, int(j)) for i, x in enumerate(q) for j in np.nonzero(h.hamming(c, x) <= 6)[0]}
    assert got <= truth and len(got) >= 0.98 * len(truth)


def test_crowded_code_is_not_capped():
    # more codes within the radius than any first beam holds
    base = np.uint64(0x0123456789ABCDEF)
    crowd = np.unique([base ^ np.uint64((1 << a) | (1 << b) | (1 << c)) for a in range(16) for b in range(a, 16) for c in range(b, 16)])
    own, links = h.build_graph(crowd)
    q, n = h.within(np.array([base]), crowd, h.both_ways(crowd, own), 32, 6)
    assert len(set(n.tolist())) == len(crowd)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_tiny_graphs(n):
    c = codes(n)
    own, links = h.build_graph(c)
    q, k = h.within(c, c, h.both_ways(c, own), 32, 0)
    assert sorted(zip(q.tolist(), k.tolist())) == [(i, i) for i in range(n)]


SCHEMA_OLD = "id long, content_hash string, phash long, batch_no string"
SCHEMA_NEW = "batch_no int, id long, content_hash string, phash long, segment int"


def run(spark, old, new):
    df = h.history_matches(spark.createDataFrame(old, SCHEMA_OLD), spark.createDataFrame(new, SCHEMA_NEW))
    return sorted((r.id_a, r.id_b) for r in df.collect())


def test_batches(spark):
    old = [(1, "aa", 0, "x"), (2, None, -1, "x"), (3, "bb", None, "x"), (1, "aa", 0, "x")]
    new = [(1, 10, "AA", None, 0), (1, 11, None, 0b111111, 0), (1, 12, None, 0b1111111, 0), (2, 13, "Bb", -1 ^ 1, 0), (2, 14, None, None, 0), (2, 15, "aa", 0, 0), (2, 15, "aa", 0, 0), (None, 16, "aa", 0, 0)]
    assert run(spark, old, new) == [(1, 10), (1, 11), (1, 15), (2, 13), (3, 13), (10, 15), (11, 15)]


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", 5, "")], []) == []
    assert run(spark, [], [(1, 10, "a", 5, 0), (2, 11, "A", 4, 0), (2, 12, "a", 4, 0)]) == [(10, 11), (10, 12)]


def test_random_batches_equal_brute_force_and_compaction(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in codes(400).view(np.int64)]
    old = [(i, None, b, "") for i, b in enumerate(base)]
    new = [(1 + i % 3, 1000 + i, None, int(near(np.uint64(base[i * 3] % 2**64), rng, 8).view(np.int64)), 0) for i in range(120)]
    pop = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    truth = {(o[0], n[1]) for o in old for n in new if pop(o[2], n[3]) <= 6} | {tuple(sorted((a[1], b[1]))) for a in new for b in new if a[0] < b[0] and pop(a[3], b[3]) <= 6}
    assert set(run(spark, old, new)) == truth
    segs = spark.createDataFrame([(k % 4, b) for k, b in enumerate(base)], "segment int, phash long")
    shards = h.build_shards(segs, 6)
    packed = h.compact(shards, 6)
    assert packed.count() == 1 and packed.first().n == len(base) and packed.first().segment == 3
    q = spark.createDataFrame([(9, base[7] ^ 3)], "segment int, phash long")
    assert [r.phash for r in h.search_shards(q, packed, 6).collect()] == [base[7]]


def test_shard_that_misses_the_target_is_searched_exhaustively():
    c = codes(6000)
    np.random.default_rng(0).shuffle(c)
    alone = np.repeat(np.arange(len(c), dtype=np.int32)[:, None], 2 * h.LINKS, axis=1)  # codes beyond the entries can't be reached
    beam, recall = h.tuned_beam(c, alone, 6)
    q, k = h.within(c[-50:], c, alone, beam, 0)
    assert recall >= h.TARGET_RECALL and sorted(zip(q.tolist(), k.tolist())) == [(i, len(c) - 50 + i) for i in range(50)]


def test_cluster_does_not_decide_the_beam():
    base = np.uint64(0x0123456789ABCDEF)
    crowd = np.unique([base ^ np.uint64((1 << a) | (1 << b) | (1 << c)) for a in range(22) for b in range(a, 22) for c in range(b, 22)])
    rest = codes(6000)
    np.random.default_rng(0).shuffle(rest)
    c = np.concatenate([crowd, rest])
    alone = np.repeat(np.arange(len(c), dtype=np.int32)[:, None], 2 * h.LINKS, axis=1)
    beam, recall = h.tuned_beam(c, alone, 6)
    q, k = h.within(c[-50:], c, alone, beam, 0)
    assert recall >= h.TARGET_RECALL and len(q) == 50


def test_compaction_gives_fresh_numbers(spark, monkeypatch):
    monkeypatch.setattr(h, "SHARD_CODES", 100)
    c = [int(x) for x in codes(400).view(np.int64)]
    shards = h.build_shards(spark.createDataFrame([(3, x) for x in c], "segment int, phash long"), 6)
    sizes = sorted(r.n for r in shards.select("n").collect())
    packed = h.compact(shards, 6, least=sizes[2]).select(*h.SHARD, "n").collect()
    assert len({tuple(r[:5]) for r in packed}) == len(packed) and sum(r.n for r in packed) == len(c)


def test_stored_index_gives_the_same_pairs_batch_by_batch(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in codes(150).view(np.int64)]
    old = [(i, None, b, "") for i, b in enumerate(base)]
    new = [(1 + i % 3, 1000 + i, None, int(near(np.uint64(base[i] % 2**64), rng, 8).view(np.int64)), 0) for i in range(60)]
    new += [(3, 2000, None, new[0][3], 0)]
    got, index = set(), h.history_index(spark.createDataFrame(old, SCHEMA_OLD))
    past = list(old)
    for b in (1, 2, 3):
        batch = [r for r in new if r[0] == b]
        df = spark.createDataFrame(batch, SCHEMA_NEW)
        got |= {(r.id_a, r.id_b) for r in h.history_matches(spark.createDataFrame(past, SCHEMA_OLD), df, index=index).collect()}
        index = h.extend_index(index, df, most=1)
        past += [(r[1], r[2], r[3], "") for r in batch]
    assert index.count() == 1 and got == set(run(spark, old, new)) and (1000, 2000) in got
    with pytest.raises(ValueError):
        h.history_matches(spark.createDataFrame(past, SCHEMA_OLD), df, index=index)


def test_regions_lose_no_pair_and_spare_shards(spark, monkeypatch):
    monkeypatch.setattr(h, "SHARD_CODES", 60)
    monkeypatch.setattr(h, "REGION_FROM", 4)
    monkeypatch.setattr(h, "BLOCK_QUERIES", 50)
    rng = np.random.default_rng(12)
    base = codes(600, 3)
    crowd = np.unique(base[:200] & ~np.uint64(0x1FF))  # a third of all codes share a region of the first block
    c = np.unique(np.concatenate([base, crowd]))
    q = np.unique(np.array([near(x, rng, 7) for x in c[::3]]))
    rows = lambda xs, s: [(s, int(x)) for x in xs.view(np.int64)]
    shards = h.build_shards(spark.createDataFrame(rows(c, 0), "segment int, phash long"), 6).cache()
    names = shards.select(*h.SHARD, "tables", "bits", "n").collect()
    assert {(r.tables, r.bits) for r in names} == {(7, 4)} and max(r.n for r in names) < 130
    assert sum(r.n for r in names) == 7 * len(c) and max(r.part for r in names if r.tab == 0 and r.val == 0) >= 2
    asked = spark.createDataFrame(rows(q, 5), "segment int, phash long")
    got = {(r.q, r.phash) for r in h.search_shards(asked, shards, 6).collect()}
    truth = {(int(x), int(y)) for i, x in enumerate(q.view(np.int64)) for y in c[h.hamming(c, q[i]) <= 6].view(np.int64)}
    assert got == truth == {(r.q, r.phash) for r in h.search_shards(asked, shards, 6, exact=True).collect()}
    with pytest.raises(ValueError):
        h.search_shards(asked, shards, 7)
    # an index of regions grows by batches as any other
    grown = h.extend_index(shards, spark.createDataFrame([(1, int(x)) for x in q.view(np.int64)[:50]], "batch_no int, phash long"))
    assert {(r.segment, r.tables) for r in h.index_shards(grown).collect()} == {(0, 7), (1, 1)}


def test_a_batch_against_an_index_builds_no_shard(spark, monkeypatch):
    old = [(i, None, int(x), "") for i, x in enumerate(codes(50).view(np.int64))]
    index = h.history_index(spark.createDataFrame(old, SCHEMA_OLD))
    monkeypatch.setattr(h, "build_shards", None)
    got = h.history_matches(spark.createDataFrame(old, SCHEMA_OLD), spark.createDataFrame([(1, 90, None, old[7][2] ^ 1, 0)], SCHEMA_NEW), index=index)
    assert [tuple(r) for r in got.collect()] == [(7, 90)]


def test_classes_of_copies(spark):
    old = [(k, "hot", 5, "") for k in range(1, 60)] + [(100, None, 6, ""), (101, None, 6, ""), (102, None, None, "")]
    new = [(1, k, "HOT", 5, 0) for k in range(200, 260)] + [(2, 300, "hot", None, 0), (2, 301, None, 2, 0)]
    a, b = spark.createDataFrame(old, SCHEMA_OLD), spark.createDataFrame(new, SCHEMA_NEW)
    got = h.history_classes(a, b).collect()
    match = {(r.id_a, r.id_b) for r in got if r.relation == "match"}
    name = {r.id_b: r.id_a for r in got if r.relation == "same"}
    assert match == {(1, 200), (1, 300), (200, 300), (1, 301), (200, 301), (100, 200), (100, 301)} and name[59] == 1 and name[101] == 100 and 102 not in name
    rep = lambda x: name.get(x, x)
    assert {tuple(sorted((rep(r.id_a), rep(r.id_b)))) for r in h.history_matches(a, b).collect()} == match
