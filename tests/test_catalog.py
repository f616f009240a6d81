import random

from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.operators import catalog as c
from fotolake.schema import LEDGER, MEDIA, USER_META, evolve


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


def users(spark, *rows):
    return spark.createDataFrame([(h, hid, rt, k, 0) for h, hid, rt, k in rows], "content_hash string, hidden boolean, rating int, kind string, updated_at long")


def test_unknown_content_stays_visible_and_hidden_is_shared_by_content(spark, media):
    rows = media({"content_hash": None}, {"content_hash": "h"}, {"content_hash": "h"}, {"content_hash": "z", "missing": True})
    u = users(spark, ("h", True, 99, "nonsense"), ("z", True, 1, None))
    assert ids(c.present(rows, u, c.VISIBLE_ONLY)) == [1]
    every = {r.id: r for r in c.present(rows, u, c.ALL).collect()}
    assert every[2].rating == 5 and every[2].kind is None and not every[1].hidden
    assert c.hidden_count(rows, u).first().hidden == 2


def test_root_is_a_literal_prefix(media):
    rows = media({"path": "/photos/lib/a"}, {"path": "/photos/library/a"}, {"path": "/photos/lib_x/a"}, {"path": "/Photos/Lib/a"})
    assert ids(rows.where(m.under("/photos/lib"))) == [1]
    assert ids(rows.where(m.under("/photos/lib/", ascii_ci=True))) == [1, 4]
    assert ids(rows.where(m.under("/photos/lib_x"))) == [3]


def test_stats_and_worklists(media):
    rows = media({"size": 100, "content_hash": "a", "phash": 1}, {"size": 100}, {"size": 999}, {"size": 100, "missing": True}, {"ext": "ARW", "size": 5})
    s = c.library_stats(rows).first()
    assert (s.files, s.hashed, s.phashed, s.bytes) == (4, 1, 1, 1204)
    assert ids(c.hash_worklist(rows)) == [2]
    assert ids(c.analysis_worklist(rows)) == [1, 2, 3]
    assert c.library_stats(rows.where("false")).first().bytes == 0


def test_changes_and_upsert(spark, media):
    old = media({"path": "/a", "content_hash": "h", "phash": 5, "width": 10, "height": 20}, {"path": "/b", "content_hash": "h2"}, {"path": "/c"}, {"path": "/d", "missing": True}, {"path": "/e", "meta_version": 1})
    disk = spark.createDataFrame([("/a", 100, 1000), ("/b", 101, 1000), ("/d", 100, 1000), ("/e", 100, 1000), ("/n", 1, 1)], "path string, size long, mtime long")
    got = {r.path: r.change for r in c.classify_changes(disk, old).collect()}
    assert got == {"/a": "unchanged", "/b": "changed", "/c": "vanished", "/d": "stale", "/e": "stale", "/n": "new"}
    new = evolve(disk.withColumn("file_name", F.lit("x")).withColumn("ext", F.lit("")), MEDIA).drop("id")
    after = {r.path: r for r in c.upsert(old, new).collect()}
    assert (after["/a"].content_hash, after["/a"].phash, after["/a"].width) == ("h", 5, 10)
    assert after["/b"].content_hash is None and not after["/d"].missing and after["/n"].id == 6 and len(after) == 6
    marked = {r.path: r.missing for r in c.mark_missing(old, spark.createDataFrame([(1,), (1,)], "id long")).collect()}
    assert marked == {"/a": False, "/b": True, "/c": True, "/d": True, "/e": True}


def test_moves_chain_and_replace(spark, media):
    rows = media({"path": "/a.jpg"}, {"path": "/b.png"}, {"path": "/stale.jpg"})
    mv = spark.createDataFrame([("/a.jpg", "/b.png"), ("/b.png", "/stale.jpg"), ("/nobody", "/x")], "src string, dst string")
    got = {r.id: (r.path, r.ext) for r in c.apply_moves(rows, mv).collect()}
    assert got == {1: ("/b.png", "png"), 2: ("/stale.jpg", "jpg")}


def test_user_meta_and_ledger(spark):
    u = users(spark, ("a", True, 3, "photo"))
    e = spark.createDataFrame([("a", 99), ("b", 2)], "content_hash string, rating int")
    got = {r.content_hash: (r.hidden, r.rating, r.kind) for r in c.set_user_meta(u, e, F.lit(7)).collect()}
    assert got == {"a": (True, 5, "photo"), "b": (False, 2, None)}
    empty = spark.createDataFrame([], LEDGER)
    assert tuple(c.next_batch(empty).first()) == (1, None)
    led = c.record(empty, spark.createDataFrame([(1, "/b", "/v/b", 5), (1, "/a", "/v/a", 5)], "batch long, original_path string, quarantine_path string, moved_at long"))
    assert [(r.id, r.original_path) for r in led.orderBy("id").collect()] == [(1, "/a"), (2, "/b")]
    done = c.mark_restored(led, led.select("id"))
    assert tuple(c.next_batch(done).first()) == (2, None) and c.pending(done).count() == 0


def test_evolve_adds_missing_columns(spark):
    old = spark.createDataFrame([("h",)], "content_hash string")
    assert tuple(evolve(old, USER_META).first()) == ("h", False, 0, None, None)


def test_unique_targets(spark):
    rows = spark.createDataFrame([("/1", "/v/a.jpg"), ("/2", "/v/a.jpg"), ("/3", "/v/.rc"), ("/4", "/v/free")], "path string, target string")
    there = spark.createDataFrame([("/v/a.jpg",), ("/v/.rc",)], "path string")
    assert {r.path: r.dest for r in c.unique_targets(rows, "target", there).collect()} == {"/1": "/v/a-2.jpg", "/2": "/v/a-3.jpg", "/3": "/v/.rc-2", "/4": "/v/free"}


def test_unique_targets_never_take_a_wanted_or_existing_name(spark):
    there = spark.createDataFrame([("/v/a.jpg",), ("/v/a-2.jpg",), ("/v/a-4.jpg",), ("/v/a-05.jpg",), (None,)], "path string")
    rows = spark.createDataFrame([("/1", "/v/a.jpg"), ("/2", "/v/a.jpg"), ("/3", "/v/a-3.jpg"), ("/4", "/v/a.jpg"), ("/5", "/v/a-3.jpg"), ("/6", None), ("/7", "/v/a-3-2.jpg")], "path string, target string")
    got = {r.path: r.dest for r in c.unique_targets(rows, "target", there).collect()}
    assert got == {"/1": "/v/a-5.jpg", "/2": "/v/a-6.jpg", "/3": "/v/a-3.jpg", "/4": "/v/a-7.jpg", "/5": "/v/a-3-3.jpg", "/6": None, "/7": "/v/a-3-2.jpg"}


def test_unique_targets_of_random_families(spark):
    rng = random.Random(3)
    name = lambda: f"/v/{rng.choice('ab')}{rng.choice(['', '-2', '-3', '-2-2', '-10'])}{rng.choice(['', '.jpg'])}"
    there = {name() for _ in range(8)}
    rows = [(f"/{k:03}", name()) for k in range(120)]
    got = c.unique_targets(spark.createDataFrame(rows, "path string, target string"), "target", spark.createDataFrame([(x,) for x in there], "path string")).collect()
    assert len(got) == 120 and len({r.dest for r in got}) == 120 and not {r.dest for r in got} & there
    assert sum(r.dest == r.target for r in got) == len({t for _, t in rows} - there)


def test_rows_without_digest_match_nothing(spark, media):
    rows = media(*[{"content_hash": None}] * 40, {"content_hash": "h"})
    u = users(spark, ("h", False, 4, None)).unionByName(spark.createDataFrame([(None, True, 5, "photo", 0)], "content_hash string, hidden boolean, rating int, kind string, updated_at long"))
    got = c.with_user_meta(rows, u).collect()
    assert len(got) == 41 and [r.id for r in got if r.rating] == [41]
