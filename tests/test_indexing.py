import os
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_sources import picture, png, tiff

from fotolake.plans import indexing
from fotolake.schema import LEDGER, MEDIA
from fotolake.sources import images
from fotolake.sources.store import Store


def test_index_run_rescan_change_and_missing(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    png(lib / "a.png", picture(0))
    (lib / "copy.png").write_bytes((lib / "a.png").read_bytes())
    png(lib / "other.png", np.tile(np.array([10, 200, 10]), (20, 30, 1)))
    (lib / "broken.jpg").write_bytes(b"no picture")
    (lib / "notes.txt").write_text("left out")
    store = Store(spark, str(tmp_path / "db"))
    first = indexing.index_library(store, str(lib))
    assert (first["scanned"], first["updated"], first["hashed"], first["analysed"], first["missing"]) == (4, 4, 2, 3, 0)
    rows = {r.file_name: r for r in store.read("media", MEDIA).collect()}
    assert rows["a.png"].content_hash == rows["copy.png"].content_hash is not None
    assert rows["other.png"].dom_color == 0x0AC80A and rows["other.png"].width == 30 and rows["broken.jpg"].phash is None

    again = indexing.index_library(store, str(lib))
    assert (again["updated"], again["unchanged"], again["hashed"]) == (0, 4, 0)

    png(lib / "a.png", picture(3, 80))
    os.remove(lib / "copy.png")
    third = indexing.index_library(store, str(lib))
    assert (third["updated"], third["missing"]) == (1, 1)
    rows = {r.file_name: r for r in store.read("media", MEDIA).collect()}
    assert rows["a.png"].width == 80 and rows["a.png"].content_hash is None and rows["copy.png"].missing
    assert indexing.summary(third) == "3 file(s): 1 updated, 2 unchanged, 1 analysed, 1 missing"


def test_restore_plan(spark):
    led = spark.createDataFrame([(1, 4, "/a", "/v/a", 0, False), (2, 4, "/b", "/v/b", 0, False), (3, 4, "/c", "/v/c", 0, True), (4, 5, "/d", "/v/d", 0, False)], LEDGER)
    there = spark.createDataFrame([("/a",)], "path string")
    assert [(r.dst, r.blocked) for r in indexing.restore_plan(led, 4, there).orderBy("seq").collect()] == [("/b", False), ("/a", True)]


def test_text_dimensions(spark):
    df = spark.createDataFrame([("/x/a.jpg", "jpg", 1, 2, " 4000 ", "3000 px", None)], "path string, ext string, size long, mtime long, width string, height string, date_taken timestamp")
    r = indexing.media_rows(df).first()
    assert (r.width, r.height, r.file_name, r.phash) == (4000, None, "a.jpg", None)
    assert indexing.media_rows(df.withColumn("height", F.lit("x"))).count() == 1


def test_hidden_names_are_read(spark, tmp_path):
    lib = tmp_path / "lib"
    (lib / "_raw").mkdir(parents=True)
    block = tiff({0x010F: (2, 6, b"Canon\0")})
    names = ("_MG_1.png", ".h.png", "_raw/b.png", "plain.png")
    for n in names:
        png(lib / n, picture(0), struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block)))
    store = Store(spark, str(tmp_path / "db"))
    got = indexing.index_library(store, str(lib))
    assert (got["scanned"], got["hashed"], got["analysed"], got["errors"]) == (4, 4, 4, 0)
    rows = store.read("media", MEDIA).collect()
    assert {r.path for r in rows} == {str(lib / n) for n in names}
    assert len({r.content_hash for r in rows} - {None}) == len({(r.phash, r.dom_color, r.width) for r in rows}) == 1
    assert all(r.content_hash and r.phash is not None and r.camera_make == "Canon" for r in rows)


def test_names_with_blanks_and_signs_are_analysed(spark, tmp_path):
    lib = tmp_path / "my lib"
    (lib / "sub dir").mkdir(parents=True)
    names = ("Screenshot 1.png", "e#1.png", "100%.png", "a%20b.png", "sub dir/b.png", "é [x]{y},*.png")
    for k, n in enumerate(names):
        png(lib / n, picture(k, 20 + k))
    direct = {r.path: r.width for r in images.analyse(images.read_images(spark, str(lib))).collect()}
    assert direct == {str(lib / n): 20 + k for k, n in enumerate(names)}
    store = Store(spark, str(tmp_path / "db"))
    assert indexing.index_library(store, str(lib))["analysed"] == len(names)
    rows = {r.path: r for r in store.read("media", MEDIA).collect()}
    assert all(rows[str(lib / n)].width == 20 + k and rows[str(lib / n)].phash is not None for k, n in enumerate(names))
    assert indexing.index_library(store, str(lib))["analysed"] == 0


def test_worklists_reach_other_roots(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir(), b.mkdir()
    png(a / "one.png", picture(0))
    (a / "late.png").write_bytes(b"not yet a picture")
    store = Store(spark, str(tmp_path / "db"))
    assert indexing.index_library(store, str(a))["hashed"] == 0
    png(a / "late.png", picture(5, 30))
    (b / "copy.png").write_bytes((a / "one.png").read_bytes())
    got = indexing.index_library(store, str(b))
    assert (got["scanned"], got["hashed"], got["errors"]) == (1, 2, 0)
    rows = {r.file_name: r for r in store.read("media", MEDIA).collect()}
    assert rows["one.png"].content_hash == rows["copy.png"].content_hash is not None
    assert rows["late.png"].phash is not None and rows["late.png"].width == 30

    # another root that is away: an error each, and due again once it is back
    (b / "third.png").write_bytes(b"x" * 40)
    (a / "forty.png").write_bytes(b"y" * 40)
    indexing.index_library(store, str(a))
    a.rename(tmp_path / "away")
    got = indexing.index_library(store, str(b))
    assert (got["hashed"], got["errors"]) == (1, 1) and not store.read("media", MEDIA).where("missing").count()
    (tmp_path / "away").rename(a)
    got = indexing.index_library(store, str(b))
    assert (got["hashed"], got["errors"]) == (1, 0)
