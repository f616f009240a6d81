import json
import os
import struct
import zlib

import numpy as np
import pytest

from fotolake.operators.ordering import global_rank
from fotolake.schema import USER_META
from fotolake.sources import exif, files, images, remote, store


def png(path, rgb, extra=b""):
    h, w, _ = rgb.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(shift, size=64):
    y, x = np.mgrid[0:size, 0:size]
    v = (7 * x + 13 * y + 61 * shift) % 256
    return np.stack([v, (v + 40) % 256, (v + 80) % 256], axis=2)


def test_walk_keeps_hidden_names(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("_MG_1.jpg", ".x.jpg", "a.PNG", "t.txt", files.UNDO_LOG, "sub/b.jpg"):
        (tmp_path / n).write_bytes(b"123")
    got = {os.path.basename(r.path) for r in files.walk(spark, str(tmp_path)).collect()}
    assert got == {"_MG_1.jpg", ".x.jpg", "a.PNG", "t.txt", "b.jpg"}
    flat = files.walk(spark, str(tmp_path), recursive=False, images_only=True)
    assert {os.path.basename(r.path) for r in flat.collect()} == {"_MG_1.jpg", ".x.jpg", "a.PNG"}
    assert files.folder_bytes(files.walk(spark, str(tmp_path))).first().bytes == 15
    assert {r.name: r.ext for r in files.file_meta(flat).collect()} == {"_MG_1": "jpg", ".x": "jpg", "a": "PNG"}


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", picture(0))
    png(tmp_path / "b.png", picture(0, 64) + 1)
    png(tmp_path / "red.png", np.tile(np.array([200, 10, 10]), (30, 40, 1)))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    got = {os.path.basename(r.path): r for r in images.analyse(images.read_images(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.png", "red.png"}
    assert (got["red.png"].width, got["red.png"].height, got["red.png"].dom_color, got["red.png"].phash) == (40, 30, 0xC80A0A, 0)
    assert bin((got["a.png"].phash ^ got["b.png"].phash) & (2**64 - 1)).count("1") <= 6


def tiff(entries, order="<", sub=None, gps=None):
    """A TIFF block from {tag: (type, count, bytes)}."""

    def directory(e, at, extra):
        e = dict(sorted(e.items()))
        data_at = at + 2 + 12 * len(e) + 4
        body, tail = struct.pack(order + "H", len(e)), b""
        for tag, (kind, count, raw) in e.items():
            if len(raw) <= 4:
                body += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                body += struct.pack(order + "HHII", tag, kind, count, data_at + len(tail))
                tail += raw
        return body + b"\0" * 4 + tail

    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    e = dict(entries)
    for tag, part in ((exif.SUB_EXIF, sub), (exif.SUB_GPS, gps)):
        if part:
            e[tag] = (4, 1, struct.pack(order + "I", 0))
    out = head + directory(e, 8, b"")
    for tag, part in ((exif.SUB_EXIF, sub), (exif.SUB_GPS, gps)):
        if part:
            e[tag] = (4, 1, struct.pack(order + "I", len(out)))
            block = directory(part, len(out), b"")
            out = head + directory(e, 8, b"") + out[len(head + directory(e, 8, b"")) :] + block
    return out


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    s = lambda x: (2, len(x) + 1, x.encode() + b"\0")
    dms = lambda d, m, c: (5, 3, struct.pack(order + "IIIIII", d, 1, m, 1, c, 1))
    block = tiff({0x010F: s("Make"), 0x0132: s("2020:01:02 03:04:05")}, order, {0x9003: s("2021:05:06 07:08:09"), 0x8827: (3, 1, struct.pack(order + "H", 400))}, {1: s("S"), 2: dms(33, 52, 8), 3: s("E"), 4: dms(151, 12, 33)})
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"
    rows = spark.createDataFrame([("j", bytearray(jpeg)), ("t", bytearray(block)), ("junk", bytearray(jpeg[:40])), ("none", None)], "path string, content binary")
    got = {r.path: r for r in exif.read_exif(rows).collect()}
    for k in ("j", "t"):
        r = got[k]
        assert (r.camera_make, r.iso, str(r.date_taken)) == ("Make", "400", "2021-05-06 07:08:09")
        assert abs(r.lat + 33.868888) < 1e-5 and abs(r.lon - 151.209166) < 1e-5
    assert got["none"].lat is None and got["junk"].date_taken is None


def test_remote(spark):
    doc = {"metadata": {"contents": [{"name": "a.jpg", "fileid": 1, "size": 5, "created": 9, "width": 10}, {"name": "", "fileid": 2}, {"name": "d", "isfolder": True, "contents": [{"name": "b", "fileid": 3}, {"name": "nofile"}]}]}}
    df = spark.createDataFrame([(json.dumps(doc),), ("{",), (None,)], "json string")
    got = {r.fileid: r for r in remote.remote_files(df).collect()}
    assert set(got) == {1, 3} and got[3].path == "/d/b" and got[3].parent == "d" and got[1].width == "10" and got[1].ext == "jpg"


def test_store_and_moves(spark, tmp_path):
    st = store.Store(spark, str(tmp_path / "db"))
    assert st.read("user_meta", USER_META).count() == 0
    for h in "abc":
        old = st.read("user_meta", USER_META)
        st.write("user_meta", old.unionByName(spark.createDataFrame([(h, False, 1, None, 0)], USER_META)))
    assert st.version("user_meta") == 3 and st.read("user_meta", USER_META).count() == 3
    a, b = tmp_path / "a", tmp_path / "x" / "y" / "b"
    a.write_text("1")
    moves = [(str(a), str(b))]
    assert store.carry_out(moves) == [(str(a), str(b), None)]
    assert store.carry_out(moves)[0][2] is not None
    files.write_undo_log(str(tmp_path), moves)
    assert files.read_undo_log(str(tmp_path)) == moves
    assert store.undo(moves) == (1, []) and a.exists() and not b.parent.exists()
    files.clear_undo_log(str(tmp_path))
    assert files.read_undo_log(str(tmp_path)) == []


def test_global_rank(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as k")
    assert all(r.rank == r.k + 1 for r in global_rank(df, ["k"]).collect())
