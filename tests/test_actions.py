import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from test_sources import picture, png

from fotolake.functions import media as m
from fotolake.plans import actions, indexing, rename
from fotolake.schema import LEDGER, MEDIA, USER_META
from fotolake.sources import files, images, remote, thumbs
from fotolake.sources.store import Store


@pytest.fixture()
def library(spark, tmp_path):
    lib = tmp_path / "lib"
    (lib / "sub").mkdir(parents=True)
    for k, n in enumerate(("a.png", "sub/b.png", "sub/c.png")):
        png(lib / n, picture(k, 20 + 10 * k))
    store = Store(spark, str(tmp_path / "db"))
    indexing.index_library(store, str(lib))
    return store, lib


def rows(store):
    return {r.file_name: r for r in store.read("media", MEDIA).collect()}


def test_tagging_hashes_what_has_no_digest(spark, library):
    store, lib = library
    ids = {n: r.id for n, r in rows(store).items()}
    os.remove(lib / "sub" / "c.png")
    edits = spark.createDataFrame([(ids["a.png"], 4, True), (ids["c.png"], 5, False), (999, 1, True)], "id long, rating int, hidden boolean")
    assert actions.tag(store, edits, 7) == {"tagged": 1, "hashed": 1, "errors": 1}
    got = rows(store)
    assert got["a.png"].content_hash and got["b.png"].content_hash is None
    u = store.read("user_meta", USER_META).collect()
    assert [(r.content_hash, r.rating, r.hidden, r.updated_at) for r in u] == [(got["a.png"].content_hash, 4, True, 7)]
    # known by now: nothing is read
    again = actions.tag(store, edits.where("rating = 4").select("id").selectExpr("id", "'saved' AS kind"), 8)
    assert again == {"tagged": 1, "hashed": 0, "errors": 0}
    r = store.read("user_meta", USER_META).first()
    assert (r.rating, r.kind, r.updated_at) == (4, "saved", 8)


def test_removal_and_restore(spark, library, tmp_path):
    store, lib = library
    vault = tmp_path / "vault"
    paths = spark.createDataFrame([(str(lib / "a.png"),), (str(lib / "sub" / "b.png"),), (str(lib / "gone.png"),)], "path string")
    got = actions.remove_files(store, paths, str(vault), 5)
    assert got == {"batch": 1, "moved": 2, "failed": 1} and not (lib / "a.png").exists() and set(rows(store)) == {"c.png"}
    led = store.read("ledger", LEDGER).collect()
    assert {(r.original_path, r.batch, r.restored) for r in led} == {(str(lib / "a.png"), 1, False), (str(lib / "sub" / "b.png"), 1, False)} and all(os.path.exists(r.quarantine_path) for r in led)
    # the place of one is taken again
    (lib / "a.png").write_bytes(b"other")
    assert actions.restore_batch(store, 1) == {"restored": 1, "failed": 1}
    assert (lib / "sub" / "b.png").exists() and (lib / "a.png").read_bytes() == b"other"
    assert {r.original_path for r in store.read("ledger", LEDGER).where("not restored").collect()} == {str(lib / "a.png")}
    assert actions.restore_batch(store, 9) == {"restored": 0, "failed": 0}


def test_removal_moves_back_if_the_ledger_fails(spark, library, tmp_path, monkeypatch):
    store, lib = library
    write = store.write
    monkeypatch.setattr(store, "write", lambda t, *a, **k: (_ for _ in ()).throw(OSError("full")) if t == "ledger" else write(t, *a, **k))
    with pytest.raises(OSError):
        actions.remove_files(store, spark.createDataFrame([(str(lib / "a.png"),)], "path string"), str(tmp_path / "vault"), 5)
    assert (lib / "a.png").exists() and "a.png" in rows(store)


def test_folder_plans_open_files_only_where_the_template_asks(spark, library, monkeypatch):
    store, lib = library
    read = []
    monkeypatch.setattr(files, "contents", lambda paths: read.append(1) or contents(paths))
    contents = lambda paths: paths.selectExpr("path", "cast(null as binary) AS content")
    plan = actions.folder_plan(spark, str(lib), "{parent}_{n}")
    assert sorted(r.rel_target for r in plan.collect()) == ["lib_1.png", "sub_2.png", "sub_3.png"] and not read
    assert {r.status for r in actions.folder_plan(spark, str(lib), "{camera_model}").collect()} == {rename.ERROR} and read == [1]
    moved = actions.apply_plan(store, plan, str(lib)).collect()
    assert len(moved) == 3 and all(r.failure is None for r in moved) and set(rows(store)) == {"lib_1.png", "sub_2.png", "sub_3.png"}
    assert {r.status for r in actions.folder_plan(spark, str(lib), "{name}", output_root=str(lib / "nowhere")).collect()} == {rename.OK}


def test_a_rescan_opens_no_file_and_a_change_one(spark, library, monkeypatch):
    store, lib = library
    opened = []
    for name in ("unreadable", "contents", "digests"):
        plain = getattr(files, name)
        monkeypatch.setattr(files, name, lambda paths, plain=plain, name=name: opened.append((name, paths.count())) or plain(paths))
    assert indexing.index_library(store, str(lib))["updated"] == 0
    assert sum(n for _, n in opened) == 0
    opened.clear()
    png(lib / "a.png", picture(9, 50))
    assert indexing.index_library(store, str(lib))["updated"] == 1
    assert {n for _, n in opened} <= {0, 1} and ("contents", 1) in opened


def test_thumbnails_from_the_same_decode(spark, library, tmp_path):
    store, lib = library
    wide = np.zeros((100, 600, 3)) + np.linspace(0, 255, 600)[None, :, None] * np.array([1.0, 0.5, 0.2])
    png(lib / "wide.png", wide)
    cache = tmp_path / "thumbs"
    got = indexing.index_library(store, str(lib), cache=str(cache))
    assert (got["analysed"], got["thumbnails"]) == (1, 1) and "1 thumbnails" in indexing.summary(got)
    place = store.read("media", MEDIA).where("file_name = 'wide.png'").select(m.thumbnail_path().alias("p")).first().p
    shown = {r.path: r for r in images.read_images(spark, str(cache)).collect()}
    assert set(shown) == {str(cache / place)}
    i = next(iter(shown.values())).image
    assert (i.width, i.height) == (256, 43)
    rgb = images.pixels(i.data, i.height, i.width, i.nChannels)
    assert np.abs(rgb - images.resized(wide.astype(np.uint8).astype(np.float32), 256, 43)).mean() < 2.5
    missing = indexing.thumbnails_missing(store.read("media", MEDIA), spark.createDataFrame([(place,)], "place string"))
    assert missing.count() == 3
    assert thumbs.clear_cache(str(cache)) > 500 and os.listdir(cache) == [] and thumbs.clear_cache(str(tmp_path / "none")) == 0


def test_jpeg_of_any_size(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for h, w in ((1, 1), (8, 8), (17, 9), (64, 50)):
        want[f"{h}x{w}"] = rng.integers(0, 256, (h, w, 3)).astype(np.float32)
        # noise loses about 0.29 of a step per coefficient: steps of 2 to 16 here
        (tmp_path / f"{h}x{w}.jpg").write_bytes(thumbs.encode_jpeg(want[f"{h}x{w}"], quality=2))
    got = images.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 4
    for r in got:
        rgb = images.pixels(r.image.data, r.image.height, r.image.width, r.image.nChannels)
        assert np.abs(rgb - want[os.path.basename(r.path)[:-4]]).mean() < 6
    with pytest.raises(ValueError):
        thumbs.encode_jpeg(want["8x8"], quality=1)


def test_display_pixels(spark, tmp_path):
    png(tmp_path / "a.png", picture(0, 64))
    small = thumbs.display_pixels(images.read_images(spark, str(tmp_path)), edge=16).first()
    assert (small.width, small.height, len(small.rgba)) == (16, 16, 16 * 16 * 4)
    whole = thumbs.display_pixels(images.read_images(spark, str(tmp_path))).first()
    rgba = np.frombuffer(bytes(whole.rgba), np.uint8).reshape(64, 64, 4)
    assert (rgba[..., :3] == picture(0, 64)).all() and (rgba[..., 3] == 255).all()


def test_remote_calls(spark):
    tree = {"result": 0, "metadata": {"contents": [{"name": "a.jpg", "fileid": 1, "size": 5}, {"name": "d", "isfolder": True, "contents": [{"name": "b.jpg", "fileid": 2}]}]}}
    seen = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            u = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(u.query).items()}
            seen.append((u.path[1:], q))
            bad = q.get("fileid") == "2" or q.get("token") != "t"
            body = json.dumps({"result": 2009, "error": "no such file"} if bad else tree).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        call = remote.http_call(base, {"token": "t"})
        assert {r.path for r in remote.list_remote(spark, call, "/lib").collect()} == {"/lib/a.jpg", "/lib/d/b.jpg"}
        assert seen[0] == ("listfolder", {"path": "/lib", "timeformat": "timestamp", "recursive": "1", "token": "t"})
        with pytest.raises(OSError):
            remote.list_remote(spark, remote.http_call(base, {}))
        seen.clear()
        done = remote.apply_remote(call, [(1, "/lib/a.jpg", "/x/y/a.jpg"), (2, "/lib/d/b.jpg", "/x/y/b.jpg"), (3, "/lib/c", "/c")])
        assert [r[3] for r in done] == [None, "2009: no such file", None]
        assert [(s, q.get("path") or q.get("topath")) for s, q in seen] == [("createfolderifnotexists", "/x"), ("createfolderifnotexists", "/x/y"), ("renamefile", "/x/y/a.jpg"), ("renamefile", "/x/y/b.jpg"), ("renamefile", "/c")]
        assert [r[:3] for r in remote.undo_remote(call, done)] == [(3, "/c", "/lib/c"), (1, "/x/y/a.jpg", "/lib/a.jpg")]
    finally:
        server.shutdown()
