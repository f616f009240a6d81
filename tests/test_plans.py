import datetime as dt

import pytest
from pyspark.sql import functions as F

from fotolake.plans import rename
from fotolake.plans import template as t


def files(spark, *rows):
    base = {"path": "/in/IMG_0042.jpg", "name": "IMG_0042", "ext": "jpg", "parent": "in", "size": 5, "date_taken": None, "camera_model": None}
    full = [tuple((base | r)[k] for k in base) for r in rows]
    return spark.createDataFrame(full, "path string, name string, ext string, parent string, size long, date_taken timestamp, camera_model string")


def only(spark, template, **row):
    r = rename.plan(files(spark, row), template, append_ext=False).first()
    return r.rel_target if r.status != "error" else r.detail


def test_rendering(spark):
    assert only(spark, "photo_{name}") == "photo_IMG_0042"
    assert only(spark, "{ n : 03}_{name}") == "001_IMG_0042" or only(spark, "{n:03}_{name}") == "001_IMG_0042"
    assert only(spark, "{date_taken:%Y}") == "no value for {date_taken}"
    assert only(spark, "{name") == "{name"
    assert only(spark, "{nonsense}{date_taken}") == "no value for {nonsense}"
    assert only(spark, "{parent}/{camera_model}", camera_model="a/b") == "in/a_b"
    assert only(spark, "{date_taken:%Y-%m it's %H%%}", date_taken=dt.datetime(2024, 3, 2, 7)) == "2024-03 it's 07%"
    assert only(spark, "{folder}{size}") == "in5"


def test_counter_width():
    assert [t.counter_width(s) for s in (None, "", "03", "0", "00", "abc", "5")] == [0, 0, 3, 1, 2, 3, 5]
    assert t.needs_contents(t.parse("{date_taken}")) and not t.needs_contents(t.parse("{name}{date_created}"))
    with pytest.raises(ValueError):
        t.date_text(F.lit(None), "%Q")


def test_statuses(spark):
    two = files(spark, {"path": "/in/a.jpg", "name": "a"}, {"path": "/in/b.JPG", "name": "b", "ext": "JPG"}, {"path": "/in/c.jpg", "name": "c"})
    p = rename.plan(two, "same")
    assert sorted((r.rel_target, r.status) for r in p.collect()) == [("same.JPG", "ok"), ("same.jpg", "collision"), ("same.jpg", "collision")]
    assert tuple(rename.counts(p).first()) == (1, 2)
    there = spark.createDataFrame([("/out/a.jpg",), ("/in/b.JPG",)], "path string")
    q = rename.plan(two, "{name}.jpg", output_root="/out", existing=there)
    assert {r.src: (r.rel_target, r.status) for r in q.collect()} == {"/in/a.jpg": ("a.jpg", "exists"), "/in/b.JPG": ("b.jpg", "ok"), "/in/c.jpg": ("c.jpg", "ok")}
    assert rename.plan(two, "{name}", output_root="/in", existing=two.select("path")).where("status = 'ok'").count() == 3
    assert rename.plan(two.where("false"), "{name}").count() == 0
