from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.operators import ordering as o


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_human_bytes(spark):
    cases = {0: "0 B", 512: "512 B", 1024: "1.0 KB", 1536: "1.5 KB", 1048576: "1.0 MB", 3 << 30: "3.0 GB", 5 << 50: "5120.0 TB"}
    rows = spark.createDataFrame([(k,) for k in cases], "b long").select("b", m.human_bytes("b").alias("t")).collect()
    assert {r.b: r.t for r in rows} == cases


def test_coordinates(spark):
    assert one(spark, m.coords_text(), lat=51.5074, lon=-0.1278) == "51.50740°N, 0.12780°W"
    assert one(spark, m.coords_text(), lat=None, lon=1.0) is None
    assert abs(one(spark, m.degrees_of(F.lit(33.0), F.lit(30.0), F.lit(36.0), F.lit("s"))) + 33.51) < 1e-9


def test_hue_order(spark):
    colours = [0x808080, 0x00FF00, None, 0x0000FF, 0xFF0000]
    df = spark.createDataFrame([(c,) for c in colours], "dom_color int")
    assert [r[0] for r in df.orderBy(m.hue_key()).collect()] == [0xFF0000, 0x00FF00, 0x0000FF, 0x808080, None]
    k = {r[0]: r[1] for r in df.select("dom_color", m.hsl()["h"]).collect()}
    assert (k[0xFF0000], k[0x00FF00], k[0x0000FF], k[0x808080]) == (0, 120, 240, 0)
    near = spark.createDataFrame([(130 << 16 | 128 << 8 | 126,), (220 << 16 | 20 << 8 | 20,)], "dom_color int").select(m.hue_key()["bucket"]).collect()
    assert [r[0] for r in near] == [1, 0]


def test_kinds(media):
    rows = media(
        {"file_name": "Screenshot 1.png", "camera_model": "x"}, {"camera_model": "x", "width": 1920, "height": 1080}, {"width": 1080, "height": 1920}, {"width": 2532, "height": 1170},
        {"width": 1000, "height": 1000}, {"date_taken": 5}, {"width": 1920},
    )
    got = [r[0] for r in rows.orderBy("id").select(m.classified_kind()).collect()]
    assert got == ["screenshot", "photo", "screenshot", "screenshot", "saved", "photo", "saved"]


def test_path_parts(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("/.bashrc",), ("name",), ("/a/b.",)], "path string")
    got = [tuple(r) for r in df.select(m.stem(), m.extension(), m.parent_name()).collect()]
    assert got == [("b.tar", "gz", "a"), (".bashrc", "", ""), ("name", "", ""), ("b", "", "a")]
    assert [one(spark, m.normalized_dir(F.lit(x))) for x in ("/", "", "Camera", "/Camera/", " /a/b/ ")] == ["/", "/", "/Camera", "/Camera", "/a/b"]
    assert one(spark, m.sanitized(F.lit('a/b:c*"'))) == "a_b_c__"


def test_hamming(spark):
    for a, b, d in ((0, 0, 0), (0b1011, 0b1001, 1), (-1, 0, 64)):
        assert one(spark, m.hamming(F.lit(a), F.lit(b))) == d


def test_orders_and_shuffle(spark, media):
    rows = media({"path": "/l/a.jpg"}, {"path": "/l/a/b.jpg"}, {"path": "/k/z.jpg", "size": 500})
    assert [r.id for r in o.ranked(rows, "path").orderBy("rank").collect()] == [3, 2, 1]
    assert [r.id for r in o.ranked(rows, "size").orderBy("rank").collect()] == [3, 2, 1]
    assert o.ranked(rows.where("false"), "size").count() == 0
    for seed in (1, 2, 42, 9999, 0):
        p = o.seeded_permutation(100, seed)
        assert sorted(p) == list(range(100)) and p == o.seeded_permutation(100, seed) and p != list(range(100))
    assert sorted(r.rank for r in o.shuffled(rows, 7).collect()) == [1, 2, 3]


def test_cursor():
    c = o.Cursor([5, 6, 7])
    assert (c.step(-1), c.step(), c.step()) == (7, 5, 6)
    c.resequence([7, 6])
    assert c.current == 6
    c.resequence([9])
    assert c.current == 9
    assert o.Cursor([]).step() is None


def test_images_filter(media, spark):
    rows = media({"path": "/lib/Holiday/IMG_1.jpg", "camera_model": "x"}, {"path": "/lib/Holiday/IMG_2.jpg", "camera_model": "x"}, {"path": "/lib/x.jpg", "camera_model": "x"})
    rows = rows.withColumn("kind", F.lit(None).cast("string")).withColumn("rating", F.when(F.col("id") == 2, 3).otherwise(5))
    assert [r.id for r in o.visible_images(rows, text=" holiday ", min_rating=5, kinds=["photo"]).collect()] == [1]


def test_filter_of_fixed_size_loses_nothing(spark, monkeypatch):
    import fotolake.runtime as r

    for bits in (64, 1 << 22):
        monkeypatch.setattr(r, "FILTER_BITS", bits)
        rows = spark.range(500).withColumn("text", F.lit("x"))
        ids = spark.createDataFrame([(k,) for k in (3, 99, 10_000)], "id long")
        got = {x.id for x in r.maybe_in(rows, ids, "id").collect()}
        assert {3, 99} <= got and len(got) < 500
        assert r.maybe_in(rows, ids.where("false"), "id").count() == 0


def test_skew_join_equals_join(spark):
    from fotolake.runtime import skew_join

    left = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id % 50) as k", "id", "'l' as x").unionByName(spark.createDataFrame([(None, 1, "l")], "k long, id long, x string"))
    right = spark.createDataFrame([(7, "a"), (8, "b"), (999, "c")], "k long, y string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, skew_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
