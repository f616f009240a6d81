import pytest
from pyspark.sql import functions as F

from fotolake import runtime as r
from fotolake.operators.ordering import global_rank, group_rank


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_equals_a_plain_join(spark, how):
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 50).cast("int").alias("k"), "id")
    right = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    assert r.heavy_keys(left, "k").collect() == [(7,)]
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(r.skew_join(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_filter_lets_all_ids_through_and_few_others(spark):
    ids = spark.range(0, 40000, 2).select(F.col("id").alias("k"))
    got = r.maybe_in(spark.range(40000).select(F.col("id").alias("k"), F.lit("x").alias("_x")), ids, "k")
    kept = {x.k for x in got.collect()}
    assert kept >= set(range(0, 40000, 2)) and len(kept) < 20000 * 1.15 and got.columns == ["k", "_x"]
    assert r.maybe_in(ids, ids.where("false"), "k").count() == 0
    assert (r.filter_bits(0), r.filter_bits(10**6), r.filter_bits(10**9)) == (r.LEAST_BITS, 1 << 24, r.MOST_BITS)


def test_ranks_with_one_shuffle(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 7).alias("g"))
    ranked = global_rank(df, ["k"])
    assert all(x.rank == x.k + 1 for x in ranked.collect())
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    inside = {}
    for x in group_rank(df, ["g"], [F.col("k").desc()]).collect():
        inside.setdefault(x.g, []).append((x.rank, -x.k))
    assert all(sorted(v) == list(zip(range(1, len(v) + 1), sorted(k for _, k in v))) for v in inside.values())
    assert global_rank(df.where("false"), ["k"]).count() == 0


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf(conf)
            self.sparkContext = type("C", (), {"master": master})()

    with pytest.raises(ValueError):
        r.shared_folder(Session("spark://host:7077"))
    with pytest.raises(ValueError):
        r.shared_folder(Session("local-cluster[3,2,1024]"))
    assert r.shared_folder(Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    assert r.shared_folder(Session("local[2]")).startswith("file://")
