"""Session, table access and lineage helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "fotolake", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, skew handling)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a folder of this machine serves a local session; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="fotolake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=eager)


def slots(spark: SparkSession) -> int:
    """Tasks worth planning for: the shuffle width, never below the cores at hand."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def distinct_rows(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.select(*cols).distinct()


#: A key is heavy when it holds more than one in HEAVY_PARTS of the rows; so there are fewer than HEAVY_PARTS heavy keys.
HEAVY_PARTS = 2_000


def heavy_keys(left: DataFrame, key: str) -> DataFrame:
    """Keys holding over 1/HEAVY_PARTS of the rows of `left` (fewer than HEAVY_PARTS keys by construction).

    `left` is read once: the counts per key are shuffled once and their sum reuses that exchange.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    heavy = F.col("_n") > F.greatest(F.expr(f"_all div {HEAVY_PARTS}"), F.lit(1_000))
    return counts.crossJoin(F.broadcast(total)).where(heavy & F.col(key).isNotNull()).select(key)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """Join where `left` may hold a third of its rows under one key and `right` is unique by key.

    Rows of `right` under a heavy key number fewer than HEAVY_PARTS, so they are broadcast; the
    other keys hold at most 1/HEAVY_PARTS of the rows each and go through an ordinary shuffle, rows
    with a null key through none. `how` is inner, left or left_semi. `heavy` gives the heavy keys
    where the caller has counted. Both sides are read more than once (`left` three times, `right`
    twice), so they should be tables or cut.
    """
    heavy = cut(heavy_keys(left, key) if heavy is None else heavy.select(key))
    if how != "left" and heavy.isEmpty():
        return left.join(right, key, how)
    bound = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    marked = left.join(bound, key, "left")
    # a left join keeps rows without a key; with the hot ones they stay where they are
    hot = marked.where("_heavy" if how != "left" else f"_heavy or `{key}` is null").drop("_heavy")
    cold = marked.where(f"_heavy is null and `{key}` is not null").drop("_heavy")
    hot_right = F.broadcast(right.join(F.broadcast(heavy), key, "left_semi"))
    return hot.join(hot_right, key, how).unionByName(cold.join(right, key, how))


#: Bits per id of the filter in `maybe_in` (about one row in twelve gets through by chance), and its bits at least and at
#: most; broadcast as one row of two longs per 64 bits, so under 40 MB.
BITS_PER_ID, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 27


def filter_bits(ids: int) -> int:
    """Bits of a filter over so many ids: a power of two, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ID * max(ids, 1) - 1).bit_length()))


def maybe_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of `df` whose key may be in `ids` (all that are, and a few more), told by a bitmap sized by the number of ids.

    Spares wide rows a shuffle before an exact join. `ids` is counted, so it should be cut. Beyond
    MOST_BITS / BITS_PER_ID ids (11 million) the bitmap grows no more and lets more rows through,
    which costs that shuffle and nothing else.
    """
    bits = filter_bits(ids.count())
    spot = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.expr("shiftleft(1L, cast(_spot % 64 as int))")
    words = ids.select(spot.alias("_spot")).groupBy(F.expr("_spot div 64").alias("_word")).agg(F.bit_or(at).alias("_bits"))
    seen = df.withColumn("_spot", spot).withColumn("_word", F.expr("_spot div 64")).join(F.broadcast(words), "_word")
    return seen.where(F.col("_bits").bitwiseAND(at) != 0).select(*df.columns)
