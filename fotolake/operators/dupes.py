"""Duplicate groups: exact, near and burst; keepers, reclaimable space and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotolake.functions import media as m
from fotolake.operators.similarity import components, hamming_pairs
from fotolake.runtime import cut, skew_join

EXACT, NEAR, BURST = "exact", "near", "burst"
LABELS = {EXACT: "identical", NEAR: "similar", BURST: "burst"}
SLICE_S = 86_400


def keeper_key() -> Column:
    """Least is best: more pixels, larger file, older, shorter path in bytes, path."""
    pixels = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(0))
    return F.struct((-pixels).alias("p"), (-F.col("size")).alias("s"), F.col("mtime").alias("t"), F.octet_length("path").alias("l"), F.col("path").alias("path"), F.col("id").alias("id"))


def _scope(rows: DataFrame, by_kind: bool) -> DataFrame:
    return rows.withColumn("scope", m.effective_kind() if by_kind else F.lit("all"))


def exact_members(rows: DataFrame, by_kind: bool = False) -> DataFrame:
    """Members of exact groups: dup_kind, scope, group_key (the digest) and the row. Counted per digest before the rows are touched."""
    r = _scope(rows, by_kind).where("content_hash is not null").withColumn("group_key", F.col("content_hash"))
    several = r.groupBy("scope", "group_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("scope", "group_key")
    return r.join(several, ["scope", "group_key"], "left_semi").withColumn("dup_kind", F.lit(EXACT))


def _not_all_same(members: DataFrame) -> DataFrame:
    """Leave out groups whose members all have one known digest: they are exact groups already."""
    h = F.col("content_hash")
    keys = ["scope", "group_key"]
    mixed = members.groupBy(*keys).agg(F.count(h).alias("_k"), F.count(F.lit(1)).alias("_n"), F.min(h).alias("_a"), F.max(h).alias("_b"))
    mixed = mixed.where("_n > 1 and not (_k = _n and _a = _b)").select(*keys)
    return members.join(mixed, keys, "left_semi")


def near_pairs(rows: DataFrame, threshold: int = 6, by_kind: bool = False) -> DataFrame:
    """Pairs of hash classes within the threshold (distance 0 is membership of one class): scope, a, b, distance."""
    return hamming_pairs(_scope(rows, by_kind), threshold, scope="scope")


def near_members(rows: DataFrame, threshold: int = 6, by_kind: bool = False) -> DataFrame:
    """Members of near groups: rows linked directly or through others, groups of identical files left out."""
    # the rows are needed several times and may come from costly joins: computed once
    rows = cut(rows.withColumn("kind", m.known_kind("kind")).where("phash is not null"))
    r = _scope(rows, by_kind)
    # a vertex is a hash within its scope; its class name is the least row id, so labels are ids
    names = cut(r.groupBy("scope", "phash").agg(F.min("id").alias("name")))
    p = near_pairs(rows, threshold, by_kind)
    p = p.join(names.withColumnsRenamed({"phash": "a", "name": "na"}), ["scope", "a"]).join(names.withColumnsRenamed({"phash": "b", "name": "nb"}), ["scope", "b"])
    roots = components(p.select("na", "nb"), "na", "nb")
    labelled = names.join(roots.withColumnRenamed("v", "name"), "name", "left").select("scope", "phash", F.coalesce("root", "name").alias("root"))
    out = r.join(labelled, ["scope", "phash"]).withColumn("group_key", F.col("root").cast("string")).drop("root")
    return cut(_not_all_same(cut(out)).withColumn("dup_kind", F.lit(NEAR)).select(*_member_cols(rows)))


def _member_cols(rows: DataFrame) -> list[str]:
    return ["scope", "group_key", *rows.columns, "dup_kind"]


def burst_members(rows: DataFrame, window_s: int = 2, by_kind: bool = False) -> DataFrame:
    """Members of bursts: shots of one camera (null and blank are one) with gaps up to `window_s`.

    Times are cut into slices; the run number inside a slice and the links between neighbouring
    slices come apart, so no camera's whole history is one window.
    """
    r = _scope(rows, by_kind).where("date_taken is not null").withColumn("_cam", F.coalesce("camera_model", F.lit("")))
    slice_s = max(SLICE_S, window_s)
    r = r.withColumn("_slice", F.expr(f"cast(floor(date_taken / {slice_s}) as long)"))
    secs = r.select("scope", "_cam", "_slice", F.col("date_taken").alias("t")).distinct()  # at most a node per second
    w = Window.partitionBy("scope", "_cam", "_slice").orderBy("t")
    secs = secs.withColumn("_new", F.when(F.col("t") - F.lag("t").over(w) <= window_s, 0).otherwise(1))
    secs = cut(secs.withColumn("_run", F.sum("_new").over(w)))
    runs = secs.groupBy("scope", "_cam", "_slice", "_run").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    ends = runs.groupBy("scope", "_cam", "_slice").agg(F.max_by("a", "b").alias("la"), F.max("b").alias("lb"))
    joins = runs.where("_run = 1").join(ends.select("scope", "_cam", (F.col("_slice") + 1).alias("_slice"), "la", "lb"), ["scope", "_cam", "_slice"]).where(f"a - lb <= {int(window_s)}")
    # runs that touch across slices: components over runs, named by what they are
    name = lambda start: F.struct("scope", "_cam", F.col(start).alias("start"))
    roots = components(joins.select(name("a").alias("x"), name("la").alias("y")), "x", "y")
    runs = runs.withColumn("v", name("a")).join(roots, "v", "left").select("scope", "_cam", "_slice", "_run", F.coalesce("root", "v")["start"].alias("root"))
    named = cut(secs.join(runs, ["scope", "_cam", "_slice", "_run"]).select(F.struct("scope", "_cam", F.col("t").alias("date_taken")).alias("_second"), "root"))
    # a camera's rows of one second may be any number
    r = cut(r.drop("_slice").withColumn("_second", F.struct("scope", "_cam", "date_taken")))
    out = skew_join(r, named, "_second").withColumn("group_key", F.concat(F.col("root").cast("string"), F.lit(" "), "_cam"))
    return _not_all_same(out).withColumn("dup_kind", F.lit(BURST)).select(*_member_cols(rows))


def member_order(members: DataFrame) -> DataFrame:
    """Members with their `place` in the group, by path; ranked over all tasks, so no group is one."""
    from fotolake.operators.ordering import group_rank

    keys = ["dup_kind", "scope", "group_key"]
    return group_rank(members.select(*keys, "id", "path"), keys, [m.path_order()], "place")


def with_keeper(members: DataFrame) -> DataFrame:
    """Add `is_keeper` and `keeper_id`. The least key is aggregated map-side; no group is sorted."""
    keys = ["dup_kind", "scope", "group_key"]
    best = members.groupBy(*keys).agg(F.min(keeper_key())["id"].alias("keeper_id"))
    return members.join(best, keys).withColumn("is_keeper", F.col("id") == F.col("keeper_id"))


def spreads(members: DataFrame) -> DataFrame:
    """Greatest distance between any two members with a hash, per group: dup_kind, scope, group_key, spread.

    Two passes over the group find its centre (the majority of each bit) and a distance it surely
    has: from the hash farthest from the centre to the one farthest from that. Two hashes can only be
    farther apart if their distances from the centre sum to more, so only the outer ones are compared
    with each other, spread over salts. Exact.
    """
    keys = ["dup_kind", "scope", "group_key"]
    h = cut(members.where("phash is not null").select(*keys, "phash").distinct())
    ones = [F.sum(F.getbit("phash", F.lit(i)).cast("long")).alias(f"_{i}") for i in range(64)]
    bits = [F.when(F.col(f"_{i}") * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    centre = bits[0]
    for bit in bits[1:]:
        centre = centre.bitwiseOR(bit)
    centres = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *ones).where("_n > 1").select(*keys, centre.alias("_c"))
    h = cut(h.join(centres, keys).withColumn("_r", m.hamming("phash", "_c")))
    outer = h.groupBy(*keys).agg(F.max(F.struct("_r", "phash")).alias("_o")).select(*keys, F.col("_o._r").alias("_top"), F.col("_o.phash").alias("_q"))
    reached = h.join(outer, keys).groupBy(*keys, "_top").agg(F.max(m.hamming("phash", "_q")).alias("_least"))
    h = cut(h.join(reached, keys).where("_r + _top > _least").select(*keys, "phash", "_r", "_least"))
    salts = 16
    left = h.withColumn("_s", F.pmod(F.xxhash64("phash"), F.lit(salts)).cast("int"))
    right = h.select(*keys, F.col("phash").alias("other"), F.col("_r").alias("_q"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("_s"))
    wider = left.join(right, [*keys, "_s"]).where("phash < other and _r + _q > _least").groupBy(*keys).agg(F.max(m.hamming("phash", "other")).alias("_far"))
    return reached.join(wider, keys, "left").select(*keys, F.greatest("_least", "_far").alias("spread"))


def groups(members: DataFrame) -> DataFrame:
    """One row per group: dup_kind, scope, group_id (least member id), n, keeper_id, bytes, reclaimable, spread, first_path."""
    keys = ["dup_kind", "scope", "group_key"]
    g = members.groupBy(*keys).agg(
        F.min("id").alias("group_id"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min(keeper_key()).alias("_k"), F.min(m.path_order()).alias("_p")
    )
    g = g.join(spreads(members.where(F.col("dup_kind") == NEAR)), keys, "left")
    return g.select("dup_kind", "scope", "group_id", "n", F.col("_k.id").alias("keeper_id"), "bytes", (F.col("bytes") + F.col("_k.s")).alias("reclaimable"), F.coalesce("spread", F.lit(0)).alias("spread"), F.concat_ws("/", "_p").alias("first_path"))


def all_members(rows: DataFrame, *, threshold: int = 6, window_s: int = 2, find: tuple[str, ...] = (EXACT, NEAR), by_kind: bool = True) -> DataFrame:
    """Members of all kinds of groups asked for: a file may be in an exact and a near group."""
    parts = {EXACT: lambda: exact_members(rows, by_kind), NEAR: lambda: near_members(rows, threshold, by_kind), BURST: lambda: burst_members(rows, window_s, by_kind)}
    chosen = [parts[k]().select(*_member_cols(rows)) for k in find]
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionByName(c)
    return out


def report(members: DataFrame) -> DataFrame:
    """Groups in report order: kind, then most reclaimable, then first path; adds `rank`."""
    from fotolake.operators.ordering import global_rank

    kind = F.array_position(F.array(*[F.lit(k) for k in (EXACT, NEAR, BURST)]), F.col("dup_kind"))
    return global_rank(groups(members), [kind, F.col("reclaimable").desc(), F.split("first_path", "/"), F.col("group_id"), F.col("scope")])


def totals(grouped: DataFrame) -> DataFrame:
    """Per kind: groups, reclaimable bytes and removable files (a file in two groups counts twice)."""
    return grouped.groupBy("dup_kind").agg(F.count(F.lit(1)).alias("groups"), F.sum("reclaimable").alias("reclaimable"), F.sum(F.col("n") - 1).alias("removable"))


def removal_selection(members: DataFrame, kinds: tuple[str, ...] = (EXACT,)) -> DataFrame:
    """Rows to move away by default: all but the keeper of each group of the kinds, each row once."""
    return with_keeper(members.where(F.col("dup_kind").isin(*kinds))).where("not is_keeper").select("id", "path", "size").distinct()
