"""Consolidating pairwise matches into groups by low-diameter decomposition.

At each level every vertex draws a start time from an exponential law; clusters grow from the
vertices that start first, one hop per round, and stop after `radius` rounds. A vertex thereby
joins the reached vertex c with the least (hops to c - head start of c). Clusters contract to
super-vertices and the edges between clusters go to the next level; few remain (about `beta` of
them, and what `radius` cut short). Composing the assignments of all levels gives the components.
Joining any vertices of one component, and mapping every edge along, keeps components as they are,
so the result is exact whatever the draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.runtime import cut, skew_join

#: Rate of the exponential head starts, and rounds of growth per level.
BETA, RADIUS = 0.02, 5
#: Edges of a vertex per salt: adjacency lists beyond this are spread over several join keys.
EDGES_PER_SALT = 50_000


def _head_start(v: str, level: int, beta: float):
    """An exponential draw per vertex and level, the same wherever and whenever it is computed."""
    u = (F.pmod(F.xxhash64(F.col(v), F.lit(level)), F.lit(1 << 52)) + F.lit(1)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(beta)


def _adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge and a self-loop per vertex: src, dst, hop, salt, salts.

    The self-loop carries the vertex's number of salts; an edge's salt is told by its far end.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    degree = both.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(EDGES_PER_SALT)).cast("int").alias("salts"))
    hubs = degree.where("salts > 1")
    loops = degree.select("src", F.col("src").alias("dst"), F.lit(0).alias("hop"), F.lit(0).alias("salt"), "salts")
    # a vertex is a hub from EDGES_PER_SALT edges on, so hubs are few; their edges are told apart by a join the planner sizes itself
    arcs = skew_join(both, hubs, "src", "left") if hubs.limit(1).count() else both.withColumn("salts", F.lit(None).cast("int"))
    arcs = arcs.select("src", "dst", F.lit(1).alias("hop"), F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dst"), F.col("salts"))).otherwise(0).cast("int").alias("salt"), F.lit(None).cast("int").alias("salts"))
    return arcs.unionByName(loops)


def _grow(adj: DataFrame, level: int, beta: float, radius: int) -> DataFrame:
    """Rounds of cluster growth: v, label, salts. One plan, as each round reads the state just once."""
    state = adj.where("hop = 0").select(F.col("src").alias("v"), (-_head_start("src", level, beta)).alias("key"), F.col("src").alias("label"), "salts")
    arcs = adj.select("src", "dst", "hop", "salt", F.col("salts").alias("own_salts"))
    for _ in range(radius):
        spread = state.select(F.col("v").alias("src"), "key", "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        seen = arcs.join(spread, ["src", "salt"])
        best = F.min(F.struct((F.col("key") + F.col("hop")).alias("key"), "label")).alias("best")
        state = seen.groupBy(F.col("dst").alias("v")).agg(best, F.max("own_salts").alias("salts")).select("v", "best.key", "best.label", "salts")
    return state.select("v", "label", "salts")


def connected_groups(pairs: DataFrame, left: str = "left_id", right: str = "right_id", *, beta: float = BETA, radius: int = RADIUS) -> DataFrame:
    """Assign every record in a pair the smallest id reachable from it: id, group_id.

    Pairs with a null end or with equal ends link nothing; repeated and turned pairs count once; an
    empty table gives no rows. Other columns are ignored.
    """
    e = pairs.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).where("l <> r")
    edges = cut(e.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        adj = cut(_adjacency(edges))
        state = cut(_grow(adj, len(levels), beta, radius))
        levels.append(state.select("v", "label"))
        # an edge's two directions meet again under the edge itself, each with the label of its source
        spread = state.select(F.col("v").alias("src"), "label", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        ends = adj.where("hop = 1").join(spread, ["src", "salt"]).groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
        edges = cut(ends.agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("a", "b").distinct())
    if not levels:
        return pairs.sparkSession.createDataFrame([], "id long, group_id long")
    # compose from the last level back: the root of each super-vertex, then of what it holds
    root = levels[-1].select("v", F.col("label").alias("root"))
    for state in reversed(levels[:-1]):
        up = root.select(F.col("v").alias("label"), "root")
        root = skew_join(state, up, "label", "left").select("v", F.coalesce("root", "label").alias("root"))
        root = cut(root)
    names = root.groupBy("root").agg(F.min("v").alias("group_id"))
    return skew_join(root, names, "root").select(F.col("v").alias("id"), "group_id")


def counted_pairs(pairs: DataFrame, media: DataFrame, near_max: int = 6) -> DataFrame:
    """Pairs that count: different ids, both of present rows, exact or at a known distance up to `near_max`."""
    p = pairs.select("left_id", "right_id", F.lower(F.trim("match_method")).alias("how"), "distance")
    p = p.where(f"left_id <> right_id and (how = 'exact' or distance <= {int(near_max)})").select("left_id", "right_id").distinct()
    present = media.where("not missing").select("id").distinct()
    return p.join(present.withColumnRenamed("id", "left_id"), "left_id", "left_semi").join(present.withColumnRenamed("id", "right_id"), "right_id", "left_semi")
