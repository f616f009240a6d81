"""Exact similarity join of 64-bit hashes within a Hamming radius, and components of its pairs."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions.media import hamming
from fotolake.operators.scan import scan_pairs
from fotolake.runtime import cut, skew_join

#: What a candidate pair costs, as a share of what a key costs on both sides of the shuffle.
PAIR_COST = 0.05
#: Cost a hash, in keys, beyond which the join is left for a scan, which shuffles no keys.
MOST_COST = 150


def join_cost(n: int, blocks: int, agree: int) -> float:
    """Cost a hash of joining n evenly spread hashes: its keys, plus the candidates they meet."""
    return comb(blocks, agree) * (1 + PAIR_COST * n / 2 ** (64 * agree / blocks))


def choose_blocks(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agreeing): hashes within `radius` agree on at least blocks - radius of the blocks.

    More agreeing blocks make longer keys, so fewer candidates, at more keys per hash. Taken is what
    costs least for n hashes: the keys, plus the candidates that evenly spread hashes would give. No
    number of keys is ruled out, so keys grow with n for every radius.
    """
    best, least = (radius + 1, 1), float("inf")
    for agree in range(1, 64 - radius):
        blocks = radius + agree
        if comb(blocks, agree) >= least:
            break
        cost = join_cost(n, blocks, agree)
        if cost < least:
            best, least = (blocks, agree), cost
    return best


def hamming_pairs(hashes: DataFrame, radius: int, *, scope: str | None = None) -> DataFrame:
    """Pairs of distinct hashes within `radius`: (scope,) a, b, distance with a < b.

    `hashes(phash[, scope])`; null hashes are left out, equal ones collapse first, so copies never
    multiply. Two hashes within the radius agree on `agree` of the blocks somewhere, so an equi-join
    on each choice of blocks finds all pairs; a pair is kept only at its first agreeing choice,
    which spares a distinct. A key many hashes share (blocks of zeros) is split by the planner's
    skew handling, as both sides are shuffled joins. At wide radii no choice of few blocks is
    selective (at 12, hundreds of keys a hash): there the hashes are scanned in arrays instead,
    which moves no keys and gives the same exact pairs.
    """
    keep = [scope] if scope else []
    h = hashes.where("phash is not null").select("phash", *keep).distinct()
    h = cut(h)
    n = max(1, h.count())
    blocks, agree = choose_blocks(n, radius)
    if join_cost(n, blocks, agree) > MOST_COST:
        return scan_pairs(h, n, radius, scope=scope)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    choices = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), agree)]
    # the choices are one literal array, so hundreds of them are no hundreds of expressions
    every = F.lit(choices).cast("array<bigint>")
    keyed = h.select(*keep, F.col("phash"), F.posexplode(F.transform(every, lambda c: F.col("phash").bitwiseAND(c))).alias("choice", "key"))
    a = keyed.withColumnRenamed("phash", "a")
    b = keyed.withColumnRenamed("phash", "b")
    met = a.join(b, [*keep, "choice", "key"]).where("a < b").withColumn("distance", hamming("a", "b")).where(F.col("distance") <= radius)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # the pairs left are true ones: few, so a search through the choices costs little
    first = F.array_position(F.transform(every, lambda c: differ.bitwiseAND(c) == 0), True) - 1
    return met.where(F.col("choice") == first).select(*keep, "a", "b", "distance")


#: Edges of a vertex per salt: adjacency lists beyond this are spread over several join keys.
EDGES_PER_SALT = 50_000


def salted_arcs(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Both directions of each edge and a self-loop per vertex: src, dst, hop, salt, salts.

    The self-loop carries the vertex's number of salts; an edge's salt is told by its far end, so a
    hub's edges are joined under many keys.
    """
    both = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst")))
    degree = both.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / F.lit(EDGES_PER_SALT)).cast("int").alias("salts"))
    hubs = degree.where("salts > 1")
    loops = degree.select("src", F.col("src").alias("dst"), F.lit(0).alias("hop"), F.lit(0).alias("salt"), "salts")
    arcs = skew_join(both, hubs, "src", "left") if hubs.limit(1).count() else both.withColumn("salts", F.lit(None).cast("int"))
    arcs = arcs.select("src", "dst", F.lit(1).alias("hop"), F.when(F.col("salts") > 1, F.pmod(F.xxhash64("dst"), F.col("salts"))).otherwise(0).cast("int").alias("salt"), F.lit(None).cast("int").alias("salts"))
    return arcs.unionByName(loops)


def under_salts(state: DataFrame, vertex: str, *values: str) -> DataFrame:
    """`state(vertex, salts, ...)` once per salt of the vertex, to meet the arcs of `salted_arcs`: src, salt, values."""
    return state.select(F.col(vertex).alias("src"), *values, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))


def components(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 4) -> DataFrame:
    """Connected components of pairs: v, root (the least value reachable). Null ends link nothing.

    Contraction by random priorities: for a few rounds every vertex takes over the best priority
    around it, then vertices that follow the same one contract and the remaining pairs go to the
    next level. Each round reads the state once, so a level's rounds are one plan; its aggregation
    is partly done before the shuffle, and a hub's edges are joined under many salts.
    """
    edges = cut(pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct())
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        arcs = cut(salted_arcs(edges, "x", "y"))
        state = arcs.where("hop = 0").select("src", F.xxhash64("src", F.lit(len(levels))).alias("key"), F.col("src").alias("label"), "salts")
        moves = arcs.select("src", "dst", "salt", F.col("salts").alias("own"))
        for _ in range(rounds):
            best = F.min(F.struct("key", "label")).alias("best")
            met = moves.join(under_salts(state, "src", "key", "label"), ["src", "salt"])
            state = met.groupBy(F.col("dst").alias("src")).agg(best, F.max("own").alias("salts")).select("src", "best.key", "best.label", "salts")
        state = cut(state.select("src", "label", "salts"))
        levels.append(state.select(F.col("src").alias("v"), "label"))
        ends = arcs.where("hop = 1").join(under_salts(state, "src", "label"), ["src", "salt"]).groupBy(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"))
        edges = cut(ends.agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("x", "y").distinct())
    if not levels:
        return pairs.select(F.col(a).alias("v"), F.col(b).alias("root")).where("false")
    root = levels[-1].withColumnRenamed("label", "root")
    for below in reversed(levels[:-1]):
        up = root.select(F.col("v").alias("label"), "root")
        root = cut(skew_join(below, up, "label", "left").select("v", F.coalesce("root", "label").alias("root")))
    names = cut(root.groupBy("root").agg(F.min("v").alias("least")))
    return skew_join(root, names, "root").select("v", F.col("least").alias("root"))
