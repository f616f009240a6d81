"""Near-duplicates of new batches against all history, through navigable small-world graphs.

History is kept as index shards, one graph per segment or part of it. Within a shard every code
(64-bit perceptual hash) links to its closest codes among those inserted before it, and back; a
search walks the graph with a beam, starting from the best of a fixed sample of entry codes. The
beam of each shard is widened until its answers reach the target recall against exhaustive search
of that shard on probes made from its own codes; where none does, the shard is searched
exhaustively. Hits are ranked by the exact distance. A new batch is searched in the shards and then
becomes a shard of its own; `compact` rebuilds small shards into full ones.

A segment of up to REGION_FROM shards is cut by hash, and a query meets all its shards. A larger one
is cut by code region instead: each code is filed under the first bits of each of radius + 1 blocks
of its bits, so two codes within the radius share a region somewhere, and a query meets just the
shards of its own radius + 1 regions, however many shards there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.runtime import cut, maybe_in, skew_join, slots

#: Codes per shard, links given per code (kept up to twice as many), entry codes, codes expanded per step.
SHARD_CODES, LINKS, ENTRIES, EXPAND = 196_608, 24, 4_096, 8
#: Beams tried in turn, the recall to reach, probes per shard.
BEAMS, TARGET_RECALL, PROBES = (32, 48, 64, 96, 128, 192, 256, 384), 0.995, 512
BUILD_BEAM, BATCH = 48, 1_024
#: Shards of a segment from which it is cut by code region; queries compared with a shard in one task.
REGION_FROM, BLOCK_QUERIES = 32, 32_768
#: Tasks a build is spread over at most.
MOST_TASKS = 100_000
#: The segment of history; small shards an index holds before they are compacted.
FIRST, MOST_SMALL = -(1 << 31), 16
#: Stands for a search of all codes, where no beam reaches the target; queries compared at once in it.
EXHAUSTIVE, FEW = 0, 16
_U = np.uint32
_FAR = _U(0xFFFFFFFF)
_ID = _U(0x1FFFFFF)  # a beam cell is distance (7 bits), number (24 bits), expanded (1 bit)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def beam_search(q: np.ndarray, codes: np.ndarray, links: np.ndarray, n: int, beam: int) -> np.ndarray:
    """The closest codes found for each query among the first `n`: cells sorted by distance."""
    e = min(n, ENTRIES)
    cells = hamming(q[:, None], codes[None, :e]).astype(_U) << _U(25)
    cells |= np.arange(e, dtype=_U) << _U(1)
    if e > beam:
        cells.partition(beam - 1, axis=1)
        cur = cells[:, :beam].copy()
    else:
        cur = np.full((len(q), beam), _FAR, _U)
        cur[:, :e] = cells
    cur.sort(axis=1)
    out, active = cur.copy(), np.arange(len(q))
    width = links.shape[1]
    room = np.empty((len(q), beam + EXPAND * width), _U)
    while len(active):
        todo = np.where((cur & _U(1)) == 0, cur, _FAR)
        todo.partition(EXPAND - 1, axis=1)
        todo = todo[:, :EXPAND]
        alive = (todo != _FAR).any(axis=1)
        if not alive.all():
            out[active[~alive]] = cur[~alive]
            active, cur, q, todo = active[alive], cur[alive], q[alive], todo[alive]
            if not len(active):
                break
        cur[cur <= todo.max(axis=1)[:, None]] |= _U(1)  # the best not yet expanded are those up to the last of them
        none = todo == _FAR
        near = links.take(np.where(none, 0, (todo & _ID) >> _U(1)), axis=0)
        every = room[: len(active)]
        every[:, :beam] = cur
        new = every[:, beam:].reshape(len(active), EXPAND, width)
        np.left_shift(hamming(codes.take(near), q[:, None, None]), _U(25), out=new, dtype=_U, casting="unsafe")
        new |= near.view(_U) << _U(1)
        new[none] = _FAR
        every.sort(axis=1)
        twice = (every[:, 1:] ^ every[:, :-1]) <= 1  # same code: the expanded cell sorts last and stays
        every[:, :-1][twice] = _FAR
        every.partition(beam - 1, axis=1)
        cur = every[:, :beam].copy()
    out.sort(axis=1)
    return out


def both_ways(codes: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """The graph to search: each code's own links and those back to it, the closest 2 x LINKS of them."""
    n, width = len(codes), 2 * LINKS
    a = np.repeat(np.arange(n, dtype=np.uint64), forward.shape[1])
    b = forward.ravel().astype(np.uint64)
    a, b = a[a != b], b[a != b]
    far = hamming(codes[a.astype(np.intp)], codes[b.astype(np.intp)]).astype(np.uint64) << np.uint64(25)
    key = np.concatenate([(a << np.uint64(32)) | far | b, (b << np.uint64(32)) | far | a])
    del a, b, far
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]]
    node = (key >> np.uint64(32)).astype(np.int32)
    start = np.concatenate(([True], node[1:] != node[:-1]))[: len(node)]
    place = np.arange(len(key), dtype=np.int32)
    place -= np.maximum.accumulate(np.where(start, place, 0))
    keep = place < width
    links = np.repeat(np.arange(n, dtype=np.int32)[:, None], width, axis=1)
    links[node[keep], place[keep]] = (key[keep] & np.uint64(0x1FFFFFF)).astype(np.int32)
    return links


def build_graph(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own links, links both ways) of each code; its own number fills free places.

    Only the own links are stored: the others follow from them (`both_ways`).
    """
    total, width = len(codes), 2 * LINKS
    forward = np.repeat(np.arange(total, dtype=np.int32)[:, None], LINKS, axis=1)
    links = np.repeat(np.arange(total, dtype=np.int32)[:, None], width, axis=1)
    n = min(total, 256)
    d = hamming(codes[:n, None], codes[None, :n]).astype(np.int64)
    np.fill_diagonal(d, 99)
    first = np.argsort(d, axis=1, kind="stable")[:, : min(LINKS, n - 1)]
    links[:n, : first.shape[1]] = forward[:n, : first.shape[1]] = first
    while n < total:
        m = min(total, n + n // 2 + 1, n + 8_192)
        for s in range(n, m, BATCH):
            got = beam_search(codes[s : min(m, s + BATCH)], codes, links, n, BUILD_BEAM)
            forward[s : min(m, s + BATCH)] = links[s : min(m, s + BATCH), :LINKS] = (got[:, :LINKS] & _ID) >> _U(1)
        # links back, the closest kept
        src, dst = np.repeat(np.arange(n, m), LINKS), links[n:m, :LINKS].ravel().astype(np.int64)
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        node, start = np.unique(dst, return_index=True)
        count = np.diff(np.append(start, len(dst)))
        back = np.repeat(node[:, None], count.max(), axis=1)
        back[np.repeat(np.arange(len(node)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
        cand = np.concatenate([links[node].astype(np.int64), back], axis=1)
        far = hamming(codes[node][:, None], codes[cand]).astype(np.int64)
        far[cand == node[:, None]] = 99
        key = (far << 32) | cand
        key.sort(axis=1)
        links[node] = key[:, :width] & 0xFFFFFFFF
        n = m
    return forward, links


def within(q: np.ndarray, codes: np.ndarray, links: np.ndarray, beam: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, code number) at most `radius` apart. A beam filled with hits is widened, so it caps no answer.

    The beam EXHAUSTIVE compares every code instead.
    """
    qs, ns = [], []
    if beam == EXHAUSTIVE:
        for s in range(0, len(q), FEW):
            r, c = np.nonzero(hamming(q[s : s + FEW, None], codes[None]) <= radius)
            qs.append(r + s)
            ns.append(c)
        q = q[:0]
    for s in range(0, len(q), BATCH):
        part = np.arange(s, min(len(q), s + BATCH))
        width = beam
        while len(part):
            got = beam_search(q[part], codes, links, len(codes), width)
            hit = (got >> _U(25)) <= radius
            full = hit.all(axis=1) & (width < len(codes))
            r, c = np.nonzero(hit & ~full[:, None])
            qs.append(part[r])
            ns.append(((got[r, c] & _ID) >> _U(1)).astype(np.int64))
            part, width = part[full], width * 4
    none = np.empty(0, np.int64)
    return (np.concatenate(qs), np.concatenate(ns)) if qs else (none, none)


def tuned_beam(codes: np.ndarray, links: np.ndarray, radius: int) -> tuple[int, float]:
    """The first beam whose hits on probes reach the target recall against exhaustive search, and that recall.

    Recall is averaged over probes, so that a cluster's many hits count no more than a lone code's.
    Where the widest beam misses the target the shard is searched exhaustively.
    """
    rng = np.random.default_rng(len(codes))
    probes = codes[rng.integers(0, len(codes), min(PROBES, len(codes)))].copy()
    for _ in range(radius):  # flips at up to `radius` places
        flip = rng.random(len(probes)) < 0.75
        probes[flip] ^= np.uint64(1) << rng.integers(0, 64, int(flip.sum())).astype(np.uint64)
    # hits are exact, so those found are among the true ones and their numbers tell the recall
    hits = lambda beam: np.bincount(within(probes, codes, links, beam, radius)[0], minlength=len(probes))
    truth = hits(EXHAUSTIVE)
    for beam in BEAMS:
        recall = float((hits(beam) / truth).mean())  # each probe has at least the code it was made from
        if recall >= TARGET_RECALL:
            return beam, recall
    return EXHAUSTIVE, 1.0


#: What names a shard: its segment, the generation it was built in, block of bits, region in it and part of that.
SHARD = ["segment", "gen", "tab", "val", "part"]
SHARD_SCHEMA = "segment int, gen int, tab int, val int, part int, tables int, bits int, codes binary, links binary, n int, beam int, recall double"


def _in_regions(rows: DataFrame, code: str) -> DataFrame:
    """`rows(code, tables, bits)` once per block of bits (`tab`), with the region there (`val`): the lowest `bits` bits of the block."""
    each = rows.withColumn("tab", F.explode(F.sequence(F.lit(0), F.col("tables") - 1)))
    return each.withColumn("val", F.expr(f"cast(shiftrightunsigned({code}, cast(64 * tab div tables as int)) & (shiftleft(1L, bits) - 1) as int)"))


def build_shards(codes: DataFrame, radius: int, gen: int = 0) -> DataFrame:
    """Index shards of `codes(segment int, phash long)`, distinct; segments of any size, shards of about SHARD_CODES codes.

    `gen` tells shards apart that were built for one segment at different times.
    """
    c = codes.where("phash is not null and segment is not null").select("segment", "phash").distinct()
    c = cut(c)
    widest = 64 // (radius + 1)
    sizes = c.groupBy("segment").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_CODES)).alias("_parts"))
    by_region = F.col("_parts") > REGION_FROM
    # one row per segment, a number of batches: the planner broadcasts it or not by its size
    sizes = cut(sizes.select(
        "segment", "_parts", F.when(by_region, radius + 1).otherwise(1).alias("tables"), F.when(by_region, F.least(F.ceil(F.log2("_parts")), F.lit(widest))).otherwise(0).cast("int").alias("bits")
    ))
    shards = sizes.agg(F.sum(F.col("_parts") * F.col("tables"))).first()[0] or 1
    sizes = sizes.drop("_parts")
    placed = _in_regions(c.join(sizes, "segment"), "phash")
    # real codes crowd in some regions: a region is cut into as many parts as its own codes fill
    full = cut(placed.groupBy("segment", "tab", "val").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_CODES)).cast("int").alias("_cut")).where("_cut > 1"))
    placed = placed.join(F.broadcast(full), ["segment", "tab", "val"], "left")  # at most a row per SHARD_CODES codes and block
    part = F.pmod(F.xxhash64("phash"), F.coalesce("_cut", F.lit(1))).cast("int")
    placed = placed.select("segment", F.lit(gen).cast("int").alias("gen"), "tab", "val", part.alias("part"), "tables", "bits", "phash")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = np.sort(pdf["phash"].to_numpy(np.int64)).view(np.uint64)
        np.random.default_rng(0).shuffle(codes)
        forward, links = build_graph(codes)
        beam, recall = tuned_beam(codes, links, radius)
        return pdf.iloc[:1][[*SHARD, "tables", "bits"]].assign(codes=[codes.tobytes()], links=[forward.tobytes()], n=[len(codes)], beam=[beam], recall=[recall])

    # codes are few bytes and graphs are work: tasks go by the number of shards, which the planner would merge by bytes
    tasks = max(slots(codes.sparkSession), min(4 * int(shards), MOST_TASKS))
    return placed.repartition(tasks, *SHARD).groupBy(*SHARD).applyInPandas(build, SHARD_SCHEMA)


def search_shards(queries: DataFrame, shards: DataFrame, radius: int, *, exact: bool = False) -> DataFrame:
    """Distinct codes near `queries(segment int, phash long)` in the shards of lower segments: segment, q, phash, hit_segment, distance.

    A stated query set against the shards it may have hits in, in blocks of BLOCK_QUERIES. With
    `exact` every shard is searched exhaustively. An index built for a smaller radius is refused.
    """
    q = queries.where("phash is not null").select("segment", F.col("phash").alias("q")).distinct()
    # computed columns, so that the planner tells them from those of the shards themselves
    names = cut(shards.select((F.col("segment") + 0).alias("hit_segment"), *[(F.col(c) + 0).alias(c) for c in (*SHARD[1:], "tables", "bits")]))
    layouts = names.select("hit_segment", "gen", "tables", "bits").distinct()
    if names.where(f"tables > 1 and tables <= {int(radius)}").limit(1).count():
        raise ValueError(f"the index was built for a smaller radius than {radius}")
    # a row per segment, then a row per shard: counts and ids, at most a few per SHARD_CODES codes
    met = _in_regions(q.join(F.broadcast(layouts), F.col("segment") > F.col("hit_segment")), "q")
    met = met.join(F.broadcast(names.select("hit_segment", *SHARD[1:])), ["hit_segment", "gen", "tab", "val"])
    key = ["hit_segment", *SHARD[1:]]
    met = cut(met.select(*key, "segment", "q"))
    blocks = cut(met.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_QUERIES)).cast("int").alias("_blocks")))
    asked = met.join(F.broadcast(blocks), key).withColumn("block", F.pmod(F.xxhash64("q"), F.col("_blocks")).cast("int"))
    # a block of queries moves its shard once; shards no query meets stay where they are
    copies = shards.withColumnRenamed("segment", "hit_segment").join(F.broadcast(blocks), key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    copies = copies.select(*key, "block", "codes", "links", "beam")

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"segment": [], "q": [], "phash": [], "hit_segment": [], "distance": []})
        r = right.iloc[0]
        codes = np.frombuffer(r["codes"], np.uint64)
        links = both_ways(codes, np.frombuffer(r["links"], np.int32).reshape(len(codes), -1))
        distinct, back = np.unique(left["q"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        a, b = within(distinct, codes, links, EXHAUSTIVE if exact else int(r["beam"]), radius)
        hits = pd.DataFrame({"u": a, "phash": codes[b].view(np.int64), "distance": hamming(distinct[a], codes[b]).astype(np.int32)})
        asked = pd.DataFrame({"u": back, "segment": left["segment"].to_numpy(), "q": left["q"].to_numpy()})
        return asked.merge(hits, on="u").assign(hit_segment=int(r["hit_segment"]))[["segment", "q", "phash", "hit_segment", "distance"]]

    found = asked.select(*key, "block", "segment", "q").groupBy(*key, "block").cogroup(copies.groupBy(*key, "block")).applyInPandas(search, "segment int, q long, phash long, hit_segment int, distance int")
    several = names.where("tables > 1").limit(1).count()  # only regions overlap
    return found.distinct() if several else found


def compact(shards: DataFrame, radius: int, least: int = SHARD_CODES // 2) -> DataFrame:
    """Scheduled compaction: cuts by hash with shards under `least` codes are rebuilt together under their highest segment; others stay.

    For an index whose next query is newer than all segments; full shards and regions are not touched.
    """
    small = shards.where((F.col("n") < least) & (F.col("tables") == 1))

    def unpack(batches):
        for pdf in batches:
            for s, c in zip(pdf["segment"], pdf["codes"]):
                yield pd.DataFrame({"segment": int(s), "phash": np.frombuffer(c, np.int64)})

    loose = small.select("segment", "codes").mapInPandas(unpack, "segment int, phash long")
    kept = shards.where((F.col("n") >= least) | (F.col("tables") > 1))
    top = small.agg(F.max("segment").alias("top"))
    newest = shards.agg(F.max("gen")).first()[0]
    merged = loose.crossJoin(F.broadcast(top)).select(F.col("top").alias("segment"), "phash")  # top: one row
    return kept.unionByName(build_shards(merged, radius, 0 if newest is None else newest + 1))


def extend_index(index: DataFrame, incoming: DataFrame, *, radius: int = 6, most: int = MOST_SMALL) -> DataFrame:
    """The index after the batches of `incoming(batch_no, phash)`: a shard for each, compacted when over `most` are small."""
    new = incoming.select(F.col("batch_no").cast("int").alias("segment"), "phash")
    grown = cut(index.unionByName(build_shards(new, radius)))
    if grown.where((F.col("n") < SHARD_CODES // 2) & (F.col("tables") == 1)).limit(most + 1).count() <= most:
        return grown
    return cut(compact(grown, radius))


def history_index(history: DataFrame, *, radius: int = 6) -> DataFrame:
    """The first index, of `history(phash)`: shards to store and give to `history_matches` with each new batch."""
    return cut(build_shards(history.select(F.lit(FIRST).cast("int").alias("segment"), "phash"), radius))


def index_shards(index: DataFrame) -> DataFrame:
    """What an index holds: its shards with codes, beam and the recall measured on each (beam 0: searched exhaustively)."""
    return index.select(*SHARD, "tables", "bits", "n", "beam", "recall")


def _rows(history: DataFrame, incoming: DataFrame) -> DataFrame:
    old = history.select(F.lit(FIRST).cast("int").alias("segment"), "id", F.lower("content_hash").alias("hash"), "phash")
    new = incoming.select(F.col("batch_no").cast("int").alias("segment"), "id", F.lower("content_hash").alias("hash"), "phash")
    return old.unionByName(new).where("id is not null and segment is not null")


def history_matches(history: DataFrame, incoming: DataFrame, *, radius: int = 6, index: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """Pairs (id_a, id_b), smaller id first, of an incoming row with a history row or one of a lower batch.

    `history(id, content_hash, phash)` is segment 0; `incoming(batch_no, id, content_hash, phash)`
    has its batch as segment. A pair matches on equal hashes apart from case, or on codes at most
    `radius` apart. Null hashes and codes match nothing; rows without id or batch are left out;
    repeated rows count once; batches need not be numbered from 1. Empty tables give no rows.

    `index` (from `history_index`, then `extend_index` after each call) holds the codes of all history
    rows, so only shards of incoming batches that later ones are held against are built, and history
    rows are read but shuffled only where a filter over the batch's hashes or the codes found lets
    them through; earlier batches are then history rows, and batch numbers must be above those in
    the index. `exact` searches all shards exhaustively, for those who need every pair.
    """
    rows = _rows(history, incoming)
    asked = cut(rows.where(F.col("segment") > FIRST).distinct())
    # equal contents: an equi-join; what a hash held by many rows yields is the result itself
    a = asked.where("hash is not null").select("hash", F.col("id").alias("x"), F.col("segment").alias("xs"))
    b = rows.where("hash is not null").select("hash", F.col("id").alias("y"), F.col("segment").alias("ys"))
    same = a.join(maybe_in(b, cut(a.select("hash").distinct()), "hash"), "hash").where("xs > ys").select("x", "y")
    low, high = asked.agg(F.min("segment"), F.max("segment")).first()
    # no row is held against those of the last batch
    met = asked.where(F.col("segment") < F.lit(high)) if high is not None else asked.where("false")
    if index is None:
        shards = cut(build_shards(rows.where(F.col("segment") == FIRST).unionByName(met).select("segment", "phash"), radius))
    else:
        top = index.agg(F.max("segment")).first()[0]
        if top is not None and low is not None and low <= top:
            raise ValueError(f"batch {low} is not above batch {top} of the index")
        shards = index if low == high else cut(index.unionByName(build_shards(met.select("segment", "phash"), radius)))
    hits = cut(search_shards(asked.select("segment", "phash"), shards, radius, exact=exact).select("segment", "q", "phash").distinct())
    by_code = asked.select("segment", F.col("phash").alias("q"), F.col("id").alias("x"))
    # back to rows by code: compaction moves codes to another segment, history rows have one
    known = maybe_in(rows.where("phash is not null").select(F.col("segment").alias("hit_segment"), "phash", F.col("id").alias("y")), cut(hits.select("phash").distinct()), "phash")
    near = hits.join(by_code, ["segment", "q"]).join(known, "phash").where("segment > hit_segment").select("x", "y")
    pairs = same.unionByName(near).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return pairs.distinct()


def history_classes(history: DataFrame, incoming: DataFrame, **options) -> DataFrame:
    """The same matches without expanding copies: relation, id_a, id_b.

    Rows of one segment with equal hash and code are a class, named by its smallest id. `match` holds
    the pairs of `history_matches` between classes, `same` each other row (id_b) with its class
    (id_a). A content held by a third of all rows is one class per segment.
    """
    rows = cut(_rows(history, incoming).groupBy("segment", "hash", "phash").agg(F.min("id").alias("id")))
    old = rows.where(F.col("segment") == FIRST).select("id", F.col("hash").alias("content_hash"), "phash")
    new = rows.where(F.col("segment") > FIRST).select(F.col("segment").alias("batch_no"), "id", F.col("hash").alias("content_hash"), "phash")
    match = history_matches(old, new, **options).select(F.lit("match").alias("relation"), "id_a", "id_b")
    named = [F.col("segment"), F.coalesce("hash", F.lit("")).alias("_h"), F.col("hash").isNull().alias("_n"), F.coalesce("phash", F.lit(0)).alias("_p"), F.col("phash").isNull().alias("_m")]
    name = rows.select(F.struct(*named).alias("_class"), F.col("id").alias("id_a"))
    member = cut(_rows(history, incoming).distinct().select(F.struct(*named).alias("_class"), F.col("id").alias("id_b")))
    same = skew_join(member, name, "_class").where("id_a <> id_b").select(F.lit("same").alias("relation"), "id_a", "id_b")
    return match.unionByName(same)
