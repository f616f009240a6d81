"""Exact pairs of 64-bit hashes within a wide Hamming radius, by arrays of hashes that meet chunk by chunk.

Of `m` blocks of bits whose radii add up to radius - m + 1, two hashes within the radius are near in
one at least. So each hash looks up, block by block, the other hashes whose block differs in so few
bits, in a table by the block's value. Only the hashes move, packed in arrays, never keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.runtime import cut

#: Hashes of a table at most, of an array about; parts of the hashes that look up, where one table holds all.
CHUNK, PACKED, PROBE_PARTS = 4_000_000, 25_000, 32
#: Hashes that look up at once; lookups and candidates held at once.
SLICE, HELD = 1 << 18, 1 << 17
#: Numbers of blocks to choose from (a table has 2^22 values at most); 0 compares all.
BLOCKS = (0, 3, 4, 5, 6)
#: Nanoseconds of a comparison, a lookup, a candidate, a call of numpy for each value looked up, a hash put in a table.
COMPARE, LOOKUP, CANDIDATE, CALL, PUT = 2.5, 15, 20, 30_000, 300


def split(radius: int, m: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each of m blocks; radius -1 is a block that need not be looked up."""
    edges = [64 * i // m for i in range(m + 1)]
    least, more = divmod(radius - m + 1, m)
    return [(a, b - a, min(b - a, least + (i >= m - more))) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def scan_cost(probes: int, n: int, radius: int, m: int) -> float:
    """Nanoseconds for so many hashes to look up their pairs among n evenly spread ones."""
    if not m:
        return probes * n * COMPARE / 2
    cost = float(n * m * PUT)
    for _, bits, r in split(radius, m):
        ball = sum(comb(bits, k) for k in range(r + 1))
        cost += ball * (CALL + probes / 2 * (LOOKUP + n / 2**bits * CANDIDATE))
    return cost


class Table:
    """Hashes (distinct, unsigned) by the value of each block: sorted, with the start of each value and whether it is there."""

    def __init__(self, hashes: np.ndarray, radius: int, m: int):
        self.radius, self.m, self.hashes = radius, m, np.sort(hashes)
        self.blocks = []
        for first, bits, r in split(radius, m) if m else ():
            mask = np.uint64((1 << bits) - 1)
            if r >= 0:
                value = ((hashes >> np.uint64(first)) & mask).astype(np.int64)
                count = np.bincount(value, minlength=1 << bits)
                start = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                self.blocks.append((np.uint64(first), bits, r, mask, hashes[np.argsort(value, kind="stable")], start, count > 0))

    def near(self, probes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arrays (p, t, distance) of pairs within the radius, p of `probes` and t of the table.

        Where both hold all hashes of a set, each pair comes once: from the side that has no bit where
        the block's values differ highest, or the lesser hash where they are equal.
        """
        if not self.m:
            yield from self._all(np.sort(probes))
            return
        for i, (first, bits, r, mask, _, _, there) in enumerate(self.blocks):
            value = ((probes >> first) & mask).astype(np.int64)
            order = np.argsort(value, kind="stable")  # lookups go through the table nearly in order
            value, sorted_probes = value[order], probes[order]
            yield from self._met(i, value, sorted_probes, True)
            values, waiting, held = [], [], 0
            for top in range(bits if r else 0):
                clear = (value >> top) & 1 == 0
                mine, theirs = value[clear], sorted_probes[clear]
                for flips in (c for k in range(min(r, top + 1)) for c in combinations(range(top), k)):
                    x = mine ^ sum((1 << f for f in flips), 1 << top)
                    at = np.flatnonzero(there.take(x))
                    if len(at):
                        values.append(x[at])
                        waiting.append(theirs[at])
                        held += len(at)
                    if held >= HELD:
                        yield from self._met(i, np.concatenate(values), np.concatenate(waiting), False)
                        values, waiting, held = [], [], 0
            if held:
                yield from self._met(i, np.concatenate(values), np.concatenate(waiting), False)

    def _met(self, i: int, values: np.ndarray, probes: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of the probes with the hashes at the values of block i; those near in an earlier block were found there."""
        _, _, _, _, by_value, start, _ = self.blocks[i]
        low = start[values].astype(np.int64)
        number = start[values + 1] - low
        done = np.cumsum(number)
        a = 0
        while a < len(values):
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + HELD, side="right")))
            n = number[a:b]
            p = np.repeat(probes[a:b], n)
            t = by_value[np.arange(len(p)) + np.repeat(low[a:b] - (np.cumsum(n) - n), n)]
            a = b
            d = np.bitwise_count(p ^ t)
            ok = (d <= self.radius) & (p < t) if same else d <= self.radius
            p, t, d = p[ok], t[ok], d[ok]
            for first, _, r, mask, *_ in self.blocks[:i]:
                ok = np.bitwise_count(((p ^ t) >> first) & mask) > r
                p, t, d = p[ok], t[ok], d[ok]
            if len(p):
                yield p, t, d

    def _all(self, probes: np.ndarray, width: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each probe with all greater hashes, a stretch of the table after the other."""
        differ, distance, near = np.empty(width, np.uint64), np.empty(width, np.uint8), np.empty(width, bool)
        for b in range(0, len(self.hashes), width):
            stretch = self.hashes[b : b + width]
            for p, a in zip(probes, np.searchsorted(stretch, probes, side="right").tolist()):
                n = len(stretch) - a
                if not n:
                    break  # the probes rise: no further one has a greater hash here
                np.bitwise_xor(stretch[a:], p, out=differ[:n])
                np.bitwise_count(differ[:n], out=distance[:n])
                np.less_equal(distance[:n], self.radius, out=near[:n])
                if np.count_nonzero(near[:n]):
                    at = np.flatnonzero(near[:n])
                    yield np.full(len(at), p), stretch[a + at], distance[at]


def _gathered(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """The same arrays in larger pieces."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[0])
        if size >= HELD:
            yield [np.concatenate(c) for c in zip(*held)]
            held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _search(radius: int, scope: str | None, m: int | None):
    """Per task the arrays of its tables come first, then those that look up, each scope by scope."""

    def answers(table: Table, probes: np.ndarray, scope_value: pa.Scalar | None) -> Iterator[pa.RecordBatch]:
        for p, t, d in _gathered(table.near(probes)):
            p, t = p.view(np.int64), t.view(np.int64)
            out = {scope: pa.repeat(scope_value, len(p))} if scope else {}
            yield pa.RecordBatch.from_pydict(out | {"a": pa.array(np.minimum(p, t)), "b": pa.array(np.maximum(p, t)), "distance": pa.array(d.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, tables, table, now, asked = None, {}, None, None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal table, asked
            probes, asked = np.concatenate(asked) if asked else np.empty(0, np.uint64), []
            hashes = tables.get(now)
            if not len(probes) or hashes is None:
                return
            if table is None:
                hashes = np.concatenate(hashes)
                best = m if m is not None else min(BLOCKS, key=lambda k: scan_cost(len(probes), len(hashes), radius, k))
                table = Table(hashes, radius, best)
            for a in range(0, len(probes), SLICE):
                yield from answers(table, probes[a : a + SLICE], pa.scalar(now[0], batch.schema.field(scope).type) if scope else None)

        for batch in batches:
            lists = batch.column("hashes")
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            sides, tasks = batch.column("side").to_numpy(), batch.column("task").to_numpy()
            scopes = batch.column(scope).to_pylist() if scope else [None] * len(batch)
            for k in range(len(batch)):
                codes = values[ends[k] : ends[k + 1]].copy()
                if tasks[k] != task:
                    yield from flush()
                    task, tables, table, now = tasks[k], {}, None, None
                if sides[k] == 0:
                    tables.setdefault((scopes[k],), []).append(codes)
                    continue
                if now != (scopes[k],) or sum(map(len, asked)) >= SLICE:
                    yield from flush()
                    if now != (scopes[k],):
                        table, now = None, (scopes[k],)
                asked.append(codes)
        yield from flush()

    return run


def scan_pairs(hashes: DataFrame, n: int, radius: int, *, scope: str | None = None, chunk: int = CHUNK, packed: int = PACKED, m: int | None = None) -> DataFrame:
    """Pairs of distinct hashes within `radius`: (scope,) a, b, distance with a < b.

    `hashes(phash[, scope])` are the n distinct rows, without null hashes, cut. They are packed in
    arrays; every part of the arrays meets every table of `chunk` hashes in a task of its own, so a
    task holds one table, and 8 bytes a hash move as often as there are parts and tables. Nothing is
    left out, whatever the radius: `m` blocks (chosen by cost) sort the lookups and nothing else.
    """
    tables = ceil(n / chunk)
    parts = max(tables, min(PROBE_PARTS, ceil(n / packed)))
    bins = parts * ceil(n / (packed * parts))
    keep = [scope] if scope else []
    known = hashes.where(F.col(scope).isNotNull()) if scope else hashes
    binned = known.groupBy(*keep, F.pmod(F.xxhash64("phash"), F.lit(bins)).cast("int").alias("_bin"))
    lists = cut(binned.agg(F.collect_list("phash").alias("hashes")))  # about `packed` each, as hashes spread evenly
    part, table = F.col("_bin") % parts, F.col("_bin") % tables
    every = lambda k, task: F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), task)).alias("task")
    stored = lists.select(*keep, "hashes", F.lit(0).alias("side"), every(parts, lambda p: p * tables + table))
    asking = lists.select(*keep, "hashes", F.lit(1).alias("side"), every(tables, lambda t: part * tables + t))
    # arrays are few bytes and lookups are work: one partition per task, which the planner would merge by bytes
    placed = stored.unionByName(asking).repartitionById(parts * tables, F.col("task")).sortWithinPartitions("task", "side", *keep)
    schema = "".join(f"`{c}` {dict(hashes.dtypes)[c]}, " for c in keep) + "a long, b long, distance int"
    return placed.mapInArrow(_search(radius, scope, m), schema)
