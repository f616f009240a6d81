"""One instant per timestamp text: all interpretations as arrays, chosen by a Viterbi search over each source's record order.

The search is exact and distributed. Records are range-partitioned by (source, order), so a source
with a third of all rows spreads over many tasks. A value with one interpretation is a state every
path passes, so paths fall apart there into short independent stretches. What crosses a partition
border is summed up as the costs from the first to the last value of the run at the border - a few
numbers per partition - from which the border states are settled before each partition is solved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions.instants import FORMATS, STATED, interpretations
from fotolake.runtime import cut, slots

#: Costs of a change of format, of time running backwards, and of each later reading in the listed order.
SWITCH, BACKWARD, LATER = 1.0, 2.0, 0.01
#: Values per task aimed at.
TASK_VALUES = 250_000

Value = tuple[list[int], list[int]]  # formats, instants


def _step(costs: list[float], prev: Value, cur: Value) -> tuple[list[float], list[int]]:
    out, via = [], []
    for j, (f, u) in enumerate(zip(*cur)):
        best, arg = None, 0
        for i, (g, v) in enumerate(zip(*prev)):
            c = costs[i] + (SWITCH if f != g else 0.0) + (BACKWARD if u < v else 0.0)
            if best is None or c < best:
                best, arg = c, i
        out.append(best + LATER * j)
        via.append(arg)
    return out, via


def _path(values: list[Value], start: int | None, stop: int | None) -> list[int]:
    """The cheapest choice for each value, with the first and last fixed if given."""
    first = len(values[0][0])
    costs = [LATER * i if start is None or i == start else float("inf") for i in range(first)]
    back: list[list[int]] = []
    for prev, cur in zip(values, values[1:]):
        costs, via = _step(costs, prev, cur)
        back.append(via)
    at = min(range(len(costs)), key=costs.__getitem__) if stop is None else stop
    out = [at]
    for via in reversed(back):
        at = via[at]
        out.append(at)
    return out[::-1]


def choose(values: list[Value], start: int | None = None, stop: int | None = None) -> list[int]:
    """Viterbi over a run, piece by piece between values that have one interpretation only."""
    out: list[int] = [0] * len(values)
    anchors = [i for i, v in enumerate(values) if len(v[0]) == 1]
    bounds = [-1, *anchors, len(values)]
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            lo, hi = max(a, 0), min(b, len(values) - 1)
            out[lo : hi + 1] = _path(values[lo : hi + 1], start if lo == 0 else None, stop if hi == len(values) - 1 else None)
    if start is not None:
        out[0] = start
    if stop is not None:
        out[-1] = stop
    return out


class Border:
    """A run as its neighbours see it: first and last value, and the least cost from each reading of the first to each of the last, up to a constant.

    Values are added one by one and not kept. From the first value with one reading on, all first
    readings go on alike, so one row of costs is carried, begun anew at each further such value.
    """

    def __init__(self, key: tuple, value: Value):
        self.key, self.first, self.last = key, value, value
        n = len(value[0])
        self.rows = [[0.0 if k == i else float("inf") for k in range(n)] for i in range(n)]
        self.head: list[float] | None = [0.0] if n == 1 else None  # cost of reaching the first anchor

    def add(self, value: Value) -> None:
        if self.head is not None and len(value[0]) == 1:
            self.rows = [[0.0]]
        else:
            self.rows = [_step(r, self.last, value)[0] for r in self.rows]
            if self.head is None and len(value[0]) == 1:
                self.head, self.rows = [r[0] for r in self.rows], [[0.0]]
        self.last = value

    @property
    def costs(self) -> list[list[float]]:
        return self.rows if self.head is None else [[h + c for c in self.rows[0]] for h in self.head]


def summary(values: list[Value]) -> list[list[float]]:
    """The costs of `Border` over a list."""
    border = Border((), values[0])
    for v in values[1:]:
        border.add(v)
    return border.costs


def settle(runs: list[dict]) -> dict[tuple, tuple[int, int]]:
    """Readings of the first and last value of each border run, given the runs of one chain in order."""
    costs = [LATER * i for i in range(len(runs[0]["first"][0]))]
    trail = []
    for k, r in enumerate(runs):
        if k:
            costs, via = _step(costs, runs[k - 1]["last"], r["first"])
        else:
            via = []
        ends, best_in = [], []
        for j in range(len(r["last"][0])):
            i = min(range(len(costs)), key=lambda i: costs[i] + r["cost"][i][j])
            ends.append(costs[i] + r["cost"][i][j])
            best_in.append(i)
        trail.append((via, best_in))
        costs = ends
    at = min(range(len(costs)), key=costs.__getitem__)
    fixed = {}
    for k in range(len(runs) - 1, -1, -1):
        via, best_in = trail[k]
        start = best_in[at]
        fixed[runs[k]["key"]] = (start, at)
        if k:
            at = via[start]
    return fixed


def _runs(pdf: pd.DataFrame) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of each stretch of equal (source, field) in a partition."""
    if not len(pdf):
        return []
    s, f = pdf["source"].to_numpy(), pdf["field_name"].to_numpy()
    cuts = [0, *(np.nonzero((s[1:] != s[:-1]) | (f[1:] != f[:-1]))[0] + 1).tolist(), len(s)]
    return [((s[a], f[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def _values(pdf: pd.DataFrame) -> list[Value]:
    return [(list(f), list(u)) for f, u in zip(pdf["formats"], pdf["instants"])]


def resolve_instants(values: DataFrame, *, conventions: frozenset = STATED) -> DataFrame:
    """Choose one interpretation per value of `values(source, field_name, ord, text, tz_name)`.

    Returns source, field_name, ord, text, tz_name, utc_us, format_name, n_instants. `utc_us` and
    `format_name` are null and `n_instants` is 0 where the text is null, blank, junk, impossible, or
    a wall time without zone or that its zone skips. A wall time met twice (clocks set back) has
    two. Ties go to the reading listed first. Records follow each other by `ord`; equal `ord`s by
    text. Repeated rows are kept as given; null sources form one chain. An empty table gives no rows.
    """
    v = values.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), "field_name", F.col("ord").cast("long").alias("ord"), "text", "tz_name")
    order = ["source", "field_name", "ord", "text", "tz_name"]
    # a task holds the stretch of one device it is solving: at most the values of its range, whatever the device's share
    tasks = max(slots(v.sparkSession), -(-v.count() // TASK_VALUES))
    ranged = v.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def read(batches):
        for pdf in batches:
            got = [interpretations(t, z, conventions) for t, z in zip(pdf["text"], pdf["tz_name"])]
            yield pdf.assign(formats=[[f for f, _ in g] for g in got], instants=[[u for _, u in g] for g in got])

    base = "source string, field_name string, ord long, text string, tz_name string"
    read_rows = cut(ranged.mapInPandas(read, base + ", formats array<int>, instants array<long>").withColumn("pid", F.spark_partition_id()))

    def borders(batches):
        # only the first and the last run of a partition can go on elsewhere
        first: Border | None = None
        last: Border | None = None
        pid = None
        for pdf in batches:
            pdf = pdf[pdf["formats"].map(len) > 0]
            values = _values(pdf)
            for k, a, b in _runs(pdf):
                pid = int(pdf["pid"].iloc[0])
                if last is None or last.key != k:
                    first = first or last
                    last = Border(k, values[a])
                    a += 1
                for v in values[a:b]:
                    last.add(v)
        for r in (first, last):
            if r:
                (f0, u0), (f1, u1) = r.first, r.last
                yield pd.DataFrame({"pid": [pid], "source": [r.key[0]], "field_name": [r.key[1]], "f0": [f0], "u0": [u0], "f1": [f1], "u1": [u1], "cost": [[c for row in r.costs for c in row]]})

    ends = read_rows.mapInPandas(borders, "pid int, source string, field_name string, f0 array<int>, u0 array<long>, f1 array<int>, u1 array<long>, cost array<double>").collect()
    chains: dict[tuple, list[dict]] = {}
    for r in sorted(ends, key=lambda r: r.pid):
        n = len(r.f1)
        cost = [r.cost[i * n : (i + 1) * n] for i in range(len(r.f0))]
        chains.setdefault((r.source, r.field_name), []).append({"key": (r.pid, r.source, r.field_name), "first": (r.f0, r.u0), "last": (r.f1, r.u1), "cost": cost})
    fixed = {k: v for runs in chains.values() if len(runs) > 1 for k, v in settle(runs).items()}

    def settled(pdf: pd.DataFrame, runs: list[tuple[tuple, int, int]]) -> pd.DataFrame:
        values = _values(pdf)
        pid = int(pdf["pid"].iloc[0])
        utc, name = [None] * len(pdf), [None] * len(pdf)
        for key, a, b in runs:
            at = [i for i in range(a, b) if values[i][0]]
            if at:
                own = [values[i] for i in at]
                for i, v, p in zip(at, own, choose(own, *fixed.get((pid, *key), (None, None)))):
                    utc[i], name[i] = v[1][p], FORMATS[v[0][p]]
        out = pdf[["source", "field_name", "ord", "text", "tz_name"]]
        return out.assign(utc_us=pd.array(utc, dtype="Int64"), format_name=pd.Series(name, dtype=object, index=out.index), n_instants=[len(set(u)) for _, u in values])

    def solve(batches):
        held: list[pd.DataFrame] = []  # the run that may go on in the next batch
        for pdf in batches:
            runs = _runs(pdf)
            if not runs:
                continue
            if held and _runs(held[0].iloc[:1])[0][0] == runs[0][0] and len(runs) == 1:
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf], ignore_index=True) if held else pdf
            runs = _runs(whole)
            start = runs[-1][1]
            if start:
                yield settled(whole.iloc[:start], runs[:-1])
            held = [whole.iloc[start:].reset_index(drop=True)]
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield settled(whole, _runs(whole))

    return read_rows.mapInPandas(solve, base + ", utc_us long, format_name string, n_instants int")


def field_values(meta: DataFrame, fields: tuple[str, ...] = ("date_taken", "date_created", "mtime")) -> DataFrame:
    """The timestamp texts of raw extraction records, one row per record and field, repeated records once.

    The source is the device: camera name and zone.
    """
    cols = ["meta_id", "tz_name", "camera_model", *fields]
    stack = ", ".join(f"'{f}', `{f}`" for f in fields)
    source = "concat(lower(trim(coalesce(camera_model, ''))), '|', coalesce(tz_name, '')) AS source"
    return meta.select(*cols).distinct().selectExpr(source, "meta_id AS ord", "tz_name", f"stack({len(fields)}, {stack}) AS (field_name, text)")
