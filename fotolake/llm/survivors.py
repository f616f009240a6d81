"""The best representative of each group, field by field, in consistent bundles.

Fields that only make sense together form a bundle; a bundle is taken whole from one member. Each
bundle has its own order of trust (most complete, most recent, largest...). Members that agree in
all a dependency compares are one candidate for a bundle, the most trusted of them; candidates rank
0, 1, 2... by trust. A branch-and-bound search picks one candidate per bundle so that the weighted
ranks are least and the declared functional dependencies hold over the values chosen. A bundle may
stay empty, at the cost of a candidate of rank `patience`: so a clash costs a field, never the
survivor. A candidate of that very rank goes before the empty bundle. One beyond it costs more than
the empty bundle, which never clashes, so it is part of no best choice, and leaving it out changes
no answer; that needs weights of 0 at least, and others are refused.

No group is collected: candidates are aggregated with partial results, ranks beyond `patience` go
before the rows of a group meet, and a group reaches the search as at most bundles x (patience + 1)
candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fotolake.runtime import cut, maybe_in, skew_join

PATIENCE = 8
#: Trust by picture: larger picture, larger file, older, shorter path in bytes, path in byte order.
PICTURE = ("-coalesce(cast(width as long) * height, 0)", "-size", "mtime", "octet_length(path)", "path", "id")


@dataclass(frozen=True)
class Bundle:
    """`known` says whether a member has the bundle, `fields` are its values, `trust` orders members by rising expressions (nulls last); without it the common order holds."""

    name: str
    known: str
    fields: tuple[str, ...] = ()
    weight: float = 1.0
    trust: tuple[str, ...] = ()


@dataclass(frozen=True)
class Dependency:
    """Field `source` determines field `target`; both are fields of bundles.

    The member that gives the bundle of `source` vouches for its own `target`; where it knows one,
    the `target` chosen must equal it.
    """

    source: str
    target: str


def members_of(groups: DataFrame, rows: DataFrame, group_id: str, members: str, id_col: str) -> DataFrame:
    """Distinct (group_id, row) of the members found in `rows` (repeated rows count once).

    `rows` is filtered by the members' ids before its one shuffle, on the id.
    """
    flat = groups.select(F.col(group_id).alias("group_id"), F.explode(members).alias(id_col)).where(f"group_id is not null and {id_col} is not null").distinct()
    flat = cut(flat)
    known = maybe_in(rows, cut(flat.select(id_col).distinct()), id_col).dropDuplicates([id_col])
    return skew_join(flat, known, id_col)


def _order(trust: Sequence[str]) -> Column:
    """A struct that is least for the most trusted member; nulls come last."""
    return F.struct(*[c for i, e in enumerate(trust) for c in (F.expr(e).isNull().alias(f"n{i}"), F.expr(e).alias(f"v{i}"))])


def _compared(bundles: Sequence[Bundle], deps: Sequence[Dependency]) -> tuple[list[list[str]], dict[tuple[int, int], list[str]]]:
    """Per bundle the facts that dependencies compare, and per pair of bundles those compared between them."""
    where = {f: i for i, b in enumerate(bundles) for f in b.fields}
    facts: list[list[str]] = [[] for _ in bundles]
    links: dict[tuple[int, int], list[str]] = {}
    for d in deps:
        if d.source not in where or d.target not in where:
            raise ValueError(f"{d.source} and {d.target} must be fields of bundles")
        a, b = where[d.source], where[d.target]
        if a != b:  # within a bundle one member gives both
            for i, j in ((a, b), (b, a)):
                links.setdefault((i, j), []).append(d.target)
                facts[i] += [d.target] if d.target not in facts[i] else []
    return facts, links


def _candidates(flat: DataFrame, i: int, b: Bundle, facts: list[str], trust: Sequence[str], id_col: str, patience: int) -> DataFrame:
    """group_id, bundle, rank, id, facts (as text, by name) of a bundle's candidates that can matter."""
    mine = flat.where(F.expr(b.known)).withColumn("_k", _order(b.trust or trust))
    names = [f"_f{n}" for n in range(len(facts))]
    mine = mine.select("group_id", F.col(id_col).alias("id"), "_k", *[F.col(f).cast("string").alias(n) for f, n in zip(facts, names)])
    best = mine.groupBy("group_id", *names).agg(F.min("_k").alias("_k"), F.min_by("id", "_k").alias("id"))
    rank = F.lit(0)
    if facts:
        # only ranks up to `patience`, none of them worse than the empty bundle, leave a task (a window's group limit), so no group meets in one
        best = best.withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy("_k"))).where(F.col("_r") <= patience + 1)
        rank = F.col("_r") - 1
    values = F.array(*[F.col(n) for n in names]) if facts else F.array().cast("array<string>")
    return best.select("group_id", F.lit(i).alias("bundle"), rank.cast("int").alias("rank"), F.col("id").cast("long").alias("id"), values.alias("facts"))


def branch_and_bound(cands: list[list[tuple]], weights: Sequence[float], conflict: Callable, patience: int) -> tuple[list, float]:
    """One candidate (rank, ...) or None per bundle with least weighted rank and no conflict, None costing as rank `patience`.

    Candidates rise by rank, any number of them; weights are 0 at least. Ties go to the lesser ranks,
    bundle by bundle, then to candidates before None. A bundle without candidates is None at no cost.
    """
    order = sorted(range(len(cands)), key=lambda i: len(cands[i]))
    # None has its place among the ranks: behind it come candidates that cost more
    options = [sorted([*c, None], key=lambda x: (patience, 1) if x is None else (x[0], 0)) for c in cands]
    best: list = [[None] * len(cands), float("inf"), (), ()]
    chosen: list = [None] * len(cands)

    def go(k: int, cost: float) -> None:
        if cost > best[1]:  # further bundles cost 0 at least
            return
        if k == len(order):
            ranks = tuple(patience if c is None else c[0] for c in chosen)
            empty = tuple(c is None for c in chosen)
            if (cost, ranks, empty) < (best[1], best[2], best[3]):
                best[:] = list(chosen), cost, ranks, empty
            return
        b = order[k]
        for c in options[b]:
            extra = (weights[b] * (patience if c is None else c[0])) if cands[b] else 0.0
            if cost + extra > best[1]:
                break
            if c is not None and any(chosen[o] is not None and conflict(o, chosen[o], b, c) for o in order[:k]):
                continue
            chosen[b] = c
            go(k + 1, cost + extra)
            chosen[b] = None

    go(0, 0.0)
    return best[0], best[1]


def _solver(bundles: Sequence[Bundle], deps: Sequence[Dependency], patience: int):
    facts, links = _compared(bundles, deps)
    weights = [b.weight for b in bundles]

    def conflict(i: int, a: tuple, j: int, b: tuple) -> bool:
        return any((x := a[2][facts[i].index(t)]) is not None and (y := b[2][facts[j].index(t)]) is not None and x != y for t in links.get((i, j), ()))

    def run(batches):
        for pdf in batches:
            out = []
            for gid, rows in zip(pdf["group_id"], pdf["c"]):
                cands: list[list[tuple]] = [[] for _ in bundles]
                for r in rows:
                    cands[r["bundle"]].append((r["rank"], r["id"], list(r["facts"])))
                pick, _ = branch_and_bound([sorted(c, key=lambda t: t[0]) for c in cands], weights, conflict, patience)
                out += [(gid, b.name, p[1]) for b, p in zip(bundles, pick) if p is not None]
            yield pd.DataFrame(out, columns=["group_id", "field_name", "media_id"])

    return run


def choose_survivors(flat: DataFrame, bundles: Sequence[Bundle], *, trust: Sequence[str] = PICTURE, dependencies: Sequence[Dependency] = (), id_col: str = "id", patience: int = PATIENCE, least_members: int = 2) -> DataFrame:
    """Per group and bundle the member it is taken from: group_id, field_name (the bundle), media_id.

    `flat` holds one row per group member (distinct); groups of fewer than `least_members` are left
    out. A bundle no member has gives no row, nor one that clashes with more trusted bundles in all
    candidates worth its weight; every group has a row as long as any member has any bundle. Trust
    expressions should end in a unique one. Empty tables give no rows; extra columns are ignored.
    """
    facts, _ = _compared(bundles, dependencies)
    if any(not b.weight >= 0 for b in bundles):
        raise ValueError("weights must be 0 at least")
    flat = cut(flat)  # one narrow row per member, read once per bundle
    found = reduce(DataFrame.unionByName, [_candidates(flat, i, b, facts[i], trust, id_col, patience) for i, b in enumerate(bundles)])
    packed = found.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "rank", "id", "facts")).alias("c"))  # bundles x (patience + 1) at most
    if least_members > 1:
        sizes = flat.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_members)
        packed = packed.join(sizes.select("group_id"), "group_id", "left_semi")
    return packed.mapInPandas(_solver(bundles, dependencies, patience), f"group_id {dict(flat.dtypes)['group_id']}, field_name string, media_id long")
