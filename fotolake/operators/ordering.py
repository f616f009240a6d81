"""Orders of the library, ranks without a single-task sort, and the seeded shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.runtime import cut, slots

#: Rows a shuffle in the exact order of the reference may have: the generator is sequential, so it runs on the driver.
MAX_SHUFFLED = 5_000_000
_MASK = (1 << 64) - 1


def global_rank(df: DataFrame, keys: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Add the 1-based rank by `keys` (which should end in a unique one), sorted by range on all tasks.

    One shuffle: rows are ranged and sorted in place, the place in a range comes from the row number
    Spark gives inside a partition, and one count per range reaches the driver. The ranked rows are
    written once (range bounds are sampled, so they must not be drawn again): select what is needed first.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(slots(spark), *keys).sortWithinPartitions(*keys)
    # upper bits: the partition, lower 33 bits: the place in it
    ranged = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("_pid")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, before = [], 0
    for pid, n in sorted((r["_pid"], r["n"]) for r in sizes):
        offsets.append((pid, before))
        before += n
    starts = spark.createDataFrame(offsets, "_pid long, _start long")  # a row per range
    out = ranged.withColumn("_pid", F.shiftright("_at", 33)).join(F.broadcast(starts), "_pid")
    return out.select(*df.columns, (F.col("_start") + place + 1).alias(name))


def group_rank(df: DataFrame, groups: Sequence[str], keys: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Add the 1-based rank by `keys` within each group (no null groups): the rank overall less that of the group's first row, so no group is one task."""
    ranked_rows = global_rank(df, [*groups, *keys], "_g")
    first = ranked_rows.groupBy(*groups).agg(F.min("_g").alias("_f"))
    return ranked_rows.join(first, list(groups)).select(*df.columns, (F.col("_g") - F.col("_f") + 1).alias(name))


def order_keys(order: str) -> list[Column]:
    """Sort keys by name: path, date, size, colour, rating. All but path fall back on the path."""
    path = m.path_order()
    if order == "path":
        return [path]
    if order == "date":
        return [F.coalesce("date_taken", "mtime").asc(), path]
    if order == "size":
        return [F.col("size").desc(), path]
    if order == "colour":
        return [m.hue_key(), path]
    if order == "rating":
        return [F.col("rating").desc(), path]
    raise ValueError(order)


def ranked(rows: DataFrame, order: str) -> DataFrame:
    return global_rank(rows, order_keys(order))


def visible_images(rows: DataFrame, *, text: str = "", min_rating: int = 0, kinds: Iterable[str] = ()) -> DataFrame:
    """Rows that match the text (anywhere in the path, any case), the least rating and the kinds; empty settings let all pass."""
    needle = text.strip().lower()
    out = rows.where(F.lower("path").contains(needle)) if needle else rows
    out = out.where(F.col("rating") >= min_rating) if min_rating > 0 else out
    wanted = list(kinds)
    return out.where(m.effective_kind().isin(*wanted)) if wanted else out


def seeded_permutation(n: int, seed: int) -> list[int]:
    """Fisher-Yates from the end with a xorshift generator (13, 7, 17); seed 0 stands for a fixed other one."""
    if n > MAX_SHUFFLED:
        raise ValueError(f"an exact shuffle has at most {MAX_SHUFFLED} rows; use hashed_order")
    items, x = list(range(n)), (seed & _MASK) or 0x9E3779B97F4A7C15
    for last in range(n - 1, 0, -1):
        x = (x ^ (x << 13)) & _MASK
        x ^= x >> 7
        x = (x ^ (x << 17)) & _MASK
        other = x % (last + 1)
        items[last], items[other] = items[other], items[last]
    return items


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """The exact seeded shuffle of rows in path order: adds `rank`."""
    spark = rows.sparkSession
    ordered = global_rank(rows, [m.path_order()], "_at")
    where = seeded_permutation(ordered.count(), seed)
    moves = spark.createDataFrame(list(zip((i + 1 for i in where), range(1, len(where) + 1))), "_at long, rank long")
    return ordered.join(moves, "_at").drop("_at")


def hashed_order(rows: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """A repeatable random order for any number of rows (another permutation than `shuffled`)."""
    return global_rank(rows, [F.xxhash64(key, F.lit(seed)), F.col(key)])


class Cursor:
    """A slideshow position over an ordered list of ids."""

    def __init__(self, order: Sequence[int]):
        self.order, self.at = list(order), 0

    def __len__(self) -> int:
        return len(self.order)

    @property
    def current(self) -> int | None:
        return self.order[self.at] if self.order else None

    def step(self, by: int = 1) -> int | None:
        if self.order:
            self.at = (self.at + by) % len(self.order)
        return self.current

    def restart(self) -> None:
        self.at = 0

    def resequence(self, order: Sequence[int]) -> None:
        """Take a new order, staying on the same item if it is still there."""
        held = self.current
        self.order = list(order)
        self.at = self.order.index(held) if held in self.order else 0
