"""Versioned Parquet snapshots with an atomic pointer, and the side effects of plans."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession

from fotolake.schema import SCHEMA_VERSION, evolve


class Store:
    """Tables as snapshot folders `table/v000001`; `CURRENT` names the one in force and is replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        os.makedirs(root, exist_ok=True)

    def _pointer(self, table: str) -> str:
        return os.path.join(self.root, table, "CURRENT")

    def version(self, table: str) -> int:
        try:
            with open(self._pointer(table)) as f:
                return json.load(f)["version"]
        except OSError:
            return 0

    def schema_version(self, table: str) -> int:
        try:
            with open(self._pointer(table)) as f:
                return json.load(f)["schema"]
        except OSError:
            return 0

    def read(self, table: str, schema) -> DataFrame:
        """The table in force, brought to `schema`; empty if it was never written."""
        v = self.version(table)
        if not v:
            return self.spark.createDataFrame([], schema)
        return evolve(self.spark.read.parquet(os.path.join(self.root, table, f"v{v:06d}")), schema)

    def write(self, table: str, df: DataFrame, keep: int = 2) -> int:
        """Write a new snapshot (it may be computed from the present one), then point to it; older ones beyond `keep` go."""
        v = self.version(table) + 1
        df.write.mode("overwrite").parquet(os.path.join(self.root, table, f"v{v:06d}"))
        pointer = self._pointer(table)
        with open(pointer + ".new", "w") as f:
            json.dump({"version": v, "schema": SCHEMA_VERSION}, f)
        os.replace(pointer + ".new", pointer)
        for old in range(1, v - keep + 1):
            shutil.rmtree(os.path.join(self.root, table, f"v{old:06d}"), ignore_errors=True)
        return v


def move_file(src: str, dst: str) -> str | None:
    """Move without replacing anything; None if done, else why not. Across volumes the copy is checked first."""
    if os.path.lexists(dst):
        return f"{dst} exists"
    try:
        os.makedirs(os.path.dirname(dst), exist_ok=True)
        try:
            os.rename(src, dst)
        except OSError:
            size = os.path.getsize(src)
            shutil.copy2(src, dst)
            if os.path.getsize(dst) != size:
                os.remove(dst)
                return "short copy"
            os.remove(src)
    except OSError as e:
        return str(e)
    return None


def carry_out(moves: list[tuple[str, str]]) -> list[tuple[str, str, str | None]]:
    """Carry out moves in order: (src, dst, failure or None). Meant for a plan's rows fetched in order, bounded by what one person renames."""
    return [(a, b, move_file(a, b)) for a, b in moves]


def undo(moves: list[tuple[str, str]]) -> tuple[int, list[str]]:
    """Move back, last first, then drop folders left empty, deepest first."""
    failed, done = [], 0
    for a, b in reversed(moves):
        why = move_file(b, a)
        if why is None:
            done += 1
        else:
            failed.append(f"{b}: {why}")
    folders = sorted({os.path.dirname(b) for _, b in moves}, key=lambda p: -p.count(os.sep))
    for folder in folders:
        try:
            os.rmdir(folder)
        except OSError:
            pass
    return done, failed
