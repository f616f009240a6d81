"""Listing files on disk, their metadata and byte sizes."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.functions.media import extension, is_image_ext, parent_name, stem

UNDO_LOG = ".moves_undo.log"
LISTING = "path string, size long, mtime long, created long, accessed long, error string"


def _walk(root: str, recursive: bool) -> Iterator[str]:
    for folder, dirs, names in os.walk(root):
        dirs.sort()
        for name in sorted(names):
            full = os.path.join(folder, name)
            if name != UNDO_LOG and os.path.isfile(full) and not os.path.islink(full):
                yield full
        if not recursive:
            break


def walk(spark: SparkSession, root: str, *, recursive: bool = True, images_only: bool = False, cloud: bool = False) -> DataFrame:
    """Regular files below `root`: path, size, mtime, created, accessed (seconds), error.

    Names that begin with a dot or underscore count, which Spark's own file sources would hide, so
    the folder tree is walked: one task per top-level folder. Files that vanish meanwhile carry an
    error. With `cloud` the listing comes from Spark's `binaryFile` source (any store, no hidden names).
    """
    if cloud:
        f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
        null = F.lit(None)
        out = f.select("path", F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"), null.cast("long").alias("created"), null.cast("long").alias("accessed"), null.cast("string").alias("error"))
    else:
        entries = sorted(os.listdir(root))
        jobs = [(os.path.join(root, e), True) for e in entries if recursive and os.path.isdir(os.path.join(root, e)) and not os.path.islink(os.path.join(root, e))] + [(root, False)]

        def stat(batches):
            import pandas as pd

            for pdf in batches:
                rows = []
                for folder, deep in zip(pdf["folder"], pdf["deep"]):
                    for path in _walk(folder, bool(deep)):
                        try:
                            s = os.stat(path)
                            rows.append((path, s.st_size, int(s.st_mtime), int(s.st_ctime), int(s.st_atime), None))
                        except OSError as e:
                            rows.append((path, None, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["path", "size", "mtime", "created", "accessed", "error"]).astype({c: "Int64" for c in ("size", "mtime", "created", "accessed")})

        out = spark.createDataFrame(jobs, "folder string, deep boolean").repartition(max(1, min(len(jobs), 256))).mapInPandas(stat, LISTING)
    return out.where(is_image_ext(extension("path"))) if images_only else out


def file_meta(listing: DataFrame) -> DataFrame:
    """Listing to name, ext, parent, size and dates; errors are left out."""
    t = lambda c: F.timestamp_seconds(c)
    return listing.where("error is null").select(
        "path", stem().alias("name"), extension().alias("ext"), parent_name().alias("parent"), "size", "mtime", t("created").alias("date_created"), t("mtime").alias("date_modified"), t("accessed").alias("date_accessed")
    )


def folder_bytes(listing: DataFrame) -> DataFrame:
    return listing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def contents(paths: DataFrame) -> DataFrame:
    """path and content of the files at `paths(path)`: each path is opened as it stands, whatever its name.

    Null where a file can't be read.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pd.DataFrame({"path": [path], "content": [content]})  # a file at a time, for memory

    return paths.select("path").mapInPandas(run, "path string, content binary")


def digests(paths: DataFrame) -> DataFrame:
    """path and content digest (that of `content_digest`) of the files at `paths(path)`, read piece by piece; null where a file can't be read."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as f:
                        out.append((path, hashlib.file_digest(f, "sha256").hexdigest()))
                except OSError:
                    out.append((path, None))
            yield pd.DataFrame(out, columns=["path", "content_hash"])

    return paths.select("path").mapInPandas(run, "path string, content_hash string")


def unreadable(paths: DataFrame) -> DataFrame:
    """Those of `paths(path)` that are gone or can't be opened."""

    def run(batches):
        for pdf in batches:
            bad = []
            for path in pdf["path"]:
                try:
                    with open(path, "rb") as f:
                        f.read(1)
                except OSError:
                    bad.append(path)
            yield pdf[pdf["path"].isin(bad)]

    return paths.select("path").mapInPandas(run, "path string")


def read_undo_log(root: str) -> list[tuple[str, str]]:
    """(from, to) of each move; two lines an entry, an odd last line is dropped, no file is no entry."""
    try:
        with open(os.path.join(root, UNDO_LOG), encoding="utf-8", errors="replace") as f:
            lines = f.read().splitlines()
    except OSError:
        return []
    return list(zip(lines[::2], lines[1::2]))


def write_undo_log(root: str, moves: list[tuple[str, str]]) -> None:
    with open(os.path.join(root, UNDO_LOG), "w", encoding="utf-8") as f:
        f.writelines(f"{a}\n{b}\n" for a, b in moves)


def clear_undo_log(root: str) -> None:
    if os.path.exists(os.path.join(root, UNDO_LOG)):
        os.remove(os.path.join(root, UNDO_LOG))
