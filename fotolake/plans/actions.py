"""Plans carried out: tags, removals with their ledger, restores, and rename plans over folders.

Files move in tasks, each move by itself; a move that a task carries out twice counts as done the
second time. Tables are written after the files moved, from what did move.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.operators import catalog as c
from fotolake.plans import indexing, rename, template
from fotolake.runtime import cut, slots
from fotolake.schema import LEDGER, MEDIA, USER_META
from fotolake.sources import exif, files
from fotolake.sources.store import Store, move_file


def move_all(moves: DataFrame) -> DataFrame:
    """Carry out `moves(src, dst, ...)` once each: the same rows with `failure` (null where done)."""
    columns = ", ".join(f"{n} {t}" for n, t in moves.dtypes)

    def run(batches):
        for pdf in batches:
            why = []
            for src, dst in zip(pdf["src"], pdf["dst"]):
                twice = not os.path.lexists(src) and os.path.lexists(dst)  # moved before the task was lost
                why.append(None if twice else move_file(src, dst))
            yield pdf.assign(failure=pd.Series(why, index=pdf.index, dtype=object))

    moves = cut(moves.repartition(slots(moves.sparkSession)))
    return cut(moves.mapInPandas(run, f"{columns}, failure string"))


def tag(store: Store, edits: DataFrame, now: int) -> dict[str, int]:
    """Set user fields (`edits(id, ...)` with hidden, rating or kind) of the contents of files, hashing those that have no digest yet.

    The last written edit of a content holds where several of its files are given (the greatest id).
    Returns tagged contents, files hashed and errors (files that can't be read, which get no tag).
    """
    media = store.read("media", MEDIA)
    work = cut(c.tag_worklist(media, edits))
    found = cut(files.digests(work.repartition(slots(store.spark))).join(work, "path"))
    known = found.where("content_hash is not null")
    hashed = known.count()
    if hashed:
        store.write("media", c.set_columns(media, known, ("content_hash",)))
        media = store.read("media", MEDIA)
    fields = [f for f in ("hidden", "rating", "kind") if f in edits.columns]
    by_content = edits.join(media.select("id", "content_hash"), "id").where("content_hash is not null")
    by_content = cut(by_content.groupBy("content_hash").agg(*[F.max_by(f, "id").alias(f) for f in fields]))
    store.write("user_meta", c.set_user_meta(store.read("user_meta", USER_META), by_content, F.lit(now)))
    return {"tagged": by_content.count(), "hashed": hashed, "errors": work.count() - hashed}


def remove_files(store: Store, selection: DataFrame, vault: str, now: int) -> dict[str, int]:
    """Move the files of `selection(path)` into the next batch below `vault`, note them in the ledger and drop their rows.

    No file there is replaced. If the ledger can't be written the files move back.
    """
    ledger = store.read("ledger", LEDGER)
    batch = c.next_batch(ledger).first().next_batch
    there = files.walk(store.spark, vault).select("path") if os.path.isdir(vault) else store.spark.createDataFrame([], "path string")
    planned = rename.removal_plan(selection, vault, batch, there).select(F.col("path").alias("src"), F.col("dest").alias("dst"))
    moved = move_all(planned)
    done = moved.where("failure is null")
    entries = done.select(F.lit(batch).cast("long").alias("batch"), F.col("src").alias("original_path"), F.col("dst").alias("quarantine_path"), F.lit(now).cast("long").alias("moved_at"))
    try:
        store.write("ledger", c.record(ledger, entries))
    except Exception:
        move_all(done.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        raise
    store.write("media", c.remove_paths(store.read("media", MEDIA), done.select(F.col("src").alias("path"))))
    return {"batch": batch, "moved": done.count(), "failed": moved.where("failure is not null").count()}


def restore_batch(store: Store, batch: int) -> dict[str, int]:
    """Move a batch back, except where the original place is taken again, and mark what was restored. Rows come back with the next index run."""
    ledger = store.read("ledger", LEDGER)
    pending = c.pending(ledger, batch)
    folders = pending.select(F.expr("left(original_path, char_length(original_path) - char_length(substring_index(original_path, '/', -1)) - 1)").alias("folder")).distinct()

    def standing(batches):
        for pdf in batches:
            for folder in pdf["folder"]:
                with os.scandir(folder or "/") if os.path.isdir(folder or "/") else _nothing() as entries:
                    yield pd.DataFrame({"path": [e.path for e in entries]}, dtype=object)

    plan = indexing.restore_plan(ledger, batch, folders.mapInPandas(standing, "path string"))
    plan = cut(plan)
    moved = move_all(plan.where("not blocked").select("id", "src", "dst"))
    done = moved.where("failure is null")
    store.write("ledger", c.mark_restored(ledger, done.select("id")))
    restored = done.count()
    return {"restored": restored, "failed": plan.count() - restored}


class _nothing:
    def __enter__(self):
        return []

    def __exit__(self, *_):
        return False


def folder_plan(spark: SparkSession, root: str, text: str, *, recursive: bool = True, append_ext: bool = True, output_root: str | None = None) -> DataFrame:
    """A rename plan over a folder. Files are opened only if the template asks for what is inside them."""
    listing = cut(files.walk(spark, root, recursive=recursive))
    meta = files.file_meta(listing)
    if template.needs_contents(template.parse(text)):
        inside = exif.read_exif(files.contents(meta.select("path").repartition(slots(spark))))
        meta = meta.join(inside, "path", "left")
    out = root if output_root is None else output_root
    there = listing if out == root else files.walk(spark, out) if os.path.isdir(out) else listing.where("false")
    return rename.plan(meta, text, append_ext=append_ext, output_root=out, existing=there.select("path"))


def apply_plan(store: Store, planned: DataFrame, output_root: str) -> DataFrame:
    """Carry out a rename plan's rows that are ok, and let the catalog follow those that moved: src, dst, failure."""
    moved = move_all(rename.moves(planned, output_root))
    store.write("media", c.apply_moves(store.read("media", MEDIA), moved.where("failure is null").select("src", "dst")))
    return moved
