"""An index run over a folder: list, compare, read what changed, hash what may be a duplicate, decode what is not analysed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.functions import media as m
from fotolake.operators import catalog as c
from fotolake.operators.ordering import global_rank
from fotolake.runtime import cut, slots
from fotolake.schema import MEDIA
from fotolake.sources import exif, files, images
from fotolake.sources.store import Store


def media_rows(meta: DataFrame) -> DataFrame:
    """Extraction records (path, name, ext, size, date_taken as timestamp, width and height as text, ...) to media rows.

    Width and height that are no whole numbers are null; what later stages compute is null.
    """
    have = set(meta.columns)
    text = lambda k: F.col(k).cast("string") if k in have else F.lit(None).cast("string")
    whole = lambda k: F.expr(f"try_cast(trim({k}) as int)") if k in have else F.lit(None).cast("int")
    null = lambda k: F.lit(None).cast(MEDIA[k].dataType).alias(k)
    place = [F.col(k) if k in have else null(k) for k in ("lat", "lon")]
    taken = F.unix_seconds("date_taken") if "date_taken" in have else F.lit(None).cast("long")
    return meta.select(
        "path", m.file_name().alias("file_name"), "ext", "size", "mtime", taken.alias("date_taken"), *[text(k).alias(k) for k in ("camera_make", "camera_model", "lens", "iso")],
        whole("width").alias("width"), whole("height").alias("height"), *[null(k) for k in c.DERIVED], *place,
    )


def index_library(store: Store, root: str, *, with_exif: bool = True, images_only: bool = True, cache: str | None = None) -> dict[str, int]:
    """Bring the `media` table up to date with a folder; each stage writes a snapshot that the next one reads.

    Returns the counters scanned, updated, unchanged, missing, hashed, analysed, thumbnails and errors.
    Files of unchanged size and time are not opened. Only present files whose size collides are hashed.
    Hashing and analysis take up all that the catalog lacks, under this folder or any other; with a
    `cache` folder the pictures analysed leave a thumbnail there, from the same decode. Files that can't
    be read count as errors and stay due for the next run.
    """
    spark = store.spark
    listing = files.walk(spark, root, images_only=images_only)
    listing = cut(listing)
    good = listing.where("error is null")
    media = store.read("media", MEDIA)
    changes = cut(c.classify_changes(good, media))
    counters = c.index_outcome(changes).first().asDict()
    todo = changes.where(F.col("change").isin("new", "changed", "stale")).select("path")
    meta = files.file_meta(good).join(todo, "path", "left_semi")
    lost = listing.where("error is not null").select("path")
    if with_exif:
        closed = cut(files.unreadable(todo.repartition(slots(spark))))
        counters["updated"] -= closed.count()
        meta, todo, lost = meta.join(closed, "path", "left_anti"), todo.join(closed, "path", "left_anti"), lost.unionByName(closed)
        meta = meta.join(exif.read_exif(files.contents(todo.repartition(slots(spark)))), "path", "left")
    seen = changes.where(F.col("change").isin("new", "changed", "stale", "unchanged"))
    merged = c.upsert(media, media_rows(meta))
    here = merged.join(seen.select("path"), "path", "left_semi").select("id")
    store.write("media", c.mark_missing(merged, here, root))

    media = store.read("media", MEDIA)
    work = cut(c.hash_worklist(media))
    found = cut(files.digests(work.repartition(slots(spark))).join(work.select("id", "path"), "path"))
    lost = lost.unionByName(found.where("content_hash is null").select("path"))
    found = found.where("content_hash is not null")
    counters["hashed"] = found.count()
    if counters["hashed"]:
        store.write("media", c.set_columns(media, found, ("content_hash",)))

    media = store.read("media", MEDIA)
    work = cut(c.analysis_worklist(media))
    counters["analysed"] = counters["thumbnails"] = 0
    if not work.isEmpty():
        closed = cut(files.unreadable(work.repartition(slots(spark))))
        work, lost = cut(work.join(closed, "path", "left_anti").join(media.select("id", m.thumbnail_path().alias("place")), "id")), lost.unionByName(closed)
        done = cut(images.analyse_files(spark, work.select("path", "place").repartition(slots(spark)), cache).join(work, "path"))
        counters["analysed"] = done.where("phash is not null").count()
        counters["thumbnails"] = counters["analysed"] if cache else 0
        media = c.set_columns(media, done, ("phash", "dom_color"))
        store.write("media", c.set_columns(media, done, ("width", "height"), keep_known=True))
    counters["errors"] = lost.distinct().count()
    return counters


def summary(counters: dict[str, int]) -> str:
    """One line about an index run; what did not happen is left out."""
    parts = [f"{counters['scanned']} file(s): {counters['updated']} updated, {counters['unchanged']} unchanged"]
    parts += [f"{counters[k]} {k}" for k in ("hashed", "analysed", "thumbnails", "missing") if counters.get(k)]
    if counters.get("errors"):
        parts.append(f"{counters['errors']} error(s)")
    return ", ".join(parts)


def thumbnails_missing(media: DataFrame, cached: DataFrame) -> DataFrame:
    """Present decodable rows whose thumbnail is not in the cache listing `cached(place)`."""
    rows = media.where(~F.col("missing") & m.is_decodable_ext()).withColumn("place", m.thumbnail_path())
    return rows.join(cached.select("place"), "place", "left_anti").select("id", "path", "place")


def restore_plan(ledger: DataFrame, batch: int, existing: DataFrame) -> DataFrame:
    """Moves that undo a removal batch, newest first: src, dst, blocked (the original place is taken again)."""
    p = c.pending(ledger, batch).select("id", F.col("quarantine_path").alias("src"), F.col("original_path").alias("dst"))
    taken = existing.select(F.col("path").alias("dst")).distinct().withColumn("_taken", F.lit(True))
    j = p.join(taken, "dst", "left")
    return global_rank(j, [F.col("id").desc()], "seq").select("seq", "id", "src", "dst", F.coalesce("_taken", F.lit(False)).alias("blocked"))
