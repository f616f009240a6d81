"""Pixels: decoding, perceptual hash and dominant colour, one pass over each picture."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotolake.runtime import cut, shared_folder

CLUSTERS, ROUNDS, EDGE = 5, 12, 64
HASH_W, HASH_H = 9, 8
#: Paths sent to all workers at once at most (under 30 MB); beyond it pictures are joined to them by shuffle.
MAX_LINKS = 100_000
#: Channels of the image source's modes (OpenCV numbering, bytes in BGR order).
_RED, _GREEN, _BLUE = 2, 1, 0
ANALYSED = "width int, height int, phash long, dom_color int"
LUMA = (0.2126, 0.7152, 0.0722)


def triangle_weights(source: int, target: int) -> np.ndarray:
    """Row-stochastic (target x source) weights of a tent filter, as wide as the reduction."""
    scale = source / target
    reach = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    w = np.maximum(0.0, 1.0 - np.abs((np.arange(source)[None, :] + 0.5 - centre[:, None]) / reach))
    return (w / w.sum(axis=1, keepdims=True)).astype(np.float32)


def resized(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """rgb (h, w, 3) floats to (height, width, 3), rounded to whole levels."""
    rows = np.tensordot(triangle_weights(rgb.shape[0], height), rgb, axes=(1, 0))
    both = np.tensordot(rows, triangle_weights(rgb.shape[1], width), axes=(1, 1)).transpose(0, 2, 1)
    return np.clip(np.floor(both + 0.5), 0, 255).astype(np.float32)


def perceptual_hash(rgb: np.ndarray) -> int:
    """64 comparisons of neighbours on a 9 x 8 grey grid, row by row from the lowest bit; as a signed long."""
    grey = np.floor(resized(rgb, HASH_W, HASH_H) @ np.array(LUMA, np.float32) + 0.5)
    bits = (grey[:, :-1] > grey[:, 1:]).ravel()
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def dominant_colour(rgb: np.ndarray) -> int:
    """Centre of the largest of five clusters, seeded evenly through the pixels: 0xRRGGBB."""
    px = resized(rgb, EDGE, EDGE).reshape(-1, 3)
    centres = px[np.arange(CLUSTERS) * len(px) // CLUSTERS].copy()
    member = np.full(len(px), -1)
    for _ in range(ROUNDS):
        now = ((px[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        stays = np.array_equal(now, member)
        member = now
        for c in range(CLUSTERS):
            if (own := px[member == c]).size:
                centres[c] = own.mean(axis=0)
        if stays:
            break
    best = int(np.bincount(member, minlength=CLUSTERS).argmax())
    r, g, b = (int(np.clip(np.floor(v + 0.5), 0, 255)) for v in centres[best])
    return r << 16 | g << 8 | b


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """path and image of the pictures below a folder (what the JVM's ImageIO reads); files that are none are dropped."""
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    return found.select(origin_path().alias("path"), "image")


def pixels(data, h: int, w: int, n: int) -> np.ndarray | None:
    """Levels (h, w, 3) of an image row in red, green, blue; None without pixels."""
    if data is None or h <= 0 or w <= 0:
        return None
    a = np.frombuffer(bytes(data), np.uint8).reshape(h, w, n).astype(np.float32)
    return np.repeat(a, 3, axis=2) if n == 1 else a[:, :, [_RED, _GREEN, _BLUE]]


def origin_path() -> F.Column:
    """Path on disk of an image row; the source gives origins percent-encoded."""
    plain = F.regexp_replace("image.origin", "^file:(//)?", "")
    # '+' stands for itself in a path
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def analyse(images: DataFrame, cache: str | None = None) -> DataFrame:
    """Image rows (path, image[, place]) to path, width, height, phash, dom_color: all from one decode, as is the thumbnail at `place` in a cache folder if one is given. Rows without pixels are null."""

    def run(batches):
        from fotolake.sources.thumbs import put_thumbnail

        for pdf in batches:
            out = []
            for path, place, h, w, n, data in zip(pdf["path"], pdf["place"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                rgb = pixels(data, h, w, n)
                if rgb is None:
                    out.append((path, None, None, None, None))
                    continue
                if cache is not None and place is not None:
                    put_thumbnail(cache, place, rgb)
                out.append((path, w, h, perceptual_hash(rgb), dominant_colour(rgb)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "phash", "dom_color"]).astype({"width": "Int32", "height": "Int32", "phash": "Int64", "dom_color": "Int32"})

    place = F.col("place") if "place" in images.columns else F.lit(None).cast("string")
    i = images.select("path", place.alias("place"), *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    return i.mapInPandas(run, f"path string, {ANALYSED}")


def _linked(paths: DataFrame, stage: str) -> DataFrame:
    """name and path of links below `stage` to the files at `paths(path)`, under names every source lists."""

    def run(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                name = hashlib.sha256(path.encode("utf-8", "surrogateescape")).hexdigest()
                os.makedirs(os.path.join(stage, name[:2]), exist_ok=True)
                link = os.path.join(stage, name[:2], name)
                try:
                    os.symlink(os.path.abspath(path), link)
                except FileExistsError:  # a task may run twice
                    pass
                out.append((name, path))
            yield pd.DataFrame(out, columns=["name", "path"])

    return paths.select("path").mapInPandas(run, "name string, path string")


@contextmanager
def opened(spark: SparkSession, paths: DataFrame) -> Iterator[DataFrame]:
    """path and image of the files at `paths(path, ...)`, with its other columns; files that are no pictures are left out. To be used inside the block.

    Spark's image source hides names that begin with a dot or underscore, so it gets links of other
    names, in the folder all executors share; that must be one the file system mounts, as the library is.
    """
    shared = urlsplit(shared_folder(spark))
    if shared.scheme not in ("", "file"):
        raise ValueError(f"decoding needs a mounted shared folder, not {shared_folder(spark)}")
    os.makedirs(unquote(shared.path), exist_ok=True)
    stage = tempfile.mkdtemp(prefix="pictures-", dir=unquote(shared.path))
    os.chmod(stage, 0o777)
    try:
        links = cut(_linked(paths, stage))
        if links.isEmpty():
            yield spark.createDataFrame([], "path string, image struct<origin string, height int, width int, nChannels int, mode int, data binary>").join(paths, "path")
        else:
            named = read_images(spark, "file://" + stage).select(F.element_at(F.split("path", "/"), -1).alias("name"), "image")
            # names are digests and paths are short: the pixels stay where they were decoded
            known = links.join(paths, "path")
            if known.count() <= MAX_LINKS:
                known = F.broadcast(known)
            yield named.join(known, "name").drop("name")
    finally:
        shutil.rmtree(stage)


def analyse_files(spark: SparkSession, paths: DataFrame, cache: str | None = None) -> DataFrame:
    """`analyse` of the files at `paths(path[, place])`, which keep their paths as given; files that are no pictures are left out."""
    with opened(spark, paths) as images:
        return cut(analyse(images, cache))
