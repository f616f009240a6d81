"""Scalar functions over media rows, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that may carry metadata, and those that can be decoded.
IMAGE_EXTS = ("jpg", "jpeg", "tif", "tiff", "heic", "heif", "png", "webp", "dng", "cr2", "nef", "arw", "raf", "rw2", "orf")
DECODABLE_EXTS = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp")
# Name fragments of screenshots, and common screen sizes (either orientation).
SCREENSHOT_HINTS = ("screenshot", "screen shot", "screen_shot", "screen-shot", "screencapture", "screen capture")
SCREEN_SIZES = (
    (1280, 720), (1366, 768), (1440, 900), (1600, 900), (1680, 1050), (1920, 1080), (1920, 1200), (2048, 1152), (2560, 1440), (2560, 1600),
    (2880, 1800), (3024, 1964), (3456, 2234), (3840, 2160), (5120, 2880), (750, 1334), (828, 1792), (1080, 1920), (1125, 2436), (1170, 2532),
    (1179, 2556), (1242, 2688), (1284, 2778), (1290, 2796), (1440, 3120),
)
KINDS = ("photo", "screenshot", "saved")
UNITS = ("B", "KB", "MB", "GB", "TB")
ILLEGAL = '/\\:*?"<>|'


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_image_ext(ext: str | Column = "ext") -> Column:
    return F.lower(col(ext)).isin(*IMAGE_EXTS)


def is_decodable_ext(ext: str | Column = "ext") -> Column:
    return F.lower(col(ext)).isin(*DECODABLE_EXTS)


def classified_kind() -> Column:
    """Kind told by the file itself: name hints, then any trace of a camera, then an exact screen size."""
    name = F.lower("file_name")
    hinted = F.lit(False)
    for h in SCREENSHOT_HINTS:
        hinted |= name.contains(h)
    camera = F.coalesce(*[F.col(c).cast("string") for c in ("camera_make", "camera_model", "lens", "iso", "date_taken")]).isNotNull()
    # both orientations at once: the longer and the shorter edge in one number
    packed = F.greatest("width", "height").cast("long") * 100_000 + F.least("width", "height")
    screen = F.col("width").isNotNull() & F.col("height").isNotNull() & packed.isin(*sorted({max(s) * 100_000 + min(s) for s in SCREEN_SIZES}))
    return F.when(hinted, "screenshot").when(camera, "photo").when(screen, "screenshot").otherwise("saved")


def known_kind(kind: str | Column) -> Column:
    """Kind as stored; text that is no kind reads as null."""
    return F.when(col(kind).isin(*KINDS), col(kind))


def effective_kind(override: str | Column = "kind") -> Column:
    return F.coalesce(known_kind(override), classified_kind())


def kind_label(override: str | Column = "kind") -> Column:
    """Label of the kind in force, starred where the user set it."""
    return F.concat(effective_kind(override), F.when(known_kind(override).isNotNull(), "*").otherwise(""))


def kind_rank(kind: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), col(kind)).cast("int") - 1


def clamp_rating(rating: str | Column) -> Column:
    return F.greatest(F.least(F.coalesce(col(rating).cast("int"), F.lit(0)), F.lit(5)), F.lit(0)).cast("tinyint")


def toggled_star(current: str | Column, star: int) -> Column:
    """The rating after a click on a star: the star already set clears it."""
    return F.when(col(current) == star, 0).otherwise(star).cast("tinyint")


def stars(rating: str | Column = "rating") -> Column:
    r = clamp_rating(rating).cast("int")
    return F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), F.lit(5) - r))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def channels(color: str | Column) -> tuple[Column, Column, Column]:
    c = col(color)
    return tuple(F.shiftright(c, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0))


def _f(c: Column) -> Column:
    return c.cast("float")


def hsl(color: str | Column = "dom_color") -> Column:
    """Struct h (0-360), s, l (0-1) of a packed colour in single precision; null for null."""
    r, g, b = (_f(_f(c) / _f(F.lit(255.0))) for c in channels(color))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span, light = _f(top - low), _f(_f(top + low) / _f(F.lit(2.0)))
    grey = span <= _f(F.lit(1.1920929e-07))
    some = F.when(grey, None)  # no division where there is no hue
    ratio = lambda x: _f(_f(x) / F.coalesce(some, span))
    sat = F.when(light > 0.5, _f(span / F.when(grey, None).otherwise(_f(F.lit(2.0).cast("float") - top - low)))).otherwise(_f(span / F.when(grey, None).otherwise(_f(top + low))))
    sixth = F.when(top == r, ratio(g - b)).when(top == g, _f(ratio(b - r) + _f(F.lit(2.0)))).otherwise(_f(ratio(r - g) + _f(F.lit(4.0))))
    hue = _f(sixth * _f(F.lit(60.0)))
    hue = F.when(hue < 0, _f(hue + _f(F.lit(360.0)))).otherwise(hue)
    zero = _f(F.lit(0.0))
    return F.when(col(color).isNotNull(), F.struct(F.when(grey, zero).otherwise(hue).alias("h"), F.when(grey, zero).otherwise(sat).alias("s"), light.alias("l")))


def hue_key(color: str | Column = "dom_color") -> Column:
    """Rainbow order: struct (bucket, major, minor). Colours by hue then lightness, near-greys by lightness, unknown last."""
    x = hsl(color)
    whole = lambda c, by: _f(c * _f(F.lit(float(by)))).cast("int")
    make = lambda a, b, c: F.struct(F.lit(a).cast("int").alias("bucket"), b.alias("major"), c.alias("minor"))
    z = F.lit(0)
    return F.when(col(color).isNull(), make(2, z, z)).when(x["s"] < _f(F.lit(0.15)), make(1, whole(x["l"], 1000), z)).otherwise(make(0, whole(x["h"], 10), whole(x["l"], 1000)))


def _fixed(x: Column, places: int) -> Column:
    """Fixed decimals, rounded from the exact binary value (format_string rounds the shortest decimal text instead)."""
    return F.translate(F.format_number(x, places), ",", "")


def human_bytes(size: str | Column) -> Column:
    """`1.4 GB`: whole bytes under 1024, else one decimal up to TB."""
    b = col(size)
    out = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS[1:], 1):
        text = F.concat(_fixed(b.cast("double") / float(1024**k), 1), F.lit(f" {unit}"))
        out = out.when(b < 1024 ** (k + 1), text) if k < len(UNITS) - 1 else out.otherwise(text)
    return F.when(b.isNotNull(), out)


def coords_text(lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    a, o = col(lat), col(lon)
    side = lambda c, plus, minus: F.when(c >= 0, plus).otherwise(minus)
    text = F.concat(_fixed(F.abs(a), 5), F.lit("°"), side(a, "N", "S"), F.lit(", "), _fixed(F.abs(o), 5), F.lit("°"), side(o, "E", "W"))
    return F.when(a.isNotNull() & o.isNotNull(), text)


def coords(lat: str | Column = "lat", lon: str | Column = "lon") -> Column:
    """Struct of both coordinates, or null if either is."""
    return F.when(col(lat).isNotNull() & col(lon).isNotNull(), F.struct(col(lat).alias("lat"), col(lon).alias("lon")))


def degrees_of(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and hemisphere letter to signed decimal degrees."""
    x = d + m / F.lit(60.0) + s / F.lit(3600.0)
    return F.when(F.upper(F.trim(ref)).rlike("^[SW]"), -x).otherwise(x)


def plausible_place(lat: Column, lon: Column) -> Column:
    return (F.abs(lat) <= 90) & (F.abs(lon) <= 180) & ~((lat == 0) & (lon == 0))


def file_name(path: str | Column = "path") -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path: str | Column = "path") -> Column:
    """File name without its extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*$", "")


def extension(path: str | Column = "path") -> Column:
    """Extension in its own case, without dot; empty if there is none."""
    return F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1)


def parent_name(path: str | Column = "path") -> Column:
    return F.element_at(F.concat(F.array(F.lit("")), F.split(col(path), "/")), -2)


def path_order(path: str | Column = "path") -> Column:
    """Component-wise path order (not byte order): /l/a/b before /l/a.jpg."""
    return F.split(col(path), "/")


def normalized_dir(path: str | Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(F.trim(col(path)), "^/+|/+$", ""))


def sanitized(value: str | Column) -> Column:
    return F.translate(col(value), ILLEGAL, "_" * len(ILLEGAL))


def content_digest(content: str | Column) -> Column:
    """256-bit digest of bytes; only equality counts (SHA-256 stands in for the digest of other catalogs)."""
    return F.sha2(col(content), 256)


def key_digest(*parts: str | Column) -> Column:
    """Digest of parts, each followed by a separator: 32 hex digits."""
    sep = F.lit("\x1f")
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (col(p), sep)]), 256), 1, 32)


def thumbnail_path(path: str | Column = "path", size: str | Column = "size", mtime: str | Column = "mtime") -> Column:
    """Place of a thumbnail in the cache, sharded by the first two digits of its key."""
    k = key_digest(path, col(size).cast("string"), col(mtime).cast("string"))
    return F.concat(F.substring(k, 1, 2), F.lit("/"), k, F.lit(".jpg"))


def under(root: str, path: str | Column = "path", ascii_ci: bool = False) -> Column:
    """Path below a root, by literal prefix; `ascii_ci` folds ASCII letters as the reference store does."""
    prefix = root.rstrip("/") + "/"
    if not ascii_ci:
        return col(path).startswith(prefix)
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(col(path), up, low).startswith(prefix.translate(str.maketrans(up, low)))
