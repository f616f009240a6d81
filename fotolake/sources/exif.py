"""EXIF of JPEG, TIFF and PNG files, parsed from their bytes in batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.functions.media import degrees_of, plausible_place

# Tag numbers, and byte sizes of the field types.
TAGS = {0x010F: "camera_make", 0x0110: "camera_model", 0x0132: "date_time", 0x9003: "date_original", 0xA434: "lens", 0x8827: "iso", 0xA002: "width", 0xA003: "height"}
GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
SUB_EXIF, SUB_GPS = 0x8769, 0x8825
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure that holds the tags, or None."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            if kind == 0xE1 and body[:6] == b"Exif\0\0":
                return body[6:]
            if kind == 0xDA:
                return None
            at += 2 + size
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
    return None


def _value(block: bytes, order: str, kind: int, count: int, raw: bytes):
    size = SIZES.get(kind, 0) * count
    if not size:
        return None
    body = raw[:size] if size <= 4 else block[struct.unpack(order + "I", raw)[0] :][:size]
    if len(body) < size:
        return None
    if kind == 2:
        return body.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        n = struct.unpack(order + ("I" if kind == 5 else "i") * (2 * count), body)
        return [a / b if b else float("nan") for a, b in zip(n[::2], n[1::2])]
    code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 7: "B"}[kind]
    return list(struct.unpack(order + code * count, body))


def _directory(block: bytes, order: str, at: int) -> dict[int, object]:
    out = {}
    if at + 2 > len(block):
        return out
    for i in range(struct.unpack(order + "H", block[at : at + 2])[0]):
        entry = block[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) < 12:
            break
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if count < 1_000_000:
            out.setdefault(tag, _value(block, order, kind, count, entry[8:]))
    return out


def read_tags(data: bytes) -> dict[str, object]:
    """Tags by name; empty where there are none or they are damaged."""
    try:
        block = tiff_block(data)
        if not block or len(block) < 8:
            return {}
        order = "<" if block[:2] == b"II" else ">"
        main = _directory(block, order, struct.unpack(order + "I", block[4:8])[0])
        found = dict(main)
        for sub in (SUB_EXIF,):
            if main.get(sub):
                found |= {k: v for k, v in _directory(block, order, int(main[sub][0])).items() if k not in found}
        out = {}
        for tag, name in TAGS.items():
            v = found.get(tag)
            if v is not None:
                out[name] = v.strip('"') if isinstance(v, str) else str(v[0])
        if main.get(SUB_GPS):
            gps = _directory(block, order, int(main[SUB_GPS][0]))
            out |= {name: gps[tag] for tag, name in GPS.items() if gps.get(tag) is not None}
        return out
    except (struct.error, ValueError, IndexError, TypeError):
        return {}


def exif_time(text: str) -> Column:
    """A tag's `YYYY:MM:DD HH:MM:SS` as a timestamp; anything else, and dates there are not, null."""
    t = F.trim(F.col(text))
    return F.when(t.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")))


SCHEMA = "path string, camera_make string, camera_model string, lens string, iso string, width string, height string, taken string, lat_dms array<double>, lat_ref string, lon_dms array<double>, lon_ref string"


def read_exif(files: DataFrame) -> DataFrame:
    """files(path, content) to the metadata inside: path, date_taken, camera_make, camera_model, lens, iso, width, height, lat, lon.

    Damaged or absent tags are null. The time is the shutter's, else the file's; a text that is no
    `YYYY:MM:DD HH:MM:SS` is null. A place needs three parts on both axes and must be plausible.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                t = read_tags(bytes(content)) if content is not None else {}
                dms = [t.get(k) if isinstance(t.get(k), list) and len(t[k]) >= 3 else None for k in ("lat", "lon")]
                rows.append((path, *[t.get(k) for k in ("camera_make", "camera_model", "lens", "iso", "width", "height")], t.get("date_original", t.get("date_time")), dms[0], t.get("lat_ref"), dms[1], t.get("lon_ref")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    x = files.select("path", "content").mapInPandas(run, SCHEMA)
    axis = lambda a: degrees_of(*[F.get(f"{a}_dms", F.lit(i)) for i in range(3)], F.coalesce(f"{a}_ref", F.lit("")))
    x = x.withColumn("_lat", axis("lat")).withColumn("_lon", axis("lon"))
    ok = F.col("_lat").isNotNull() & F.col("_lon").isNotNull() & plausible_place(F.col("_lat"), F.col("_lon"))
    return x.select("path", exif_time("taken").alias("date_taken"), "camera_make", "camera_model", "lens", "iso", "width", "height", F.when(ok, F.col("_lat")).alias("lat"), F.when(ok, F.col("_lon")).alias("lon"))
