"""Small pictures: thumbnails as JPEG files in a sharded cache, and pixels for display."""

from __future__ import annotations

import os
import shutil
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.sources.images import pixels, resized

THUMB_EDGE, DISPLAY_EDGE, QUALITY = 256, 2_560, 4
_N = np.arange(8)
#: The 8-point cosine transform, the order of coefficients by rising diagonal, and steps that grow along it.
DCT = np.where(_N == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16)
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Symbols get codes of one length each: 12 sizes in 4 bits, 162 pairs of run and size in 8 bits.
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = [0x00, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
_AC_CODE = {s: i for i, s in enumerate(AC_SYMBOLS)}


def fitted(width: int, height: int, edge: int) -> tuple[int, int]:
    """Width and height within a square box, never enlarged, at least 1."""
    scale = min(1.0, edge / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def _amplitude(v: int) -> tuple[int, int]:
    size = abs(v).bit_length()
    return size, v if v > 0 else v + (1 << size) - 1


def encode_jpeg(rgb: np.ndarray, quality: int = QUALITY) -> bytes:
    """A baseline JPEG of (height, width, 3) levels; `quality`, 2 at least, is the step of the finest coefficients."""
    if quality < 2:  # coefficients would not fit the ten bits they have
        raise ValueError(quality)
    h, w, _ = rgb.shape
    steps = np.minimum(255, quality + (_N[:, None] + _N[None, :]) * quality // 2).astype(np.int64)
    full = np.pad(rgb.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    r, g, b = full[..., 0], full[..., 1], full[..., 2]
    # Luminance and colour differences of the file format.
    planes = [0.299 * r + 0.587 * g + 0.114 * b - 128, -0.168736 * r - 0.331264 * g + 0.5 * b, 0.5 * r - 0.418688 * g - 0.081312 * b]
    blocks = []
    for p in planes:
        cut = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        blocks.append(np.rint(DCT @ cut @ DCT.T / steps).astype(np.int64).reshape(-1, 64)[:, ZIGZAG])
    bits: list[str] = []
    before = [0, 0, 0]
    for k in range(len(blocks[0])):
        for c in range(3):
            block = blocks[c][k]
            size, extra = _amplitude(int(block[0]) - before[c])
            before[c] = int(block[0])
            bits.append(f"{size:04b}" + (f"{extra:0{size}b}" if size else ""))
            last = 0
            for i in np.nonzero(block[1:])[0] + 1:
                run = int(i) - last - 1
                bits.append(f"{_AC_CODE[0xF0]:08b}" * (run // 16))
                size, extra = _amplitude(int(block[i]))
                bits.append(f"{_AC_CODE[(run % 16) << 4 | size]:08b}{extra:0{size}b}")
                last = int(i)
            if last < 63:
                bits.append(f"{_AC_CODE[0x00]:08b}")
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda mark, body: struct.pack(">HH", 0xFF00 | mark, len(body) + 2) + body
    table = lambda kind, length, symbols: bytes([kind << 4]) + bytes(len(symbols) if n == length else 0 for n in range(1, 17)) + bytes(symbols)
    parts = [
        part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        part(0xDB, b"\0" + bytes(steps.reshape(64)[ZIGZAG].tolist())),
        part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))),
        part(0xC4, table(0, 4, DC_SYMBOLS) + table(1, 8, AC_SYMBOLS)),
        part(0xDA, b"\x03" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\0\x3f\0"),
    ]
    return b"\xff\xd8" + b"".join(parts) + data + b"\xff\xd9"


def put_thumbnail(cache: str, place: str, rgb: np.ndarray, edge: int = THUMB_EDGE) -> int:
    """Write a picture's thumbnail to its place in a cache folder; its bytes.

    The file is written beside its place and then put there in one step, so a task that runs twice does no harm.
    """
    jpeg = encode_jpeg(resized(rgb, *fitted(rgb.shape[1], rgb.shape[0], edge)))
    target = os.path.join(cache, place)
    os.makedirs(os.path.dirname(target), exist_ok=True)
    beside = f"{target}.{os.getpid()}"
    with open(beside, "wb") as f:
        f.write(jpeg)
    os.replace(beside, target)
    return len(jpeg)


def display_pixels(images: DataFrame, edge: int = DISPLAY_EDGE) -> DataFrame:
    """Pictures as they are shown: path, width, height, rgba (row by row), the longer edge at most `edge`."""

    def run(batches):
        for pdf in batches:
            for path, h, w, n, data in zip(pdf["path"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                rgb = pixels(data, h, w, n)
                if rgb is not None:
                    tw, th = fitted(w, h, edge)
                    small = rgb if (tw, th) == (w, h) else resized(rgb, tw, th)
                    rgba = np.concatenate([small, np.full((th, tw, 1), 255, np.float32)], axis=2).astype(np.uint8)
                    yield pd.DataFrame({"path": [path], "width": [tw], "height": [th], "rgba": [rgba.tobytes()]})  # one at a time, for memory

    i = images.select("path", *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    return i.mapInPandas(run, "path string, width int, height int, rgba binary")


def clear_cache(cache: str) -> int:
    """Empty a cache folder; the bytes it held."""
    held = 0
    if os.path.isdir(cache):
        for folder, _, names in os.walk(cache):
            held += sum(os.path.getsize(os.path.join(folder, n)) for n in names)
        shutil.rmtree(cache)
        os.makedirs(cache)
    return held
