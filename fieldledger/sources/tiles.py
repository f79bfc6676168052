"""Raster tiles from a folder: binary files read in parallel, decoded to one row a pixel."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "tile_x long, tile_y long, px int, py int, r int, g int, b int"


def decode_png(data: bytes) -> np.ndarray:
    """height x width x channels of an 8-bit RGB or RGBA image that is not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body += part
        at += size + 12
    width, height, depth, colour, _, _, interlaced = head
    channels = {2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlaced:
        raise ValueError("only 8-bit RGB or RGBA without interlace")
    raw = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, width * channels + 1)
    out = np.zeros((height, width * channels), dtype=np.uint8)
    above = np.zeros(width * channels, dtype=np.int32)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if rule == 2:
            line = (line + above) & 255
        elif rule in (1, 3, 4):
            # each pixel depends on the one before it; the channels of a pixel go together
            for i in range(0, width * channels, channels):
                left = line[i - channels : i] if i else np.zeros(channels, dtype=np.int32)
                up = above[i : i + channels]
                if rule == 1:
                    guess = left
                elif rule == 3:
                    guess = (left + up) >> 1
                else:
                    corner = above[i - channels : i] if i else np.zeros(channels, dtype=np.int32)
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[i : i + channels] = (line[i : i + channels] + guess) & 255
        out[y], above = line, line
    return out.reshape(height, width, channels)


def read_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """One row a pixel of every `<x>_<y>.png` in the folder. A tile is decoded where it is read; nothing is gathered."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder)
    named = files.select(F.regexp_extract("path", r"(\d+)_(\d+)\.png$", 1).cast("long").alias("tile_x"), F.regexp_extract("path", r"(\d+)_(\d+)\.png$", 2).cast("long").alias("tile_y"), "content")

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                img = decode_png(bytes(t.content))
                py, px = np.indices(img.shape[:2])
                yield pd.DataFrame({"tile_x": t.tile_x, "tile_y": t.tile_y, "px": px.ravel(), "py": py.ravel(), "r": img[..., 0].ravel(), "g": img[..., 1].ravel(), "b": img[..., 2].ravel()})

    return named.filter("tile_x IS NOT NULL").mapInPandas(pixels, PIXELS)
