import json
import struct
import zlib

import numpy as np

from fieldledger.plans import maps
from fieldledger.sources.tiles import decode_png, read_tiles


def png(img, rule=0):
    h, w, c = img.shape
    flat = img.reshape(h, w * c).astype(np.int32)
    rows = b""
    for y in range(h):
        line, above = flat[y], flat[y - 1] if y else np.zeros(w * c, np.int32)
        left = np.concatenate([np.zeros(c, np.int32), line[:-c]])
        corner = np.concatenate([np.zeros(c, np.int32), above[:-c]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [np.zeros_like(line), left, above, (left + above) >> 1, paeth][rule]
        rows += bytes([rule]) + ((line - guess) & 255).astype(np.uint8).tobytes()
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_png_filters_round_trip():
    img = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    for rule in range(5):
        assert (decode_png(png(img, rule)) == img).all()


def test_terrain_from_tiles(spark, tmp_path):
    for x in (3, 4):
        img = np.zeros((4, 4, 3), int)
        img[..., 0], img[..., 1] = 128, 10 * x  # metres = 10 x
        (tmp_path / f"{x}_9.png").write_bytes(png(img, 2))
    assert read_tiles(spark, str(tmp_path)).count() == 32
    got = {(r["row"], r["col"]): r["high"] * 256 + r["low"] for r in maps.terrain(spark, str(tmp_path), 4).collect()}
    assert got == {(r, c): (500 + (30 if c < 2 else 40)) * 10 for r in range(2) for c in range(4)}


def test_basemap(spark, tmp_path):
    def write(name, feats):
        (tmp_path / name).write_text(json.dumps({"features": [{"properties": p, "geometry": {"type": t, "coordinates": c}} for p, t, c in feats]}))
        return str(tmp_path / name)

    sq = lambda x: [[[x, 0.0], [x + 1.0, 0.0], [x + 1.0, 1.0], [x, 1.0]]]
    counties = write("c.geojson", [({"BASENAME": "Ash", "LSADC": "06"}, "Polygon", sq(0.0)), ({"BASENAME": "Oak", "LSADC": "25"}, "Polygon", sq(1.0)), ({"BASENAME": "Far", "LSADC": "06"}, "Polygon", sq(8.0))])
    roads = write("r.geojson", [({"NAME": "I- 64"}, "LineString", [[0.1, 0.1], [0.5, 0.1001], [0.9, 0.1]]), ({"NAME": "Mill Rd"}, "LineString", [[0.1, 0.1], [0.2, 0.2]])])
    water = write("w.geojson", [({"NAME": "Ash Riv"}, "Polygon", sq(0.0))])
    wanted = spark.createDataFrame([("Ash",), ("Oak (City)",), ("Elm",)], "name string")
    out = maps.basemap(spark, counties, roads, water, wanted, (-1.0, -1.0, 3.0, 2.0))
    assert sorted(r["name"] for r in out["counties"].collect()) == ["Ash", "Oak (City)"]
    assert [len(r["line"]) for r in out["outline"].collect()] == [5]  # six corners, one of them within the tolerance
    r = out["roads"].collect()
    assert [(x["class"], len(x["line"])) for x in r] == [("interstate", 2)]
    assert [x["label"] for x in out["water"].collect()] == ["Ash River"]
    assert [x["name"] for x in out["missing"].collect()] == ["Elm"]
