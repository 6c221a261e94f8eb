"""Facts of pictures, overlays and stabilizing."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from frameweave.operators import overlays as O
from frameweave.operators import temporal as T
from frameweave.plans.bridge import pixels
from frameweave.sources import stills


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + bytes(4)


def test_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 20, 8, 3, 0, 0, 0)) + chunk(b"acTL", struct.pack(">II", 7, 0)) + chunk(b"tRNS", b"x")
    exif = b"Exif\0\0II*\0" + struct.pack("<IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 48, 64, 1) + bytes(3)
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little") + b"ANMF\0\0\0\0" * 3
    bmp = b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 12, -9, 1, 32)
    assert stills.summarize(png) == {"format": "png", "width": 30, "height": 20, "frames": 7, "has_alpha": True}
    assert stills.summarize(jpeg) == {"format": "jpeg", "frames": 1, "has_alpha": False, "orientation": 6, "height": 48, "width": 64}
    assert stills.summarize(webp) == {"format": "webp", "frames": 3, "has_alpha": True, "width": 100, "height": 50}
    assert stills.summarize(bmp)["height"] == 9 and "error" in stills.summarize(png[:20]) and "error" in stills.summarize(b"")
    df = spark.createDataFrame([(str(i), bytearray(d) if d is not None else None) for i, d in enumerate((png, jpeg, webp, bmp, b"?", None))], "path string, content binary")
    assert sorted((r.path, r.format) for r in stills.summaries(df).collect() if not r.error) == [("0", "png"), ("1", "jpeg"), ("2", "webp"), ("3", "bmp")]


def test_overlays(spark, sf):
    px = pixels(spark, sf).where("frame_idx = 0")
    assert O.measure_text("10:5") == (15, 5)
    inked = O.draw_text(px, "1", 2, 3, (1, 2, 3)).where("r = 1 and g = 2 and b = 3").count()
    assert inked == sum(row.count("#") for row in O.DIGITS["1"])
    out = O.overlay(px, [("rect", {"x": 0, "y": 0, "width": 4, "height": 4, "color": (9, 9, 9)}), ("progress", {"width": 16, "height": 16, "share": F.lit(0.5)}), ("highlight", {"x": 5, "y": 5, "width": 6, "height": 6})])
    assert out.where("x < 4 and y < 4 and r = 9").count() == 16 and out.where("y >= 14 and x < 8 and r = 255").count() == 16 and out.count() == 256


def test_stabilize(spark, sf):
    px = pixels(spark, sf)
    out = O.stabilize(px, T.estimate_motion(px, 16, 16, 1), 0.65, 1)
    assert 0 < out.count() <= px.count() and out.agg(F.max("x"), F.min("y")).first()[0] <= 13
