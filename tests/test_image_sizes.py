"""Sizes from image bytes: payloads that look like frames, fill bytes, units, cut files."""

import struct

from pyspark.sql import functions as F

from atlasweave.functions.images import header_size


def segment(marker, payload):
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def frame(marker, width, height):
    return segment(marker, struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00" * 3)


START, END = b"\xff\xd8", b"\xff\xd9"


def test_sizes(spark):
    thumbnail = segment(0xE1, b"Exif\0\0" + START + frame(0xC0, 16, 16) + b"\xff\xff" * 300)
    many = b"".join(segment(0xED, b"\xff" * 60_000) for _ in range(12))
    vp8 = b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 640 | 0x4000, 480)
    lossless = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", (300 - 1) | (200 - 1) << 14)
    cases = {
        "plain": (START + segment(0xE0, b"JFIF\0") + frame(0xC0, 640, 480) + END, ("jpg", 640, 480)),
        "thumbnail": (START + thumbnail + frame(0xC2, 4000, 3000) + END, ("jpg", 4000, 3000)),
        "long": (START + many + b"\xff\xff\xff" + frame(0xC1, 50, 60)[1:] + END, ("jpg", 50, 60)),
        "tables first": (START + segment(0xC4, b"\0" * 20) + frame(0xC0, 7, 9), ("jpg", 7, 9)),
        "scan first": (START + segment(0xDA, b"\0" * 8) + frame(0xC0, 7, 9), None),
        "cut": ((START + segment(0xE0, b"J" * 30) + frame(0xC0, 7, 9))[:-14], None),
        "not a marker": (START + b"\x00" * 20 + frame(0xC0, 7, 9), None),
        "no length": (START + b"\xff\xe0\x00\x00" + b"\x00" * 20, None),
        "svg": (b'\xef\xbb\xbf<?xml version="1.0"?>\n<!DOCTYPE svg [<!ENTITY a "b">]>\n<svg\n width = "2in" height=\'5cm\'>', ("svg", 192, 189)),
        "svg box": (b'<svg viewBox="-5 -5 120.4 60.2"></svg>     ', ("svg", 120, 60)),
        "svg width": (b'<!-- <svg width="9" height="9"/> --><svg data-width="3" width="50" viewBox="0,0,200,100"/>', ("svg", 50, 25)),
        "svg percent": (b'<svg width="100%" height="100%" style="a"></svg>', None),
        "svg cut": (b'<svg width="50" height="40" id="abc', None),
        "svg in html": (b'<html><body><svg width="50" height="40"/></body>', None),
        "svg many": (b"<svg " + b'a="b" ' * 20_000 + b'width="5" height="6">', ("svg", 5, 6)),
        "webp": (vp8, ("webp", 640, 480)),
        "webp lossless": (lossless, ("webp", 300, 200)),
        "ico": (b"\0\0\1\0\1\0\0\x20" + b"\0" * 20, ("ico", 256, 32)),
        "gif": (b"GIF89a" + struct.pack("<HH", 3, 4) + b"\0" * 10, ("gif", 3, 4)),
        "text": (b"nothing that is an image", None),
        "empty": (b"", None),
        "none": (None, None),
    }
    frame_ = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in cases.items()], "name string, body binary")
    got = {r.name: r.s and tuple(r.s) for r in frame_.select("name", header_size(F.col("body")).alias("s")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
