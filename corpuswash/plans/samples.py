"""Test files of every binary format, made from the tables by a rule: bytes built by column expressions."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def said(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def big(n: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("bigint")), 2 * size, "0"))


def little(n: Column, size: int) -> Column:
    byte = lambda k: F.unhex(F.lpad(F.hex(F.shiftright(n.cast("bigint"), 8 * k).bitwiseAND(F.lit(255))), 2, "0"))
    return F.concat(*[byte(k) for k in range(size)])


def length(data: Column) -> Column:
    return F.octet_length(data)


def exif(tag: int) -> bytes:
    """A TIFF block with one tag."""
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", tag, 4, 1, 0) + bytes(4)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


#: A PNG of 4 by 4 pixels, before and after the place of further chunks.
PNG_START = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 8, 6, 0, 0, 0))
PNG_END = _chunk(b"IDAT", zlib.compress((b"\0" + bytes(range(16))) * 4)) + _chunk(b"IEND", b"")


def png_chunk(kind: bytes, data: Column) -> Column:
    return F.concat(big(length(data), 4), raw(kind), data, big(F.crc32(F.concat(raw(kind), data)), 4))


def png(*chunks: Column) -> Column:
    return F.concat(raw(PNG_START), *chunks, raw(PNG_END))


def jpeg_segment(marker: int, data: Column) -> Column:
    return F.concat(raw(bytes([0xFF, marker])), big(length(data) + 2, 2), data)


def jpeg(*segments: Column) -> Column:
    """A JPEG whose frame says 7 by 5 pixels."""
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 5, 7, 1) + b"\1\x11\0"
    return F.concat(raw(b"\xff\xd8"), *segments, raw(frame + b"\xff\xda\0\2data\xff\xd9"))


def webp_chunk(kind: bytes, data: Column) -> Column:
    return F.concat(raw(kind), little(length(data), 4), data, F.when(length(data) % 2 == 1, raw(b"\0")).otherwise(raw(b"")))


def webp(*chunks: Column) -> Column:
    """A lossless WebP of 4 by 2 pixels."""
    body = F.concat(raw(b"WEBPVP8L" + struct.pack("<I", 6) + b"\x2f" + struct.pack("<I", 3 | 1 << 14) + b"\0"), *chunks)
    return F.concat(raw(b"RIFF"), little(length(body), 4), body)


def gif(comment: Column) -> Column:
    """A GIF of 1 by 1 pixel with a comment of at most 255 bytes."""
    head = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x21\xfe"
    return F.concat(raw(head), big(length(comment), 1), comment, raw(b"\0\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\1\0\0\x3b"))


def tiff(width: Column, height: Column, tag: Column) -> Column:
    """A TIFF header with its size and one more tag."""
    entry = lambda t, value: F.concat(t, raw(struct.pack("<HI", 3, 1)), little(value, 4))
    return F.concat(raw(b"II*\0" + struct.pack("<IH", 8, 3)), entry(raw(b"\0\1"), width), entry(raw(b"\1\1"), height), entry(little(tag, 2), F.lit(0)), raw(bytes(4)))


def bmp(width: Column, height: Column) -> Column:
    return F.concat(raw(b"BM" + bytes(12) + struct.pack("<I", 40)), little(width, 4), little(height, 4), raw(struct.pack("<HH", 1, 24) + bytes(24)))


def zipped(*entries: tuple[bytes, Column]) -> Column:
    """A zip file of stored entries."""
    local, central, at = [], [], F.lit(0)
    for name, data in entries:
        sizes = F.concat(little(F.crc32(data), 4), little(length(data), 4), little(length(data), 4))
        local.append(F.concat(raw(b"PK\3\4\x14\0" + bytes(6) + b"\x21\0"), sizes, raw(struct.pack("<HH", len(name), 0) + name), data))
        central.append(F.concat(raw(b"PK\1\2\x14\0\x14\0" + bytes(6) + b"\x21\0"), sizes, raw(struct.pack("<HHHHHI", len(name), 0, 0, 0, 0, 0)), little(at, 4), raw(name)))
        at = at + length(data) + 30 + len(name)
    directory = F.concat(*central)
    n = len(entries)
    return F.concat(*local, directory, raw(b"PK\5\6" + struct.pack("<HHHH", 0, 0, n, n)), little(length(directory), 4), little(at, 4), raw(b"\0\0"))


def ooxml(creator: Column, client: Column, body: Column) -> Column:
    core = F.concat(raw(b'<?xml version="1.0"?><cp:core xmlns:cp="u" xmlns:dc="v"><dc:creator>'), creator, raw(b"</dc:creator><dc:title> </dc:title></cp:core>"))
    custom = F.concat(raw(b'<Properties><property name="Client"><vt>'), client, raw(b"</vt></property></Properties>"))
    return zipped((b"[Content_Types].xml", raw(b"<Types/>")), (b"docProps/core.xml", core), (b"docProps/custom.xml", custom), (b"word/document.xml", body))


def pdf(author: Column, xmp: Column) -> Column:
    return F.concat(
        raw(b"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R/Metadata 4 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[]/Count 0>>\nendobj\n3 0 obj\n<</Author ("),
        author, raw(b")/Title <FEFF0041>/Empty ()>>\nendobj\n4 0 obj\n<</Type/Metadata/Subtype/XML/Length "), length(xmp).cast("string").cast("binary"), raw(b">>\nstream\n"),
        xmp, raw(b"\nendstream\nendobj\ntrailer\n<</Root 1 0 R/Info 3 0 R/Size 5>>\nstartxref\n0\n%%EOF\n"),
    )


def mp3(artist: Column, song: Column, audio: Column) -> Column:
    """ID3v2.4 with an artist, the audio, ID3v1 with a title of up to 30 bytes."""
    frame = F.concat(raw(b"TPE1"), big(length(artist) + 1, 4), raw(b"\0\0\3"), artist)
    title = F.concat(song, F.unhex(F.repeat(F.lit("00"), F.lit(124) - length(song))))
    return F.concat(raw(b"ID3\4\0\0\0\0\0"), big(length(frame), 1), frame, audio, raw(b"TAG"), title, raw(b"\0"))


def atom(kind: bytes, *data: Column) -> Column:
    own = F.concat(*data)
    return F.concat(big(length(own) + 8, 4), raw(kind), own)


def mp4(name: Column, cover: Column, sound: Column) -> Column:
    item = lambda kind, value, form: atom(kind, atom(b"data", raw(struct.pack(">II", form, 0)), value))
    tags = atom(b"udta", atom(b"meta", raw(bytes(4)), atom(b"ilst", item(b"\xa9nam", name, 1), item(b"covr", cover, 13))))
    return F.concat(atom(b"ftyp", raw(b"M4A ")), atom(b"moov", atom(b"mvhd", raw(bytes(8))), tags), atom(b"mdat", sound))
