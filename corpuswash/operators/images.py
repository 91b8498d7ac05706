"""Images: structural inspection without decoding pixels, and removal of metadata segments.

Inspection walks the container (JPEG segments, PNG and WebP chunks, GIF blocks, TIFF tags) and lists what
identifies a person, device or tool.  Cleaning drops those segments and leaves the pixels' own data untouched,
byte for byte; PNG, BMP, TIFF (not packed) and GIF can also be decoded and written here (zlib and numpy), so they take part in
upscaling, contrast, sharpening, the seeded fingerprint reset and changes of format.

A bad file gives ok = false and an error; it never fails the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswash.options import ImageOptions
from corpuswash.schema import FINDINGS

#: Byte strings that image generators and content credentials leave (fixed values).
GENERATOR_MARKS = [b"Steps:", b"Sampler:", b"CFG scale:", b"Seed:", b"Model hash:", b"Negative prompt:", b'"prompt"', b'"workflow"']
CREDENTIAL_MARKS = [b"c2pa", b"C2PA", b"digitalSourceType", b"compositeSynthetic", b"trainedAlgorithmicMedia", b"Content Credentials", b"caiSignature"]
#: PNG and WebP chunks that are no metadata, PNG keywords of generators, TIFF tags that identify (fixed values).
PNG_PLAIN = [b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"tIME", b"pHYs", b"bKGD", b"sBIT", b"hIST", b"sPLT", b"acTL", b"fcTL", b"fdAT"]
WEBP_PLAIN = [b"VP8 ", b"VP8L", b"VP8X", b"ANIM", b"ANMF", b"ALPH"]
PNG_GENERATOR_KEYWORDS = ["parameters", "prompt", "workflow"]
TIFF_IDENTIFYING = [0x010F, 0x0110, 0x0131, 0x0132, 0x013B, 0x8298, 0x8769]
GPS_TAG = 0x8825
SCANNED = 65536
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


class ImageError(ValueError):
    """Why an image cannot be read or cleaned."""


def _marked(data: bytes, marks: list[bytes]) -> bool:
    head = data[:SCANNED]
    return any(m in head for m in marks)


def image_kind(data: bytes) -> str | None:
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == PNG_HEAD:
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:2] == b"BM":
        return "bmp"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return None


def tiff_tags(data: bytes) -> list[int]:
    """Tags of the first directory; none at all if anything is out of bounds."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            return []
        at = struct.unpack_from(order + "I", data, 4)[0]
        n = struct.unpack_from(order + "H", data, at)[0]
        return [struct.unpack_from(order + "H", data, at + 2 + 12 * i)[0] for i in range(n)]
    except struct.error:
        return []


def _exif(data: bytes, size: int) -> tuple[str, str, int]:
    gps = GPS_TAG in tiff_tags(data)
    return ("gps", "EXIF with GPS location", size) if gps else ("exif", "EXIF metadata", size)


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, marker, payload) of the segments before the scan data."""
    at = 2
    while at < len(data) and data[at] == 0xFF:
        start = at
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return
        marker = data[at]
        at += 1
        if marker in (0xD9, 0xDA):
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > len(data):
            return
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            return
        yield start, at + size, marker, data[at + 2 : at + size]
        at += size


def _jpeg(data: bytes) -> Iterator[tuple[int, int, list[tuple[str, str, int]]]]:
    for start, end, marker, own in jpeg_segments(data):
        n, found = len(own), []
        if marker == 0xE1 and own.startswith(b"Exif\0\0"):
            found = [_exif(own[6:], n)]
        elif marker == 0xE1 and own.startswith(b"http://ns.adobe.com/xap/"):
            found = [("xmp", "XMP metadata", n)] + [("c2pa", "provenance marker in XMP", n)] * _marked(own, CREDENTIAL_MARKS)
        elif marker == 0xE1:
            found = [("unknown", "APP1 segment", n)]
        elif marker == 0xE2:
            found = [("icc-profile", "ICC color profile", n)] if own.startswith(b"ICC_PROFILE\0") else []
        elif marker == 0xEB:
            found = [("c2pa", "APP11 segment (content credentials)", n)]
        elif marker == 0xED and b"8BIM" in own:
            found = [("iptc", "IPTC metadata (APP13)", n)]
        elif marker == 0xFE:
            ai = _marked(own, GENERATOR_MARKS)
            found = [("ai-generator", "generation parameters in a comment", n) if ai else ("unknown", "comment segment", n)]
        elif 0xE3 <= marker <= 0xEF:
            found = [("unknown", f"APP{marker - 0xE0} segment", n)]
        yield start, end, found


def png_chunks(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        end = at + 12 + size
        if end > len(data):
            return
        yield at, end, kind, data[at + 8 : end - 4]
        at = end
        if kind == b"IEND":
            return


def _keyword(data: bytes) -> str | None:
    end = data.find(b"\0")
    if not 1 <= end <= 79:
        return None
    try:
        return data[:end].decode("utf-8")
    except UnicodeDecodeError:
        return None


def _chunk_name(kind: bytes) -> str:
    try:
        return kind.decode("utf-8")
    except UnicodeDecodeError:
        return "????"


def _png(data: bytes) -> Iterator[tuple[int, int, list[tuple[str, str, int]]]]:
    for start, end, kind, own in png_chunks(data):
        n, found = len(own), []
        if kind in (b"tEXt", b"zTXt", b"iTXt"):
            word = _keyword(own)
            if word == "XML:com.adobe.xmp":
                found = [("xmp", "XMP metadata", n)]
            elif word in PNG_GENERATOR_KEYWORDS or _marked(own, GENERATOR_MARKS):
                found = [("ai-generator", f'generation parameters ("{word or "text"}")', n)]
            else:
                found = [("unknown", f'text metadata ("{word or "unknown"}")', n)]
        elif kind == b"eXIf":
            found = [_exif(own, n)]
        elif kind == b"iCCP":
            found = [("icc-profile", "ICC color profile", n)]
        elif kind == b"caBX":
            found = [("c2pa", "content credentials (caBX)", n)]
        elif kind not in PNG_PLAIN:
            found = [("unknown", f'chunk "{_chunk_name(kind)}"', n)]
        yield start, end, found


def _webp(data: bytes) -> Iterator[tuple[int, int, list[tuple[str, str, int]]]]:
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            return
        own = data[at + 8 : at + 8 + size]
        n, found = len(own), []
        if kind == b"EXIF":
            found = [_exif(own, n)]
        elif kind == b"XMP ":
            found = [("xmp", "XMP metadata", n)] + [("c2pa", "provenance marker in XMP", n)] * _marked(own, CREDENTIAL_MARKS)
        elif kind == b"ICCP":
            found = [("icc-profile", "ICC color profile", n)]
        elif kind not in WEBP_PLAIN:
            found = [("unknown", f'chunk "{_chunk_name(kind)}"', n)]
        end = at + 8 + size + size % 2
        yield at, min(end, len(data)), found
        at = end


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        size = data[at]
        at += 1
        if size == 0:
            return b"".join(parts), at
        if at + size > len(data):
            raise IndexError
        parts.append(data[at : at + size])
        at += size


def gif_blocks(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """(start, end, kind, content) of blocks; an IndexError where the file ends inside one."""
    at = 13 + (3 << ((data[10] & 7) + 1) if data[10] & 0x80 else 0)
    while at < len(data):
        start, lead = at, data[at]
        if lead == 0x21:
            label = data[at + 1]
            own, at = _sub_blocks(data, at + 2)
            yield start, at, {0xFE: "comment", 0xFF: "application"}.get(label, "extension"), own
        elif lead == 0x2C:
            if at + 10 > len(data):
                raise IndexError
            packed = data[at + 9]
            at += 10 + (3 << ((packed & 7) + 1) if packed & 0x80 else 0) + 1
            _, at = _sub_blocks(data, at)
            yield start, at, "image", b""
        else:
            return


def _gif(data: bytes) -> list[tuple[int, int, list[tuple[str, str, int]]]]:
    out = []
    if len(data) < 13:
        return out
    try:
        for start, end, kind, own in gif_blocks(data):
            n, found = len(own), []
            if kind == "comment":
                ai = _marked(own, GENERATOR_MARKS)
                found = [("ai-generator", "generation parameters in a comment", n) if ai else ("unknown", "comment extension", n)]
            elif kind == "application" and own[:11] != b"NETSCAPE2.0":
                found = [("unknown", f'application extension ("{own[:11].decode("utf-8", "ignore")}")', n)]
            out.append((start, end, found))
    except IndexError:
        return []
    return out


def _tiff(data: bytes) -> list[tuple[str, str, int]]:
    tags = tiff_tags(data)
    if GPS_TAG in tags:
        return [("gps", "tags with GPS location", len(data))]
    if any(t in TIFF_IDENTIFYING for t in tags):
        return [("exif", "tags that name camera, software or author", len(data))]
    return []


def dimensions(data: bytes, kind: str) -> tuple[int, int]:
    """Declared width and height."""
    try:
        if kind == "png":
            return struct.unpack_from(">II", data, 16)
        if kind == "gif":
            return struct.unpack_from("<HH", data, 6)
        if kind == "bmp":
            w, h = struct.unpack_from("<ii", data, 18)
            return abs(w), abs(h)
        if kind == "jpeg":
            for _, _, marker, own in jpeg_segments(data):
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", own, 1)
                    return w, h
        if kind == "webp":
            four = data[12:16]
            if four == b"VP8X":
                return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            if four == b"VP8L":
                bits = struct.unpack_from("<I", data, 21)[0]
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            w, h = struct.unpack_from("<HH", data, 26)
            return w & 0x3FFF, h & 0x3FFF
        if kind == "tiff":
            order = "<" if data[:2] == b"II" else ">"
            at = struct.unpack_from(order + "I", data, 4)[0]
            size = {}
            for i in range(struct.unpack_from(order + "H", data, at)[0]):
                tag, form = struct.unpack_from(order + "HH", data, at + 2 + 12 * i)
                if tag in (256, 257):
                    size[tag] = struct.unpack_from(order + ("H" if form == 3 else "I"), data, at + 10 + 12 * i)[0]
            return size[256], size[257]
    except (struct.error, KeyError):
        pass
    raise ImageError("decode error: no dimensions")


def inspect_image(data: bytes, options: ImageOptions = ImageOptions()) -> tuple[str, int, int, list[tuple[str, str, int]]]:
    """(format, width, height, findings as (category, label, bytes))."""
    kind, (w, h) = _guarded(data, options)
    parts = {"jpeg": _jpeg, "png": _png, "webp": _webp, "gif": _gif}
    if kind in parts:
        found = [f for _, _, fs in parts[kind](data) for f in fs]
    else:
        found = _tiff(data) if kind == "tiff" else []
    return kind, w, h, found


def _guarded(data: bytes, options: ImageOptions) -> tuple[str, tuple[int, int]]:
    if options.max_input_bytes is not None and len(data) > options.max_input_bytes:
        raise ImageError(f"input too large: {len(data)} bytes, limit {options.max_input_bytes}")
    kind = image_kind(data)
    if kind is None:
        raise ImageError("unsupported format")
    w, h = dimensions(data, kind)
    if options.max_dimension is not None and max(w, h) > options.max_dimension:
        raise ImageError(f"decode error: {w}x{h} exceeds {options.max_dimension}")
    return kind, (w, h)


def frames(data: bytes, kind: str) -> int:
    """Frames or pages: more than one is not cleaned, since all but the first could be lost."""
    if kind == "gif":
        try:
            return sum(k == "image" for _, _, k, _ in gif_blocks(data))
        except IndexError:
            return 1
    if kind == "tiff":
        order = "<" if data[:2] == b"II" else ">"
        try:
            at = struct.unpack_from(order + "I", data, 4)[0]
            n = struct.unpack_from(order + "H", data, at)[0]
            return 1 + (struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0] != 0)
        except struct.error:
            return 1
    if kind == "png":
        return 1 + any(k == b"acTL" for _, _, k, _ in png_chunks(data))
    if kind == "webp":
        return 1 + (b"ANIM" in data[12:64])
    return 1


def strip_segments(data: bytes, kind: str) -> bytes:
    """data without the segments that have findings."""
    parts = {"jpeg": _jpeg, "png": _png, "webp": _webp, "gif": _gif}
    if kind not in parts:
        return data
    out, at = [], 0
    for start, end, found in parts[kind](data):
        if found and found[0][0] != "icc-profile":
            out.append(data[at:start])
            at = end
    clean = b"".join([*out, data[at:]])
    if kind == "webp":
        clean = clean[:4] + struct.pack("<I", len(clean) - 8) + clean[8:]
        if clean[12:16] == b"VP8X":
            clean = clean[:20] + bytes([clean[20] & ~0x0C]) + clean[21:]
    return clean


def decode(data: bytes, kind: str) -> np.ndarray:
    """Pixels as height x width x 4 bytes, for PNG (8 bits, not interlaced), BMP (24 or 32 bits), TIFF (8 bits, not packed) and GIF."""
    w, h = dimensions(data, kind)
    if kind == "tiff":
        return _decode_tiff(data, w, h)
    if kind == "gif":
        return _decode_gif(data, w, h)
    if kind == "bmp":
        offset, bits, packing = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
        if bits not in (24, 32) or packing not in (0, 3):
            raise ImageError("decode error: BMP variant")
        n = bits // 8
        row = (w * n + 3) // 4 * 4
        raw = np.frombuffer(data, np.uint8, row * h, offset).reshape(h, row)[:, : w * n].reshape(h, w, n)
        raw = raw[::-1] if struct.unpack_from("<i", data, 22)[0] > 0 else raw
        out = np.full((h, w, 4), 255, np.uint8)
        out[..., :3] = raw[..., 2::-1]
        if n == 4:
            out[..., 3] = raw[..., 3]
        return out
    if kind != "png":
        raise ImageError(f"decode error: no {kind} codec")
    depth, color, _, _, interlaced = struct.unpack_from(">BBBBB", data, 24)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if depth != 8 or channels is None or interlaced:
        raise ImageError("decode error: PNG variant")
    palette = next((own for _, _, k, own in png_chunks(data) if k == b"PLTE"), b"")
    alpha = next((own for _, _, k, own in png_chunks(data) if k == b"tRNS"), b"")
    size = h * (1 + w * channels)
    try:
        raw = zlib.decompressobj().decompress(b"".join(own for _, _, k, own in png_chunks(data) if k == b"IDAT"), size)
    except zlib.error as e:
        raise ImageError(f"decode error: {e}") from None
    if len(raw) < size:
        raise ImageError("decode error: too little data")
    lines = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * channels)
    out, above = np.zeros((h, w * channels), np.uint8), np.zeros(w * channels, np.int64)
    for y in range(h):
        f, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if f == 2:
            line = line + above
        elif f == 1:
            line = np.cumsum(line.reshape(w, channels), axis=0).reshape(-1)
        elif f in (3, 4):
            for x in range(w * channels):
                left = line[x - channels] if x >= channels else 0
                corner = above[x - channels] if x >= channels else 0
                if f == 3:
                    line[x] = (line[x] + (left + above[x]) // 2) & 255
                else:
                    p = left + above[x] - corner
                    near = min((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner))
                    line[x] = (line[x] + near[2]) & 255
        above = line & 255
        out[y] = above
    px = out.reshape(h, w, channels)
    rgba = np.full((h, w, 4), 255, np.uint8)
    if color == 3:
        colors = np.zeros((256, 4), np.uint8)
        colors[:, 3] = 255
        colors[: len(palette) // 3, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        colors[: len(alpha), 3] = np.frombuffer(alpha, np.uint8)
        return colors[px[..., 0]]
    rgba[..., :3] = px[..., :1] if channels < 3 else px[..., :3]
    if channels in (2, 4):
        rgba[..., 3] = px[..., -1]
    return rgba


def _decode_tiff(data: bytes, w: int, h: int) -> np.ndarray:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, form, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if form in (3, 4) and count <= len(data):
            place = at + 10 + 12 * i
            size = count * (2 if form == 3 else 4)
            place = place if size <= 4 else struct.unpack_from(order + "I", data, place)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{'H' if form == 3 else 'I'}", data, place)
    n = tags.get(277, (1,))[0]
    if tags.get(259, (1,))[0] != 1 or set(tags.get(258, (1,))) != {8} or n not in (1, 3, 4) or tags.get(284, (1,))[0] != 1 or 273 not in tags or tags.get(262, (0,))[0] not in (1, 2):
        raise ImageError("decode error: TIFF variant")
    raw = b"".join(data[a : a + c] for a, c in zip(tags[273], tags.get(279, (w * h * n,))))
    if len(raw) < w * h * n:
        raise ImageError("decode error: too little data")
    px = np.frombuffer(raw, np.uint8, w * h * n).reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = px[..., :3] if n >= 3 else px
    if n == 4:
        out[..., 3] = px[..., 3]
    return out


def _encode_tiff(px: np.ndarray) -> bytes:
    h, w = px.shape[:2]
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 4, 8 + 2 + 11 * 12 + 4), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 154), (277, 3, 1, 4), (278, 4, 1, h), (279, 4, 1, w * h * 4), (284, 3, 1, 1), (338, 3, 1, 2)]
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4) + struct.pack("<HHHH", 8, 8, 8, 8) + px.tobytes()


def _decode_gif(data: bytes, w: int, h: int) -> np.ndarray:
    """The first image of a GIF; places it does not cover are transparent."""
    table = np.frombuffer(data, np.uint8, 3 << ((data[10] & 7) + 1), 13).reshape(-1, 3) if data[10] & 0x80 else np.zeros((0, 3), np.uint8)
    clear = None
    for start, end, kind, own in gif_blocks(data):
        if kind == "extension" and data[start + 1] == 0xF9 and own and own[0] & 1:
            clear = own[3]
        if kind != "image":
            continue
        x, y, iw, ih, packed = struct.unpack_from("<HHHHB", data, start + 1)
        at = start + 10
        if packed & 0x80:
            table = np.frombuffer(data, np.uint8, 3 << ((packed & 7) + 1), at).reshape(-1, 3)
            at += 3 << ((packed & 7) + 1)
        index = _unpack_lzw(_sub_blocks(data, at + 1)[0], data[at], iw * ih)
        if packed & 0x40 or len(index) < iw * ih or x + iw > w or y + ih > h:
            raise ImageError("decode error: GIF variant")
        index = np.frombuffer(index, np.uint8, iw * ih).reshape(ih, iw)
        colors = np.zeros((256, 4), np.uint8)
        colors[: len(table), :3], colors[:, 3] = table, 255
        if clear is not None:
            colors[clear, 3] = 0
        out = np.zeros((h, w, 4), np.uint8)
        out[y : y + ih, x : x + iw] = colors[index]
        return out
    raise ImageError("decode error: no image")


def _unpack_lzw(data: bytes, least: int, most: int) -> bytes:
    out, bits, held, at = bytearray(), 0, 0, 0
    stop = (1 << least) + 1
    table: list[bytes] = []
    width, last = least + 1, b""
    while len(out) < most and at < len(data):
        while bits < width and at < len(data):
            held |= data[at] << bits
            bits += 8
            at += 1
        code = held & ((1 << width) - 1)
        held >>= width
        bits -= width
        if code == stop:
            break
        if code == stop - 1:
            table, width, last = [bytes([i]) for i in range(1 << least)] + [b"", b""], least + 1, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ImageError("decode error: GIF data")
        own = table[code] if code < len(table) else last + last[:1]
        out += own
        if last and len(table) < 4096:
            table.append(last + own[:1])
        width = min(12, max(least + 1, len(table).bit_length()))
        last = own
    return bytes(out)


def _encode_gif(px: np.ndarray) -> bytes:
    """One image of up to 255 colors (others by three bits a channel, two for blue) and one for transparent places."""
    h, w = px.shape[:2]
    flat, seen = px.reshape(-1, 4), px[..., 3].reshape(-1) >= 128
    rgb = flat[:, 0].astype(np.int64) << 16 | flat[:, 1].astype(np.int64) << 8 | flat[:, 2]
    colors, index = np.unique(rgb, return_inverse=True)
    if len(colors) > 255:
        coarse = (flat[:, 0].astype(np.int64) * 7 + 127) // 255 * 32 + (flat[:, 1].astype(np.int64) * 7 + 127) // 255 * 4 + (flat[:, 2].astype(np.int64) * 3 + 127) // 255
        index = np.minimum(coarse, 254)
        grid = np.arange(255)
        colors = (grid >> 5) * 255 // 7 << 16 | (grid >> 2 & 7) * 255 // 7 << 8 | (grid & 3) * 255 // 3
    index = np.where(seen, index, 255)
    table = np.zeros((256, 3), np.uint8)
    for k, shift in enumerate((16, 8, 0)):
        table[: len(colors), k] = colors >> shift & 255
    # Codes of nine bits, with a clear code often enough that they stay so: no packing, which every reader takes.
    codes = []
    for a in range(0, len(index), 250):
        codes += [256, *index[a : a + 250].tolist()]
    codes.append(257)
    bits = (np.array(codes)[:, None] >> np.arange(9) & 1).astype(np.uint8).reshape(-1)
    packed = np.packbits(bits, bitorder="little").tobytes()
    blocks = b"".join(bytes([len(packed[a : a + 255])]) + packed[a : a + 255] for a in range(0, len(packed), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + table.tobytes() + b"\x21\xf9\4\1\0\0\xff\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0\x3b"


def encode(px: np.ndarray, kind: str) -> bytes:
    h, w = px.shape[:2]
    if kind == "tiff":
        return _encode_tiff(px)
    if kind == "gif":
        return _encode_gif(px)
    if kind == "png":
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = np.zeros((h, 1 + 4 * w), np.uint8)
        raw[:, 1:] = px.reshape(h, -1)
        return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")
    if kind == "bmp":
        row = (w * 3 + 3) // 4 * 4
        raw = np.zeros((h, row), np.uint8)
        raw[:, : w * 3] = px[::-1, :, 2::-1].reshape(h, -1)
        return b"BM" + struct.pack("<IHHI", 54 + raw.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, raw.size, 2835, 2835, 0, 0) + raw.tobytes()
    raise ImageError(f"no {kind} encoder")


def upscale(px: np.ndarray, factor: float) -> np.ndarray:
    """Lanczos resampling with three lobes, rows then columns."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        old = a.shape[0]
        at = (np.arange(n) + 0.5) * old / n - 0.5
        taps = np.floor(at).astype(int)[:, None] + np.arange(-2, 4)
        d = at[:, None] - taps
        weight = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
        weight /= weight.sum(1, keepdims=True)
        return np.einsum("nt,nt...->n...", weight, a[np.clip(taps, 0, old - 1)])

    h, w = px.shape[:2]
    tall = along(px.astype(float), round(h * factor))
    wide = along(tall.swapaxes(0, 1), round(w * factor)).swapaxes(0, 1)
    return np.clip(np.rint(wide), 0, 255).astype(np.uint8)


def stretch_contrast(px: np.ndarray, clip: float = 0.005) -> np.ndarray:
    """Each color channel stretched between its 0.5 % ends; flat channels and alpha stay."""
    out = px.copy()
    cut = int(px.shape[0] * px.shape[1] * clip)
    for c in range(3):
        upto = np.cumsum(np.bincount(px[..., c].ravel(), minlength=256))
        low, high = int(np.argmax(upto > cut)), int(np.argmax(upto >= upto[-1] - cut))
        if high > low:
            out[..., c] = np.clip((px[..., c].astype(float) - low) * 255 / (high - low), 0, 255).astype(np.uint8)
    return out


def sharpen(px: np.ndarray, sigma: float = 1.0, threshold: int = 2) -> np.ndarray:
    """Unsharp mask: differences above the threshold to a blurred copy are added; alpha stays."""
    x = np.arange(-3, 4)
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    blurred = px[..., :3].astype(float)
    for axis in (0, 1):
        padded = np.pad(blurred, [(3, 3) if a == axis else (0, 0) for a in range(3)], mode="edge")
        blurred = sum(k[i] * np.take(padded, range(i, i + px.shape[axis]), axis=axis) for i in range(7))
    d = px[..., :3] - blurred
    out = px.copy()
    out[..., :3] = np.clip(np.rint(np.where(np.abs(d) > threshold, px[..., :3] + d, px[..., :3])), 0, 255).astype(np.uint8)
    return out


def reset_fingerprint(px: np.ndarray, strength: int, fraction: float, seed: int) -> np.ndarray:
    """A seeded share of pixels moved by up to strength in each color; the same seed gives the same pixels."""
    draw = np.random.default_rng(seed)
    chosen = draw.random(px.shape[:2]) < fraction
    noise = draw.integers(-strength, strength, px.shape[:2] + (3,), endpoint=True)
    out = px.copy()
    out[..., :3] = np.clip(px[..., :3].astype(int) + noise * chosen[..., None], 0, 255)
    return out


def clean_image(data: bytes, options: ImageOptions = ImageOptions()) -> bytes:
    kind, (w, h) = _guarded(data, options)
    if frames(data, kind) > 1:
        raise ImageError(f"multi-frame {kind} is not cleaned")
    wanted = options.output_format or kind
    # A TIFF's tags are not segments that can be cut out: it is decoded and written anew, as one of another format is.
    if wanted == kind and not (options.upscale > 1 or options.enhance or options.fingerprint_reset or (kind == "tiff" and _tiff(data))):
        return strip_segments(data, kind)
    if options.max_alloc_bytes is not None and w * h * 4 > options.max_alloc_bytes:
        raise ImageError("decode error: pixels exceed the allocation limit")
    if options.upscale > 1 and options.max_dimension is not None and round(max(w, h) * options.upscale) > options.max_dimension:
        raise ImageError("upscaled image too large")
    px = decode(data, kind)
    px = upscale(px, options.upscale) if options.upscale > 1 else px
    px = sharpen(stretch_contrast(px)) if options.enhance else px
    px = reset_fingerprint(px, options.strength, options.fraction, options.seed) if options.fingerprint_reset else px
    return encode(px, wanted)


def rows_of(found: list[tuple[str, str, int]]) -> list[dict]:
    return [{"family": "image", "category": c, "location": None, "label": x, "value": None, "codepoint": None, "count": None, "size_bytes": n, "ordinal": i} for i, (c, x, n) in enumerate(found)]


def inspect_images(df: DataFrame, content: str = "content", key: str = "path", options: ImageOptions = ImageOptions()) -> DataFrame:
    """key, ok, error, format, width, height, bytes, findings; larger files than the limit are not read."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, data in zip(pdf[key], pdf[content]):
                try:
                    form, w, h, found = inspect_image(bytes(data or b""), options)
                    rows.append((k, True, None, form, w, h, len(data), rows_of(found)))
                except Exception as e:  # a broken file must not fail the job
                    rows.append((k, False, str(e) or type(e).__name__, None, None, None, len(data or b""), []))
            yield pd.DataFrame(rows, columns=[key, "ok", "error", "format", "width", "height", "bytes", "findings"]).astype({"width": "Int32", "height": "Int32"})

    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, ok boolean, error string, format string, width int, height int, bytes long, findings {FINDINGS}")


def clean_images(df: DataFrame, content: str = "content", key: str = "path", options: ImageOptions = ImageOptions()) -> DataFrame:
    """key, ok, error, bytes_in, bytes_out, cleaned."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, data in zip(pdf[key], pdf[content]):
                try:
                    rows.append((k, True, None, len(data), clean_image(bytes(data), options)))
                except Exception as e:  # a broken file must not fail the job
                    rows.append((k, False, str(e), 0 if data is None else len(data), None))
            yield pd.DataFrame(rows, columns=[key, "ok", "error", "bytes_in", "cleaned"])

    out = df.select(key, content).mapInPandas(run, f"`{key}` {kind}, ok boolean, error string, bytes_in long, cleaned binary")
    return out.withColumn("bytes_out", F.length("cleaned").cast("bigint"))
