"""Office packages, PDF, MP3 and MP4: what their tags say, and files without them.

Each format has an inspect and a clean function on bytes; ``inspect_files`` and ``clean_files`` run them over a
DataFrame.  A bad file gives ok = false and an error.  Decompression is bounded by actual bytes.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuswash.operators.images import clean_image, inspect_image, rows_of
from corpuswash.options import MIB, PdfLimits, ZipLimits
from corpuswash.schema import FINDINGS

Finding = tuple[str, str, str]  # location, label, value
PROPERTY_PARTS = ["docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"]
PREVIEW = 160
#: Files that go to Python together; bytes of files whose results are returned together.
FILE_ROWS, RUN_BYTES = 200, 4 << 20


class FileError(ValueError):
    """Why a file cannot be read or cleaned."""


def _limit(data: bytes, most: int | None) -> None:
    if most is not None and len(data) > most:
        raise FileError(f"input too large: {len(data)} bytes, limit {most}")


# Office packages


def _package(data: bytes, limits: ZipLimits) -> zipfile.ZipFile:
    _limit(data, limits.max_input_bytes)
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        raise FileError(f"not a zip file: {e}") from None
    if len(package.namelist()) > limits.max_entries:
        raise FileError(f"too many entries: {len(package.namelist())}")
    if "[Content_Types].xml" not in package.namelist():
        raise FileError("not an Office package")
    return package


def is_ooxml(data: bytes) -> bool:
    try:
        _package(data, ZipLimits())
    except FileError:
        return False
    return True


def _entry(package: zipfile.ZipFile, name: str, limits: ZipLimits, used: list[int]) -> bytes:
    try:
        with package.open(name) as f:
            own = f.read(limits.max_entry_bytes + 1)
    except (zipfile.BadZipFile, zlib.error, OSError, NotImplementedError, RuntimeError) as e:
        raise FileError(f"cannot read {name}: {e}") from None
    if len(own) > limits.max_entry_bytes:
        raise FileError(f"entry too large: {name}")
    used[0] += len(own)
    if used[0] > limits.max_total_bytes:
        raise FileError("package too large")
    return own


def leaf_values(xml: bytes) -> list[tuple[str, str]]:
    """(field, value) of the non-empty texts; the field is the nearest named property, else the element."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str | None]] = []
    text: list[str] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def flush() -> None:
        value = "".join(text).strip()
        text.clear()
        if value and stack:
            named = next((n for _, n in reversed(stack) if n is not None), None)
            out.append((named if named is not None else stack[-1][0], value))

    def start(name: str, attributes: dict[str, str]) -> None:
        flush()
        local = name.rpartition(":")[2]
        stack.append((local, attributes.get("name") if local == "property" else None))

    def end(_: str) -> None:
        flush()
        stack.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse(xml, True)
    except expat.ExpatError as e:
        raise FileError(f"bad XML: {e}") from None
    return out


_XML_TOKEN = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|[^<]+", re.S)


def blank_texts(xml: bytes) -> bytes:
    """xml without its texts and CDATA sections; tags and attributes stay byte for byte."""
    return b"".join(t for t in _XML_TOKEN.findall(xml) if t.startswith(b"<") and not t.startswith(b"<![CDATA["))


def inspect_ooxml(data: bytes, limits: ZipLimits = ZipLimits()) -> list[Finding]:
    package, used = _package(data, limits), [0]
    names = set(package.namelist())
    return [(part, field, value) for part in PROPERTY_PARTS if part in names for field, value in leaf_values(_entry(package, part, limits, used))]


def clean_ooxml(data: bytes, limits: ZipLimits = ZipLimits()) -> bytes:
    package, used = _package(data, limits), [0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as new:
        for info in package.infolist():
            own = _entry(package, info.filename, limits, used)
            copy = zipfile.ZipInfo(info.filename, info.date_time)
            copy.compress_type, copy.external_attr = info.compress_type, info.external_attr
            new.writestr(copy, blank_texts(own) if info.filename in PROPERTY_PARTS else own)
    return out.getvalue()


# PDF: objects are found by their headers; strings and dictionaries are read by a small tokenizer.

_OBJECT = re.compile(rb"(?<![0-9])([0-9]+)\s+([0-9]+)\s+obj\b")
_PDF_TOKEN = re.compile(rb"\s+|%[^\r\n]*|<<|>>|\[|\]|/[^\s()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+|.", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A parenthesised string that starts at `at`, and the place after it."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data) and depth:
        c = data[i : i + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                i = octal.end()
                continue
            n = data[i + 1 : i + 2]
            if n not in (b"\n", b"\r"):
                out += _ESCAPES.get(n, n)
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if depth:
            out += c
        i += 1
    return bytes(out), i


def _tokens(data: bytes, at: int, end: int) -> Iterator[tuple[str, bytes, int, int]]:
    while at < end:
        m = _PDF_TOKEN.match(data, at, end)
        t = m[0]
        if t == b"(":
            own, after = _literal(data, at)
            yield "string", own, at, after
            at = after
            continue
        if t[:1] == b"<" and t != b"<<" and t.endswith(b">"):
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at, m.end()
        elif t.strip() and not t.startswith(b"%"):
            yield "name" if t.startswith(b"/") else "word", t, at, m.end()
        at = m.end()


def _dictionary(data: bytes, at: int, end: int) -> dict[bytes, tuple[list[tuple[str, bytes]], int, int]]:
    """Entries of the first dictionary from `at`: tokens of each value, start and end of the entry."""
    out: dict[bytes, tuple[list[tuple[str, bytes]], int, int]] = {}
    depth, brackets, key, value, begin, last = 0, 0, None, [], 0, 0
    for kind, t, s, e in _tokens(data, at, end):
        if t == b"<<" and kind == "word":
            depth += 1
            if depth == 1:
                continue
        elif t == b">>" and kind == "word":
            depth -= 1
            if depth <= 0:
                break
        elif kind == "word" and t in (b"[", b"]"):
            brackets += 1 if t == b"[" else -1
        elif depth == 1 and not brackets and kind == "name" and (key is None or value):
            if key is not None:
                out[key] = (value, begin, last)
            key, value, begin, last = t, [], s, e
            continue
        if depth == 0:
            break
        value.append((kind, t))
        last = e
    if key is not None:
        out[key] = (value, begin, last)
    return out


def _objects(data: bytes) -> dict[int, tuple[int, int]]:
    """Last definition of each object: start of its body, end."""
    out = {}
    for m in _OBJECT.finditer(data):
        end = data.find(b"endobj", m.end())
        out[int(m[1])] = (m.end(), end if end >= 0 else len(data))
    return out


def _reference(value: list[tuple[str, bytes]]) -> int | None:
    words = [t for _, t in value]
    return int(words[0]) if len(words) >= 3 and words[2] == b"R" and words[0].isdigit() else None


def pdf_text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def _trailer_info(data: bytes) -> int | None:
    info = None
    for m in re.finditer(rb"\btrailer\b", data):
        entries = _dictionary(data, m.end(), len(data))
        if b"/Info" in entries:
            info = _reference(entries[b"/Info"][0])
    for a, e in _objects(data).values():
        head = data[a : min(e, a + 4096)]
        if b"/XRef" in head and b"/Info" in head:
            entries = _dictionary(data, a, e)
            info = _reference(entries[b"/Info"][0]) if b"/Info" in entries else info
    return info


def _stream(data: bytes, a: int, e: int) -> tuple[int, int] | None:
    at = data.find(b"stream", a, e)
    if at < 0:
        return None
    at += 6
    at += 2 if data[at : at + 2] == b"\r\n" else 1
    end = data.find(b"endstream", at)
    return (at, end) if end >= 0 else None


def _metadata_streams(data: bytes) -> list[tuple[int, int, int, dict]]:
    out = []
    for n, (a, e) in sorted(_objects(data).items()):
        if b"/Metadata" in data[a:e]:
            entries = _dictionary(data, a, e)
            if [t for _, t in entries.get(b"/Type", ([], 0, 0))[0]][:1] == [b"/Metadata"]:
                span = _stream(data, a, e)
                if span:
                    out.append((n, *span, entries))
    return out


def _decoded(own: bytes, entries: dict, most: int) -> bytes:
    if b"/FlateDecode" in [t for _, t in entries.get(b"/Filter", ([], 0, 0))[0]]:
        try:
            return zlib.decompressobj().decompress(own, most)
        except zlib.error:
            return b""
    return own[:most]


def _packed(data: bytes, most: int) -> dict[int, tuple[tuple[int, int], dict, bytes, int, int]]:
    """Objects inside compressed object streams: span of the stream, its entries, decoded bytes, start and end in those."""
    out = {}
    for a, e in _objects(data).values():
        if b"/ObjStm" not in data[a:e]:
            continue
        entries, span = _dictionary(data, a, e), _stream(data, a, e)
        count, first = (entries.get(k, ([("word", b"")], 0, 0))[0][0][1] for k in (b"/N", b"/First"))
        if span is None or not (count.isdigit() and first.isdigit()):
            continue
        body = _decoded(data[span[0] : span[1]], entries, most)
        heads = [int(x) for x in body[: int(first)].split()[: 2 * int(count)] if x.isdigit()]
        starts = [int(first) + x for x in heads[1::2]]
        for n, x, y in zip(heads[::2], starts, [*starts[1:], len(body)]):
            out[n] = (span, entries, body, x, y)
    return out


def inspect_pdf(data: bytes, limits: PdfLimits = PdfLimits()) -> list[Finding]:
    _limit(data, limits.max_input_bytes)
    if b"%PDF-" not in data[:1024]:
        raise FileError("not a PDF")
    found: list[Finding] = []
    objects, info = _objects(data), _trailer_info(data)
    packed = _packed(data, limits.max_stream_bytes) if info is not None and info not in objects else {}
    if info in objects or info in packed:
        for key, (value, _, _) in (_dictionary(data, *objects[info]) if info in objects else _dictionary(*packed[info][2:])).items():
            if len(value) >= 1 and value[0][0] == "string" and value[0][1]:
                found.append(("Info", key[1:].decode("latin-1"), pdf_text(value[0][1])))
    for n, a, e, entries in _metadata_streams(data):
        own = data[a:e].rstrip(b"\r\n")
        if own:
            text = re.sub(r"\s+", " ", _decoded(own, entries, min(MIB, limits.max_stream_bytes)).decode("utf-8", "replace")).strip()
            found.append((f"object {n}", "XMP", text[:PREVIEW]))
    return found


def clean_pdf(data: bytes, limits: PdfLimits = PdfLimits()) -> bytes:
    """Info strings and metadata streams blanked in place, so offsets stay right; the trailer's Info entry goes."""
    found = inspect_pdf(data, limits)
    if not found:
        return data
    out = bytearray(data)

    def blank(a: int, e: int) -> None:
        out[a:e] = b" " * (e - a)

    objects, info = _objects(data), _trailer_info(data)
    if info in objects:
        a, e = objects[info]
        for _, (value, s, t) in _dictionary(data, a, e).items():
            blank(s, t)
    elif info is not None and (packed := _packed(data, limits.max_stream_bytes).get(info)):
        (a, e), entries, body, x, y = packed
        blanked = bytearray(body)
        for _, s, t in _dictionary(body, x, y).values():
            blanked[s:t] = b" " * (t - s)
        new = zlib.compress(bytes(blanked), 9) if b"/Filter" in entries else bytes(blanked)
        if len(new) > e - a:
            raise FileError("object stream with Info cannot be rewritten in place")
        out[a:e] = new + b"\n" * (e - a - len(new))
    for m in re.finditer(rb"\btrailer\b", data):
        entries = _dictionary(data, m.end(), len(data))
        if b"/Info" in entries:
            blank(entries[b"/Info"][1], entries[b"/Info"][2])
    for a, e in _objects(data).values():
        if b"/XRef" in data[a : min(e, a + 4096)]:
            entries = _dictionary(data, a, e)
            if b"/Info" in entries:
                blank(entries[b"/Info"][1], entries[b"/Info"][2])
    for _, a, e, entries in _metadata_streams(data):
        blank(a, e)
        if b"/Filter" in entries:
            blank(entries[b"/Filter"][1], entries[b"/Filter"][2])
    return bytes(out)


# MP3


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2_size(data: bytes) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    return 10 + _syncsafe(data[6:10]) + (10 if data[5] & 0x10 else 0)


def _frame_text(own: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(own[0], "latin-1") if own else "latin-1"
    return own[1:].decode(codec, "replace").strip("\0")[:PREVIEW]


def inspect_mp3(data: bytes) -> list[Finding]:
    """Every ID3v2 frame, then the non-empty fields of ID3v1."""
    _limit(data, 256 * MIB)
    found: list[Finding] = []
    end = min(_id3v2_size(data), len(data))
    if end:
        major, at = data[3], 10
        if major >= 3 and data[5] & 0x40:
            at += _syncsafe(data[10:14]) if major == 4 else 4 + int.from_bytes(data[10:14], "big")
        head = 6 if major == 2 else 10
        while at + head <= end and data[at : at + 1] not in (b"\0", b""):
            name = data[at : at + (3 if major == 2 else 4)].decode("latin-1")
            raw = data[at + 3 : at + 6] if major == 2 else data[at + 4 : at + 8]
            size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            own = data[at + head : at + head + size]
            value = _frame_text(own) if name.startswith("T") else f"{name} data, {len(own)} bytes"
            found.append(("ID3v2", name, value))
            at += head + size
    if data[-128:-125] == b"TAG":
        tag = data[-128:]
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            value = tag[a:b].split(b"\0")[0].decode("latin-1").strip()
            if value:
                found.append(("ID3v1", name, value))
    return found


def clean_mp3(data: bytes) -> bytes:
    """The audio without ID3v2 at its start and ID3v1 (plain or extended) at its end."""
    _limit(data, 256 * MIB)
    start = min(_id3v2_size(data), len(data))
    end = len(data)
    if data[-128:-125] == b"TAG" and end - start >= 128:
        end -= 128
        if data[end - 227 : end - 223] == b"TAG+" and end - start >= 227:
            end -= 227
    return data[start:end]


# MP4

_CONTAINERS = {b"moov", b"udta", b"ilst", b"trak", b"mdia"}


def _atoms(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, start of content, end)."""
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at, at + head, at + size
        at += size


def _item_lists(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, content, end) of every ilst under moov."""
    for kind, start, own, stop in _atoms(data, at, end):
        if kind == b"ilst":
            yield start, own, stop
        elif kind == b"meta":
            skip = 4 if data[own : own + 4] == b"\0\0\0\0" else 0
            yield from _item_lists(data, own + skip, stop)
        elif kind in _CONTAINERS:
            yield from _item_lists(data, own, stop)


def inspect_mp4(data: bytes) -> list[Finding]:
    _limit(data, 256 * MIB)
    if data[4:8] != b"ftyp" and not any(k == b"moov" for k, *_ in _atoms(data, 0, len(data))):
        raise FileError("not an MP4")
    found: list[Finding] = []
    for _, own, end in _item_lists(data, 0, len(data)):
        for kind, _, a, e in _atoms(data, own, end):
            name = kind.decode("latin-1")
            for inner, _, x, y in _atoms(data, a, e):
                if inner == b"data":
                    form, body = int.from_bytes(data[x : x + 4], "big"), data[x + 8 : y]
                    value = body.decode("utf-8", "replace")[:PREVIEW] if form == 1 else f"{'image' if form in (13, 14) else 'binary'} data, {len(body)} bytes"
                    found.append(("ilst", name, value))
    return found


def clean_mp4(data: bytes) -> bytes:
    """Item lists overwritten by free atoms of the same size, so no offset changes."""
    if not inspect_mp4(data):
        return data
    out = bytearray(data)
    for start, _, end in _item_lists(data, 0, len(data)):
        out[start:end] = struct.pack(">I", end - start) + b"free" + bytes(end - start - 8)
    return bytes(out)


INSPECT: dict[str, Callable[[bytes], list[Finding]]] = {"ooxml": inspect_ooxml, "pdf": inspect_pdf, "mp3": inspect_mp3, "mp4": inspect_mp4}
CLEAN: dict[str, Callable[[bytes], bytes]] = {"ooxml": clean_ooxml, "pdf": clean_pdf, "mp3": clean_mp3, "mp4": clean_mp4}


def _listed(kind: str, data: bytes) -> list[dict]:
    """Findings of one file in the common schema."""
    if kind == "image":
        return rows_of(inspect_image(data)[3])
    found = INSPECT[kind](data)
    return [{"family": kind, "category": None, "location": p, "label": x, "value": v, "codepoint": None, "count": None, "size_bytes": None, "ordinal": i} for i, (p, x, v) in enumerate(found)]


def _small_batches(spark: SparkSession) -> None:
    """Whole files go to Python FILE_ROWS at a time, unless the session has set fewer: the default of ten thousand is held
    several times over, in each of an executor's workers."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > FILE_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(FILE_ROWS))


def _by_row(df: DataFrame, kind: str | None, content: str, key: str, added: list[str], types: str, one: Callable[[str, bytes], tuple]) -> DataFrame:
    """key, ok, error and what `one` makes of each file's kind and bytes.  Whatever is wrong with a file is its row's error."""
    of_key = df.schema[key].dataType.simpleString()
    _small_batches(df.sparkSession)
    rows = df.select(F.col(key), F.col(content).alias("content"), (F.lit(kind) if kind is not None else F.col("kind")).alias("kind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, size = [], 0
            for k, data, sort in zip(pdf[key], pdf["content"], pdf["kind"]):
                data = bytes(data or b"")
                try:
                    if sort != "image" and sort not in INSPECT:
                        raise FileError(f"kind {sort} is not supported")
                    out.append((k, True, None, len(data), *one(sort, data)))
                except Exception as e:  # a broken file must not fail the job
                    out.append((k, False, str(e) or type(e).__name__, len(data), None))
                size += len(data)
                if size > RUN_BYTES:
                    yield pd.DataFrame(out, columns=[key, "ok", "error", *added])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=[key, "ok", "error", *added])

    return rows.mapInPandas(run, f"`{key}` {of_key}, ok boolean, error string, {types}")


def inspect_files(df: DataFrame, kind: str | None = None, content: str = "content", key: str = "path") -> DataFrame:
    """key, ok, error, bytes, findings for files of one kind (image, ooxml, pdf, mp3 or mp4), or each of its own in column `kind`."""
    out = _by_row(df, kind, content, key, ["bytes", "findings"], f"bytes long, findings {FINDINGS}", lambda k, data: (_listed(k, data),))
    return out.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def clean_files(df: DataFrame, kind: str | None = None, content: str = "content", key: str = "path") -> DataFrame:
    """key, ok, error, bytes_in, cleaned, bytes_out; kind as for inspect_files."""
    clean = lambda k, data: (clean_image(data) if k == "image" else CLEAN[k](data),)
    out = _by_row(df, kind, content, key, ["bytes_in", "cleaned"], "bytes_in long, cleaned binary", clean)
    return out.withColumn("bytes_out", F.length("cleaned").cast("bigint"))
