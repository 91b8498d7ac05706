"""Binary formats, file sources, reports and the stream."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuswash.operators import binaries as b
from corpuswash.operators import images as im
from corpuswash.operators import report
from corpuswash.operators.text import inspect_text
from corpuswash.options import ImageOptions, PdfLimits, ZipLimits
from corpuswash.sources import files
from corpuswash.streaming.clean import clean_text_stream


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(*extra, w=4, h=4):
    px = (np.arange(h * w * 4) % 251).astype(np.uint8).reshape(h, w, 4)
    whole = im.encode(px, "png")
    return whole[:33] + b"".join(extra) + whole[33:], px


def tiff(tag):
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHII", tag, 4, 1, 0) + b"\0\0\0\0"


def jpeg(*segments):
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 5, 7, 1) + b"\1\x11\0"
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments) + frame + b"\xff\xda\0\2data\xff\xd9"


def gif(*blocks, frames=1):
    frame = b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\1\0\0"
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"".join(blocks) + frame * frames + b"\x3b"


def kinds(data):
    return [c for c, _, _ in im.inspect_image(data)[3]]


def test_png_findings_and_strip():
    data, px = png(chunk(b"tEXt", b"parameters\0Steps: 20"), chunk(b"eXIf", tiff(0x8825)), chunk(b"caBX", b"x"), chunk(b"iTXt", b"XML:com.adobe.xmp\0x"), chunk(b"tEXt", b"Author\0J"), chunk(b"abCD", b"q"))
    assert kinds(data) == ["ai-generator", "gps", "c2pa", "xmp", "unknown", "unknown"]
    clean = im.clean_image(data)
    assert kinds(clean) == [] and (im.decode(clean, "png") == px).all() and im.inspect_image(data)[:3] == ("png", 4, 4)


def test_jpeg_findings_and_strip():
    data = jpeg((0xE0, b"JFIF\0"), (0xE1, b"Exif\0\0" + tiff(0x0132)), (0xE1, b"http://ns.adobe.com/xap/1.0/ c2pa"), (0xE2, b"ICC_PROFILE\0x"), (0xE2, b"other"), (0xEB, b"j"), (0xED, b"..8BIM"), (0xFE, b"Seed: 1"), (0xFE, b"hi"), (0xE5, b"z"))
    assert kinds(data) == ["exif", "xmp", "c2pa", "icc-profile", "c2pa", "iptc", "ai-generator", "unknown", "unknown"]
    clean = im.clean_image(data)
    assert kinds(clean) == ["icc-profile"] and clean.endswith(b"data\xff\xd9") and im.inspect_image(clean)[1:3] == (7, 5)


def test_webp_gif_tiff_bmp():
    body = b"VP8L" + struct.pack("<I", 6) + b"\x2f" + struct.pack("<I", 3 | 1 << 14) + b"\0" + b"EXIF" + struct.pack("<I", 5) + b"II*\0x\0" + b"XMP " + struct.pack("<I", 4) + b"C2PA"
    webp = b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
    assert kinds(webp) == ["exif", "xmp", "c2pa"] and kinds(im.clean_image(webp)) == [] and im.inspect_image(webp)[1:3] == (4, 2)
    app = b"\x21\xff\x0bNETSCAPE2.0\x03\1\0\0\0"
    data = gif(b"\x21\xfe\x05Steps\0", b"\x21\xfe\x06Steps:\0", app, b"\x21\xff\x0bSOMETHING12\0")
    assert kinds(data) == ["unknown", "ai-generator", "unknown"] and kinds(im.clean_image(data)) == [] and app in im.clean_image(data)
    assert kinds(gif(b"\x21\xfe\x05ab")[:20]) == []
    two = struct.pack("<H", 2) + struct.pack("<HHII", 256, 3, 1, 9) + struct.pack("<HHII", 257, 3, 1, 8)
    assert im.inspect_image(b"II*\0" + struct.pack("<I", 8) + two + b"\0\0\0\0")[1:3] == (9, 8)
    assert im.tiff_tags(tiff(0x8825)) == [0x8825] and im.tiff_tags(b"II*\0\xff\xff\xff\xff") == []
    _, px = png()
    bmp = im.encode(px, "bmp")
    assert kinds(bmp) == [] and (im.decode(bmp, "bmp")[..., :3] == px[..., :3]).all()


@pytest.mark.parametrize("data", [b"not an image", b"", gif(frames=2), png(w=4)[0][:20]])
def test_refused(data):
    with pytest.raises(im.ImageError):
        im.clean_image(data)


def test_limits_and_pixels():
    data, px = png()
    with pytest.raises(im.ImageError):
        im.inspect_image(data, ImageOptions(max_input_bytes=10))
    bomb = im.PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", 60000, 60000, 8, 6, 0, 0, 0))
    with pytest.raises(im.ImageError):
        im.inspect_image(bomb)
    big = im.clean_image(data, ImageOptions(upscale=3.0))
    assert im.inspect_image(big)[1:3] == (12, 12) and im.clean_image(data, ImageOptions(upscale=1.0)) == data
    with pytest.raises(im.ImageError):
        im.clean_image(data, ImageOptions(upscale=10.0, max_dimension=20))
    flat = np.full((8, 8, 4), 77, np.uint8)
    assert (im.stretch_contrast(flat) == flat).all() and (im.sharpen(flat) == flat).all()
    ramp = np.full((16, 16, 4), 9, np.uint8)
    ramp[..., :3] = np.linspace(100, 150, 256).astype(np.uint8).reshape(16, 16, 1)
    wide = im.stretch_contrast(ramp)
    assert wide[..., 0].min() == 0 and wide[..., 0].max() == 255 and (wide[..., 3] == 9).all()
    again = im.reset_fingerprint(px, 2, 0.5, 1)
    assert (again == im.reset_fingerprint(px, 2, 0.5, 1)).all() and (again[..., 3] == px[..., 3]).all()
    assert np.abs(again[..., :3].astype(int) - px[..., :3]).max() <= 2 and (again != px).any()


@pytest.mark.parametrize("form", ["png", "bmp", "tiff", "gif"])
def test_formats_round_trip(form):
    data, px = png(chunk(b"tEXt", b"Author\0J"))
    px[..., 3] = 255
    solid = im.encode(px, "png")
    made = im.clean_image(solid, ImageOptions(output_format=form))
    assert im.image_kind(made) == form and im.inspect_image(made)[1:3] == (4, 4) and kinds(made) == []
    assert (im.decode(made, form) == px).all() and im.clean_image(made) == made
    assert (im.decode(im.clean_image(made, ImageOptions(output_format="png")), "png") == px).all()
    big = im.clean_image(made, ImageOptions(upscale=3.0))
    assert im.image_kind(big) == form and im.inspect_image(big)[1:3] == (12, 12)
    with pytest.raises(im.ImageError):
        im.clean_image(solid, ImageOptions(output_format="jpeg"))


def test_tiff_tags_are_left_out():
    px = (np.arange(5 * 3 * 4) % 200).astype(np.uint8).reshape(3, 5, 4)
    whole = im.encode(px, "tiff")
    tagged = whole[:10] + whole[10 : 10 + 12 * 10] + struct.pack("<HHII", 0x8825, 4, 1, 0) + whole[10 + 12 * 11 :]
    assert kinds(tagged) == ["gps"]
    clean = im.clean_image(tagged)
    assert kinds(clean) == [] and (im.decode(clean, "tiff") == px).all()
    many = np.random.default_rng(3).integers(0, 256, (40, 40, 4)).astype(np.uint8)
    many[..., 3] = 255
    back = im.decode(im.encode(many, "gif"), "gif")
    assert back.shape == many.shape and np.abs(back[..., 0].astype(int) - many[..., 0]).max() <= 40
    clear = many[:4, :4].copy()
    clear[0, 0, 3] = 0
    assert im.decode(im.encode(clear, "gif"), "gif")[0, 0, 3] == 0


def office(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        for name, text in parts:
            z.writestr(name, text)
        z.writestr("word/document.xml", "<d>keep</d>")
    return out.getvalue()


def test_ooxml():
    data = office(
        ("docProps/core.xml", '<?xml version="1.0"?><cp:core xmlns:cp="u" xmlns:dc="v"><dc:creator>Jane</dc:creator><dc:title> </dc:title></cp:core>'),
        ("docProps/custom.xml", '<Properties><property name="Client"><vt>Acme</vt></property></Properties>'),
    )
    assert b.inspect_ooxml(data) == [("docProps/core.xml", "creator", "Jane"), ("docProps/custom.xml", "Client", "Acme")]
    clean = b.clean_ooxml(data)
    assert b.inspect_ooxml(clean) == [] and zipfile.ZipFile(io.BytesIO(clean)).read("word/document.xml") == b"<d>keep</d>"
    assert b'xmlns:cp="u"' in zipfile.ZipFile(io.BytesIO(clean)).read("docProps/core.xml") and b.is_ooxml(clean)
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        z.writestr("readme.txt", "x")
    for bad, limits in ((plain.getvalue(), ZipLimits()), (b"nope", ZipLimits()), (data, ZipLimits(max_input_bytes=1)), (data, ZipLimits(max_entries=1)), (data, ZipLimits(max_entry_bytes=3)), (data, ZipLimits(max_total_bytes=99))):
        with pytest.raises(b.FileError):
            b.inspect_ooxml(bad, limits)


def test_pdf():
    xmp = zlib.compress(b"<x:xmpmeta>Jane</x:xmpmeta>")
    data = (
        b"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R/Metadata 4 0 R>>\nendobj\n2 0 obj\n<</Type/Pages/Kids[]/Count 0>>\nendobj\n"
        b"3 0 obj\n<</Author (J\\(a\\)ne)/Title <FEFF0041>/Empty ()/Trapped /False>>\nendobj\n4 0 obj\n<</Type/Metadata/Subtype/XML/Filter[/FlateDecode]/Length "
        + str(len(xmp)).encode() + b">>\nstream\n" + xmp + b"\nendstream\nendobj\ntrailer\n<</Root 1 0 R/Info 3 0 R/Size 5>>\nstartxref\n0\n%%EOF\n"
    )
    assert b.inspect_pdf(data) == [("Info", "Author", "J(a)ne"), ("Info", "Title", "A"), ("object 4", "XMP", "<x:xmpmeta>Jane</x:xmpmeta>")]
    clean = b.clean_pdf(data)
    assert [f for f in b.inspect_pdf(clean) if f[2]] == [] and len(clean) == len(data) and b"Jane" not in clean and b.clean_pdf(clean[:60] + b"x") is not None
    with pytest.raises(b.FileError):
        b.inspect_pdf(data, PdfLimits(max_input_bytes=10))
    with pytest.raises(b.FileError):
        b.inspect_pdf(b"hello")


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_object_streams(packed):
    heads, body = b"5 0 6 10 ", b"<</A 1>>  <</Author (Jane Doe)/Producer (Tool)>>"
    plain = heads + body
    own = zlib.compress(plain) if packed else plain
    data = (
        b"%PDF-1.7\n1 0 obj\n<</Type/Catalog>>\nendobj\n7 0 obj\n<</Type/ObjStm/N 2/First 9" + (b"/Filter/FlateDecode" if packed else b"") + b"/Length "
        + str(len(own)).encode() + b">>\nstream\n" + own + b"\nendstream\nendobj\n8 0 obj\n<</Type/XRef/Root 1 0 R/Info 6 0 R/Size 9>>\nstream\n\nendstream\nendobj\nstartxref\n0\n%%EOF\n"
    )
    assert b.inspect_pdf(data) == [("Info", "Author", "Jane Doe"), ("Info", "Producer", "Tool")]
    clean = b.clean_pdf(data)
    assert b.inspect_pdf(clean) == [] and len(clean) == len(data) and b"Jane" not in clean and b"/Info" not in clean


def test_mp3():
    frame = lambda n, v: n + struct.pack(">I", len(v) + 1) + b"\0\0\3" + v
    body = frame(b"TPE1", b"Artist") + frame(b"TSSE", b"Enc")
    tag = b"ID3\4\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + bytes(94) + b"\0"
    audio = b"\xff\xfb\x90\x00audio"
    assert b.inspect_mp3(tag + audio + v1) == [("ID3v2", "TPE1", "Artist"), ("ID3v2", "TSSE", "Enc"), ("ID3v1", "title", "Song")]
    assert b.clean_mp3(tag + audio + v1) == audio and b.inspect_mp3(audio) == [] and b.clean_mp3(audio) == audio


def test_mp4():
    atom = lambda k, d: struct.pack(">I", len(d) + 8) + k + d
    item = lambda k, v, form=1: atom(k, atom(b"data", struct.pack(">II", form, 0) + v))
    ilst = atom(b"ilst", item(b"\xa9nam", b"Name") + item(b"covr", b"jpegdata", 13))
    data = atom(b"ftyp", b"M4A ") + atom(b"moov", atom(b"mvhd", bytes(8)) + atom(b"udta", atom(b"meta", bytes(4) + ilst))) + atom(b"mdat", b"sound")
    assert b.inspect_mp4(data) == [("ilst", "\xa9nam", "Name"), ("ilst", "covr", "image data, 8 bytes")]
    clean = b.clean_mp4(data)
    assert b.inspect_mp4(clean) == [] and len(clean) == len(data) and clean.endswith(b"sound")
    with pytest.raises(b.FileError):
        b.inspect_mp4(b"nothing here")


def test_sources_and_frames(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    data, _ = png(chunk(b"tEXt", b"prompt\0x"))
    (tmp_path / "a.PNG").write_bytes(data)
    (tmp_path / "sub" / "b.png").write_bytes(b"broken")
    (tmp_path / "c.docx").write_bytes(office(("docProps/core.xml", "<a><b>v</b></a>")))
    (tmp_path / "d.bin").write_bytes(b"xx")
    (tmp_path / ".md").write_text("---\n")
    with pytest.raises(ValueError):
        files.expand_inputs(spark, [str(tmp_path)], ["image"])
    got = files.expand_inputs(spark, [str(tmp_path)], ["image"], recursive=True, max_bytes=10_000)
    assert "LessThanOrEqual(length,10000)]" in got._jdf.queryExecution().toString()
    rows = {r["path"].rsplit("/", 1)[1]: r for r in im.inspect_images(got).collect()}
    assert rows["a.PNG"]["ok"] and rows["a.PNG"]["findings"][0]["category"] == "ai-generator" and not rows["b.png"]["ok"] and rows["b.png"]["error"]
    cleaned = {r["path"].rsplit("/", 1)[1]: r for r in im.clean_images(got).collect()}
    assert cleaned["a.PNG"]["bytes_out"] < cleaned["a.PNG"]["bytes_in"] and cleaned["b.png"]["cleaned"] is None
    assert got.select(files.image_format(F.col("content")).alias("f")).filter("f = 'png'").count() == 1
    office_rows = files.expand_inputs(spark, [str(tmp_path / "c.docx"), str(tmp_path / "d.bin")], ["ooxml"])
    seen = {r["path"].rsplit("/", 1)[1]: r for r in b.inspect_files(office_rows, "ooxml").collect()}
    assert seen["c.docx"]["findings"][0]["value"] == "v" and not seen["d.bin"]["ok"]
    assert {r["ok"] for r in b.clean_files(office_rows, "ooxml").collect()} == {True, False}
    assert files.skipped(spark, [str(tmp_path)], ["image"]) == 2  # hidden files are not listed
    assert got.select(files.extension(F.lit("/x/.md")).alias("e")).first()["e"] == ""
    mixed = files.expand_inputs(spark, [str(tmp_path)], ["image", "ooxml"], recursive=True)
    assert {r["path"].rsplit("/", 1)[1]: r["ok"] for r in b.inspect_files(mixed).collect()} == {"a.PNG": True, "b.png": False, "c.docx": True}
    assert {r["ok"] for r in b.clean_files(mixed).collect()} == {True, False}
    gate = report.gate(im.inspect_images(got), F.col("ok")).first()
    assert (gate["files"], gate["files_with_findings"], gate["failures"], gate["failed"]) == (2, 1, 1, True)
    said = {json.loads(r["report"])["ok"] for r in report.json_report(im.inspect_images(got), "path", "format", "width").collect()}
    assert said == {True, False}


def test_utf8_and_names(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9",), (b"\xff\xfe",), (None,)], "content binary")
    got = files.decode_utf8(df).collect()
    assert [(r["text"], r["ok"]) for r in got] == [("café", True), (None, False), (None, True)]
    names = spark.createDataFrame([("/a/b/x.tar.gz",), ("y",), ("/q/.md",)], "p string").select(report.clean_name(F.col("p")).alias("n")).collect()
    assert [r["n"] for r in names] == ["x.tar-clean.gz", "y-clean", ".md-clean"]
    pivot = report.kinds_pivot(inspect_text(spark.createDataFrame([("<!-- a -->",)], "text string"), ext=F.lit("html")), ["meta", "comment"]).first()
    assert (pivot["meta"], pivot["comment"]) == (0, 1)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("---\nauthor: x\n---\nb​")
    for _ in range(2):  # the second run finds nothing new
        clean_text_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["cleaned"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["---\n---\nb"]


def test_files_go_to_python_in_small_batches(spark):
    """A worker holds a bounded number of whole files, however many rows a partition has."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = spark.range(1000).coalesce(1).select("id", F.lit(bytes(8)).alias("content"))
    out = b.clean_files(files, "mp3", key="id")
    most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    assert most <= 1000
    assert out.filter("ok AND bytes_out = 8").count() == 1000
