"""Deterministic carriers planted into the fixture tables, alike in Spark and in DuckDB.

The fixture texts hold nothing that inspection looks for, so each query plants
something by key first; the SQL beside each function does the same.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provscan.functions.slices import sliced
from provscan.sources.tables import read_table

PHRASES = "\n\nIt is important to note that we delve into a rich tapestry of ideas. Furthermore, as an AI I hope this helps.\n"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A fixture table; ``columns`` are selected before a small table is spread over the cores."""
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def planted_text(key: Column, text: Column) -> Column:
    """Zero-width space after three characters (key % 3 = 0), no-break space (5), spaced dash (7), phrases (11), Cyrillic letter (13), full-width letters (17)."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(key % 3 == 0, F.concat(F.substring(t, 1, 3), F.lit("\u200b"), F.expr("substring(coalesce(text, ''), 4)"))).otherwise(t)
    for mod, tail in ((5, "\u00a0end"), (7, " \u2014 so"), (11, PHRASES), (13, " \u0440"), (17, " \uff21\uff42")):
        t = F.concat(t, F.when(key % mod == 0, tail).otherwise(""))
    return t


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with planted text."""
    return table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", planted_text(F.col("doc_id"), F.col("text")).alias("text"))


_Q = PHRASES.replace("\n", "' || chr(10) || '")
DOCS = f"""(SELECT doc_id, lang, source,
  CASE WHEN doc_id % 3 = 0 THEN substr(coalesce(text, ''), 1, 3) || chr(8203) || substr(coalesce(text, ''), 4) ELSE coalesce(text, '') END
  || CASE WHEN doc_id % 5 = 0 THEN chr(160) || 'end' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(8212) || ' so' ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN '{_Q}' ELSE '' END
  || CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(1088) ELSE '' END
  || CASE WHEN doc_id % 17 = 0 THEN ' ' || chr(65313) || chr(65346) ELSE '' END AS text
FROM documents)"""

PAGE_MARKS = [
    (4, '<meta name="generator" content="ChatGPT">'),
    (5, '<meta name="generator" content="WordPress 6.5">'),
    (6, '<script type="application/ld+json">{"digitalSourceType":"trainedAlgorithmicMedia"}</script>'),
    (9, '<p data-ai-model="x">text</p>'),
    (10, '<meta name="c2pa" content="manifest">'),
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with planted marks at the end of their html."""
    html = F.coalesce("html", F.lit(""))
    for mod, mark in PAGE_MARKS:
        html = F.concat(html, F.when(F.col("page_id") % mod == 0, mark).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


PAGES = "(SELECT page_id, url, coalesce(html, '')" + "".join(f" || CASE WHEN page_id % {m} = 0 THEN '{mark}' ELSE '' END" for m, mark in PAGE_MARKS) + " AS html FROM pages)"


# files:


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(*chunks: tuple[bytes, bytes]) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + b"".join(_chunk(*c) for c in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), *chunks, (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(bytes((0xFF, m)) + struct.pack(">H", len(b) + 2) + b for m, b in segments) + b"\xff\xda\0\2\xff\xd9"


def riff(kind: bytes, *chunks: tuple[bytes, bytes]) -> bytes:
    body = kind + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1) for n, b in chunks)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def box(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + name + body


def bmp(tail: bytes = b"") -> bytes:
    return b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4 + tail


def gif(comment: bytes = b"") -> bytes:
    extension = b"\x21\xfe" + bytes([len(comment)]) + comment + b"\0" if comment else b""
    return b"GIF89a\1\0\1\0\0\0\0" + extension + b"\x2c\0\0\0\0\1\0\1\0\0\2\2\x44\1\0\x3b"


def tiff(software: bytes = b"") -> bytes:
    entry = struct.pack("<HHII", 305, 2, len(software), 26) if software else struct.pack("<HHII", 256, 3, 1, 1)
    return b"II*\0\x08\0\0\0\1\0" + entry + b"\0\0\0\0" + software


def id3(frame: bytes) -> bytes:
    body = b"TXXX" + struct.pack(">I", len(frame)) + b"\0\0" + frame
    return b"ID3\3\0\0" + bytes((0, 0, len(body) >> 7, len(body) & 127)) + body


def zipped(**parts: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


def docx_of(lines: Column) -> Column:
    """A DOCX file of a heading and a paragraph for each line."""

    def build(texts: list) -> list:
        files = []
        for t in texts:
            told = (f"<w:p><w:r><w:t>{line.replace('&', '&amp;').replace('<', '&lt;')}</w:t></w:r></w:p>" for line in t.split("\n"))
            head = '<w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
            space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            named = f'<w:styles {space}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
            files.append(zipped(**{"word/document.xml": f"<w:document {space}><w:body>{head}{''.join(told)}</w:body></w:document>", "word/styles.xml": named}))
        return files

    def run(texts: pa.Array) -> pa.Array:
        return sliced(build, pa.binary(), texts)

    return F.arrow_udf(run, "binary")(lines)


MARK = b"Generated by OpenAI"
#: (file name, bytes, format, has_c2pa, has_ai_metadata)
IMAGES = [
    ("a.png", png(), "png", False, False),
    ("b.png", png((b"tEXt", b"Software\0ChatGPT")), "png", False, True),
    ("c.png", png((b"caBX", b"manifest")), "png", True, True),
    ("d.jpg", jpeg((0xE1, b"Exif" + MARK)), "jpeg", False, True),
    ("e.jpg", jpeg((0xEB, b"jumb")), "jpeg", True, True),
    ("f.webp", riff(b"WEBP", (b"XMP ", MARK)), "webp", False, True),
    ("g.avif", box(b"ftyp", b"avif\0\0\0\0avif") + box(b"jumb", b"c2pa"), "avif", True, True),
    ("h.heic", box(b"ftyp", b"heic\0\0\0\0heic") + box(b"mdat", b"pixels"), "heic", False, False),
    ("i.bmp", bmp(MARK), "bmp", False, True),
    ("j.gif", gif(MARK), "gif", False, True),
    ("k.tiff", tiff(MARK), "tiff", False, True),
    ("l.png", png((b"tEXt", b"Software\0ChatGPT"))[:60], "png", False, False),
]
AV = [
    ("a.mp4", box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", box(b"udta", MARK)), "mp4", False, True),
    ("b.mp4", box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"x"), "mp4", False, False),
    ("c.mp3", id3(MARK), "mp3", False, True),
    ("d.wav", riff(b"WAVE", (b"LIST", b"INFOISFT" + MARK), (b"data", b"\0\0")), "wav", False, True),
    ("e.wav", riff(b"WAVE", (b"data", b"\0\0")), "wav", False, False),
]
CONTAINERS = [
    ("a.docx", zipped(**{"word/document.xml": "OpenAI in the body", "docProps/app.xml": "<Application>Generated by Claude</Application>"}), "docx", False, True),
    ("b.docx", zipped(**{"word/document.xml": "OpenAI in the body"}), "docx", False, False),
    ("c.xlsx", zipped(**{"xl/workbook.xml": "x", "xl/media/a.png": png((b"caBX", b"m"))}), "xlsx", True, True),
    ("d.pptx", zipped(**{"ppt/presentation.xml": "x", "customXml/item1.xml": "x"}), "pptx", False, False),
    ("e.odt", zipped(**{"content.xml": "x", "meta.xml": "<generator>Gemini</generator>"}), "odt", False, True),
    ("f.epub", zipped(**{"META-INF/container.xml": "x", "a.opf": "<x/>", "b.xhtml": '<meta name="generator" content="ChatGPT">'}), "epub", False, True),
    ("g.pdf", b"%PDF-1.4\n<< /Producer (OpenAI) >>\nstream\nAIGC\nendstream", "pdf", False, True),
    ("h.pdf", b"%PDF-1.4\nstream\nAIGC OpenAI\nendstream", "pdf", False, False),
    ("i.svg", b"<svg><metadata>x</metadata></svg>", "svg", False, True),
    ("j.svg", b"<svg></svg>", "svg", False, False),
    ("k.md", b"---\ntitle: t\ngenerator: tool\n---\nbody", "markdown", False, True),
    ("l.md", b"# title\n\nbody", "markdown", False, False),
    ("m.html", b'<img src="data:image/png;base64,' + __import__("base64").b64encode(png((b"caBX", b"m"))) + b'">', "html", True, True),
    ("n.docx", b"PK\3\4 broken", "docx", False, False),
]


def files(spark: SparkSession, sf_dir: str, kinds: list[tuple]) -> DataFrame:
    """(doc_id, path, content): one of ``kinds`` per document, by its id."""
    names, blobs = [k[0] for k in kinds], [k[1] for k in kinds]

    def build(ids: pa.Array) -> pa.Array:
        return pa.array([None if i is None else blobs[i % len(blobs)] for i in ids.to_pylist()], pa.binary())

    which = F.array(*map(F.lit, names))[(F.col("doc_id") % len(names)).cast("int")]
    return table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit("-"), which).alias("path"), F.arrow_udf(build, "binary")(F.col("doc_id")).alias("content"))


def expected(kinds: list[tuple]) -> str:
    """SQL of (k, name, format, has_c2pa, has_ai) rows."""
    return ", ".join(f"({i}, '{n}', '{f}', {str(c).upper()}, {str(a).upper()})" for i, (n, _, f, c, a) in enumerate(kinds))
