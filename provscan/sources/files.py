"""Reading texts and files into DataFrames: whole files, HTML, DOCX, sitemaps and token lists."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provscan.functions import formats
from provscan.functions.slices import sliced

AUDIT_SKIPS = "node_modules venv __pycache__ dist build target vendor site-packages env coverage htmlcov bower_components out bin obj".split()
STYLE_SKIPS = "node_modules venv __pycache__ dist build target vendor site-packages env coverage out".split()
STYLE_FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"}
MAX_TEXT, MAX_BINARY, MAX_CHARS, MAX_EXPANDED = 1_000_000, 25_000_000, 1_000_000, 20_000_000
MAX_SITEMAP = 64 << 20
LOADED = "struct<format:string,text:string,skip_reason:string,notes:array<string>,ceiling:string>"


def read_files(spark: SparkSession, root: str, skip_dirs: list[str] = AUDIT_SKIPS, glob: str = "*", max_bytes: int | None = None) -> DataFrame:
    """(path, length, content) of files below ``root``; directories to skip and hidden ones are left out by path.

    Size and path filters reach the scan, so bytes of other files are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # Roots and paths may write their scheme with one slash or three.
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", root).rstrip("/")
    inside = F.concat(F.lit("/"), F.replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/"), F.lit(bare), F.lit("")))
    hidden = inside.rlike(r"/(?:\.[^/]+|" + "|".join(map(re.escape, skip_dirs)) + ")/")
    rows = files.where(~hidden)
    return (rows if max_bytes is None else rows.where(F.col("length") <= max_bytes)).select("path", "length", "content")


def read_listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, content) of the files named."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def read_texts(spark: SparkSession, root: str, first: int | None = None, max_bytes: int = 64 << 10) -> DataFrame:
    """(path, text) of the .txt files of a directory by path, empty and larger ones left out; ``first`` takes that many."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(root).where(F.col("length").between(1, max_bytes))
    rows = rows.select("path", text_of(F.col("content")).alias("text")).where(F.trim("text") != "").orderBy("path")
    return rows if first is None else rows.limit(first)


def glob_pattern(glob: str) -> str:
    """A file name pattern (*, ?, [...]) as a regular expression."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else re.escape(c)) for c in glob)
    return "^(?:" + out.replace("[!", "[^") + ")$"


def ignored(path: Column, globs: list[str]) -> Column:
    """Whether a relative path, or its name, matches one of the globs."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g))
    return out


def text_of(content: Column) -> Column:
    """Bytes as UTF-8, broken sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def decoded(content: Column) -> Column:
    """Struct (text, note): UTF-8 without its mark, UTF-16 by its mark, or Windows-1252 where over 2 % would be replaced."""
    wide = F.substring(content, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff"))
    text = F.regexp_replace(text_of(content), "^\ufeff", "")
    bad = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    mostly = bad * 50 <= F.length(text)
    # Windows-1252 is ISO-8859-1 but for the bytes 80 to 9F.
    differ = {bytes([b]).decode("latin-1"): bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0)}
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(differ), "".join(differ.values()))
    return F.struct(
        F.when(wide, F.decode(content, "UTF-16")).when((bad == 0) | mostly, text).otherwise(western).alias("text"),
        F.when(wide, "decoded as UTF-16").when(bad == 0, F.lit(None)).when(mostly, F.format_string("%d invalid UTF-8 sequences replaced", bad)).otherwise("decoded as Windows-1252").alias("note"),
    )


class _Html(HTMLParser):
    """Headings, items, rows and paragraphs as markdown-like text."""

    starts = {**{f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}, "li": "\n- ", "br": "\n", "tr": "\n| ", **dict.fromkeys("p div section article header footer ul ol table blockquote".split(), "\n\n")}
    ends = {**dict.fromkeys("h1 h2 h3 h4 h5 h6 p div section article header footer ul ol table blockquote".split(), "\n\n"), "td": " | ", "th": " | "}
    silent = ("script", "style", "noscript", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs) -> None:
        self.depth += tag in self.silent
        if tag in self.starts:
            self.out.append(self.starts[tag])

    def handle_endtag(self, tag) -> None:
        if tag in self.silent:
            self.depth = max(0, self.depth - 1)
        self.out.append(self.ends.get(tag, ""))

    def handle_data(self, data) -> None:
        if not self.depth:
            self.out.append(data)


def html_text_python(html: str) -> str:
    parser = _Html()
    parser.feed(html)
    parser.close()
    squeezed = "\n".join(" ".join(re.split("[ \\t]+", line)).strip() for line in "".join(parser.out).splitlines())
    return re.sub("\n\n\n+", "\n\n", squeezed).strip() + "\n"


def html_text(html: Column) -> Column:
    """The text of a page; null for null."""

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else html_text_python(p) for p in pages.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(html)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text_python(data: bytes) -> str:
    """Paragraphs, with heading, title and list styles as markdown, and tables with pipes; needs no other library."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        parts = dict(formats.zip_members(z, lambda n: n in ("word/document.xml", "word/styles.xml")))
    if sum(map(len, parts.values())) > MAX_EXPANDED:
        raise ValueError(f"docx expands beyond {MAX_EXPANDED} bytes")
    names = {s.get(_W + "styleId"): n.get(_W + "val", "") for s in ElementTree.fromstring(parts.get("word/styles.xml", b"<x/>")).iter(_W + "style") if (n := s.find(_W + "name")) is not None}
    body = ElementTree.fromstring(parts["word/document.xml"]).find(_W + "body")
    said = lambda e: "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(_W), "") for x in e.iter()).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == _W + "p" and (text := said(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = names.get(style.get(_W + "val"), style.get(_W + "val") or "") if style is not None else ""
            level = re.fullmatch(r"(?i)heading ?(\d+)", name)
            out.append(("#" * min(int(level[1]), 6) + " " if level else "# " if name == "Title" else "- " if name.startswith("List") else "") + text)
        elif e.tag == _W + "tbl":
            rows = (" | ".join(said(c) for c in r.iter(_W + "tc")) for r in e.iter(_W + "tr"))
            out.append("\n".join(f"| {r} |" for r in rows))
    return "\n\n".join(out) + "\n"


def pdf_text_python(data: bytes, pages: int = 200) -> str:
    """Text of a PDF by the optional pypdf library."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("reading pdf needs the optional pypdf library") from None
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        raise ValueError("pdf is encrypted")
    return "\n\n".join(p.extract_text() for p in reader.pages[:pages]) + "\n"


_LOADED_ARROW = pa.struct([("format", pa.string()), ("text", pa.string()), ("skip_reason", pa.string()), ("notes", pa.list_(pa.string())), ("ceiling", pa.string())])


def load(path: Column, content: Column) -> Column:
    """LOADED of a file for the style tools: its text, or why it is skipped; never fails a row. ceiling: the most confidence its text deserves."""
    kind = formats.suffix(path)
    easy, plain = kind.isin("md", "markdown", "txt"), decoded(content)
    binary = kind.isin("docx", "pdf")
    size = F.octet_length(content)
    refusal = (
        F.when(content.isNull(), "unreadable")
        .when(~kind.isin(*STYLE_FORMATS), F.concat(F.lit("unsupported format: "), kind))
        .when(size > F.when(binary, MAX_BINARY).otherwise(MAX_TEXT), "too large")
        .when(~binary & F.contains(F.substring(content, 1, 8192), F.lit(b"\0")) & ~F.coalesce(plain["note"] == "decoded as UTF-16", F.lit(False)), "binary content")
    )

    def extract(kinds: list, blobs: list) -> list:
        rows = []
        for k, data in zip(kinds, blobs):
            if data is None:
                rows.append(None)
                continue
            try:
                text = {"docx": docx_text_python, "pdf": pdf_text_python}[k](data)
                notes = [f"text cut at {MAX_CHARS} characters"] if len(text) > MAX_CHARS else []
                rows.append({"format": k, "text": text[:MAX_CHARS], "skip_reason": None, "notes": notes, "ceiling": "medium" if k == "pdf" else "high"})
            except (ValueError, KeyError, formats.Budget, ElementTree.ParseError, zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError, zlib.error) as e:
                rows.append({"format": k, "text": None, "skip_reason": f"{k} unreadable ({e})", "notes": [], "ceiling": None})
        return rows

    def run(kinds: pa.Array, blobs: pa.Array) -> pa.Array:
        return sliced(extract, _LOADED_ARROW, kinds, blobs)

    extracted = F.arrow_udf(run, LOADED)(kind, F.when(refusal.isNull() & binary, content))
    named = F.create_map(*(F.lit(x) for pair in STYLE_FORMATS.items() for x in pair))[kind]
    text = F.when(refusal.isNull() & ~binary, F.when(easy, plain["text"]).otherwise(html_text(F.when(refusal.isNull() & kind.isin("html", "htm"), plain["text"]))))
    simple = F.struct(named.alias("format"), text.alias("text"), refusal.alias("skip_reason"), F.array_compact(F.array(plain["note"])).alias("notes"), F.lit("high").alias("ceiling"))
    return F.coalesce(extracted, simple)


SITEMAP = "struct<kind:string,urls:array<string>,error:string>"


def sitemap_python(data: bytes) -> tuple[str, list[str]]:
    """(kind of the root, its locations), gzipped or not; files that declare entities are refused."""
    if data.startswith(bytes.fromhex("1f8b")):
        data = gzip.open(io.BytesIO(data)).read(MAX_SITEMAP + 1)
    if len(data) > MAX_SITEMAP:
        raise ValueError("sitemap too large")
    if re.search(b"<!(?:DOCTYPE|ENTITY)", data):
        raise ValueError("sitemap declares a DTD or entities")
    root = ElementTree.fromstring(data)
    bare = lambda tag: tag.rpartition("}")[2]
    return bare(root.tag), [e.text.strip() for e in root.iter() if bare(e.tag) == "loc" and e.text]


def sitemap(content: Column) -> Column:
    """SITEMAP of a file's bytes; null for null."""

    def run(blobs: pa.Array) -> pa.Array:
        rows = []
        for data in blobs.to_pylist():
            try:
                rows.append(None if data is None else {"kind": (found := sitemap_python(data))[0], "urls": found[1], "error": None})
            except (ValueError, ElementTree.ParseError, OSError, EOFError, zlib.error) as e:
                rows.append({"kind": None, "urls": [], "error": str(e)})
        return pa.array(rows, pa.struct([("kind", pa.string()), ("urls", pa.list_(pa.string())), ("error", pa.string())]))

    return F.arrow_udf(run, SITEMAP)(content)


def sitemap_pages(sitemaps: DataFrame, url: str = "url", content: str = "content", most: int = 200) -> DataFrame:
    """(site, page): pages of the same origin as their sitemap, each once, the first ``most`` per sitemap by position."""
    rows = sitemaps.select(F.col(url).alias("site"), F.posexplode(sitemap(F.col(content))["urls"]).alias("at", "page"))
    same = rows.where(F.lower(origin(F.col("site"))) == F.lower(origin(F.col("page"))))
    firsts = same.groupBy("site", "page").agg(F.min("at").alias("at"))
    from pyspark.sql import Window

    order = Window.partitionBy("site").orderBy("at")
    return firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("site", "page")


def robots_sitemap(site: Column, robots: Column) -> Column:
    """The sitemap that the bytes of a site's robots.txt name first; null where it names none, or one of another origin."""
    lines = F.split(text_of(robots), r"\r\n|\r|\n")
    named = F.filter(lines, lambda x: F.lower(x).startswith("sitemap:"))
    first = F.trim(F.substring(F.get(named, F.lit(0)), 9, 1 << 20))
    return F.when(origin(first) == origin(site), first)


def origin(url: Column) -> Column:
    """scheme://host:port, with the default port left out; null where it is no http(s) URL."""
    found = F.regexp_extract(url, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?", 0)
    scheme, host, port = (F.regexp_extract(url, r"(?i)^(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?", i) for i in (1, 2, 3))
    usual = F.when(F.lower(scheme) == "https", "443").otherwise("80")
    return F.when(found != "", F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port))))
