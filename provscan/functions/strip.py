"""Removing metadata from files of one's own, into a new column, with a record of what went.

Opt-in: nothing else calls this. Every removal is inspected again, and the
result says what is still there. Pixels, samples and visible text are copied as
they are; a damaged tail is kept and reported.
"""

from __future__ import annotations

import base64
import io
import re
import struct
import urllib.parse
import zipfile

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from provscan.functions import formats as fm
from provscan.functions.unicode import Decider, Options, clean_python

RESULT = "struct<content:binary,actions:array<string>,changed:boolean,still_has_c2pa:boolean,still_has_ai_metadata:boolean>"
Stripped = tuple[bytes, list[str]]
_ESSENTIAL = b"IHDR PLTE IDAT IEND tRNS iCCP cHRM gAMA sRGB pHYs".split()


def strip_png(data: bytes, everything: bool) -> Stripped:
    out, actions, at, whole = bytearray(data[:8]), [], 8, False
    for name, payload, start, end in fm.png_chunks(data):
        at, whole = end, name == b"IEND" and payload is not None
        shown = name.decode("latin-1")
        if payload is None:
            actions.append(f"kept {len(data) - start} bytes of truncated chunk {shown}")
            break
        text = name in (b"tEXt", b"zTXt", b"iTXt")
        gone = name == b"eXIf" or fm.png_is_manifest(name) or text and (everything or any(fm.png_marks(name, payload))) or name not in _ESSENTIAL and not text and bool(fm.marks_in(name + payload, fm.MANIFEST_MARKS))
        if gone:
            actions.append(f"drop chunk {shown}")
        else:
            out += data[start:end]
    return bytes(out) + (b"" if whole else data[at:]), actions


def strip_jpeg(data: bytes, everything: bool) -> Stripped:
    out, actions, at = bytearray(data[:2]), [], 2
    for mark, payload, start, end in fm.jpeg_segments(data):
        if payload is None:
            break
        app = 0xE0 <= mark <= 0xEF
        if mark in (0xEB, 0xFE) or app and (everything and mark != 0xE0 or fm.marks_in(payload)):
            out += data[at:start]
            at = end
            actions.append(f"drop APP{mark - 0xE0}" if app else "drop comment")
    return bytes(out + data[at:]), actions


def _riff(data: bytes, gone) -> Stripped:
    """A RIFF file without the chunks that ``gone`` names; VP8X flags follow."""
    flags = dict(zip((b"XMP ", b"EXIF", b"ICCP"), (4, 8, 32)))
    kept, actions, cleared, tail = [], [], 0, b""
    for name, payload, start, end in fm.riff_chunks(data):
        if payload is None:
            tail = data[start:]
            actions += [f"kept {len(tail)} bytes after the last whole chunk"] if tail else []
        elif gone(name, payload):
            actions.append(f"drop chunk {name.decode('latin-1').strip()}")
            cleared |= flags.get(name, 0)
        else:
            kept.append((name, bytearray(data[start:end])))
    for name, chunk in kept:
        if name == b"VP8X" and len(chunk) > 8:
            chunk[8] &= ~cleared & 0xFF
    body = data[8:12] + b"".join(bytes(c) for _, c in kept) + tail
    return struct.pack("<4sI", b"RIFF", len(body)) + body, actions


def strip_webp(data: bytes, everything: bool) -> Stripped:
    return _riff(data, lambda n, p: n.upper() == b"C2PA" or n in (b"ICCP", b"EXIF", b"XMP ") and (everything or bool(fm.marks_in(p))))


def strip_wav(data: bytes, everything: bool) -> Stripped:
    return _riff(data, lambda n, p: (n == b"LIST" and p[:4] == b"INFO" or n.lower() == b"id3 ") and (everything or bool(fm.marks_in(p, fm.AI_MARKS))))


def _free(size: int, head: int) -> bytes:
    """A box to skip of the same size, so that offsets after it stay true."""
    if head == 16:
        return struct.pack(">I4sQ", 1, b"free", size) + bytes(size - 16)
    return struct.pack(">I4s", size, b"free") + bytes(size - 8)


def _strip_boxes(data: bytes, everything: bool, at: int, parent: bytes, actions: list[str]) -> bytes:
    out, end_ = bytearray(data[:at]), at
    for name, payload, start, end, head in fm.boxes(data, at):
        end_ = end
        marked = everything or bool(fm.marks_in(payload))
        gone = fm.box_is_manifest(name) or name == b"uuid" and (payload.startswith(fm.XMP_BOX) or marked) or parent == b"meta" and name in (b"xml ", b"bxml") and marked or parent == b"moov" and name == b"udta" and (everything or bool(fm.marks_in(payload, fm.AI_MARKS)))
        if gone:
            actions.append(f"drop {'/'.join(p.decode('latin-1') for p in (parent, name) if p)} box")
            out += _free(end - start, head)
        elif name in (b"meta", b"moov") and not parent:
            out += data[start : start + head] + _strip_boxes(payload, everything, 4 if name == b"meta" else 0, name, actions)
        else:
            out += data[start:end]
    if len(data) - end_ >= 8 and not parent:
        actions.append(f"kept {len(data) - end_} bytes of truncated tail")
    return bytes(out + data[end_:])


def strip_boxes(data: bytes, everything: bool) -> Stripped:
    actions: list[str] = []
    return _strip_boxes(data, everything, 0, b"", actions), actions


def strip_bmp(data: bytes, everything: bool) -> Stripped:
    end = fm.bmp_end(data)
    tail = data[end:] if end is not None else b""
    if not tail or not (everything or fm.marks_in(tail)):
        return data, []
    return data[:2] + struct.pack("<I", end) + data[6:end], [f"drop {len(tail)} trailing bytes"]


def strip_gif(data: bytes, everything: bool) -> Stripped:
    out, actions, at = bytearray(), [], 0
    for kind, label, payload, start, end in fm.gif_blocks(data):
        if payload is None or kind != 0x21 or label not in (0xFE, 0xFF):
            continue
        control = label == 0xFF and payload[:11] in (b"NETSCAPE2.0", b"ICCRGBG1012")
        if fm.marks_in(payload) or everything and not control:
            out += data[at:start]
            at = end
            actions.append("drop comment extension" if label == 0xFE else "drop application extension")
    return bytes(out + data[at:]), actions


def strip_tiff(data: bytes, everything: bool) -> Stripped:
    """Values of metadata tags are overwritten in place by zeros: directories and offsets stay valid."""
    out, actions = bytearray(data), []
    for tag, payload in fm.tiff_entries(data)[0]:
        pointer = tag in (34665, 34853, 40965)
        if pointer or not payload or not (fm.marks_in(payload) or everything and tag in fm.TIFF_TAGS):
            continue
        at = bytes(out).find(payload)
        if at >= 0:
            out[at : at + len(payload)] = bytes(len(payload))
            actions.append(f"blank tag {tag}")
    return bytes(out), actions


def strip_id3(data: bytes, everything: bool) -> Stripped:
    size, version, frames = fm.id3_frames(data) or (0, 0, None)
    if frames is None:
        return data, []
    if everything or not frames:
        return (data[size:], [f"drop ID3v2.{version} tag"]) if everything or fm.marks_in(data[:size], fm.AI_MARKS) else (data, [])
    pack7 = lambda n: bytes((n >> s & 127) for s in (21, 14, 7, 0))
    kept = [(n, p) for n, p in frames if not fm.marks_in(p, fm.AI_MARKS)]
    if len(kept) == len(frames):
        return data, []
    body = b"".join(n + (pack7(len(p)) if version == 4 else struct.pack(">I", len(p))) + b"\0\0" + p for n, p in kept)
    return b"ID3" + bytes((version, 0, 0)) + pack7(len(body)) + body + data[size:], [f"drop {len(frames) - len(kept)} ID3v2 frames"]


_BY_FORMAT = {"png": strip_png, "jpeg": strip_jpeg, "webp": strip_webp, "avif": strip_boxes, "heic": strip_boxes, "bmp": strip_bmp, "gif": strip_gif, "tiff": strip_tiff, "mp4": strip_boxes, "wav": strip_wav, "mp3": strip_id3}


def strip_uris(text: str, everything: bool, actions: list[str]) -> str:
    """Embedded images re-encoded without their metadata."""

    def put(m: re.Match) -> str:
        data = fm.decode_uri(m[2] or "", m[3])
        fmt = data and fm.sniff_image(data)
        if not fmt:
            return m[0]
        new, done = _BY_FORMAT[fmt](data, everything)
        if new == data:
            return m[0]
        actions.append(f"clean embedded data:image/{m[1]} ({', '.join(done[:2])})")
        shown = base64.b64encode(new).decode() if "base64" in (m[2] or "").lower() else urllib.parse.quote_from_bytes(new)
        return f"data:image/{m[1]}{m[2] or ''},{shown}"

    return fm._DATA_URI.sub(put, text)


def strip_markdown(text: str, everything: bool) -> tuple[str, list[str]]:
    """Without AI keys of the front matter, their nested lines included."""
    actions: list[str] = []
    m = fm._FRONT.match(text)
    if m:
        kept, dropping = [], False
        for line in m[1].splitlines():
            key = re.match(r"([A-Za-z0-9_.-]+)\s*:(.*)", line)
            if key:
                dropping = fm.is_ai_key(key[1]) or bool(re.search(fm.META_NAMES, key[2], re.I))
                if dropping:
                    actions.append(f"drop frontmatter key: {key[1]}")
            elif line.strip() and line[0] not in " \t-#":
                dropping = False
            if not dropping:
                kept.append(line)
        if actions:
            head = "\n".join(kept).strip("\n")
            text = (f"---\n{head}\n---\n" if head else "") + text[m.end() :]
    return strip_uris(text, everything, actions), actions


def _without(text: str, opener: re.Pattern, closer: re.Pattern, wanted, label: str, actions: list[str]) -> str:
    out, at = [], 0
    for a, b in fm.tag_blocks(text, opener, closer):
        if wanted(text[a:b]):
            out.append(text[at:a])
            at = b
            actions.append(label)
    return "".join((*out, text[at:]))


def strip_html(text: str, everything: bool) -> tuple[str, list[str]]:
    actions: list[str] = []

    def meta(m: re.Match) -> str:
        if fm.is_cms(m[0]) or not fm.is_ai_meta(m[0]):
            return m[0]
        actions.append(f"drop meta: {m[0][:80]}")
        return ""

    text = fm._META.sub(meta, text)
    text = _without(text, fm._LD_OPEN, fm._LD_CLOSE, fm.is_ai_ld, "drop json-ld provenance-like script", actions)
    text, n = re.subn(r"\s" + fm._DATA_AI.pattern.removeprefix("(?i)"), "", text, flags=re.I)
    actions += [f"drop data-ai attributes x{n}"] if n else []
    return strip_uris(text, everything, actions), actions


def strip_svg(data: bytes, everything: bool) -> Stripped:
    actions: list[str] = []
    text = data.decode("utf-8", "surrogateescape")
    for tag in ("metadata", "x:xmpmeta"):
        opener, closer = re.compile(rf"(?i)<{tag}\b{fm._REST}"), re.compile(rf"(?i)</{tag}\s*>")
        text = _without(text, opener, closer, lambda b: True, f"drop <{tag}>", actions)
    text = _without(text, re.compile("<!--"), re.compile("--!?>"), lambda b: bool(re.search(fm.META_NAMES, b, re.I)), "drop comment with markers", actions)
    return strip_uris(text, everything, actions).encode("utf-8", "surrogateescape"), actions


_RUNS = re.compile(rb"(<(?:w:t|a:t|t)(?:\s[^>]*)?>)([^<]*)(</(?:w:t|a:t|t)>)")
_PROPERTIES = re.compile(rb"(<(?:dc:creator|cp:lastModifiedBy|dc:description|cp:keywords|dc:subject|Application|Company|Manager|AppVersion|Template)(?:\s[^>]*)?>)[^<]*(</)")

_ODT_ORIGIN = re.compile(rb"<((?:meta:)?(?:generator|initial-creator))(?:\s[^>]*)?>[^<]*</\1\s*>")


def strip_zip(data: bytes, fmt: str, everything: bool, decider: Decider) -> Stripped:
    """Office files: custom parts go with what points at them, properties are blanked, media and text runs cleaned. EPUB and ODT: pages, media and metadata."""
    actions: list[str] = []
    office = fmt in ("docx", "xlsx", "pptx")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        locked = fm._encrypted(z) if fmt == "epub" else set()
        members, infos = dict(fm.zip_members(z)), {i.filename: i for i in z.infolist()}
    gone = {n for n in members if office and (n.startswith("customXml/") or n == "docProps/custom.xml")}
    actions += [f"drop part {n}" for n in sorted(gone)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in members.items():
            if name in gone:
                continue
            new = raw if name in locked else _part(name, raw, fmt, everything, decider, gone, actions)
            z.writestr(infos[name], new, infos[name].compress_type)
    return out.getvalue(), actions


def _part(name: str, raw: bytes, fmt: str, everything: bool, decider: Decider, gone: set[str], actions: list[str]) -> bytes:
    image = fm.sniff_image(raw)
    if image:
        new, done = _BY_FORMAT[image](raw, everything)
        actions += [f"{name}: {a}" for a in done]
        return new
    if name.lower().endswith(fm._PAGES) and fmt == "epub":
        text, done = strip_html(raw.decode("utf-8", "surrogateescape"), everything)
        cleaned = clean_python(text, decider)
        done += ["clean invisible characters"] * (cleaned["removed_count"] + cleaned["replaced_count"] > 0)
        actions += [f"{name}: {a}" for a in done]
        return cleaned["text"].encode("utf-8", "surrogateescape")
    if gone and (name.endswith(".rels") or name == "[Content_Types].xml"):
        tails = [re.escape(g.rsplit("/", 1)[-1]).encode() for g in gone]
        return re.sub(rb"<(?:Relationship|Override)\b[^>]*(?:Target|PartName)=[\"'][^\"']*(?:" + b"|".join(tails) + rb")[\"'][^>]*/>", b"", raw)
    if name.startswith("docProps/") or name == "meta.xml" and fmt == "odt" or name.lower().endswith(".opf"):
        new = _PROPERTIES.sub(lambda m: m[1] + m[2], raw) if name.startswith("docProps/") else _ODT_ORIGIN.sub(b"", raw)
        if name.lower().endswith(".opf"):
            new = re.sub(rb"<meta\b[^>]*/>", lambda m: b"" if re.search(fm.META_NAMES.encode(), m[0], re.I) else m[0], new)
        if new != raw:
            actions.append(f"{name}: blank properties")
        return new
    if fmt in ("docx", "xlsx", "pptx") and name.endswith(".xml"):

        def run(m: re.Match) -> bytes:
            return m[1] + clean_python(m[2].decode("utf-8", "surrogateescape"), decider)["text"].encode("utf-8", "surrogateescape") + m[3]

        new = _RUNS.sub(run, raw)
        if new != raw:
            actions.append(f"{name}: clean invisible characters")
        return new
    return raw


def strip_python(kind: str, suffix: str, data: bytes, everything: bool, decider: Decider) -> dict:
    """One file. What cannot be read stays as it is, with an action that says so."""
    inspect = {"image": fm.inspect_image, "av": fm.inspect_av}.get(kind)
    fmt = inspect(data)[0] if inspect else fm.sniff_container(suffix, data) if kind == "container" else None
    new, actions = data, []
    try:
        if fmt in _BY_FORMAT:
            new, actions = _BY_FORMAT[fmt](data, everything)
        elif fmt in ("html", "markdown"):
            text, actions = (strip_html if fmt == "html" else strip_markdown)(data.decode("utf-8", "surrogateescape"), everything)
            cleaned = clean_python(text, decider)
            if cleaned["removed_count"] + cleaned["replaced_count"]:
                actions.append(f"clean {cleaned['removed_count'] + cleaned['replaced_count']} characters")
            new = cleaned["text"].encode("utf-8", "surrogateescape")
        elif fmt == "svg":
            new, actions = strip_svg(data, everything)
        elif fmt in ("docx", "xlsx", "pptx", "odt", "epub"):
            new, actions = strip_zip(data, fmt, everything, decider)
            new = new if actions else data
        elif fmt == "pdf":
            actions = ["degraded: a PDF needs an external rewriter; left unchanged"]
        else:
            actions = ["unsupported format; left unchanged"]
    except (fm.Budget, *fm._ZIP_ERRORS) as e:
        new, actions = data, [f"unreadable ({type(e).__name__}); left unchanged"]
    again = inspect(new)[1] if inspect else fm.inspect_container(suffix, new, decider)[1] if fmt else (False, False, [])
    return {"content": new, "actions": actions or ["nothing to remove"], "changed": new != data, "still_has_c2pa": again[0], "still_has_ai_metadata": again[1]}


_RESULT_ARROW = pa.struct([("content", pa.binary()), ("actions", pa.list_(pa.string())), ("changed", pa.bool_()), ("still_has_c2pa", pa.bool_()), ("still_has_ai_metadata", pa.bool_())])


def strip(kind: Column, suffix: Column, content: Column, everything: bool = True) -> Column:
    """RESULT of a file's bytes; null for null. ``everything`` also removes metadata without any mark."""

    def run(kinds: pa.Array, suffixes: pa.Array, blobs: pa.Array) -> pa.Array:
        decider = Decider(Options())
        rows = zip(kinds.to_pylist(), suffixes.to_pylist(), blobs.to_pylist())
        return pa.array([None if b is None else strip_python(k, s or "", b, everything, decider) for k, s, b in rows], _RESULT_ARROW)

    return F.arrow_udf(run, RESULT)(kind, suffix, content)
