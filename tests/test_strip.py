"""Removing metadata: what is marked goes, what is not stays, and a second run changes nothing."""

import pytest
from pyspark.sql import functions as F

from provscan.functions import formats as fm
from provscan.functions import strip as st
from provscan.plans import planted as P

CASES = [("image", *c) for c in P.IMAGES] + [("av", *c) for c in P.AV] + [("container", *c) for c in P.CONTAINERS]


@pytest.mark.parametrize("everything", [True, False])
@pytest.mark.parametrize("case", CASES, ids=lambda c: c[1])
def test_case(case, everything):
    kind, name, data, fmt, c2pa, ai = case
    run = lambda d: st.strip_python(kind, name.rsplit(".", 1)[1], d, everything, fm.Decider(fm.Options()))
    r = run(data)
    if fmt != "pdf" and name != "n.docx":
        assert not r["still_has_c2pa"] and not r["still_has_ai_metadata"], r["actions"]
        assert r["changed"] or not (c2pa or ai)
    again = run(r["content"])
    assert again["content"] == r["content"] and not again["changed"]


def test_pixels_and_offsets_stay():
    png = P.png((b"tEXt", b"Software\0ChatGPT"))
    assert st.strip_png(png, True)[0] == P.png()
    boxed = P.box(b"ftyp", b"avif\0\0\0\0avif") + P.box(b"jumb", b"c2pa") + P.box(b"mdat", b"pixels")
    new, actions = st.strip_boxes(boxed, True)
    assert len(new) == len(boxed) and new.endswith(P.box(b"mdat", b"pixels")) and actions == ["drop jumb box"]
    cut = png[:-6]
    assert cut[-4:] in st.strip_png(cut, True)[0]
    assert st.strip_png(P.png((b"tEXt", b"Title\0mine")), False)[1] == []


def test_office_parts():
    docx = P.zipped(**{"[Content_Types].xml": '<Override PartName="/docProps/custom.xml"/><Override PartName="/word/document.xml"/>', "word/document.xml": "<w:t>a​b</w:t>", "docProps/custom.xml": "x", "docProps/core.xml": "<dc:creator>me</dc:creator>"})
    new, actions = st.strip_zip(docx, "docx", True, fm.Decider(fm.Options()))
    parts = dict(fm.zip_members(__import__("zipfile").ZipFile(__import__("io").BytesIO(new))))
    assert "docProps/custom.xml" not in parts and parts["word/document.xml"] == b"<w:t>ab</w:t>" and parts["docProps/core.xml"] == b"<dc:creator></dc:creator>"
    assert b"custom" not in parts["[Content_Types].xml"] and b"document.xml" in parts["[Content_Types].xml"] and len(actions) == 3


def test_markdown_keeps_other_keys():
    text = "---\ntitle: t\ngenerator:\n  name: x\n  version: 1\ntags:\n  - a\n---\nbody"
    assert st.strip_markdown(text, True)[0] == "---\ntitle: t\ntags:\n  - a\n---\nbody"


def test_column(spark):
    df = spark.createDataFrame([("image", "png", bytearray(P.png((b"caBX", b"m")))), ("unknown", "", bytearray(b"x")), ("image", "png", None)], "k string, s string, c binary")
    rows = [r["r"] for r in df.select(st.strip(F.col("k"), F.col("s"), F.col("c")).alias("r")).collect()]
    assert rows[0]["changed"] and not rows[0]["still_has_c2pa"] and not rows[1]["changed"] and rows[2] is None
