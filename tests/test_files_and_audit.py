"""Formats, loaders, audits, sinks, pair metrics, corpus statistics and streams."""

import base64
import gzip
import json
import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provscan.functions import formats as fm
from provscan.operators import audit, corpus, pairwise
from provscan.plans import planted as P
from provscan.sources import files as S
from provscan.sources import sinks
from provscan.streaming import facade


@pytest.mark.parametrize("case", P.IMAGES + P.AV, ids=lambda c: c[0])
def test_media(case):
    name, data, fmt, c2pa, ai = case
    found_fmt, (found_c2pa, found_ai, _) = (fm.inspect_image if case in P.IMAGES else fm.inspect_av)(data)
    assert (found_fmt, found_c2pa, found_ai) == (fmt, c2pa, ai)


@pytest.mark.parametrize("data", [c[1] for c in P.IMAGES + P.AV + P.CONTAINERS], ids=range(len(P.IMAGES + P.AV + P.CONTAINERS)))
def test_every_cut_of_a_file_is_survived(data):
    decider = fm.Decider(fm.Options(bidi=True))
    for cut in range(0, len(data), max(1, len(data) // 40)):
        for work in (fm.inspect_image, fm.inspect_av, lambda d: fm.inspect_container("", d, decider)):
            work(data[:cut])


def test_details():
    z = P.png((b"zTXt", b"parameters\0\0" + zlib.compress(b"Midjourney v6")), (b"iTXt", b"Title\0\0\0\0\0Midjourney"))
    assert fm.inspect_png(z)[2] == ["PNG zTXt: AI generator (parameters=Midjourney)"]
    assert fm.inspect_png(P.png((b"tEXt", b"Comment\0ChatGPT drew this")))[:2] == (False, False)
    hidden = P.box(b"ftyp", b"avif\0\0\0\0avif") + P.box(b"mdat", b"..jumb..")
    assert fm.inspect_boxes(hidden, "avif")[2] == ["byte-scan C2PA markers: jumb, JUMB"]
    cut = fm.inspect_boxes(struct.pack(">I", 99) + b"ftypavif c2pa", "avif")
    assert cut[0] and "not a valid AVIF" in cut[2][-1]
    xmp = P.box(b"uuid", fm.XMP_BOX + b"<x/>")
    assert fm.inspect_boxes(xmp, "mp4")[1:] == (True, ["MP4 XMP uuid box"])
    cms = fm.inspect_html('<meta name="generator" content="WordPress">')
    assert cms == (False, False, ['info: cms generator: <meta name="generator" content="WordPress">'])
    uri = "data:image/png;base64," + base64.b64encode(P.png((b"caBX", b"m"))).decode()
    assert fm.inspect_uris(f'x "{uri}"')[2] == ["embedded data:image/png: PNG chunk caBX (possible C2PA container)"]
    locked = P.zipped(**{"META-INF/container.xml": "x", "a.opf": "x", "b.xhtml": "x", "META-INF/encryption.xml": '<CipherReference URI="b.xhtml"/>'})
    assert "b.xhtml: encrypted content (skipped)" in fm.inspect_zip(locked, "epub")[2]
    assert fm.zip_format(locked) == "epub"


def test_unclosed_blocks_are_linear():
    assert fm.inspect_html("<script type='application/ld+json'>" * 30_000)[2] == []
    assert fm.inspect_pdf(b"stream\n" * 100_000)[2] == []


def test_zip_budget(monkeypatch):
    monkeypatch.setattr(fm, "ZIP_BUDGET", 1000)
    bomb = P.zipped(**{"word/document.xml": "x", "docProps/app.xml": "Claude", "docProps/z.xml": b"0" * 5000})
    c2pa, ai, found = fm.inspect_zip(bomb, "docx")
    assert "expands beyond" in found[-1]


def test_audit_end_to_end(spark):
    df = spark.createDataFrame([(n, bytearray(d)) for n, d, *_ in P.IMAGES + P.CONTAINERS] + [("t.txt", bytearray("a​b \ud83d".encode("utf-8", "surrogatepass"))), ("null.txt", None), ("x.bin", bytearray(b"\0\1\2"))], "path string, content binary")
    items = audit.audit_files(df).cache()
    by = {r["path"]: r for r in items.collect()}
    assert by["t.txt"]["suspicious_total"] == 1 and by["null.txt"]["skip_reason"] == "unreadable" and by["x.bin"]["kind"] == "unknown"
    s = audit.summary(items).first()
    assert s["skipped"] == 1 and s["total"] == len(by) - 1 and s["by_kind"]["docx"] == 3 and set(s["findings_by_confidence"]) == set(fm.CONFIDENCES)
    assert audit.exit_status(items).first()[0] == 3 and audit.exit_status(items.where("skip_reason is null")).first()[0] == 1
    assert audit.exit_status(items.where("false")).first()[0] == 0
    empty = audit.summary(items.where("false")).first()
    assert empty["total"] == 0 and empty["findings_by_confidence"]["confirmed"] == 0


def test_dash_severity_flag(spark):
    df = spark.createDataFrame([("p", "a — b")], "path string, text string")
    weak = lambda flag: audit.audit_texts(df, dashes_weak=flag).first()["findings"][0]["confidence"]
    assert (weak(False), weak(True)) == ("probable", "informational")


def test_cadence_in_audit(spark):
    text = "It is important to note that we delve into a rich tapestry. Furthermore, I hope this helps. " * 8
    r = audit.audit_texts(spark.createDataFrame([("p", text)], "path string, text string"), check_cadence=True).first()
    assert r["findings"][-1]["message"].startswith("stylometry [high_probability]") and r["suspicious_total"] == 1


def test_sarif_file(spark, tmp_path):
    df = spark.createDataFrame([(n, bytearray(d)) for n, d, *_ in P.CONTAINERS], "path string, content binary")
    sinks.write_sarif(audit.audit_files(df), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    report = json.loads(text)
    assert report["version"] == "2.1.0" and len(report["runs"][0]["results"]) > 5 and {r["level"] for r in report["runs"][0]["results"]} <= {"error", "warning", "note"}


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1)], "path string, n int").withColumn("s", F.struct("n"))
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_markdown(df.drop("s"), str(tmp_path / "m"), "Report")
    assert "| a b | 1 |" in "".join(p.read_text() for p in (tmp_path / "m").glob("part-*"))


def test_directory(spark, tmp_path):
    for name in ("a.txt", "sub/b.md", "node_modules/c.txt", ".git/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("text")
    found = {Path(r["path"]).name for r in S.read_files(spark, f"file:{tmp_path}").collect()}
    assert found == {"a.txt", "b.md"}
    assert S.read_texts(spark, f"file:{tmp_path}").count() == 1
    df = spark.createDataFrame([("docs/a.md",), ("b.txt",)], "p string")
    assert [r[0] for r in df.select(S.ignored(F.col("p"), ["docs/*", "x?.txt"])).collect()] == [True, False]


def test_loaders(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda text, style="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{style}{chr(34)}/>" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("Top", "H1") + para("text") + para("item", "L") + "<w:tbl><w:tr><w:tc>" + para("a") + "</w:tc><w:tc>" + para("b") + "</w:tc></w:tr></w:tbl>"
    styles = f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L"><w:name w:val="List Bullet"/></w:style></w:styles>'
    docx = P.zipped(**{"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})
    rows = [("a.docx", docx), ("b.docx", b"PK\3\4junk"), ("c.html", b"<h2>T</h2><ul><li>x</li></ul><script>no</script><p>y &amp; z</p>"), ("d.txt", "né".encode("utf-16")), ("e.txt", b"a\x93b\x94" * 9), ("f.exe", b"x"), ("g.txt", None), ("h.pdf", b"%PDF-")]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    got = {r["path"]: r["l"] for r in df.select("path", S.load(F.col("path"), F.col("content")).alias("l")).collect()}
    assert got["a.docx"]["text"] == "# Top\n\ntext\n\n- item\n\n| a | b |\n" and got["b.docx"]["skip_reason"].startswith("docx unreadable")
    assert got["c.html"]["text"] == "## T\n\n- x\n\ny & z\n" and got["d.txt"]["text"] == "né" and got["e.txt"]["text"] == "a“b”" * 9
    assert got["f.exe"]["skip_reason"] and got["g.txt"]["skip_reason"] == "unreadable" and got["h.pdf"]["skip_reason"].startswith("pdf unreadable")


def test_sitemap():
    xml = b'<sitemapindex xmlns="http://x"><sitemap><loc> https://a/1 </loc></sitemap></sitemapindex>'
    assert S.sitemap_python(xml) == S.sitemap_python(gzip.compress(xml)) == ("sitemapindex", ["https://a/1"])
    with pytest.raises(ValueError):
        S.sitemap_python(b"<!DOCTYPE x><x/>")


def test_pairs(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("a b c", "x y z"), ("", ""), ("a b", ""), ("a", "b"), ("see 42 http://x/1", "42 only")], "o string, c string")
    q = [r["q"] for r in df.select(pairwise.quality(F.col("o"), F.col("c")).alias("q")).collect()]
    assert [x["lexical_divergence"] for x in q[:5]] == [0, 1, 0, 1, 0] and q[5]["urls_preserved"] == 0 and q[5]["numbers_preserved"] == 0.5


def test_effect(spark):
    rows = [(0, float(x)) for x in (1, 2, 3, 4)] + [(1, float(x)) for x in (2, 3, 4, 5)]
    e = corpus.effect(spark.createDataFrame(rows, "side int, x double"), "side", "x", 0, 1).first()
    assert e["cohens_d"] == pytest.approx(1 / (5 / 3) ** 0.5) and e["auc"] == pytest.approx(sum((b > a) + (b == a) / 2 for a in (1, 2, 3, 4) for b in (2, 3, 4, 5)) / 16)
    flat = corpus.effect(spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 1.0)], "side int, x double"), "side", "x", 0, 1).first()
    assert flat["cohens_d"] is None and flat["auc"] == 0.5 and not flat["enough"]


def test_stream_dedup(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")], "i int, t string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = facade.table_stream(spark, str(tmp_path / "in"), rows)
    facade.run_once(facade.without_copies(stream, "t", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["t"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
    facade.run_once(facade.without_copies(stream, "t", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_only_folders_below_the_root_are_skipped(spark, tmp_path, scheme):
    root = tmp_path / ".cache" / "build"
    for name in ("a.txt", "sub/b.txt", "build/c.txt", ".git/d.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    found = {r.path.rsplit("/", 1)[-1] for r in S.read_files(spark, f"{scheme}{root}").select("path").collect()}
    assert found == {"a.txt", "b.txt"}
