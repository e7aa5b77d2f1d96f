"""One row per rule of the Unicode layer."""

import hashlib
import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from provscan.functions import codepoints as cp
from provscan.functions import unicode as U
from provscan.plans import planted as P
from provscan.plans import queries as Q

ZWSP, ZWNJ, ZWJ, NBSP, DASH = "\u200b", "\u200c", "\u200d", "\u00a0", "\u2014"
FLAG = "\U0001f3f4\U000e0067\U000e0062\U000e007f"
#: (name, text, cleaned, kinds that inspection reports)
RULES = [
    ("plain", "plain text\n\twith tabs", "plain text\n\twith tabs", []),
    ("empty", "", "", []),
    ("zero width", f"a{ZWSP}b", "ab", ["zwj_family"]),
    ("soft hyphen", "a\u00adb", "ab", ["strip"]),
    ("no-break space", f"a{NBSP}b", "a b", ["space"]),
    ("spaced dash", f"a {DASH} b", "a, b", ["em_dash"]),
    ("spaced dash between no-break spaces", f"a{NBSP}{DASH}{NBSP}b", "a, b", ["space", "space", "em_dash"]),
    ("bare dash", f"a{DASH}b", "a-b", ["em_dash"]),
    ("en dash stays", "1990\u20132000", "1990\u20132000", []),
    ("emoji family", f"\U0001f468{ZWJ}\U0001f469{ZWJ}\U0001f467", f"\U0001f468{ZWJ}\U0001f469{ZWJ}\U0001f467", []),
    ("emoji variation", "\u2696\ufe0f", "\u2696\ufe0f", []),
    ("loose joiner", f"a{ZWJ}b", "ab", ["zwj_family"]),
    ("loose variation selector", "a\ufe0fb", "ab", ["variation_selector"]),
    ("Persian joiner", f"\u0645\u06cc{ZWNJ}\u0631\u0648\u0645", f"\u0645\u06cc{ZWNJ}\u0631\u0648\u0645", []),
    ("flag tags", FLAG, FLAG, []),
    ("loose tags", "a\U000e0067b", "ab", ["tag_chars"]),
    ("ideograph variation", "\u845b\U000e0100", "\u845b\U000e0100", []),
    ("Mongolian selector", "\u1820\u180b", "\u1820\u180b", []),
    ("loose Mongolian selector", "a\u180b", "a", ["variation_selector"]),
    ("Khmer vowel", "\u1780\u17b4", "\u1780\u17b4", []),
    ("Hangul filler", "\u1100\u1160", "\u1100\u1160", []),
    ("loose filler", "a\u3164b", "ab", ["strip"]),
    ("paired embedding", "x \u202bab\u202c", "x \u202bab\u202c", ["bidi", "bidi"]),
    ("unpaired embedding", "x \u202bab", "x ab", ["bidi"]),
    ("override", "x \u202eab\u202c", "x ab", ["bidi", "bidi"]),
    ("mark kept but reported", "a\u200fb", "a\u200fb", ["bidi"]),
    ("colour escape", "\x1b[31mred", "\x1b[31mred", []),
    ("other escape", "\x1b]8;;x", "]8;;x", ["control"]),
    ("control", "a\x07b\x85", "ab", ["control", "control"]),
    ("noncharacter", "a\ufdd0b", "ab", ["noncharacter"]),
    ("reserved", "a\u2065b", "ab", ["reserved_ignorable"]),
    ("private use", "a\ue000b", "ab", ["private_use"]),
    ("Arabic number sign", "\u0600\u0661", "\u0600\u0661", []),
    ("braille blank in braille", "\u2801\u2800\u2802", "\u2801\u2800\u2802", []),
    ("lone braille blank", "a\u2800b", "a b", ["space"]),
    ("layout control in its script", "\U00013000\U00013430\U00013001", "\U00013000\U00013430\U00013001", []),
    ("loose layout control", "a\U00013430b", "ab", ["other_cf"]),
    ("Cyrillic stays by default", "\u0440", "\u0440", []),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(n, t) for n, t, *_ in RULES] + [("null", None)], "name string, text string")
    t = F.col("text")
    found = df.select("name", U.clean_text(t).alias("fast"), U.clean(t).alias("c"), U.inspect(t).alias("r"), U.clean_text(U.clean_text(t)).alias("twice"))
    return {r["name"]: r for r in found.collect()}


@pytest.mark.parametrize("name, text, cleaned, kinds", RULES, ids=[r[0] for r in RULES])
def test_rule(rows, name, text, cleaned, kinds):
    r = rows[name]
    assert r["fast"] == r["c"]["text"] == r["twice"] == cleaned
    assert sorted(k for h in r["r"]["hits"] for k in [h["kind"]] * h["count"]) == sorted(kinds)
    assert r["r"]["length"] == len(text)


def test_null(rows):
    assert rows["null"]["fast"] is None and rows["null"]["c"] is None and rows["null"]["r"] is None


def test_hits_are_ordered_and_sampled(spark):
    df = spark.createDataFrame([(f"{NBSP}" * 12 + ZWSP,)], "t string")
    hits = df.select(U.inspect(F.col("t"))["hits"].alias("h")).first()["h"]
    assert [(h["codepoint"], h["count"], h["confidence"]) for h in hits] == [(0xA0, 12, "informational"), (0x200B, 1, "probable")]
    assert hits[0]["sample_offsets"] == list(range(10)) and hits[1]["label"] == "U+200B ZERO WIDTH SPACE (Cf)"


def test_options(spark):
    df = spark.createDataFrame([("\u0430\uff21 \u2014 \ufb01",)], "t string")
    t = F.col("t")
    assert df.select(U.clean(t, U.Options(confusables=True, nfkc=True))["text"]).first()[0] == "aA, fi"
    assert df.select(U.clean_text(t, U.Options(dashes=False))).first()[0] == "\u0430\uff21 \u2014 \ufb01"


def test_usual_characters_are_never_suspect():
    assert not (cp.USUAL - cp.SUSPECT) & cp.HARD and cp.GLUE <= cp.SUSPECT


@pytest.mark.parametrize("seed", range(6))
def test_unmatched_is_sequence_matcher(seed, monkeypatch):
    monkeypatch.setattr(U, "SMALL", 0)
    rng = random.Random(seed)
    for letters, n in (("ab", 60), ("abcdefgh ﬁＡ²…", 200), ("the Ａquickﬃ ", 300), ("Ａｂ㎥", 50)):
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
        for b in (unicodedata.normalize("NFKC", a), "".join(rng.choice(letters) for _ in range(n))):
            steps = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
            assert U.unmatched(a, b) == sum(j - i for name, i, j, _, _ in steps if name != "equal")


def test_nfkc_folds_whole_texts(spark, tmp_path):
    """The query on documents with compatibility characters in their middle, against unicodedata; the matcher took minutes for the longest."""
    middle = ["plain", "", "oﬃce x²", "Ｆｕｌｌ", "① and …", None, "straße", "é", "word ﬁ " * 4, " ".join(map(str, range(9000))) + " ﬂ" * 4]
    texts = [None if m is None else f"begin {m} end" for m in middle]
    docs = spark.createDataFrame([(i, "en", "s", t) for i, t in enumerate(texts, 1)], "doc_id long, lang string, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    planted = {r.doc_id: r.text for r in P.docs(spark, str(tmp_path)).collect()}
    heads = Q._COMPATIBLE
    rows = Q.unicode_nfkc(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) == len(planted)
    for r in rows:
        clean = U.clean_python(heads[r.doc_id % len(heads)] + planted[r.doc_id], U.Decider(U.Options()))["text"]
        folded = unicodedata.normalize("NFKC", clean)
        assert (r.folded_sha256, r.folded_length, r.changed) == (hashlib.sha256(folded.encode()).hexdigest(), len(folded), folded != clean)
