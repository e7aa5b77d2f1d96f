"""Cadence and style scores, naturalizer, watermark replay."""

import hashlib
import hmac
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from provscan.functions import cadence, naturalize, style, watermark


def cadence_of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["cadence"] for r in cadence.report(df).orderBy("i").collect()]


def test_composite(spark):
    rows = spark.createDataFrame([(120, 0.30, 1.2, 0.70), (65, 0.30, 1.2, 0.70), (29, 0.1, 5.0, 0.7), (200, None, 0.0, 0.9)], "w int, cv double, d double, m double")
    found = [r[0] for r in rows.select(cadence.composite(F.col("w"), F.col("cv"), F.col("d"), F.col("m"))).collect()]
    assert found == pytest.approx([0.7375, 0.51625, 0.0, 0.01 / 0.55])


def test_formulaic_and_plain_text(spark):
    formulaic = "In today's digital landscape, it is important to note that we delve into a rich tapestry. Furthermore, this underscores the importance of a holistic approach. " * 6
    plain = "We broke the build. Nobody noticed until Tuesday, when the nightly job, which Ana had rewritten twice, failed again for a reason that had nothing to do with the change. Oops. I reverted it and went home early because the train was late anyway."
    high, low, short, null = cadence_of(spark, formulaic, plain, "As an AI, hello.", None)
    assert high["score"] >= 0.7 and len(high["matched_markers"]) >= 3 and high["confidence_level"] == "HIGH"
    assert low["score"] < 0.35 and short["status"] == "insufficient_length" and short["score"] == 0 and short["matched_markers"][0]["phrase"] == "as an AI"
    assert null is None


def test_fenced_text_has_no_burstiness(spark):
    r = cadence_of(spark, "```\n" + "word " * 40 + "\n```")[0]
    assert r["burstiness_cv"] is None and r["sentence_count"] == 0


def test_moving_ratio_equals_its_definition():
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") for _ in range(200)]
    windows = [len(set(words[i : i + 50])) / 50 for i in range(151)]
    assert cadence.moving_ratio(words) == pytest.approx(sum(windows) / len(windows))


def test_language(spark):
    en, pt, none = cadence_of(spark, "the cat and the dog of it " * 8, "que não uma para com dos das " * 6, "xyz " * 40)
    assert (en["language"], pt["language"], none["language"]) == ("en", "pt", "unknown") and pt["notice"] and not en["notice"]


SIGNALS = {
    "not_just_but": "It is not just fast, it is cheap.",
    "delve_family": "Let's explore this.",
    "worth_noting": "It's worth noting that.",
    "here_is_why": "Here's why: because.",
    "meta_commentary": "As we have seen, yes.",
    "hedge_double": "Perhaps it maybe works.",
    "declarative_close": "It is not big. It is small.",
    "template_heading": "## Why this matters\n",
    "emoji_heading": "# ✅ Done\n",
    "bold_lead_in": "\n".join(f"- **Label{i}**: text" for i in range(3)),
    "comparison_table_symmetry": "| abcd | efgh |\n|---|---|\n| abcd | efgh |\n| abcd | efgh |",
    "tricolon_uniform": "\n\n".join(["We like a, b, and c."] * 3 + ["x"]).replace("x", ""),
    "em_dash_density": "a — b — c — d.",
}


@pytest.mark.parametrize("name", SIGNALS)
def test_signal(name):
    found = style.analyzer().analyze(SIGNALS[name])[0]
    assert name in {s[0] for s in found}
    assert name not in {s[0] for s in style.analyzer().analyze("```\n" + SIGNALS[name] + "\n```")[0]}


def test_style_score_and_ranks(spark):
    signals = [("bold_lead_in", "medium"), ("worth_noting", "low"), ("type_token_ratio", "high")]
    df = spark.createDataFrame([([{"name": n, "severity": s} for n, s in signals],), ([],)], "s array<struct<name:string,severity:string>>")
    assert [r[0] for r in df.select(style.score(F.col("s"))).collect()] == [pytest.approx(0.2357), 0.0]


@pytest.mark.parametrize("blob", ["<" * 200_000, "a\n\n" * 60_000, "**A" * 60_000, "it is not just " * 20_000, "| a " * 60_000, "“" * 200_000], ids=range(6))
def test_adversarial_texts_are_linear(blob):
    began = time.process_time()
    style.analyzer().analyze(blob)
    naturalize.Pass(blob, frozenset(), [], naturalize.Patterns())
    assert time.process_time() - began < 15


GOLDEN = [
    ("Let's dive into the logs and delve deeper into the traces.", "Let's look at the logs and look closer at the traces."),
    ("In today's fast-paced world, teams ship faster.", "Teams ship faster."),
    ("It's worth noting that pip installs wheels.", "pip installs wheels."),
    ("Perhaps maybe it works. `perhaps maybe` stays.", "Maybe it works. `perhaps maybe` stays."),
    ("## Why this matters\n\nText.", "## Relevance\n\nText."),
    ("## Why this matters\n\nSee [it](#why-this-matters).", "## Why this matters\n\nSee [it](#why-this-matters)."),
    ("# ✅ Result\n\nText.", "# Result\n\nText."),
    ("- **Speed** — linear.\n- **Safety**: yes.\n- **Size:** small.", "- Speed: linear.\n- Safety: yes.\n- Size: small."),
    ("One — two. Pages 10—20. Three — four. Five — six.", "One, two. Pages 10—20. Three, four. Five, six."),
    ("> We delve into quotes.\n\n```\ndelve into code\n```\n", "> We delve into quotes.\n\n```\ndelve into code\n```\n"),
    ("Nothing to do here.", "Nothing to do here."),
]


@pytest.mark.parametrize("before, after", GOLDEN)
def test_naturalize(before, after):
    run = lambda t: naturalize.naturalize_python(t, style.analyzer(), naturalize.Patterns())
    r = run(before)
    assert r["text"] == after and r["changed"] == (before != after)
    assert run(after)["text"] == after


def keyed(rng, key, n, vocabulary=40):
    """Token ids drawn by the keyed rule: of all candidates the one of largest u ** (1 / p), p equal."""
    ids = [i.to_bytes(8) for i in range(vocabulary)]
    out = [rng.choice(ids) for _ in range(4)]
    seen = set()
    while len(out) < n:
        context = b"".join(out[-4:])
        if context in seen:
            out.append(rng.choice(ids))
            continue
        seen.add(context)
        seed = hmac.digest(key, context, "sha256")
        out.append(max(ids, key=lambda i: hmac.digest(seed, i, "sha256")[:8]))
    return out


def test_replay_finds_its_own_key_only():
    ids = keyed(random.Random(1), b"key", 80)
    assert watermark.replay(ids, b"key")["is_watermarked"] and not watermark.replay(ids, b"other")["is_watermarked"]
    short = watermark.replay(ids[:3], b"key")
    assert short["counted"] == 0 and short["p_value"] == 1 and not short["is_watermarked"]
    again = watermark.replay(ids[:8] * 3, b"key")
    assert again["skipped_repeated"] > 0 and again["counted"] + again["skipped_repeated"] + 4 == 24
    assert watermark.gamma_tail(20, 1) == pytest.approx(math.exp(-20)) and 0 <= watermark.gamma_tail(1e5, 20_000) <= 1


def test_tokens_and_keys(spark):
    df = spark.createDataFrame([("Hello, World 42!",), ("",)], "t string")
    ids = [r[0] for r in df.select(watermark.simple_tokens(F.col("t"))).collect()]
    assert [bytes(i) for i in ids[0]] == [hashlib.sha256(w).digest()[:8] for w in (b"hello", b"world", b"42")] and ids[1] == []
    assert watermark.key_bytes("0xff01") == b"\xff\x01" and watermark.key_bytes("secret") == b"secret"
    with pytest.raises(ValueError):
        watermark.key_bytes("0xabc")
    plan = df.select(watermark.detect_ids(watermark.simple_tokens(F.col("t")), "topsecret"))._jdf.queryExecution().toString()
    assert "topsecret" not in plan
    raw = spark.createDataFrame([("[1, 18446744073709551615]",), ("7\n0xff",), ("[18446744073709551616]",)], "t string")
    found = [r[0] for r in raw.select(watermark.listed_tokens(F.col("t"))).collect()]
    assert [list(map(bytes, f)) for f in found[:2]] == [[(1).to_bytes(8), b"\xff" * 8], [(7).to_bytes(8), (255).to_bytes(8)]] and not found[2]
