"""Invisible characters, space and letter lookalikes, dashes: inspection and cleaning of a text column.

Most texts hold no suspect character at all; the JVM tells which by one match
against a character class, and only the others are handed to Python. Texts whose
only suspects are spaces and dashes are cleaned in the JVM too.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from provscan.functions import codepoints as cp
from provscan.functions.slices import sliced

HIT = "struct<codepoint:int,label:string,kind:string,confidence:string,count:int,sample_offsets:array<int>>"
REPORT = f"struct<length:int,suspicious_total:int,hits:array<{HIT}>>"
CLEANED = "struct<text:string,input_length:int,output_length:int,removed_count:int,replaced_count:int,removed:map<string,int>,replaced:map<string,int>,nfkc_changed:boolean>"

SUSPECT_CLASS = cp.java_class(cp.SUSPECT)
_DASH_GAP = "[^\\S\\r\\n]+[\u2014\u2015]+[^\\S\\r\\n]+"
WEAK_KINDS = ("space", "em_dash")


@dataclass(frozen=True)
class Options:
    """What to look for or change. ``bidi`` also treats marks and paired embeddings that cleaning keeps by default."""

    spaces: bool = True
    confusables: bool = False
    emoji_glue: bool = False
    bidi: bool = False
    dashes: bool = True
    nfkc: bool = False


# Python side: one decision per suspect character:


class Decider:
    """Decides on suspect characters in context. Plain data only, so that it travels to workers by value."""

    def __init__(self, o: Options):
        self.o = o
        wanted = cp.SUSPECT | (frozenset(cp.CONFUSABLES) if o.confusables else frozenset())
        self.find = re.compile(cp.python_class(wanted))
        self.sets = {name: getattr(cp, name) for name in ("STRIPPED", "SPACES", "DASHES", "BIDI_HARMLESS", "EMOJI_GLUE", "JOINERS", "FLAG_TAGS", "MONGOLIAN_SELECTORS", "KHMER_VOWELS", "HANGUL_FILLERS", "ORTHOGRAPHIC", "SELECTORS_EXTRA", "GLUE", "FORMAT")}
        self.tables = {name: getattr(cp, name) for name in ("EMOJI_BASES", "IDEOGRAPHS", "MONGOLIAN", "KHMER", "JAMO", "BRAILLE_CELLS", "JOINING_SCRIPTS", "LAYOUT")}
        self.confusables = cp.CONFUSABLES

    def _in(self, char: str | None, table: str, letters: str = "") -> bool:
        if char is None:
            return False
        c = ord(char)
        return any(a <= c <= b for a, b in self.tables[table]) and (not letters or unicodedata.category(char)[0] in letters)

    def _script(self, char: str | None) -> str | None:
        if char is None or unicodedata.category(char)[0] not in "LM":
            return None
        return next((name for name, table in self.tables["JOINING_SCRIPTS"].items() if any(a <= ord(char) <= b for a, b in table)), None)

    def keeps(self, c: int, base: str | None, before: str | None, after: str | None, flag: bool, paired: bool) -> bool:
        """Whether an invisible character carries meaning where it stands. base: the last visible character kept."""
        s = self.sets
        if not self.o.bidi and (paired or c in s["BIDI_HARMLESS"]):
            return True
        if self.o.emoji_glue:
            return False
        if self._in(before, "IDEOGRAPHS") and (c in s["SELECTORS_EXTRA"] or 0xFE00 <= c <= 0xFE0D):
            return True
        if c in s["MONGOLIAN_SELECTORS"] and (self._in(before, "MONGOLIAN") or self._in(base, "MONGOLIAN", "L")):
            return True
        if c in (0xFE0E, 0xFE0F) and self._in(before, "EMOJI_BASES"):
            return True
        if c == 0x200D and self._in(base, "EMOJI_BASES") and self._in(after, "EMOJI_BASES"):
            return True
        if c in s["JOINERS"] and self._script(before) is not None and self._script(before) == self._script(after):
            return True
        if flag and c in s["FLAG_TAGS"]:
            return True
        if c in s["KHMER_VOWELS"] and self._in(base, "KHMER", "L") or c in s["HANGUL_FILLERS"] and self._in(base, "JAMO"):
            return True
        if c in s["ORTHOGRAPHIC"]:
            return True
        for controls, script in self.tables["LAYOUT"]:
            if any(a <= c <= b for a, b in controls):
                return any(x is not None and any(a <= ord(x) <= b for a, b in script) for x in (before, after))
        return False

    def decide(self, char, base, before, after, flag, paired) -> tuple[str | None, str | None]:
        """(what takes the character's place: itself if kept, "" if stripped; kind, None if kept)."""
        c, s = ord(char), self.sets
        if self.keeps(c, base, before, after, flag, paired):
            return char, None
        if c == 0x1B:
            return (char, None) if after == "[" else ("", "control")
        if c in s["STRIPPED"]:
            return "", cp.strip_kind(c)
        if c == 0x2800 and (self._in(before, "BRAILLE_CELLS") or self._in(after, "BRAILLE_CELLS")):
            return char, None
        if c in s["DASHES"]:
            return ("-", "em_dash") if self.o.dashes else (char, None)
        if c in s["SPACES"]:
            return (" ", "space") if self.o.spaces else (char, None)
        if self.o.confusables and c in self.confusables:
            return self.confusables[c], "confusable"
        return ("", "other_cf") if c in s["FORMAT"] else (char, None)

    def walk(self, text: str):
        """(index, character, replacement, kind) of every suspect character that is not kept."""
        flags = {i for m in re.finditer("\U0001f3f4([\U000e0020-\U000e007e]+\U000e007f)", text) for i in range(*m.span(1))}
        paired, stack = set(), []
        for m in re.finditer("[\u202a-\u202e]", text):
            if m[0] != "\u202c":
                stack.append(m)
            elif stack and (opener := stack.pop())[0] in "\u202a\u202b":
                paired.update((opener.start(), m.start()))
        base, last = None, -2
        for m in self.find.finditer(text):
            i, char = m.start(), m[0]
            if i != last + 1:  # what lies between suspects is visible and kept
                base = text[i - 1] if i else None
            put, kind = self.decide(char, base, text[i - 1] if i else None, text[i + 1 : i + 2] or None, i in flags, i in paired)
            if kind is not None:
                yield i, char, put, kind
            if put and (kind is not None or ord(char) not in self.sets["GLUE"]):
                base = put
            last = i


def _most_first(entry) -> tuple[int, int]:
    (codepoint, _), offsets = entry
    return -len(offsets), codepoint


def inspect_python(text: str, decider: Decider) -> dict:
    found: dict[tuple[int, str], list[int]] = {}
    for i, char, _, kind in decider.walk(text):
        found.setdefault((ord(char), kind), []).append(i)
    hits = [
        {"codepoint": c, "label": cp.label(c), "kind": kind, "confidence": "informational" if kind in WEAK_KINDS else "probable", "count": len(at), "sample_offsets": at[:10]}
        for (c, kind), at in sorted(found.items(), key=_most_first)
    ]
    return {"length": len(text), "suspicious_total": sum(h["count"] for h in hits), "hits": hits}


class _Windows:
    """Hashes of all windows of one length in stretches of two texts. A hash only proposes; texts are compared."""

    def __init__(self, a: str, b: str):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for t in (a, b)]
        n = max(map(len, codes))
        odd = np.uint64(0x9E3779B97F4A7C15)
        self.sums, self.texts = [], (a, b)
        powers = np.multiply.accumulate(np.full(n, odd))
        self.back = np.multiply.accumulate(np.full(n + 1, np.uint64(pow(int(odd), -1, 1 << 64))))
        for c in codes:
            c = (c + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            c ^= c >> np.uint64(29)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers[: len(c)])]))

    def _hashes(self, side: int, low: int, high: int, size: int) -> np.ndarray:
        s = self.sums[side]
        return (s[low + size : high + 1] - s[low : high + 1 - size]) * self.back[low : high + 1 - size]

    def first(self, alo: int, ahi: int, blo: int, bhi: int, size: int) -> tuple[int, int] | None:
        """The first window of a that b holds, and the first place there; ValueError if a hash lied."""
        if size > min(ahi - alo, bhi - blo):
            return None
        x, y = self._hashes(0, alo, ahi, size), self._hashes(1, blo, bhi, size)
        found = np.isin(x, y)
        i = int(found.argmax())
        if not found[i]:
            return None
        j = int((y == x[i]).argmax())
        a, b = self.texts
        if a[alo + i : alo + i + size] != b[blo + j : blo + j + size]:
            raise ValueError("two windows share a hash")
        return alo + i, blo + j


SMALL = 1 << 14  #: pairs of characters up to which SequenceMatcher compares directly


def unmatched(a: str, b: str) -> int:
    """Characters of ``a`` outside SequenceMatcher's matching blocks (without junk), also for long texts.

    The matcher takes the longest common block, the first of equals, and goes on
    left and right of it. Its search tries all pairs of equal characters; here
    the longest block is found by hashed windows, in time about the texts' length.
    """
    windows, matched, todo = None, 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        short = min(ahi - alo, bhi - blo)
        if not short:
            continue
        if (ahi - alo) * (bhi - blo) <= SMALL:
            matched += sum(m.size for m in SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).get_matching_blocks())
            continue
        # A run at either end is common for sure: begin with the longer one.
        head, tail = _same_start(a[alo:ahi], b[blo:bhi]), _same_start(a[alo:ahi][::-1], b[blo:bhi][::-1])
        size = max(head, tail)
        at = (alo, blo) if head >= tail else (ahi - size, bhi - size)
        # All runs of b that long hold its middle: if a has that once, there is no other.
        core = b[bhi - size : blo + size]
        if core and (once := a.find(core, alo, ahi)) >= 0 and a.find(core, once + 1, ahi) < 0:
            matched += size
            todo += [(alo, at[0], blo, at[1]), (at[0] + size, ahi, at[1] + size, bhi)]
            continue
        try:
            windows, step = windows or _Windows(a, b), 1
            if size:
                at = windows.first(alo, ahi, blo, bhi, size)
            beyond = short + 1  # no common window is that long
            while size + 1 < beyond:
                tried = min(size + step, beyond - 1)
                hit = windows.first(alo, ahi, blo, bhi, tried)
                if hit:
                    size, at, step = tried, hit, 2 * step
                else:
                    beyond, step = tried, max(1, (tried - size) // 2)
        except ValueError:
            m = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).find_longest_match()
            size, at = m.size, (alo + m.a, blo + m.b)
        if size:
            matched += size
            todo += [(alo, at[0], blo, at[1]), (at[0] + size, ahi, at[1] + size, bhi)]
    return len(a) - matched


def _same_start(a: str, b: str) -> int:
    """How many characters both start with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def clean_python(text: str, decider: Decider) -> dict:
    removed, replaced = Counter(), Counter()
    if decider.o.dashes:
        text, n = re.subn(_DASH_GAP, ", ", text)
        replaced.update({"em_dash_spaced": n} if n else {})
    out, at = [], 0
    for i, char, put, _ in decider.walk(text):
        out += (text[at:i], put)
        at = i + 1
        (replaced if put else removed)[cp.label(ord(char))] += 1
    result = "".join((*out, text[at:]))
    changed = False
    if decider.o.nfkc:
        folded = unicodedata.normalize("NFKC", result)
        if changed := folded != result:
            replaced["NFKC_normalize"] += unmatched(result, folded) or 1
        result = folded
    return {
        "text": result,
        "input_length": len(text),
        "output_length": len(result),
        "removed_count": removed.total(),
        "replaced_count": replaced.total(),
        "removed": list(removed.items()),
        "replaced": list(replaced.items()),
        "nfkc_changed": changed,
    }


# columns:

_HIT_ARROW = pa.struct([("codepoint", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.string()), ("count", pa.int32()), ("sample_offsets", pa.list_(pa.int32()))])
_REPORT_ARROW = pa.struct([("length", pa.int32()), ("suspicious_total", pa.int32()), ("hits", pa.list_(_HIT_ARROW))])
_CLEANED_ARROW = pa.struct(
    [("text", pa.string()), *((n, pa.int32()) for n in ("input_length", "output_length", "removed_count", "replaced_count")), *((n, pa.map_(pa.string(), pa.int32())) for n in ("removed", "replaced")), ("nfkc_changed", pa.bool_())]
)


def _mapped(work, decider: Decider, kind: pa.DataType, returns: str):
    def run(texts: pa.Array) -> pa.Array:
        return sliced(lambda rows: [None if t is None else work(t, decider) for t in rows], kind, texts)

    return F.arrow_udf(run, returns)


def suspect(text: Column, options: Options = Options()) -> Column:
    """Whether inspection could report anything. The wide class is only tried on texts with an unusual character."""
    wanted = cp.java_class(cp.SUSPECT | frozenset(cp.CONFUSABLES)) if options.confusables else SUSPECT_CLASS
    # No suspect is among the usual ones of ASCII, whose test is quick; others try the ranges one by one.
    return F.when(unusual(text, options), text.rlike("(?![\\t\\n\\f\\r -~])" + wanted)).otherwise(False)


def unusual(text: Column, options: Options = Options(), but: frozenset[int] = frozenset()) -> Column:
    """Whether a text leaves the everyday letters and signs: true for more texts than are suspect, and quick to tell.

    Only characters beyond ASCII are looked up in the wider class, as the JVM
    tries its ranges one by one.
    """
    usual = (cp.USUAL - cp.SUSPECT - (frozenset(cp.CONFUSABLES) if options.confusables else frozenset())) | but
    return text.rlike("[^\\t\\n\\f\\r -~](?<!" + cp.java_class(c for c in usual if c > 0x7E) + ")")


def inspect(text: Column, confusables: bool = False, emoji_glue: bool = False) -> Column:
    """REPORT of a text (null for null): hits by codepoint and kind, most frequent first.

    Bidi controls, spaces and dashes are always reported, whatever cleaning keeps.
    """
    options = Options(confusables=confusables, emoji_glue=emoji_glue, bidi=True)
    report = _mapped(inspect_python, Decider(options), _REPORT_ARROW, REPORT)(F.when(unusual(text, options), text))
    clean = F.struct(F.length(text).alias("length"), F.lit(0).alias("suspicious_total"), F.array().cast(f"array<{HIT}>").alias("hits"))
    return F.when(text.isNotNull(), F.coalesce(report, clean))


def spaced_dashes(text: Column) -> Column:
    """U+2014 and U+2015 between horizontal white space become a comma and a space."""
    found = text.contains("\u2014") | text.contains("\u2015")
    return F.when(found, F.regexp_replace(text, "(?U)" + _DASH_GAP, ", ")).otherwise(text)


def plain_dashes(text: Column) -> Column:
    return F.translate(text, "\u2014\u2015", "--")


def plain_spaces(text: Column) -> Column:
    """Space lookalikes become U+0020; a blank cell beside other braille stays."""
    others = "".join(map(chr, sorted(cp.SPACES - {cp.BRAILLE_BLANK})))
    plain = F.translate(text, others, " " * len(others))
    lone = "(?<![\u2801-\u28ff])\u2800(?![\u2801-\u28ff])"
    return F.when(text.contains("\u2800"), F.regexp_replace(plain, lone, " ")).otherwise(plain)


def latin_letters(text: Column) -> Column:
    """Cyrillic and full-width lookalikes become Latin letters."""
    return F.translate(text, "".join(map(chr, cp.CONFUSABLES)), "".join(cp.CONFUSABLES.values()))


def clean_text(text: Column, options: Options = Options()) -> Column:
    """The cleaned text alone, in the JVM unless a text holds characters that need their context."""
    hard = unusual(text, options, cp.SPACES | cp.DASHES)
    if options.nfkc:
        hard = hard | text.rlike(r"[^\x00-\x7E]")
    slow = _mapped(clean_python, Decider(options), _CLEANED_ARROW, CLEANED)(F.when(hard, text))["text"]
    fast = spaced_dashes(text) if options.dashes else text
    fast = plain_dashes(fast) if options.dashes else fast
    fast = plain_spaces(fast) if options.spaces else fast
    return F.coalesce(slow, F.when(unusual(text, options), fast).otherwise(text))


def clean(text: Column, options: Options = Options()) -> Column:
    """CLEANED: the text and what was removed and replaced; null for null."""
    touched = unusual(text, options)
    if options.nfkc:
        touched = touched | text.rlike(r"[^\x00-\x7E]")
    done = _mapped(clean_python, Decider(options), _CLEANED_ARROW, CLEANED)(F.when(touched, text))
    none = F.create_map().cast("map<string,int>")
    same = F.struct(
        text.alias("text"),
        F.length(text).alias("input_length"),
        F.length(text).alias("output_length"),
        F.lit(0).alias("removed_count"),
        F.lit(0).alias("replaced_count"),
        none.alias("removed"),
        none.alias("replaced"),
        F.lit(False).alias("nfkc_changed"),
    )
    return F.when(text.isNotNull(), F.coalesce(done, same))
