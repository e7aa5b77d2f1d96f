"""Codepoint classes of the Unicode layer: one table, compiled for the JVM and for Python.

Classes are explicit ranges. The only category that is looked up is Cf, once, on
the driver, so that executors with another Unicode version decide alike.
"""

from __future__ import annotations

import unicodedata


def ranges(spec: str) -> tuple[tuple[int, int], ...]:
    """'AD 200B-200F' as ((0xAD, 0xAD), (0x200B, 0x200F))."""
    pairs = (part.partition("-") for part in spec.split())
    return tuple((int(a, 16), int(b or a, 16)) for a, _, b in pairs)


def members(spec: str) -> frozenset[int]:
    return frozenset(c for a, b in ranges(spec) for c in range(a, b + 1))


CONTROLS = members("0-8 B E-1A 1C-1F 7F-9F")
ESCAPE = 0x1B
TAGS = members("E0001-E007F")
FLAG_TAGS = members("E0020-E007F")
NONCHARACTERS = members("FDD0-FDEF " + " ".join(f"{p:X}FFFE-{p:X}FFFF" for p in range(17)))
RESERVED = members("2065 E0000 FFF0-FFF8 E0080-E00FF E01F0-E0FFF")
SELECTORS_EXTRA = members("E0100-E01EF")
SELECTORS = members("FE00-FE0F")
MONGOLIAN_SELECTORS = members("180B-180D 180F")
BIDI = members("61C 200E-200F 202A-202E 2066-2069")
BIDI_HARMLESS = members("61C 200E-200F 2066-2069")
ZERO_WIDTH = members("200B-200D 2060 FEFF 180E")
PRIVATE = members("E000-F8FF F0000-FFFFD 100000-10FFFD")
KHMER_VOWELS = members("17B4-17B5")
HANGUL_FILLERS = members("115F-1160 3164 FFA0")
OTHER_INVISIBLE = members("AD 34F 2061-2064 206A-206F FFF9-FFFB") | KHMER_VOWELS | HANGUL_FILLERS
STRIPPED = CONTROLS | TAGS | NONCHARACTERS | RESERVED | SELECTORS_EXTRA | SELECTORS | MONGOLIAN_SELECTORS | BIDI | ZERO_WIDTH | PRIVATE | OTHER_INVISIBLE

BRAILLE_BLANK = 0x2800
SPACES = members("A0 1680 2000-200A 202F 205F 2800 3000")
DASHES = members("2014-2015")
ORTHOGRAPHIC = members("600-605 6DD 70F 8E2 110BD 110CD")
EMOJI_GLUE = members("200D FE0E-FE0F")
JOINERS = members("200C-200D")
GLUE = EMOJI_GLUE | SELECTORS | SELECTORS_EXTRA | MONGOLIAN_SELECTORS | JOINERS | FLAG_TAGS | KHMER_VOWELS | HANGUL_FILLERS

EMOJI_BASES = ranges("1F000-1FAFF 2190-27BF 2B00-2BFF A9 AE 2122 3030 303D 3297 3299 23 2A 30-39")
IDEOGRAPHS = ranges("3400-4DBF 4E00-9FFF F900-FAFF 20000-323AF")
MONGOLIAN = ranges("1800-18AF")
KHMER = ranges("1780-17FF")
JAMO = ranges("1100-11FF A960-A97C D7B0-D7C6 3131-318E FFA1-FFDC")
BRAILLE_CELLS = ranges("2801-28FF")
JOINING_SCRIPTS = {name: ranges(spec) for name, spec in {"arabic": "600-8FF", "indic": "900-DFF", "south-asian": "F00-109F", "khmer": "1780-17FF", "mongolian": "1800-18AF"}.items()}
#: Format controls that lay out the script of the second ranges.
LAYOUT = ((ranges("13430-1343F"), ranges("13000-143FF")), (ranges("1BCA0-1BCA3"), ranges("1BC00-1BCA3")), (ranges("1D173-1D17A"), ranges("1D100-1D1FF")))

FORMAT = frozenset(c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")
#: Everything that inspection can report, whatever its options, but confusables.
HARD = STRIPPED | FORMAT | {ESCAPE}
SUSPECT = HARD | SPACES | DASHES

#: Blocks of everyday text; what is suspect in them is taken out where they are used.
USUAL = members("9-D 20-7E A1-5FF 900-DFF 1E00-1FFF 2010-206F 20A0-20CF 2100-214F 2190-21FF 3001-30FF 4E00-9FFF AC00-D7A3 FF00-FFEF")

#: Lookalikes of Latin letters: Cyrillic, and full-width forms.
CONFUSABLES = dict(zip(map(ord, "\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0456"), "ABEKMHOPCTXaeopcyxi")) | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}


def inside(cp: int, table) -> bool:
    return any(a <= cp <= b for a, b in table)


def _runs(chars) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for c in sorted(chars):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def java_class(chars) -> str:
    """A character class of Java's regular expressions."""
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _runs(c for c in chars if not 0xD800 <= c <= 0xDFFF)) + "]"


def python_class(chars) -> str:
    """The same class of Python's."""
    return "[" + "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in _runs(chars)) + "]"


def label(cp: int) -> str:
    """U+200B ZERO WIDTH SPACE (Cf)."""
    char = chr(cp)
    return f"U+{cp:04X} {unicodedata.name(char, 'UNKNOWN')} ({unicodedata.category(char)})"


def strip_kind(cp: int) -> str:
    """The name of the first class that holds a stripped codepoint."""
    order = (
        ("tag_chars", TAGS),
        ("control", CONTROLS),
        ("noncharacter", NONCHARACTERS),
        ("reserved_ignorable", RESERVED),
        ("variation_selector", SELECTORS_EXTRA | SELECTORS | MONGOLIAN_SELECTORS),
        ("bidi", BIDI),
        ("zwj_family", ZERO_WIDTH),
        ("private_use", PRIVATE),
    )
    return next((name for name, chars in order if cp in chars), "strip")
