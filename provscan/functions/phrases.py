"""Phrase patterns in a small notation, compiled for Java, Python and RE2 alike.

A pattern is words between single spaces; any white space in a text matches a
space. ``a|b`` inside square brackets is a choice, a trailing ``?`` makes a
bracket optional and, if a word of its own, takes the space after it along, ``{...}`` is passed on as
a regular expression, ``'`` matches a straight or (with curly=True) curly one.
"""

from __future__ import annotations

import re


def compile_phrase(spec: str, curly: bool = False, ends: bool = True) -> str:
    """The regular expression of a pattern: word-bounded, without lookarounds or captures."""
    out, i = "", 0
    while i < len(spec):
        c = spec[i]
        if c == "{":
            j = spec.index("}}", i)
            out += spec[i + 2 : j]
            i = j + 2
            continue
        if c == "[":
            j, word = _closing(spec, i), i == 0 or spec[i - 1] in " |"
            inner = "|".join(compile_phrase(x, curly, False) for x in _split(spec[i + 1 : j]))
            i = j + 1
            mark = spec[i] if i < len(spec) and spec[i] in "?*" else ""
            i += len(mark)
            if mark and word and i < len(spec) and spec[i] == " ":
                inner = f"(?:{inner})\\s+"
                i += 1
            out += f"(?:{inner}){mark}"
            continue
        out += {" ": "\\s+", "'": "['’]" if curly else "'"}.get(c) or (c if c.isalnum() or c in "-,_" else re.escape(c))
        i += 1
    return f"\\b{out}\\b" if ends else out


def _closing(spec: str, i: int) -> int:
    depth = 0
    for j in range(i, len(spec)):
        depth += {"[": 1, "]": -1}.get(spec[j], 0)
        if not depth:
            return j
    raise ValueError(spec)


def _split(body: str) -> list[str]:
    parts, depth = [""], 0
    for c in body:
        depth += {"[": 1, "]": -1}.get(c, 0)
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


_COMMA = "{{\\b[,\\s]}}"
#: (label, weight, texts of which every match contains one, in lower case with single spaces, pattern)
CADENCE: list[tuple[str, float, str, str]] = [
    ("delve into", 1.2, "delve", "delve[s|d]? into"),
    ("a testament to", 1.1, "a testament to", "a testament to"),
    ("rich tapestry", 1.3, "rich tapestry", "rich tapestry{{(?:\\s+of)?}}"),
    ("plays a pivotal/crucial role", 1.0, "pivotal role|crucial role|vital role|key role", "play[s]? a [pivotal|crucial|vital|key] role"),
    ("in today's fast-paced world/landscape", 1.4, "world|landscape| era|environment", "in [today{{'?}}s|the] [fast-paced|ever-evolving|digital|rapidly changing]* [world|landscape|era|environment]"),
    ("it is important/crucial to note", 0.9, "it is important to|it is essential to|it is crucial to|it is worth noting to", "it is [important|essential|crucial|worth noting] to [note|remember|consider|highlight]"),
    ("not only ... but also serves to", 0.8, "serves to|acts as|highlights", "not only{{\\b[\\w\\s,]+\\b}}but [also]? [serves to|acts as|highlights]"),
    ("serves as a beacon/catalyst/cornerstone", 1.1, "as a beacon|as a reminder|as a catalyst|as a cornerstone", "serve[s|d]? as a [beacon|reminder|catalyst|cornerstone]"),
    ("underscores the importance/need", 0.9, "underscore", "underscore[s|d]? the [importance|need|significance]"),
    ("fosters a sense/culture", 0.9, "foster", "foster[s|ing|ed]? a [sense|culture|deeper understanding]"),
    ("seamlessly integrates/blends", 1.0, "seamlessly", "seamlessly [integrate{{s?}}|integrated|blend{{s?}}|combine{{[sd]?}}]"),
    ("navigating the complexities/nuances", 1.0, "navigat", "navigat[e|ing|es|ed] the [complexities|intricacies|nuances]"),
    ("multifaceted nature/approach", 1.0, "multifaceted", "multifaceted [nature|approach|landscape]"),
    ("harnessing the power of", 1.0, "the power of", "harness[ing|ed|es]? the power of"),
    ("a myriad of", 0.8, "a myriad of", "a myriad of"),
    ("paradigm shift", 0.9, "paradigm shift", "paradigm shift"),
    ("holistic approach/perspective", 0.9, "holistic", "holistic [approach|view|perspective]"),
    ("in conclusion", 0.8, "in conclusion", "in conclusion" + _COMMA),
    ("to summarize", 0.8, "to summarize", "to summarize" + _COMMA),
    ("ultimately,", 0.6, "ultimately", "ultimately" + _COMMA),
    ("furthermore,", 0.6, "furthermore", "furthermore" + _COMMA),
    ("moreover,", 0.6, "moreover", "moreover" + _COMMA),
    ("as an AI", 1.5, "as an ai", "as an ai"),
    ("I hope this helps", 1.2, "i hope this helps", "i hope this helps"),
    ("as a large language model / AI assistant", 2.0, "large language model|as an ai |as a ai ", "as a{{n?}} [large language model|ai [language]? [model|assistant]]"),
    ("I am an AI / language model", 2.0, "i'm |i am ", "i['m| am] [just]? a{{n?}} [ai|language model|chatbot]"),
    ("my training data / knowledge cutoff", 1.8, "training data|knowledge cut", "[my|the] [training data|knowledge cut{{-?}}off]"),
    ("I cannot access real-time/the internet", 1.6, "i can't |i cant |i cannot |i do not |i don't |i dont ", "i [can{{'?}}t|cannot|do not|don{{'?}}t] [have [access to|the ability]|browse|access]{{\\b[\\w\\s]*\\b}}[real{{-?}}time|internet|web|current]"),
    ("I apologize for the confusion", 1.2, "confusion", "i [apologize|'m sorry] for [the]? [confusion|any confusion]"),
    ("let's dive in", 1.0, "let's d|lets d|let us d", "[let{{'?}}s|let us] [dive|delve] [right]? in{{(?:to)?}}"),
    ("it's important to remember", 0.8, "to remember", "it{{'?}}s [important|worth] to remember"),
    ("in the realm of", 1.1, "in the realm of", "in the realm of"),
    ("game-changer", 0.8, "game-chang|game chang", "game{{[- ]}}chang[er|ing]"),
    ("cannot be overstated", 1.2, "cannot be overstated", "cannot be overstated"),
    ("embark on a journey", 1.2, "on a journey", "embark[s|ed|ing]? on a journey"),
    ("at the end of the day", 0.6, "at the end of the day", "at the end of the day" + _COMMA),
]


def cadence_pattern(spec: str) -> str:
    """A cadence pattern; one that ends in a separator needs no word border after it."""
    found = compile_phrase(spec)
    return found[:-2] if spec.endswith(_COMMA) else found
