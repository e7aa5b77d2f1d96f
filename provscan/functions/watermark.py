"""Keyed Gumbel watermark: same-key replay over token ids, and a registry of text detectors.

The key is a driver-side parameter that reaches the workers inside the pickled
function: it is in no column and in no plan that ``explain`` shows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from provscan.functions.slices import sliced

WINDOW = 4
THRESHOLD = 1e-6
REPORT = "struct<available:boolean,reason:string,tokens_total:int,skipped_no_context:int,skipped_repeated:int,counted:int,statistic:double,p_value:double,score:double,is_watermarked:boolean>"
POSITIONS = "struct<tokens_total:int,skipped_no_context:int,skipped_repeated:int,counted:int>"


def simple_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case, as 8-byte ids (BINARY: ids are unsigned 64-bit)."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 16)))


def listed_tokens(raw: Column) -> Column:
    """A JSON array of ids, or one decimal or 0x number a line, as 8-byte ids; null where one is out of range."""
    parts = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<decimal(20,0)>"))
    lines = F.filter(F.transform(F.split(raw, r"\r\n|\r|\n"), F.trim), lambda x: x != "")
    hexed = F.transform(lines, lambda x: F.when(x.rlike("^0[xX]"), F.lpad(F.substring(x, 3, 16), 16, "0")).otherwise(_hex(x.cast("decimal(20,0)"))))
    ids = F.transform(F.coalesce(F.transform(parts, _hex), hexed), lambda h: F.unhex(h))
    return F.when(~F.exists(ids, lambda i: i.isNull()), ids)


def _hex(n: Column) -> Column:
    """16 hexadecimal digits of a decimal from 0 to 2**64 - 1; null outside."""
    return F.when((n >= 0) & (n <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.lpad(F.conv(n.cast("string"), 10, 16), 16, "0"))


def key_bytes(raw: str) -> bytes:
    """0x and an even number of digits: those bytes; anything else: its UTF-8."""
    raw = raw.strip()
    if raw[:2].lower() != "0x":
        return raw.encode()
    if len(raw) < 4:
        raise ValueError("a hex key needs digits after 0x")
    return bytes.fromhex(raw[2:])


def gamma_tail(s: float, n: int, logs: list[float] | None = None) -> float:
    """The chance that a Gamma(n, 1) variable reaches s, summed in logarithms so that no term overflows.

    ``logs`` keeps the logarithms of 1, 2, ... for the next call.
    """
    if n <= 0 or s <= 0:
        return 1.0
    logs = [] if logs is None else logs
    logs += map(math.log, range(len(logs) + 1, n))
    terms = np.cumsum(np.concatenate(([0.0], math.log(s) - np.array(logs[: n - 1]))))  # added one by one
    top = float(terms.max())
    return min(1.0, max(0.0, math.exp(top - s + math.log(sum(map(math.exp, (terms - top).tolist()))))))


def contexts_of(ids: list[bytes], window: int = WINDOW, mask_repeated: bool = True) -> tuple[list[bytes], list[int]]:
    """(the windows before each id that has one, which of them count): with mask_repeated the first of equal ones."""
    whole, size = b"".join(ids), 8 * window
    found = [whole[at : at + size] for at in range(0, 8 * (len(ids) - window), 8)]
    if not mask_repeated:
        return found, list(range(len(found)))
    return found, sorted(dict(zip(reversed(found), range(len(found) - 1, -1, -1))).values())


class Hmac:
    """HMAC-SHA256 by one key, and by its own digests: begun hashes are copied, which is quicker than to begin them."""

    def __init__(self, key: bytes):
        self.flip = [bytes(x ^ pad for x in range(256)) for pad in (0x36, 0x5C)]
        self.rest = [bytes([pad]) * 32 for pad in (0x36, 0x5C)]
        key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        self.inner, self.outer = (hashlib.sha256(key.translate(flip)) for flip in self.flip)

    def chained(self, firsts: list[bytes], seconds: list[bytes]) -> list[bytes]:
        """For each pair the digest of the second by the digest of the first."""
        (flip_in, flip_out), (rest_in, rest_out), out = self.flip, self.rest, []
        inner, outer, new = self.inner.copy, self.outer.copy, hashlib.sha256().copy
        for first, second in zip(firsts, seconds):
            h = inner()
            h.update(first)
            g = outer()
            g.update(h.digest())
            seed = g.digest()
            h = new()
            h.update(seed.translate(flip_in) + rest_in + second)
            g = new()
            g.update(seed.translate(flip_out) + rest_out + h.digest())
            out.append(g.digest())
        return out


def replay(ids: list[bytes], key: bytes | Hmac, window: int = WINDOW, threshold: float = THRESHOLD, mask_repeated: bool = True, logs: list[float] | None = None) -> dict:
    """The test over 8-byte ids: each window of ids seeds a uniform number for the id after it, once."""
    keyed = key if isinstance(key, Hmac) else Hmac(key)
    found, kept = contexts_of(ids, window, mask_repeated)
    counted, repeated = len(kept), len(found) - len(kept)
    drawn = b"".join(keyed.chained([found[at] for at in kept], [ids[at + window] for at in kept]))
    u = (np.frombuffer(drawn, ">u8")[::4].astype(np.float64) + 0.5) / 2**64
    total = -float(np.cumsum(np.fromiter(map(math.log1p, (-u).tolist()), np.float64, counted))[-1]) if counted else 0.0  # added one by one
    p = gamma_tail(total, counted, logs) if counted else 1.0
    return {
        "available": True,
        "reason": None if counted else "no verifiable token positions",
        "tokens_total": len(ids),
        "skipped_no_context": min(window, len(ids)),
        "skipped_repeated": repeated,
        "counted": counted,
        "statistic": round(total, 6) if counted else None,
        "p_value": p,
        "score": round(-math.log10(p) if p > 0 else 300.0, 6) if counted else 0.0,
        "is_watermarked": counted > 0 and p < threshold,
    }


_POSITIONS_ARROW = pa.struct([(n, pa.int32()) for n in ("tokens_total", "skipped_no_context", "skipped_repeated", "counted")])
_REPORT_ARROW = pa.struct(
    [("available", pa.bool_()), ("reason", pa.string()), *((n, pa.int32()) for n in ("tokens_total", "skipped_no_context", "skipped_repeated", "counted")), *((n, pa.float64()) for n in ("statistic", "p_value", "score")), ("is_watermarked", pa.bool_())]
)


def detect_ids(ids: Column, key: str | bytes, window: int = WINDOW, threshold: float = THRESHOLD, mask_repeated: bool = True) -> Column:
    """REPORT over an array of 8-byte ids; null for null."""
    if window < 1 or not 0 < threshold < 1:
        raise ValueError("window must be at least 1 and threshold between 0 and 1")
    secret = key_bytes(key) if isinstance(key, str) else bytes(key)

    def run(arrays: pa.Array) -> pa.Array:
        keyed, logs = Hmac(secret), []
        work = lambda rows: [None if a is None else replay(a, keyed, window, threshold, mask_repeated, logs) for a in rows]
        return sliced(work, _REPORT_ARROW, arrays)

    return F.arrow_udf(run, REPORT)(ids)


class Ids(dict):
    """The 8-byte ids of tokens met so far, emptied before it grows large."""

    most = 100_000

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[token] = hashlib.sha256(token.encode()).digest()[:8]
        return found

    def of(self, lowered: str) -> list[bytes]:
        """What simple_tokens makes of a text in lower case."""
        return list(map(self.__getitem__, re.findall("[A-Za-z0-9]+", lowered)))


def detect_text(text: Column, key: str | bytes, window: int = WINDOW, threshold: float = THRESHOLD, mask_repeated: bool = True) -> Column:
    """REPORT over the simple tokens of a text, which never become a column; null for null."""
    if window < 1 or not 0 < threshold < 1:
        raise ValueError("window must be at least 1 and threshold between 0 and 1")
    secret = key_bytes(key) if isinstance(key, str) else bytes(key)

    def run(texts: pa.Array) -> pa.Array:
        keyed, ids, logs = Hmac(secret), Ids(), []
        work = lambda rows: [None if t is None else replay(ids.of(t), keyed, window, threshold, mask_repeated, logs) for t in rows]
        return sliced(work, _REPORT_ARROW, texts)

    return F.arrow_udf(run, REPORT)(F.lower(text))


def positions(text: Column, window: int = WINDOW, mask_repeated: bool = True) -> Column:
    """POSITIONS of the test over the simple tokens of a text: what it counts and skips depends on no key; null for null."""
    if window < 1:
        raise ValueError("window must be at least 1")

    def run(texts: pa.Array) -> pa.Array:
        ids = Ids()

        def work(rows: list) -> list:
            out = []
            for t in rows:
                tokens = ids.of(t or "")
                found, kept = contexts_of(tokens, window, mask_repeated)
                out.append(None if t is None else {"tokens_total": len(tokens), "skipped_no_context": min(window, len(tokens)), "skipped_repeated": len(found) - len(kept), "counted": len(kept)})
            return out

        return sliced(work, _POSITIONS_ARROW, texts)

    return F.arrow_udf(run, POSITIONS)(F.lower(text))


def unavailable(reason: str) -> Column:
    """REPORT of a detector that cannot run here."""
    fields = REPORT[len("struct<") : -1].replace(":", " ")
    return F.from_json(F.lit('{"available": false}'), fields).withField("reason", F.lit(reason))


#: Detectors by name: text column and options to a REPORT column. Open to registration.
DETECTORS: dict[str, Callable[..., Column]] = {
    "gumbel": lambda text, key=None, **options: detect_text(text, key, **options) if key else unavailable("no key given"),
    "model_watermark": lambda text, **_: unavailable("needs an external model, which this engine doesn't run"),
    "vendor": lambda text, **_: unavailable("the vendor offers no public detector"),
}


def register_detector(name: str, build: Callable[..., Column]) -> None:
    DETECTORS[name] = build


def detect(text: Column, names: list[str] | None = None, **options) -> Column:
    """A struct of the REPORTs of several detectors; an option reaches those it is named for (gumbel={...})."""
    return F.struct(*(DETECTORS[n](text, **options.get(n, {})).alias(n) for n in names or DETECTORS))
