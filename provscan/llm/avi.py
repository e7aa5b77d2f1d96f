"""Motion-JPEG in AVI: writing, parsing, intra decoding and shot detection.

Reads RIFF AVI files (an idx1 index, or a walk over movi where there is none),
whose video frames are JPEG images: baseline DCT in grey or colour, and the
lossless process (SOF3) that stores 8-bit samples exactly. Frames are decoded
from their own bytes alone, as motion-JPEG has no inter frames. Shots are found
where the histogram of a frame differs from its predecessor's by more than what
the frames just before it did.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = 64  #: samples in a line of a frame that holds a payload
LINES = 32  #: lines in such a frame; the last may have fewer
FPS = 25
BINS = 16
MAX_SAMPLES = 1 << 26  #: a frame that says it has more gives an error row
#: Code lengths for the categories 0..8 of differences between neighbouring bytes: short where text puts them.
LENGTHS = (4, 5, 4, 3, 2, 2, 4, 5, 7)


class MediaError(ValueError):
    """A file that is not what its headers say."""


# Huffman codes:


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """{symbol: (code, length)}: codes in order of length, those of one length as listed."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], code, last = (code, n), code + 1, n
    return out


def _writer_tables() -> tuple[np.ndarray, np.ndarray, bytes]:
    """(bits, bit counts) by difference + 255, and the DHT segment that says so."""
    codes = _codes(dict(enumerate(LENGTHS)))
    bits, count = np.zeros(511, np.uint32), np.zeros(511, np.uint32)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], count[d + 255] = code << size | extra, n + size
    by_length = [[s for s, (_, n) in sorted(codes.items(), key=lambda x: x[1][0]) if n == k] for k in range(1, 17)]
    body = bytes([0, *map(len, by_length)]) + bytes(s for row in by_length for s in row)
    return bits, count, b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_BITS, _COUNT, _DHT = _writer_tables()


def _lookup(dht: dict[int, int]) -> np.ndarray:
    """By the next 16 bits: total bits << 16 | (difference + 32768), or 0 where code and extra bits are longer."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, (code, n) in _codes(dht).items():
        total = n + (symbol if symbol < 16 else 0)
        if total > 16:
            continue
        low = code << 16 - n
        extra = np.arange(1 << 16 - n) >> 16 - total if symbol else np.zeros(1 << 16 - n, np.int64)
        value = np.where(extra >> max(symbol - 1, 0) & 1, extra, extra - (1 << symbol) + 1) if symbol else extra
        table[low : low + (1 << 16 - n)] = total << 16 | (value + 32768)
    return table


# writing:


def _entropy(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every line of samples as a restart interval: (bytes with a two-byte slot after each line, starts, ends)."""
    n = len(lines)
    steps = lines.astype(np.int16)
    steps[:, 1:] -= lines[:, :-1]
    steps[:, 0] -= 128
    index = (steps + 255).ravel()
    bits, count = _BITS[index], _COUNT[index].astype(np.int64)
    ends = np.cumsum(count.reshape(n, LINE), axis=1)
    sizes = ends[:, -1] + 7 >> 3
    at = np.cumsum(sizes) - sizes
    place = (ends - count.reshape(n, LINE) + at[:, None] * 8).ravel()
    word = bits.astype(np.uint64) << (32 - count - (place & 7)).astype(np.uint64)
    byte, total = place >> 3, int(sizes.sum())
    raw = np.zeros(total + 4)
    for k in range(4):
        raw[: total + 4] += np.bincount(byte + k, (word >> np.uint64(24 - 8 * k) & np.uint64(255)).astype(np.float64), total + 4)[: total + 4]
    raw = raw[:total].astype(np.uint8)
    pad = (sizes * 8 - ends[:, -1]).astype(np.uint8)
    raw[at + sizes - 1] |= ((1 << pad.astype(np.int32)) - 1).astype(np.uint8)
    full = raw == 255
    before = np.concatenate([[0], np.cumsum(full)])
    line = np.repeat(np.arange(n), sizes)
    where = np.arange(total) + before[:-1] + 2 * line
    out = np.zeros(total + int(before[-1]) + 2 * n, np.uint8)
    out[where] = raw
    starts = at + before[at] + 2 * np.arange(n)
    stops = at + sizes + before[at + sizes] + 2 * np.arange(n)
    return out, starts, stops


def _frame_head(lines: int) -> bytes:
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, lines, LINE, 1, 1, 0x11, 0)
    dri = b"\xff\xdd" + struct.pack(">HH", 4, LINE)
    sos = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 1, 0, 0)
    return b"\xff\xd8" + _DHT + sof + dri + sos


_HEADS = [_frame_head(k) for k in range(LINES + 1)]


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS) -> bytes:
    """An AVI file of one MJPG stream, with an idx1 index."""
    chunks, index, at = [], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        pad = b"\0" * (len(f) & 1)
        chunks += (b"00dc", struct.pack("<I", len(f)), f, pad)
        at += 8 + len(f) + len(pad)
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    movi = chunk(b"LIST", b"movi" + b"".join(chunks))
    body = b"AVI " + hdrl + movi + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def payload(text: bytes) -> bytes:
    """``text`` and bytes 0 up to a positive multiple of LINE."""
    return text + b"\0" * (-len(text) % LINE if text else LINE)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of LINE bytes) as the samples of a lossless motion-JPEG AVI."""
    lines = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, LINE)
    out, starts, stops = _entropy(lines)
    out, starts, stops = memoryview(out.tobytes()), starts.tolist(), stops.tolist()
    files, at = [], 0
    for p in payloads:
        frames, end = [], at + len(p) // LINE
        while at < end:
            n = min(LINES, end - at)
            scan = bytearray(out[starts[at] : stops[at + n - 1]])
            for k in range(n - 1):  # restart markers between lines
                mark = stops[at + k] - starts[at]
                scan[mark], scan[mark + 1] = 0xFF, 0xD0 + k % 8
            frames.append(b"".join((_HEADS[n], scan, b"\xff\xd9")))
            at += n
        files.append(write_avi(frames, LINE, min(LINES, len(p) // LINE)))
    return files


# parsing:


@dataclass
class Video:
    width: int
    height: int
    seconds_per_frame: float
    frames: list[memoryview]


def parse_avi(data: bytes) -> Video:
    """Headers and the frames of the first video stream.

    Frames of the first movi list go by idx1 where there is one, else by walking
    the list; the lists of further RIFF AVIX segments are walked, as idx1 does
    not cover them.
    """
    view = memoryview(data)
    if len(data) < 12 or view[:4] != b"RIFF" or view[8:12] != b"AVI ":
        raise MediaError("not a RIFF AVI file")
    found: dict = {"streams": [], "rate": None, "movi": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
            body, stop = at + 8, min(at + 8 + size, end)
            if name == b"LIST" and view[body : body + 4] == b"movi":
                found["movi"].append((body, stop))
            elif name == b"LIST" or (name == b"RIFF" and view[body : body + 4] == b"AVIX"):
                walk(body + 4, stop)
            elif name == b"avih" and size >= 40:
                micro, = struct.unpack_from("<I", data, body)
                found["rate"] = micro / 1e6
                found["size"] = struct.unpack_from("<II", data, body + 32)
            elif name == b"strh" and size >= 28:
                scale, rate = struct.unpack_from("<II", data, body + 20)
                found["streams"].append((bytes(view[body : body + 4]), scale / rate if rate else None))
            elif name == b"idx1":
                found.setdefault("idx1", (body, stop))
            at = body + size + (size & 1)

    whole = 8 + int.from_bytes(view[4:8], "little")
    if not 12 <= whole <= len(data):  # a size that a writer left open
        whole = len(data)
    walk(12, whole)
    walk(whole + (whole & 1), len(data))
    if not found["movi"]:
        raise MediaError("no movi list")
    video = next((k for k, (kind, _) in enumerate(found["streams"]) if kind == b"vids"), 0)
    wanted = (b"%02ddc" % video, b"%02ddb" % video)
    frames = []
    for segment, (start, end) in enumerate(found["movi"]):
        if segment == 0 and "idx1" in found:
            a, b = found["idx1"]
            base = None
            for name, _, offset, size in struct.iter_unpack("<4sIII", view[a : a + (b - a) // 16 * 16]):
                if name in wanted:
                    if base is None:  # offsets count from the list's name, or from the file's start
                        base = start if view[start + offset : start + offset + 4] == name else 0
                    at = base + offset + 8
                    frames.append(view[at : at + size])
            continue
        at = start + 4
        while at + 8 <= end:
            name, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
            if name == b"LIST":
                at += 12
                continue
            if name in wanted:
                frames.append(view[at + 8 : min(at + 8 + size, end)])
            at += 8 + size + (size & 1)
    each = next((s for k, (_, s) in enumerate(found["streams"]) if k == video and s), found["rate"]) or 1 / FPS
    return Video(*found.get("size", (0, 0)), each, frames)


@dataclass
class _Jpeg:
    process: int
    precision: int
    height: int
    width: int
    components: list[tuple[int, int, int, int]]  # id, h, v, quantisation table
    quant: dict[int, np.ndarray]
    tables: dict[int, dict[int, int]]  # class << 4 | id: {symbol: code length}
    restart: int
    scan: list[tuple[int, int]]  # index of component, tables
    predictor: int
    data: memoryview


def _listed(counts: str, symbols: str) -> dict[int, int]:
    lengths = [k + 1 for k, n in enumerate(bytes.fromhex(counts)) for _ in range(n)]
    return dict(zip(bytes.fromhex(symbols), lengths))


_SMALL = "43444546474849" + "4a" + "535455565758595a636465666768696a737475767778797a"
_LATE = "92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
#: The tables of the JPEG standard, which motion-JPEG frames may leave out.
_STANDARD = {
    0x00: _listed("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: _listed("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: _listed(
        "0002010303020403050504040000017d",
        "0102030004110512213141061351610722711432819" + "1a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a" + _SMALL + "838485868788898a" + _LATE + "e1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: _listed(
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442" + "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a" + _SMALL + "82838485868788898a" + _LATE + "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def parse_jpeg(frame) -> _Jpeg:
    """Headers of a JPEG image up to its first scan."""
    frame = memoryview(frame)
    if frame[:2] != b"\xff\xd8":
        raise MediaError("not a JPEG frame")
    at, quant, tables, restart, sof = 2, {}, dict(_STANDARD), 0, None
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise MediaError("a JPEG frame without a scan")
        mark = frame[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        size = int.from_bytes(frame[at + 2 : at + 4])
        body = bytes(frame[at + 4 : at + 2 + size])
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                if len(body) <= n:
                    raise MediaError("a quantisation table that ends early")
                quant[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                counts = body[1:17]
                lengths = [k + 1 for k, n in enumerate(counts) for _ in range(n)]
                symbols = body[17 : 17 + len(lengths)]
                tables[body[0]] = dict(zip(symbols, lengths))
                body = body[17 + len(lengths) :]
        elif mark in (0xC0, 0xC1, 0xC3):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            sof = (mark, precision, height, width, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise MediaError(f"JPEG process {mark:02x} is not an intra process read here")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2])
        elif mark == 0xDA:
            if sof is None:
                raise MediaError("a scan before its frame header")
            ids = [c[0] for c in sof[4]]
            named = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            if not named or any(i not in ids for i, _ in named):
                raise MediaError("a scan of components that the frame lacks")
            scan = [(ids.index(i), t) for i, t in named]
            return _checked(_Jpeg(*sof, quant, tables, restart, scan, body[1 + 2 * body[0]], frame[at + 2 + size :]))
        at += 2 + size


def _checked(j: _Jpeg) -> _Jpeg:
    """``j`` if its header can be true: sizes that its scan can hold bound what decoding allocates."""
    if not (j.width and j.height and j.components):
        raise MediaError("a frame without samples")
    if not 2 <= j.precision <= 16 or any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in j.components):
        raise MediaError("a precision or sampling factor out of range")
    samples = j.width * j.height
    # Each sample of a lossless scan, and each block of 64 in a DCT scan, takes at least a bit, or two.
    least = samples if j.process == 0xC3 else samples // 32
    if least > 8 * (len(j.data) + 64) or samples > MAX_SAMPLES:
        raise MediaError(f"{j.width} x {j.height} samples in a scan of {len(j.data)} bytes")
    return j


# decoding:


def _intervals(scans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Restart intervals of several scans, unstuffed and laid end to end: (bytes, starts, scan of each)."""
    raw = np.frombuffer(b"".join([*(b"".join((s, b"\xff\xd9")) for s in scans), b"\0" * 8]), np.uint8)
    full = np.flatnonzero(raw[:-1] == 255)
    follow = raw[full + 1]
    keep = np.ones(len(raw), bool)
    keep[full[follow == 0] + 1] = False  # stuffing
    marks = full[(follow >= 0xD0) & (follow <= 0xD9)]
    keep[marks], keep[marks + 1] = False, False
    sizes = np.cumsum([len(s) + 2 for s in scans])
    heads = np.concatenate([[0], sizes[:-1]])
    inner = marks[raw[marks + 1] < 0xD8] + 2
    starts = np.sort(np.concatenate([heads, inner]))
    new = np.cumsum(keep) - keep
    return raw[keep], new[starts], np.searchsorted(sizes, starts, "right")


def _lossless_lines(scans: list, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one-line restart intervals, all decoded abreast: (lines, scan of each)."""
    data, starts, of = _intervals(scans)
    wide = data.astype(np.uint32)
    window = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    last = len(window) - 1
    steps = np.empty((len(starts), width), np.int16)
    for low in range(0, len(starts), 8192):
        bit = starts[low : low + 8192].astype(np.int64) * 8
        part = steps[low : low + 8192]
        for x in range(width):
            got = table[(window[np.minimum(bit >> 3, last)] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
            if not got.all():
                raise MediaError("a broken code in a lossless scan")
            part[:, x] = (got & 0xFFFF) - 32768
            bit += got >> 16
    steps[:, 0] += 128
    return np.cumsum(steps, axis=1, dtype=np.int16).astype(np.uint8), of


def _prefixes(lengths: dict[int, int]) -> np.ndarray:
    """By the next 16 bits: bits of the code << 8 | symbol, or 0 where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, n) in _codes(lengths).items():
        if n > 16 or code >> n:
            raise MediaError("a Huffman table with too many codes")
        table[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbol
    return table


@functools.lru_cache(64)
def _steps(lengths: tuple[tuple[int, int], ...]) -> tuple[list[int], list[int]]:
    """(by the next 16 bits: code and extra bits << 24 | symbol << 16 | value + 32768, or 0 where these need more; _prefixes)."""
    short = _prefixes(dict(lengths))
    n, symbol = short >> 8, short & 255
    size = symbol & 15
    total = n + size
    extra = (np.arange(1 << 16) >> np.maximum(16 - total, 0)) & (1 << size) - 1
    value = np.where(size == 0, 0, np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1))
    whole = np.where((n > 0) & (total <= 16), total.astype(np.int64) << 24 | symbol << 16 | value + 32768, 0)
    return whole.tolist(), short.tolist()


def _windows(piece: bytes) -> list[int]:
    """The 32 bits from each byte of a restart interval on; zeros follow its end."""
    b = np.frombuffer(piece + b"\0" * 12, np.uint8).astype(np.uint32)
    return (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]).tolist()


def _long(windows: list[int], at: int, short: list[int]) -> tuple[int, int, int]:
    """(bit after it, symbol, value) of a code whose extra bits reach beyond 16."""
    found = short[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]
    if not found:
        raise MediaError("a code that no table has")
    at += found >> 8
    symbol, size = found & 255, found & 15
    if not size:
        return at, symbol, 0
    extra = windows[at >> 3] >> 32 - size - (at & 7) & (1 << size) - 1
    return at + size, symbol, extra if extra >> size - 1 else extra - (1 << size) + 1


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _pieces(scan) -> list[bytes]:
    data, starts, _ = _intervals([scan])
    raw, ends = data.tobytes(), [*starts[1:].tolist(), len(data) - 8]
    return [raw[a:b] for a, b in zip(starts.tolist(), ends)]


def _baseline(j: _Jpeg) -> np.ndarray:
    """Luma (the first component) of a sequential DCT image, as uint8 lines; one line of units is held as blocks at a time."""
    h_max, v_max = max(c[1] for c in j.components), max(c[2] for c in j.components)
    if len(j.scan) == 1:  # not interleaved: a unit is one block
        h_max = v_max = 1
        parts = [(j.scan[0][0], 1, 1, j.scan[0][1])]
    else:
        parts = [(i, j.components[i][1], j.components[i][2], t) for i, t in j.scan]
    if all(i for i, *_ in parts):
        raise MediaError("a scan without luma")
    across, down = -(-j.width // (8 * h_max)), -(-j.height // (8 * v_max))
    tables = {k: _steps(tuple(t.items())) for k, t in j.tables.items()}
    h, v = next((h, v) for i, h, v, _ in parts if i == 0)
    if j.components[0][3] not in j.quant:
        raise MediaError("a frame without its quantisation table")
    quant = np.ones(64)
    quant[_ZIGZAG] = j.quant[j.components[0][3]]
    image = np.empty((down * v * 8, across * h * 8), np.uint8)
    places: list[int] = []
    values: list[int] = []
    zigzag = [*_ZIGZAG, *[64] * 256]

    def finish(line: int) -> None:
        blocks = np.zeros(v * across * h * 64)
        blocks[places] = values
        cells = (blocks.reshape(-1, 64) * quant).reshape(v, across * h, 8, 8)
        pixels = _COSINES @ cells @ _COSINES.T + 128
        lines = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3)
        image[line * v * 8 : (line + 1) * v * 8] = lines.reshape(v * 8, -1)
        places.clear()
        values.clear()

    # What each unit is made of: (component, block of it in the line of units, DC tables, AC tables).
    order = [(i, k // wide * across * h + k % wide, tables[t >> 4], tables[0x10 | t & 15]) for i, wide, high, t in parts for k in range(wide * high)]
    units, each = across * down, j.restart or across * down
    pieces = _pieces(j.data)
    for first, piece in zip(range(0, units, each), pieces):
        windows, at, end = _windows(piece), 0, len(piece) * 8
        last = [0] * len(j.components)
        for unit in range(first, min(first + each, units)):
            column = unit % across
            for i, block, (dc, dc_short), (ac, ac_short) in order:
                got = dc[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]
                if got:
                    at += got >> 24
                    last[i] += (got & 0xFFFF) - 32768
                else:
                    at, _, step = _long(windows, at, dc_short)
                    last[i] += step
                base = (block + column * h) * 64
                if i == 0:
                    places.append(base)
                    values.append(last[0])
                k = 1
                while k < 64:
                    got = ac[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]
                    if got:
                        at += got >> 24
                        symbol, value = got >> 16 & 255, (got & 0xFFFF) - 32768
                    else:
                        at, symbol, value = _long(windows, at, ac_short)
                    if not symbol:
                        break
                    k += symbol >> 4
                    if i == 0 and value and k < 64:
                        places.append(base + zigzag[k])
                        values.append(value)
                    k += 1
                if at > end + 16:
                    raise MediaError("a scan that ends early")
            if column == across - 1:
                finish(unit // across)
    if len(pieces) * each < units:
        raise MediaError("a scan that ends early")
    height, width = -(-j.height * v // v_max), -(-j.width * h // h_max)
    return image[:height, :width]


def _lossless(j: _Jpeg) -> np.ndarray:
    """One-component lossless image of any predictor and restart interval."""
    whole, short = _steps(tuple((s, n) for s, n in j.tables[j.scan[0][1] >> 4].items()))
    if not 1 <= j.predictor <= 7 or j.restart % j.width:
        raise MediaError("a lossless predictor or restart interval out of range")
    out = np.empty((j.height, j.width), np.uint16)
    rows = j.restart // j.width if j.restart else j.height
    pieces = _pieces(j.data)
    if len(pieces) * rows < j.height:
        raise MediaError("a scan that ends early")
    for top, piece in zip(range(0, j.height, rows), pieces):
        windows, at, end = _windows(piece), 0, len(piece) * 8
        above: list[int] = []
        for y in range(top, min(top + rows, j.height)):
            line: list[int] = []
            for x in range(j.width):
                if y == top:
                    guess = line[-1] if x else 1 << j.precision - 1
                elif not x:
                    guess = above[0]
                else:
                    left, up, corner = line[-1], above[x], above[x - 1]
                    guess = (left, up, corner, left + up - corner, left + (up - corner >> 1), up + (left - corner >> 1), left + up >> 1)[j.predictor - 1]
                found = short[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]
                if found & 255 == 16:  # the one difference without extra bits
                    at, step = at + (found >> 8), 32768
                elif got := whole[windows[at >> 3] >> 16 - (at & 7) & 0xFFFF]:
                    at, step = at + (got >> 24), (got & 0xFFFF) - 32768
                else:
                    at, _, step = _long(windows, at, short)
                line.append(guess + step & 0xFFFF)
            if at > end + 16:
                raise MediaError("a scan that ends early")
            out[y] = above = line
    return (out >> max(j.precision - 8, 0)).astype(np.uint8)


def decode_frames(frames: list) -> list[np.ndarray]:
    """Luma samples (uint8 lines) of JPEG frames. Lossless frames of one-line intervals are decoded together."""
    parsed = [parse_jpeg(f) for f in frames]
    out: list = [None] * len(frames)
    together: dict[tuple, list[int]] = {}
    for k, j in enumerate(parsed):
        if j.process != 0xC3:
            out[k] = _baseline(j)
            continue
        if j.precision > 16 or len(j.components) != 1:
            raise MediaError("a lossless frame of several components")
        lengths = j.tables[j.scan[0][1] >> 4]
        if j.precision == 8 and j.predictor == 1 and j.restart == j.width and all(s <= 8 and s + n <= 16 for s, n in lengths.items()):
            together.setdefault((j.width, tuple(lengths.items())), []).append(k)
        else:
            out[k] = _lossless(j)
    for (width, lengths), of in together.items():
        scans = [_scan_bytes(parsed[k].data) for k in of]
        lines, owner = _lossless_lines(scans, width, _lookup(dict(lengths)))
        bounds = np.searchsorted(owner, np.arange(len(of) + 1)).tolist()
        for n, k in enumerate(of):
            out[k] = lines[bounds[n] : bounds[n + 1]]
            if len(out[k]) != parsed[k].height:
                raise MediaError("a frame whose lines don't match its header")
    return out


def _scan_bytes(data: memoryview) -> memoryview:
    """A scan without the end marker."""
    return data[:-2] if data[-2:] == b"\xff\xd9" else data


# shots:


def histograms(frames: list[np.ndarray]) -> np.ndarray:
    """[frame, bin]: shares of samples in BINS equal ranges."""
    out = np.zeros((len(frames), BINS))
    for k, f in enumerate(frames):
        out[k] = np.bincount(f.ravel() >> 4, minlength=BINS) / max(f.size, 1)
    return out


def shots(hists: np.ndarray, memory: int = 8, factor: float = 3.0, least: float = 0.3) -> list[int]:
    """First frames of shots. A cut is where half the L1 difference of two histograms is at least ``least``
    and exceeds the mean of up to ``memory`` differences since the last cut by ``factor`` of their deviations."""
    cuts, since = ([0] if len(hists) else []), []
    for k in range(1, len(hists)):
        d = float(np.abs(hists[k] - hists[k - 1]).sum() / 2)
        recent = since[-memory:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d >= least and d > mean + factor * spread:
            cuts.append(k)
            since = []
        else:
            since.append(d)
    return cuts


def _clips(data: bytes) -> list[tuple[int, int, int, float, float]]:
    video = parse_avi(data)
    cuts = shots(histograms(decode_frames(video.frames)))
    ends = [*cuts[1:], len(video.frames)]
    return [(n, a, b, a * video.seconds_per_frame, b * video.seconds_per_frame) for n, (a, b) in enumerate(zip(cuts, ends))]


def _clip_batches(batches):
    for batch in batches:
        rows, of = [], []
        for k, data in enumerate(batch.column(1).to_pylist()):
            try:
                found = [(*c, None) for c in _clips(data or b"")]
            except (ValueError, IndexError, KeyError, ArithmeticError, MemoryError, struct.error) as e:
                found = [(None, None, None, None, None, f"{type(e).__name__}: {e}")]
            rows += found
            of += [k] * len(found)
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
        names = ["clip", "first_frame", "end_frame", "start_s", "end_s", "error"]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["id", *names])


def clips(media: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """(id, clip, first_frame, end_frame, start_s, end_s, error): one row per shot of each AVI file.

    A file without frames has no rows. A null, empty or damaged file, and one
    with a frame of over MAX_SAMPLES samples, has one row with nulls and what
    was wrong with it; other files are not touched by that. Ids may be null or repeated; an
    empty table gives an empty result; only the two named columns are read.
    """
    kind = media.schema[id_col].dataType.simpleString()
    rest = "clip int, first_frame long, end_frame long, start_s double, end_s double, error string"
    return media.select(F.col(id_col).alias("id"), F.col(content_col).alias("content")).mapInArrow(_clip_batches, f"id {kind}, {rest}")


def _round_trip(texts: list[bytes]) -> list[tuple]:
    """Stores payloads as AVI files, reads them back from their bytes, and sums up both."""
    files = store([payload(t) for t in texts])
    videos = [parse_avi(f) for f in files]
    images = decode_frames([f for v in videos for f in v.frames])
    out, at = [], 0
    for text, data, video in zip(texts, files, videos):
        own = images[at : at + len(video.frames)]
        at += len(own)
        back = own[0].tobytes() if len(own) == 1 else b"".join([f.tobytes() for f in own])
        hists = histograms(own)
        cuts = shots(hists)
        mean = np.average(hists, axis=0, weights=[f.size for f in own])
        feature = f"frames={len(own)};shots={len(cuts)};cuts={','.join(map(str, cuts))};histogram={','.join('%.4f' % x for x in mean)}"
        out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-LINE:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    return out


_TRIP = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _trip_batches(batches):
    for batch in batches:
        rows, some, size = [], [], 0
        for text in batch.column(1).to_pylist():
            some.append(text or b"")
            size += len(some[-1])
            if size > 1 << 19:
                rows += _round_trip(some)
                some, size = [], 0
        if some:
            rows += _round_trip(some)
        columns = list(zip(*rows)) if rows else [()] * len(_TRIP)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _TRIP))], names=["id", *(n for n, _ in _TRIP)])


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text stored as a lossless motion-JPEG AVI file and read back, summed up in a row.

    A null text counts as empty and is stored as 64 bytes 0; ids may be null or
    repeated; repeated rows keep their rows; an empty table gives an empty
    result; only the two named columns are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rest = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_trip_batches, f"id {kind}, {rest}")


def _store_batches(batches):
    for batch in batches:
        files = [store([payload(t or b"")])[0] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["id", "content"])


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content): each text's AVI file."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_store_batches, f"id {kind}, content binary")
