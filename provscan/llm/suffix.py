"""Repeated byte strings across a corpus by distributed prefix doubling.

A position's rank names the bytes around it: equal ranks, equal bytes. Spark
gives the ranks. In every round each position has a pair (its rank so far, what
the next longer string adds); pairs are counted, those that occur once leave,
and the others are sorted and numbered: the number is the new rank, which goes
back to its positions by a join and is one half of the next round's pair.

1.  64 bytes. Pairs of (nothing, the 64 bytes).
2.  169 bytes. Pairs of (the rank of the 64-byte string that leads them, the 169
    bytes). Equal pairs with equal bytes on either side, too, settle all windows
    around them; the others go on, one position for all that look alike.
3.  200 bytes, past the threshold. Pairs of (the rank of the 169 bytes inside a
    window, the 31 bytes that the window adds), for every single window still
    open. What is not unique now occurs twice.

Not every position takes part in rounds 1 and 2, but a sample that depends on
the bytes alone, so that equal strings are sampled alike: it is a filter, and
the outcome is that of ranking every position. Strings enter pairs as 64-bit
hashes (see README on what a collision takes).

Pairs that many positions share are merged before they are shuffled: a row per
pair and map batch. They are counted in the map tasks first, and the joins that
bring ranks back have many rows on one side only, so that adaptive execution can
split a pair that a third of all documents share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provscan.llm.bpe import forget
from provscan.llm.scratch import Scratch

WINDOW = 200  #: bytes of a string that must not occur twice
COARSE = 64  #: bytes ranked in round 1
FINE = 32  #: bytes compared, and positions among which one is taken, by the sample of round 2
SPAN = 128
#: Bytes before and after a position of round 2: those in all windows that it stands for, and those in any.
INNER_LEFT, INNER_RIGHT = 31, 138
LEFT, RIGHT = 63, 169
AMONG = INNER_LEFT + INNER_RIGHT - COARSE + 1  #: positions of 64-byte strings within the inner bytes
BLOCK = 1 << 19  #: bytes handled at once in a Python worker
HALO = 512
_OCCURRENCE = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("at", "<i4")])
#: A pair (g, h1) and its surroundings h2, how often it occurs in a map batch, the first place and its number, and the other places.
_ROWS = "g long, h1 long, h2 long, n long, k1 long, k2 int, at int, place long, seen binary"
_KEYS = ["g", "h1", "h2"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _double(text: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Ranks of every position for the given lengths (ascending powers of two); short at the end."""
    table = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ranks, size, factor, found = table[text], 1, 0x9E3779B97F4A7C15, []
    while True:
        if size in lengths:
            found.append(ranks)
        if size >= lengths[-1]:
            return found
        ranks = ranks[:-size] * np.uint64(factor) + ranks[size:] if len(ranks) > size else ranks[:0]
        size, factor = 2 * size, factor * factor & (1 << 64) - 1


def _extreme(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of ``width`` values."""
    k = 1
    while 2 * k <= width:
        x, k = op(x[:-k], x[k:]), 2 * k
    rest = width - k
    return op(x[: len(x) - rest], x[rest:]) if rest else x


def _sampled(ranks: np.ndarray, width: int, fits: np.ndarray) -> np.ndarray:
    """Which positions are least in some run of ``width`` that starts where ``fits`` holds."""
    if len(ranks) < width:
        return np.zeros(len(ranks), bool)
    least = _extreme(ranks, width, np.minimum)
    least = np.where(fits[: len(least)], least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    return (_extreme(np.concatenate([pad, least, pad]), width, np.maximum) == ranks) & (ranks != 0)


class _Block:
    """Texts laid end to end; ``end`` is each byte's end of segment, ``own`` the bytes this block answers for."""

    def __init__(self, parts: list[tuple[int, bytes, int, int, int]]):
        self.parts = parts
        sizes = np.array([len(p[1]) for p in parts])
        stops = np.cumsum(sizes)
        self.starts = stops - sizes
        self.text = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
        self.part = np.repeat(np.arange(len(parts)), sizes)
        self.left = stops[self.part] - np.arange(len(self.text))  # bytes to the end of the segment, this one included
        self.doc = np.array([p[0] for p in parts])
        self.base = np.array([p[2] for p in parts])
        self.low, self.high = np.array([p[3] for p in parts]), np.array([p[4] for p in parts])

    def where(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, offset in it) of positions of the block."""
        part = self.part[index]
        return self.doc[part], index - self.starts[part] + self.base[part]

    def owned(self, index: np.ndarray) -> np.ndarray:
        _, at = self.where(index)
        part = self.part[index]
        return index[(at >= self.low[part]) & (at < self.high[part])]


def _blocks(texts: list[bytes]):
    """Whole texts in blocks of about BLOCK bytes; longer ones in overlapping segments."""
    parts, size = [], 0
    for k, text in enumerate(texts):
        if len(text) < WINDOW:
            continue
        for at in range(0, len(text), BLOCK):
            low = max(0, at - HALO)
            piece = text[low : at + BLOCK + HALO] if len(text) > BLOCK else text
            parts.append((k, piece, low, at, min(at + BLOCK, len(text))))
            size += len(piece)
            if size >= BLOCK:
                yield _Block(parts)
                parts, size = [], 0
    if parts:
        yield _Block(parts)


def _collect(found: list[tuple], k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    """_ROWS of (g, h1, h2, document, offset) arrays of one batch: one row per different (g, h1, h2)."""
    if not found:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    g, h1, h2, doc, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, doc, h2, h1, g))
    g, h1, h2, doc, at = (x[order] for x in (g, h1, h2, doc, at))
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(g)))
    rest = np.flatnonzero(~new)
    seen = np.empty(len(rest), _OCCURRENCE)
    seen["k1"], seen["k2"], seen["at"] = k1[doc[rest]], k2[doc[rest]], at[rest]
    offsets = np.concatenate([[0], np.cumsum(counts - 1)]).astype(np.int32) * _OCCURRENCE.itemsize
    binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(seen.tobytes())])
    k1, k2, at = k1[doc[first]], k2[doc[first]].astype(np.int32), at[first].astype(np.int32)
    place = _mix(k1.view(np.uint64) + _mix((k2.astype(np.int64) << 32 | at).view(np.uint64))).view(np.int64)
    arrays = [g[first], h1[first].view(np.int64), h2[first].view(np.int64), counts, k1, k2, at, place]
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), binary], names=[*_KEYS, "n", "k1", "k2", "at", "place", "seen"])


def _keys(batch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()


def _fits(block: _Block, n: int, size: int) -> np.ndarray:
    return block.left[:n] >= size


def _coarse(block: _Block, ranks: np.ndarray) -> np.ndarray:
    return np.where(_fits(block, len(ranks), COARSE), _mix(ranks), ~np.uint64(0))


def _first_batches(batches):
    """Round 1: positions least among AMONG neighbours. Copies of a text in one batch give theirs once."""
    forget()
    for batch in batches:
        k1, k2, texts = _keys(batch)
        once = np.unique(np.stack([k1, k2], axis=1), axis=0, return_index=True)[1]
        k1, k2, texts = k1[once], k2[once], [texts[i] for i in once]
        found = []
        for block in _blocks(texts):
            ranks = _coarse(block, _double(block.text, (COARSE,))[0])
            chosen = _sampled(ranks, AMONG, _fits(block, len(ranks), INNER_LEFT + INNER_RIGHT))
            index = block.owned(np.flatnonzero(chosen))
            none = np.zeros(len(index), np.uint64)
            found.append((none.view(np.int64), ranks[index], none, *block.where(index)))
        yield _collect(found, k1, k2)


def _fine(block: _Block, ranks: np.ndarray) -> np.ndarray:
    """Next finely sampled position at or after each position (len(text) if none)."""
    ranks = np.where(_fits(block, len(ranks), FINE), _mix(ranks), ~np.uint64(0))
    chosen = np.flatnonzero(_sampled(ranks, FINE, _fits(block, len(ranks), 2 * FINE - 1)))
    n = len(block.text)
    return np.append(chosen, n)[np.searchsorted(chosen, np.arange(n + FINE))]


def _told(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, ranks) of each row of an array of structs."""
    flat = column.values
    values, ranks = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
    bounds = column.offsets.to_numpy().tolist()
    return [(values[a:b], ranks[a:b]) for a, b in zip(bounds, bounds[1:])]


def _laid(block: _Block, told: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (low two bits of each value, offset above them) and ranks laid out over the block; 0 where there is none."""
    codes, ranks = np.zeros(size, np.uint8), np.zeros(size, np.int64)
    for part, (k, piece, base, _, _) in enumerate(block.parts):
        values, named = told[k]
        if len(values):
            at = (values >> 2) - base
            inside = (at >= 0) & (at < len(piece))
            where = at[inside] + block.starts[part]
            codes[where], ranks[where] = values[inside] & 3, named[inside]
    return codes, ranks


def _stands(block: _Block, r32: np.ndarray) -> np.ndarray:
    """For each position where a window may start, the fine position that stands for it: 31 to 62 bytes on."""
    return _fine(block, r32)[INNER_LEFT : INNER_LEFT + max(len(block.text) - WINDOW + 1, 0)]


def _second_batches(batches):
    """Round 2: fine positions whose leading 64 bytes have a rank, with all bytes around as their surroundings."""
    forget()
    for batch in batches:
        k1, k2, texts = _keys(batch)
        told = _told(batch.column(3))
        found = []
        for block in _blocks(texts):
            r32, r64, r128 = _double(block.text, (FINE, COARSE, SPAN))
            coarse = _coarse(block, r64)
            _, ranks = _laid(block, told, len(block.text))
            known = np.flatnonzero((ranks[: len(coarse)] > 0) & _fits(block, len(coarse), COARSE))
            hashes, first = np.unique(coarse[known], return_index=True)  # equal strings have one rank
            if not len(hashes):
                continue
            stands = _stands(block, r32)
            fine = block.owned(np.unique(stands[_fits(block, len(stands), WINDOW)]))
            least = _extreme(coarse, AMONG, np.minimum)[fine - INNER_LEFT]
            at = np.minimum(np.searchsorted(hashes, least), len(hashes) - 1)
            fine, at = fine[hashes[at] == least], at[hashes[at] == least]
            inner = _mix(_mix(r128[fine - INNER_LEFT]) + r64[fine + INNER_RIGHT - COARSE] * np.uint64(0xA24BAED4963EE407))
            found.append((ranks[known[first[at]]], inner, _around(block, r64, fine), *block.where(fine)))
        yield _collect(found, k1, k2)


def _around(block: _Block, r64: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Rank of the bytes from LEFT before to RIGHT after, or up to the segment's ends."""
    part = block.part[index]
    low = np.maximum(index - LEFT, block.starts[part])
    high = np.minimum(index + RIGHT, index + block.left[index])
    a = _mix(r64[low] * np.uint64(0xA24BAED4963EE407) + (index - low).astype(np.uint64))
    return _mix(a * np.uint64(0x9FB21C651E98DF25) + _mix(r64[high - COARSE] + np.uint64(0x632BE59BD9B4E019) * (high - index).astype(np.uint64)))


def _third_batches(batches):
    """Round 3: every window left open, as the rank of its fine position's inner bytes and the bytes it adds to them."""
    forget()
    for batch in batches:
        k1, k2, texts = _keys(batch)
        told = _told(batch.column(3))
        found = []
        for block in _blocks(texts):
            (r32,) = _double(block.text, (FINE,))
            codes, ranks = _laid(block, told, len(block.text) + 1)
            stands = _stands(block, r32)
            index = block.owned(np.flatnonzero((codes[stands] & 2 > 0) & _fits(block, len(stands), WINDOW)))
            fine = stands[index]
            added = _mix(r32[index + WINDOW - FINE] * np.uint64(0x9FB21C651E98DF25) + (fine - index).astype(np.uint64))
            added = _mix(r32[index] * np.uint64(0xA24BAED4963EE407) + added)
            found.append((ranks[fine], added, np.zeros(len(index), np.uint64), *block.where(index)))
        yield _collect(found, k1, k2)


def _placed_batches(batches):
    """(k1, k2, value, rank) of every place of joined rows: bit 0 of the code says that pair and surroundings
    occur elsewhere; bit 1 that the place answers for windows left open, where the pair has other surroundings too."""
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        seen = batch.column(batch.schema.get_field_index("seen")).to_pylist()
        counts = np.array([len(x) for x in seen], np.int64) // _OCCURRENCE.itemsize
        rest = np.frombuffer(b"".join(seen), _OCCURRENCE)
        again = column("again").astype(np.int64)
        code = np.concatenate([again | column("open").astype(np.int64) << 1, np.repeat(again, counts)])
        k1, k2, at = (np.concatenate([column(name), rest[name]]) for name in ("k1", "k2", "at"))
        rank = np.concatenate([column("rank"), np.repeat(column("rank"), counts)])
        keep = code > 0
        arrays = [k1[keep], k2[keep], (at.astype(np.int64) << 2 | code)[keep], rank[keep]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["k1", "k2", "value", "rank"])


def _ranked(rows: DataFrame, name: str, scratch: Scratch, surroundings: bool = False) -> DataFrame:
    """(k1, k2, told array<struct<value,rank>>): the new ranks of pairs that are not unique, by text.

    A text's copies give each of their places once. With ``surroundings``, pairs
    are told apart by h2, too (see _placed_batches).
    """
    pair = ["g", "h1"]
    rows = scratch.write(rows if surroundings else rows.drop("h2", "place"), f"{name}-pairs", dictionaries=False)
    if surroundings:
        alike = scratch.write(rows.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("place").alias("one")), f"{name}-alike", dictionaries=False)
        counted = alike.groupBy(*pair).agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
    else:
        counted = rows.groupBy(*pair).agg(F.sum("n").alias("all"))
    repeated = counted.where(F.col("all") > 1).drop("all").sortWithinPartitions(*pair)
    ranks = scratch.write(repeated.withColumn("rank", F.monotonically_increasing_id() + 1), f"{name}-ranks")
    # Both sides are hashed by pair: the side that a task holds has each pair once.
    if surroundings:
        known = alike.join(ranks.hint("shuffle_hash"), pair).select(*_KEYS, "rank", "one", (F.col("n") > 1).alias("again"), (F.col("kinds") > 1).alias("several"))
        back = rows.join(known.hint("shuffle_hash"), _KEYS).withColumn("open", F.col("several") & (F.col("place") == F.col("one")))
    else:
        back = rows.join(ranks.hint("shuffle_hash"), pair).withColumns({"again": F.lit(True), "open": F.lit(False)})
    places = back.select("k1", "k2", "at", "seen", "rank", "again", "open").mapInArrow(_placed_batches, "k1 long, k2 int, value long, rank long")
    found = scratch.write(places.groupBy("k1", "k2").agg(F.collect_set(F.struct("value", "rank")).alias("told")), name)
    scratch.drop(f"{name}-pairs", f"{name}-alike", f"{name}-ranks")
    return found


def _cover(n: int, proven: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """[[start, end)] of the bytes covered, as maximal runs."""
    low, high = np.maximum(proven - LEFT, 0), np.minimum(proven + RIGHT, n)
    wide = high - low >= WINDOW
    low, high = np.concatenate([low[wide], windows]), np.concatenate([high[wide], windows + WINDOW])
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    covered = np.concatenate([[0], np.cumsum(step)[:-1] > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered))
    return edges.reshape(-1, 2)


def _cut_batches(batches):
    for batch in batches:
        k1, k2, texts = _keys(batch)
        seconds, thirds = _told(batch.column(3)), _told(batch.column(4))
        rows = []
        for text, (second, _), (third, _) in zip(texts, seconds, thirds):
            spans = _cover(len(text), second[second & 1 > 0] >> 2, third >> 2)
            bounds = [0, *spans.ravel().tolist(), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            rows.append((len(text) - len(kept), spans.ravel(), kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest()))
        removed, spans, kept, digests = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1), pa.array(k2), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.string()), pa.array(digests, pa.string())],
            names=["k1", "k2", "n_removed", "spans", "kept_text", "kept_sha256"],
        )


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with __k1, __k2: a 96-bit key of the whole text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = (F.crc32(text) - F.lit(1 << 31)).cast("int")
    return docs.withColumns({"__k1": F.xxhash64(text), "__k2": low})


def repeated_spans(docs: DataFrame, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(k1, k2, n_removed, spans, kept_text, kept_sha256) of each text that shares bytes with another text or itself.

    spans: byte offsets start, end, start, end, ... of the runs removed.
    Copies of a whole text count once here: ``deduplicated`` finds them by their key.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    keyed = _keyed(docs.select(text_col), text_col)
    texts = keyed.select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.where(F.length("text") >= WINDOW)
    first = _ranked(texts.mapInArrow(_first_batches, _ROWS), "first", scratch)
    # One row per text before the join: copies merge in the map tasks, then by key.
    once = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    left = scratch.write(once.join(first, ["k1", "k2"]), "left")
    scratch.drop("first")
    second = _ranked(left.mapInArrow(_second_batches, _ROWS), "second", scratch, surroundings=True)
    open_ = left.select("k1", "k2", "text").join(second, ["k1", "k2"])
    third = _ranked(open_.mapInArrow(_third_batches, _ROWS), "third", scratch)
    none = F.array().cast("array<struct<value:bigint,rank:bigint>>")
    settled = open_.join(third.withColumnRenamed("told", "more"), ["k1", "k2"], "left").withColumn("more", F.coalesce("more", none))
    schema = "k1 long, k2 int, n_removed long, spans array<long>, kept_text string, kept_sha256 string"
    return settled.mapInArrow(_cut_batches, schema).where("n_removed > 0")


def deduplicated(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, spans, kept_text and kept_sha256 in columns named __...

    Every byte goes that lies in a 200-byte string which starts anywhere else
    too; texts that occur on several rows go whole when they have 200 bytes. A
    null text counts as empty, an empty or short text loses nothing, ids are
    not looked at (null or repeated ids do no harm), an empty table gives an
    empty result and other columns pass through. kept_sha256 is of the bytes
    left; kept_text is those bytes without characters that a cut left in part,
    and null where the text stays as it is.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    cut = scratch.write(repeated_spans(docs, text_col, scratch), "cut")
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    keyed = _keyed(docs, text_col).withColumns({"__n_bytes": size, "__whole": F.sha2(text, 256)})
    copied = _keyed(docs.select(text_col), text_col).where(size >= WINDOW).groupBy("__k1", "__k2").agg(F.count("*").alias("__copies")).where("__copies > 1")
    cut = cut.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "kept_text": "__cut", "n_removed": "__cut_bytes", "spans": "__cut_spans", "kept_sha256": "__cut_sha"})
    outcome = cut.join(copied, ["__k1", "__k2"], "full")
    joined = keyed.join(outcome, ["__k1", "__k2"], "left")
    gone = F.col("__copies").isNotNull()
    spans = F.when(gone, F.array(F.lit(0).cast("long"), F.col("__n_bytes"))).otherwise(F.coalesce("__cut_spans", F.array().cast("array<long>")))
    return joined.withColumns(
        {
            "__n_removed": F.when(gone, F.col("__n_bytes")).otherwise(F.coalesce("__cut_bytes", F.lit(0))),
            "__spans": spans,
            "__n_spans": (F.size(spans) / 2).cast("long"),
            "__kept_text": F.when(gone, F.lit("")).otherwise(F.col("__cut")),
            "__kept_sha256": F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("__cut_sha", "__whole")),
        }
    ).drop("__k1", "__k2", "__whole", "__copies", "__cut", "__cut_bytes", "__cut_spans", "__cut_sha")
