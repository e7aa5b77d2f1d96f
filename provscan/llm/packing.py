"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so the packing is planned on the
table of lengths and their counts, which has at most one row per length however
many documents there are. The reduction takes the longest length left and looks
for a set of at most three pieces that provably dominates every other set that
holds it; such sets are fixed for as many sequences as their counts allow, and
the instance shrinks. What no rule settles is packed best-fit, longest first.
The plan is a bounded list of patterns; pieces find their place by their rank
among pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provscan.llm.bpe import library_encoder
from provscan.llm.scratch import Scratch

CAPACITY = 2048


class _Sizes:
    """Lengths left, with counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        left = self.count[size] - n
        if left:
            self.count[size] = left
        else:
            del self.count[size]
            del self.order[bisect.bisect_left(self.order, size)]

    def smallest(self, k: int) -> list[int]:
        """The k smallest pieces (fewer if fewer are left)."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.count[s], k - len(out))
            if len(out) == k:
                break
        return out

    def at_most(self, room: int) -> int | None:
        at = bisect.bisect_right(self.order, room)
        return self.order[at - 1] if at else None


def _dominant(sizes: _Sizes, top: int, room: int) -> list[int] | None:
    """What to put beside one piece of length ``top``, if a set provably dominates all others; else None.

    ``sizes`` no longer holds that piece. A set dominates another if the
    other's pieces can be grouped so that each group is no longer than a piece
    of its own in the set: exchanging them then never costs a sequence.
    """
    small = sizes.smallest(3)
    if not small or small[0] > room:
        return []  # nothing fits beside it
    best = sizes.at_most(room)
    if best == room or len(small) < 2 or small[0] + small[1] > room:
        return [best]  # fills the rest, or no two pieces fit: the longest that does dominates
    if len(small) > 2 and sum(small) <= room:
        return None
    # At most two more fit. The pair of the longest piece and the longest beside it dominates if no pair has a longer second piece, unless the first covers that pair alone.
    sizes.take(best, 1)
    second = sizes.at_most(room - best)
    sizes.count[best] = sizes.count.get(best, 0) + 1
    if sizes.count[best] == 1:
        bisect.insort(sizes.order, best)
    if second is None:
        second = 0
    for d in reversed(sizes.order[: bisect.bisect_right(sizes.order, room // 2)]):
        if d <= second:
            break
        c = sizes.at_most(room - d)
        if c == d and sizes.count[d] < 2:
            continue
        if c >= d and c + d > best:
            return None
    return [best, second] if second else [best]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], int]:
    """([(lengths of a sequence, how many such sequences)], sequences fixed by dominance)."""
    sizes = _Sizes(counts)
    patterns: list[tuple[list[int], int]] = []
    left: dict[int, int] = {}
    fixed = 0
    moved = True
    while moved:
        moved = False
        for top in list(reversed(sizes.order)):
            while sizes.count.get(top):
                sizes.take(top, 1)
                found = _dominant(sizes, top, capacity - top)
                if top not in sizes.count:
                    bisect.insort(sizes.order, top)
                sizes.count[top] = sizes.count.get(top, 0) + 1
                if found is None:
                    break
                pattern = [top, *found]
                need = {s: pattern.count(s) for s in pattern}
                n = min(sizes.count[s] // k for s, k in need.items())
                # Taking pieces away only takes alternatives away, so the set dominates for as long as it can be formed.
                for s, k in need.items():
                    sizes.take(s, k * n)
                patterns.append((pattern, n))
                fixed += n
                moved = True
    left = dict(sizes.count)
    return _joined(patterns) + _best_fit(left, capacity), fixed


def _joined(patterns):
    total: dict[tuple[int, ...], int] = {}
    for pattern, n in patterns:
        total[tuple(pattern)] = total.get(tuple(pattern), 0) + n
    return [(list(p), n) for p, n in total.items()]


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing, many equal pieces and sequences at a time."""
    open_: dict[int, list[tuple[list[int], int]]] = {}  # by room left
    rooms: list[int] = []

    def add(room: int, pattern: list[int], n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    del rooms[at]
            else:
                room, pattern, m = capacity, [], -(-n // (capacity // size))
            each = room // size
            whole = min(m, n // each)
            add(room - each * size, pattern + [size] * each, whole)
            n -= whole * each
            m -= whole
            if m and n:
                add(room - n * size, pattern + [size] * n, 1)
                m -= 1
                n = 0
            if pattern:
                add(room, pattern, m)
    return [x for room in rooms for x in open_[room]]


class Places:
    """Where the r-th piece of a length goes: arrays per length, at most one entry per pattern."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        rank: dict[int, int] = {}
        base = 0
        for pattern, n in patterns:
            offset = 0
            for size in dict.fromkeys(pattern):
                each = pattern.count(size)
                entries.setdefault(size, []).append((rank.get(size, 0), each, base, offset))
                rank[size] = rank.get(size, 0) + each * n
                offset += each * size
            base += n
        self.by_size = {s: tuple(np.array(x, np.int64) for x in zip(*rows)) for s, rows in entries.items()}

    def find(self, size: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces of this length by rank from 0."""
        first, each, base, offset = self.by_size[size]
        at = np.searchsorted(first, ranks, "right") - 1
        inside = ranks - first[at]
        return base[at] + inside // each[at], offset[at] + inside % each[at] * size


def _place_batches(places: Places):
    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                of = np.flatnonzero(length == size)
                sequence[of], offset[of] = places.find(int(size), rank[of])
            kept = [i for i, name in enumerate(batch.schema.names) if name != "__rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)],
                names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a column ``length`` long from 1 to capacity, no column sequence_id or offset) with those two.

    ``order`` names columns that tell pieces apart; repeated rows get places of
    their own all the same. Ranks are counted in groups of length and salt, so
    a length that a third of all pieces have is spread over tasks. Read twice:
    pass a written table. Empty in, empty out.
    """
    spark = pieces.sparkSession
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    patterns, _ = plan(counted, capacity)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    groups = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order))
    ranked = salted.withColumn("__in", inside).join(starts, ["length", "__salt"])
    ranked = ranked.select(*pieces.columns, (F.col("__start") + F.col("__in") - 1).alias("__rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(_place_batches(Places(patterns)), f"{schema}, sequence_id long, offset long")


def _piece_batches(path: str, capacity: int, separator: int, keep_ids: bool):
    mark = np.array([separator], "<u4").tobytes()

    def run(batches):
        enc = library_encoder(path)
        for batch in batches:
            rows, of = [], []
            for k, ids in enumerate(enc.encode_many([t or "" for t in batch.column(1).to_pylist()])):
                ids += mark
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((piece, start, len(part) // 4, zlib.crc32(part), *((part,) if keep_ids else ())))
                    of.append(k)
            columns = list(zip(*rows)) if rows else [()] * (4 + keep_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = ["piece", "start", "length", "ids_crc32", "ids_le32"][: len(arrays)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *arrays], names=["id", *names])

    return run


def packed_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids_le32 binary if asked for).

    A document is its ids and the separator; only documents longer than a
    sequence are cut. A null or empty text is the separator alone; null or
    repeated ids and repeated rows are packed like any others; an empty table
    gives an empty result; only the two named columns are read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids_le32 binary" * keep_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = scratch.write(rows.mapInArrow(_piece_batches(path, capacity, separator, keep_ids), schema), "pieces")
    return pack(pieces, ["id", "piece", "ids_crc32"], capacity)
