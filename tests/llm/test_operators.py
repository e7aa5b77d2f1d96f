"""The training-data operators against brute force, and on odd rows: nulls, empties, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provscan.llm import avi, bpe, hnsw, packing, preferences, sharding, simhash, suffix, toxicity, urls
from provscan.llm.components import connected_components
from provscan.llm.scratch import Scratch
from provscan.llm.registry import word_vocabulary

#: Ids and texts that no operator may trip over; other columns clash with names used inside.
ODD = [(1, "One two three four. " * 30), (2, "One two three four. " * 30), (3, None), (4, ""), (5, "  \t\n"), (6, "word"), (None, "nobody"), (7, "twice"), (7, "twice"), (8, "été 日本語 \U0001f600 " * 40), (9, "x" * 5000), (10, "long text " * 30_000)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    clash = {n: F.lit("clash") for n in ("id", "fp", "component", "k1", "values", "length", "at", "label", "sequence_id", "score", "n", "shard", "slot")}
    return df.withColumns(clash).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# 1:


def test_media_round_trip(odd):
    rows = avi.round_trips(odd).collect()
    assert len(rows) == len(ODD)
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r["id"] is None, r["id"], r["n_bytes"])), sorted(ODD, key=lambda x: (x[0] is None, x[0]))):
        data = avi.payload((t or "").encode())
        assert r["payload_bytes"] == len(data) >= 64 and len(data) % 64 == 0
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])
    assert avi.round_trips(odd.where("false")).count() == 0


def test_stored_file_is_lossless_jpeg_of_any_bytes():
    rng = random.Random(4)
    for data in (bytes(range(256)), b"\xff" * 640, rng.randbytes(64 * 200), b"\0\xff" * 96):
        video = avi.parse_avi(avi.store([data])[0])
        assert b"".join(f.tobytes() for f in avi.decode_frames(video.frames)) == data
        one = avi.parse_jpeg(video.frames[0])
        assert avi._lossless(one).tobytes() == data[: one.height * 64]


def baseline_jpeg(image: np.ndarray, restart: int = 0, own_tables: bool = True) -> bytes:
    """A grey baseline JPEG with quantisation 1, written as the standard says."""
    dc = avi._codes(avi._STANDARD[0x00])
    ac = avi._codes(avi._STANDARD[0x10])
    h, w = image.shape
    padded = np.pad(image, ((0, -h % 8), (0, -w % 8)), "edge").astype(float) - 128
    out, bits = bytearray(), ""
    last = unit = 0

    def magnitude(v):
        n = abs(v).bit_length()
        return n, (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            b = int(bits[k : k + 8], 2)
            out.extend((b, 0) if b == 255 else (b,))

    code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
    for y in range(0, padded.shape[0], 8):
        for x in range(0, padded.shape[1], 8):
            if restart and unit and unit % restart == 0:
                flush(bits)
                out.extend((0xFF, 0xD0 + (unit // restart - 1) % 8))
                bits, last = "", 0
            q = np.rint(avi._COSINES.T @ padded[y : y + 8, x : x + 8] @ avi._COSINES).astype(int).ravel()
            n, extra = magnitude(int(q[0]) - last)
            last = int(q[0])
            bits += code(dc, n) + extra
            run = 0
            zig = [int(q[i]) for i in avi._ZIGZAG[1:]]
            while zig and zig[-1] == 0:
                zig.pop()
            for v in zig:
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    bits += code(ac, 0xF0)
                    run -= 16
                n, extra = magnitude(v)
                bits += code(ac, run << 4 | n) + extra
                run = 0
            if len(zig) < 63:
                bits += code(ac, 0)
            unit += 1
    flush(bits)
    seg = lambda m, b: bytes((0xFF, m)) + struct.pack(">H", len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xDB, b"\0" + b"\1" * 64) + seg(0xC0, struct.pack(">BHHBBBB", 8, h, w, 1, 1, 0x11, 0))
    if own_tables:
        for k, t in ((0x00, avi._STANDARD[0]), (0x10, avi._STANDARD[0x10])):
            head += seg(0xC4, bytes([k, *(sum(v == n for v in t.values()) for n in range(1, 17))]) + bytes(t))
    if restart:
        head += seg(0xDD, struct.pack(">H", restart))
    return head + seg(0xDA, b"\1\1\0\0\x3f\0") + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart, own", [(0, True), (3, True), (0, False)])
def test_baseline_frames(restart, own):
    y, x = np.mgrid[0:37, 0:53]
    image = (128 + 60 * np.sin(x / 6.0) + 50 * np.cos(y / 5.0)).astype(np.uint8)
    got = avi.decode_frames([baseline_jpeg(image, restart, own)])[0]
    assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 2


def test_shots_of_a_video(spark):
    rng = np.random.default_rng(1)
    scenes = [40, 200, 110]
    frames = [np.clip(rng.normal(v, 6, (64, 64)), 0, 255).astype(np.uint8) for v in scenes for _ in range(6)]
    data = avi.write_avi([baseline_jpeg(f) for f in frames], 64, 64, 10)
    no_index = data[: data.rindex(b"idx1")]
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(no_index)), (3, bytearray(data[:300])), (4, None), (5, bytearray(b"RIFF\0\0\0\0AVI junk"))], "id int, content binary")
    rows = avi.clips(df).orderBy("id", "clip").collect()
    for i in (1, 2):
        assert [(r["first_frame"], r["end_frame"], round(r["start_s"], 3)) for r in rows if r["id"] == i] == [(0, 6, 0.0), (6, 12, 0.6), (12, 18, 1.2)]
    assert all(r["error"] for r in rows if r["id"] in (3, 4, 5)) and avi.clips(df.where("false")).count() == 0


def test_large_frame_of_noise_is_fast_and_right():
    rng = np.random.default_rng(3)
    image = np.clip(rng.normal(128, 40, (320, 320)), 0, 255).astype(np.uint8)
    frame = baseline_jpeg(image)
    assert len(frame) > 80_000
    began = time.perf_counter()
    got = avi.decode_frames([frame])[0]
    assert time.perf_counter() - began < 2  # 0.2 s on an idle core; quadratic before
    assert np.abs(got.astype(int) - image).max() <= 2


def test_damaged_frames_give_error_rows(spark):
    good = baseline_jpeg(np.full((16, 16), 90, np.uint8))
    lossless = bytes(avi.parse_avi(avi.store([b"x" * 128])[0]).frames[0])
    sof = lossless.index(b"\xff\xc3")
    at = good.index(b"\xff\xc0")

    def patched(frame, where, new):
        return frame[:where] + new + frame[where + len(new) :]

    dqt = good.index(b"\xff\xdb")
    damaged = [
        good[:dqt] + b"\xff\xdb\0\5\0\1\1" + good[dqt + 69 :],  # a short table
        patched(good, good.index(b"\xff\xda") + 5, b"\7"),  # an unknown component
        patched(good, at + 5, b"\0\0\0\0"),  # 0 x 0
        patched(good, at + 5, b"\xff\xff\xff\xff"),  # 65535 x 65535
        patched(good, at + 11, b"\x00"),  # a sampling factor of 0
        patched(lossless, sof + 7, b"\0\0"),  # width 0
        patched(lossless, sof + 4, b"\0"),  # precision 0
        good[:-8],
        b"\xff\xd8",
        b"",
    ]
    rows = [(k, bytearray(avi.write_avi([good, f], 16, 16))) for k, f in enumerate(damaged)] + [(99, bytearray(avi.write_avi([good, good], 16, 16)))]
    got = {r["id"]: r["error"] for r in avi.clips(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert sorted(got) == [*range(len(damaged)), 99] and got[99] is None
    assert all(got[k] for k in range(len(damaged)) if k != 7)


def test_bytes_of_a_scan_may_be_anything(spark):
    rng = random.Random(2)
    good = baseline_jpeg(np.full((24, 24), 90, np.uint8))
    rows = []
    for k in range(150):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        rows.append((k, bytearray(avi.write_avi([bytes(bad)], 24, 24))))
    assert avi.clips(spark.createDataFrame(rows, "id int, content binary")).select("id").distinct().count() == 150


def test_further_riff_segments(spark):
    frames = [baseline_jpeg(np.full((16, 16), v, np.uint8)) for v in (20, 20, 200, 200)]
    first = avi.write_avi(frames[:2], 16, 16, 10)
    movi = b"movi" + b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames[2:])
    body = b"AVIXLIST" + struct.pack("<I", len(movi)) + movi
    data = first + b"RIFF" + struct.pack("<I", len(body)) + body
    rows = avi.clips(spark.createDataFrame([(1, bytearray(data))], "id int, content binary")).orderBy("clip").collect()
    assert [(r["first_frame"], r["end_frame"]) for r in rows] == [(0, 2), (2, 4)]


def test_stored_files_and_features(spark, odd):
    files = {r["id"]: bytes(r["content"]) for r in avi.stored(odd).where("id is not null").collect()}
    for r in avi.round_trips(odd).where("id is not null").collect():
        data = files[r["id"]]
        assert (r["media_bytes"], r["media_sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        lines = np.frombuffer(avi.payload((dict(ODD)[r["id"]] or "").encode()), np.uint8)
        hists = [np.bincount(lines[k : k + 2048] // 16, minlength=16) for k in range(0, len(lines), 2048)]
        shares = [h / h.sum() for h in hists]
        cuts, since = [0], []
        for k in range(1, len(shares)):
            d = abs(shares[k] - shares[k - 1]).sum() / 2
            near = since[-8:]
            if d >= 0.3 and d > (np.mean(near) + 3 * np.std(near) if near else 0):
                cuts.append(k)
                since = []
            else:
                since.append(d)
        whole = sum(hists) / len(lines)
        assert r["feature"] == f"frames={len(hists)};shots={len(cuts)};cuts={','.join(map(str, cuts))};histogram={','.join('%.4f' % x for x in whole)}"
    assert avi.stored(odd.where("false")).count() == 0


# 2:


def fewest(items, capacity):
    """Exact, by dynamic programming over subsets."""
    best = [(99, 0)] * (1 << len(items))
    best[0] = (1, 0)
    for mask in range(1 << len(items)):
        used, level = best[mask]
        for i, s in enumerate(items):
            if not mask >> i & 1:
                t = (used, level + s) if level + s <= capacity else (used + 1, s)
                best[mask | 1 << i] = min(best[mask | 1 << i], t)
    return best[-1][0]


def test_plan_against_exact_packing():
    rng = random.Random(9)
    for _ in range(150):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        patterns, _ = packing.plan(dict(Counter(items)), 20)
        assert Counter(s for p, n in patterns for s in p * n) == Counter(items) and all(sum(p) <= 20 for p, _ in patterns)
        assert sum(n for _, n in patterns) <= fewest(items, 20) + 1


def test_dominated_sets_alone_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(5, 20) for _ in range(rng.randint(1, 9))]
        patterns, fixed = packing.plan(dict(Counter(items)), 20)
        if fixed == sum(n for _, n in patterns):
            assert fixed == fewest(items, 20)


def test_plan_does_not_grow_with_counts():
    rng = random.Random(1)
    small = {s: rng.randint(1, 50) for s in range(1, 2049)}
    large = {s: n * 10_000 for s, n in small.items()}
    assert len(packing.plan(large)[0]) < 20_000 and packing.plan({})[0] == []


def test_packed_documents(odd, library):
    rows = packing.packed_documents(odd, word_vocabulary()).collect()
    tokens = Counter()
    for i, t in ODD:
        v = [*ids_of(library, t), 0]
        for k in range(0, len(v), 2048):
            part = v[k : k + 2048]
            tokens[i, k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == tokens
    places: dict = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(odd.where("false"), word_vocabulary()).count() == 0


# 3:


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(odd):
    rows = simhash.near_duplicates(odd).collect()
    marks = Counter((i, plain_fingerprint(t)) for i, t in ODD)
    assert Counter((r["id"], r["fp"] & (1 << 64) - 1) for r in rows) == marks
    by_id = {r["id"]: r["component"] for r in rows}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == 3 and by_id[None] is None and by_id[7] == 7
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_every_link_of_near_fingerprints(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(8):
            f = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << bit
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {frozenset((r["u"], r["v"])) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    exact = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == exact and len(exact) > 400


def test_anchor_covering():
    halves = np.random.default_rng(0).integers(0, 1 << 32, 3000)
    home, index, reached = simhash.anchors(halves)
    distance = lambda a, b: np.array([int(x).bit_count() for x in a ^ b])
    assert distance(home, halves).max() <= 1 and distance(reached, halves[index]).max() <= 2 and np.bincount(index).max() == 17
    assert not simhash.syndromes(reached).any()


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(300, 200), (200, 300), (5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in connected_components(df, Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[101 + i] == 100 for i in range(50)) and got[300] == 200
    assert connected_components(df.where("false"), Scratch(spark, "test")).count() == 0


def test_one_document_of_each_class_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in (1, 3, 6, 7, 8, 9, 10, None))


# 4:


def test_ids_equal_the_library(odd, library):
    rows = bpe.digests(odd, word_vocabulary()).collect()
    want = Counter()
    for i, t in ODD:
        v = ids_of(library, t)
        want[i, len(v), hashlib.sha256(np.array(v, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(v, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    encoded = bpe.encode(odd, word_vocabulary())
    texts = {r["id"]: r["text"] for r in bpe.decode(encoded, word_vocabulary()).collect()}
    assert texts[6] == library.decode(ids_of(library, "word"), skip_special_tokens=False) and texts[3] == ""


def test_random_texts_equal_the_library(library):
    v = bpe.Vocabulary(word_vocabulary())
    own = bpe.Encoder(v, library)
    other = bpe.Encoder(v, library, bpe.library_words(v, library))
    rng = random.Random(6)
    letters = [chr(c) for c in (*range(1, 0x250), *range(0x370, 0x600), *range(0x1E00, 0x2100), 0x1F600, 0x4E00, 0xAC00)]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(800)]
    texts += ["it's I'LL  don't", "<|endoftext|>a<|startoftext|>", "İ ΣΑΣ ſ'ſ", "ab" * 900, "x" * 3000, "<|endoftext|", "".join(rng.choice("aeinrst") for _ in range(4000))]
    want = [np.array(ids_of(library, t), "<u4").tobytes() for t in texts]
    assert own.encode_many(texts) == want == other.encode_many(texts)


def test_decoding_reads_the_offset_table(library):
    v = bpe.Vocabulary(word_vocabulary())
    rng = random.Random(2)
    rows = [[rng.randrange(len(v.text)) for _ in range(rng.randint(0, 60))] for _ in range(300)]
    got = v.decode_many([np.array(r, np.int64) for r in rows])
    assert [g.decode() for g in got] == [library.decode(r, skip_special_tokens=False) for r in rows]
    v.offsets = v.offsets - v.offsets  # without it nothing is found
    assert v.decode([5, 6]) == ""


def test_encoding_and_decoding_empty_tables_and_odd_ids(spark, odd):
    assert bpe.encode(odd.where("false"), word_vocabulary()).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [None, 10**6, -1]), (3, [0])], "id int, ids array<int>").withColumn("text", F.lit("clash"))
    got = [(r["id"], r["text"]) for r in bpe.decode(rows, word_vocabulary()).collect()]
    assert got[:3] == [(1, None), (2, ""), (3, "")] and got[3][1] and bpe.decode(rows.where("false"), word_vocabulary()).count() == 0


def test_every_character_that_is_split_here(library):
    own = bpe.Encoder(bpe.Vocabulary(word_vocabulary()), library)
    texts = [t for c in map(chr, range(0x2100)) if bpe.SIMPLE.fullmatch(c) for t in (c, f"a{c}b", f"1{c}{c} {c}s")]
    assert own.encode_many(texts) == [np.array(ids_of(library, t), "<u4").tobytes() for t in texts]


# 5:


def test_sharding(odd, spark):
    rows = sharding.assign(odd, sharding.topology(8), sharding.topology(9)).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    ids = spark.range(20_000).select("id", sharding.shard_of(F.col("id"), sharding.topology(8)).alias("a"), sharding.shard_of(F.col("id"), sharding.topology(9)).alias("b"))
    moved = ids.where("a != b")
    assert moved.where("b != 8").count() == 0 and 1900 < moved.count() < 2550
    sizes = [r["count"] for r in ids.groupBy("a").count().collect()]
    assert min(sizes) > 2300 and max(sizes) < 2700
    assert sharding.assign(odd.where("false"), sharding.topology(8)).count() == 0


def test_weights_move_rows_in_changed_subtrees_only(spark):
    tree = {"r1": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0}}, "r2": {"c": {3: 2.0, 4: 1.0}}}
    changed = {"r1": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0}}, "r2": {"c": {3: 1.0, 4: 2.0}}}
    ids = spark.range(10_000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), changed).alias("b")).where("a != b")
    assert {(r["a"], r["b"]) for r in ids.collect()} == {(3, 4)}
    heavy = spark.range(12_000).groupBy(sharding.shard_of(F.col("id"), tree).alias("s")).count().collect()
    assert 3700 < next(r["count"] for r in heavy if r["s"] == 3) < 4300


# 6:


def toxic_corpus(n=1500):
    rng = random.Random(12)
    words = ["w" + str(i) for i in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.15)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["vile", "Nasty!", "gross,"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity(spark, odd):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model[0]) < 2000
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [(scores[i], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (t == 1) for s, t in held) / len(held) > 0.97
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.drop_toxic(odd, model).columns == odd.columns
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, s in scores.items() if s < 0.5}
    assert toxicity.score(docs.where("false"), model).count() == 0
    empty = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(docs.limit(3), empty).collect()} == {0.5}
    flipped = toxicity.fit(docs, labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (flipped[0] == model[0]).all() and np.allclose(flipped[1], model[1])


def test_ftrl_against_a_scalar_version():
    """The published update, one coordinate at a time."""
    rng = random.Random(4)
    rows = []
    for _ in range(120):
        label = rng.random() < 0.4
        at = {rng.randrange(50) for _ in range(rng.randint(0, 9))} | ({60} if label and rng.random() < 0.9 else set()) | {1 << toxicity.BITS}
        rows.append((np.array(sorted(at)), int(label)))
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for at, label in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in w:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weight(i) for i in z if weight(i)}
    index, found = toxicity.fit_ftrl(rows)
    assert set(index.tolist()) == set(want) and 60 in want
    assert np.allclose([want[i] for i in index.tolist()], found)


def test_fitting_reads_one_row_per_sampled_id(spark):
    docs = spark.range(30_000).select((F.col("id") % 10).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.range(10).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    model = toxicity.fit(docs, labels, max_rows=5)
    once = docs.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64(F.col("text").cast("binary")), "text")).alias("text"))
    same = toxicity.fit(once, labels, max_rows=5)
    assert (model[0] == same[0]).all() and np.allclose(model[1], same[1])


# 7:


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + k, vectors[0].tolist()) for k in range(40)]  # copies of one vector
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0, 2.0]), (None, [1.0] * 16), (2005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + rows[:3] + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got: dict = {}
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array([i for i, _ in rows])
    all_ = np.array([v for _, v in rows], float)
    hits = 0
    wanted = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(wanted)
    for q in wanted:
        cosines = hnsw.cosines(all_, all_[list(ids).index(q)])
        order = [i for i in np.lexsort((ids, -cosines)) if ids[i] != q][:5]
        found = sorted(got[q])
        assert [r for r, *_ in found] == [1, 2, 3, 4, 5] and [s for *_, s in found] == sorted((s for *_, s in found), reverse=True)
        hits += len({int(ids[i]) for i in order} & {v for _, v, _ in found})
    assert hits / (5 * len(wanted)) >= 0.95
    assert [v for _, v, _ in sorted(got[0])] == [1000, 1001, 1002, 1003, 1004]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert hnsw.nearest(few, few, 5).count() == 2 and hnsw.nearest(few.where("false"), few.where("false"), 5).count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_over_several_shards(spark, monkeypatch, clustered):
    """Recall of graphs in many shards; clustered vectors let queries pass most shards by."""
    monkeypatch.setattr(hnsw, "SHARD_NODES", 300)
    monkeypatch.setattr(hnsw, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 24)) * 4
    vectors = rng.normal(size=(2000, 24)) * (0.3 if clustered else 1) + (centres[rng.integers(0, 6, 2000)] if clustered else 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    visits = []
    searched = hnsw._searched
    monkeypatch.setattr(hnsw, "_searched", lambda graphs, asked, k, ef: visits.append(asked.count()) or searched(graphs, asked, k, ef))
    got: dict = {}
    for r in hnsw.nearest(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    scaled = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        near = scaled @ scaled[q]
        near[q] = -9
        hits += len(got[q] & set(np.argsort(-near)[:5].tolist()))
    assert hits / (5 * len(got)) >= 0.97 and len(got) == 40
    shards = 7 if not clustered else 8
    assert sum(visits) < 40 * 4 if clustered else sum(visits) >= 40 * shards


def test_graph_is_flat_arrays(spark):
    vectors = hnsw._unit(np.random.default_rng(1).normal(size=(600, 8)))
    graph = hnsw.Graph.build(vectors)
    again = hnsw.Graph.read(vectors, graph.flat(), graph.entry)
    assert (graph.ground == again.ground).all() and [v for v in again.search(vectors[5])][0] == 5
    assert (graph.ground < 600).all() and ((graph.ground >= 0).sum(axis=1) <= 2 * hnsw.LINKS).all() and len(graph.upper) >= 1
    seen, todo = {graph.entry}, [graph.entry]
    while todo:
        for v in graph.ground[todo.pop()]:
            if v >= 0 and v not in seen:
                seen.add(int(v))
                todo.append(int(v))
    assert len(seen) == 600
    assert hnsw.Graph.build(vectors[:0]).entry == 0 and hnsw.Graph.build(vectors[:1]).search(vectors[0]) == [0]


# 8:


def plain_rule(url):
    _, found, rest = (url or "").partition("://")
    host = rest if found else ""
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :] if found else ""
    path = path.split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        at, _, tail = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    cases = ["http://A.Example.ORG/es/1", "https://example.org/en/12?x", "http://example.org/en/2", "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/#a", "http://org/", "http://org", "nothing", None, "", "a://b://c/d", "http://x.net/a/b\nc", "http://x.net?y/z", "http://ÉX.org/es/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(None, "http://x.com/de/1"), (0, cases[0])], "page_id int, url string").withColumn("host", F.lit("clash"))
    rows = urls.judge(df).collect()
    assert len(rows) == len(cases) + 2
    for r in rows:
        if r["id"] is not None:
            host, path, best = plain_rule(cases[r["id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1]) and (best is None or r["verdict"] == best[0])
    assert {r["verdict"] for r in rows} <= {"allow", "block"} and urls.judge(df.where("false")).count() == 0


def plain_judge(pages):
    """Templates and verdicts of [(url)] as the tree is described: (templates by (host, shape), verdict per page)."""

    def kind(segment):
        for pattern, name in ((r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(\.|$)", "<date>"), (r"^[0-9]+(\.|$)", "<number>"), (r"^[0-9a-f-]{16,}(\.|$)", "<hex>")):
            segment = re.sub(pattern, lambda m, n=name: n + m[1], segment)
        return "<star>" if segment == "*" else segment

    parsed = [plain_rule(u) for u in pages]
    shape = lambda path: tuple(map(kind, path.removeprefix("/").split("/")))
    made = {(h, shape(p)): () for h, p, _ in parsed}
    for level in range(max((len(s) for _, s in made), default=0)):
        below: dict = {}
        for (h, s), m in made.items():
            if len(s) > level:
                below.setdefault((h, m), {}).setdefault(s[level], set()).add(s[level + 1] if len(s) > level + 1 else "<end>")
        for (h, s), m in made.items():
            if len(s) > level:
                kids = below[h, m]
                wild = len(kids) >= 8 and sum(map(len, kids.values())) <= len(kids) * math.sqrt(len(kids))
                made[h, s] = (*m, "*" if wild else s[level])
    counts: dict = {}
    for h, p, rule in parsed:
        c = counts.setdefault((h, made[h, shape(p)]), [0, 0])
        if rule:
            c[0] += 1
            c[1] += rule[0] == "block"
    smooth = lambda bad, known, prior: (bad + 10 * prior) / (known + 10)
    everything = smooth(sum(b for _, b in counts.values()), sum(k for k, _ in counts.values()), 0.5)
    shares: dict = {}

    def descend(names, level, prior):
        children: dict = {}
        for h, t in names:
            children.setdefault(t[level] if len(t) > level else None, []).append((h, t))
        sums = {c: (sum(counts[n][0] for n in group), sum(counts[n][1] for n in group)) for c, group in children.items()}
        pools = [[c for c in children if not sums[c][0]]]
        last = None
        for c in sorted((c for c in children if sums[c][0]), key=lambda c: (sums[c][1] / sums[c][0], c or "<end>")):
            k, b = sums[c]
            if last is None:
                pools.append([])
            else:
                k0, b0 = sums[last]
                p = (b + b0) / (k + k0)
                if abs(b / k - b0 / k0) > 1.96 * math.sqrt(p * (1 - p) * (1 / k + 1 / k0)):
                    pools.append([])
            pools[-1].append(c)
            last = c
        for pool in pools:
            share = smooth(sum(sums[c][1] for c in pool), sum(sums[c][0] for c in pool), prior)
            for n in children[None] if None in pool else ():
                shares[n] = share
            rest = [n for c in pool if c is not None for n in children[c]]
            if rest:
                descend(rest, level + 1, share)

    for host in {h for h, _ in counts}:
        names = [n for n in counts if n[0] == host]
        descend(names, 0, smooth(sum(counts[n][1] for n in names), sum(counts[n][0] for n in names), everything))
    verdicts = [rule[0] if rule else "block" if shares[h, made[h, shape(p)]] > 0.5 else "allow" for h, p, rule in parsed]
    return made, verdicts


def learnt_templates(spark, addresses):
    df = spark.createDataFrame([(u,) for u in addresses], "url string")
    rows = df.select(urls.host_of(F.col("url")).alias("host"), urls.shape_of(urls.path_of(F.col("url"))).alias("shape"), F.lit(None).cast("string").alias("verdict"))
    return {(r["host"], tuple(r["shape"])): tuple(r["template"]) for r in urls.templates(urls.shapes(rows), Scratch(spark, "test")).collect()}


def test_templates_below_a_wildcard(spark):
    names = [f"n{k}x" for k in range(60)]
    pages = [f"http://a.com/u/{n}/p/{n}-{j}" for n in names for j in range(3)] + [f"http://a.com/s{k}/item/{n}" for k in range(4) for n in names]
    got = set(learnt_templates(spark, pages * 2).values())
    assert got == {("u", "*", "p", "*"), *((f"s{k}", "item", "*") for k in range(4))}


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_against_a_plain_learner(spark, seed):
    rng = random.Random(seed)
    hosts = ["x.com", "y.example.org", "a.net", ""]
    tops = ["de", "fr", "en", "es", "u", "tag", "*", ""]
    word = lambda n: rng.choice("abcdefgh") + str(rng.randrange(n)) + "z"
    pages = []
    for _ in range(700):
        parts = [rng.choice(tops), *(word(rng.choice([3, 40])) if rng.random() < 0.8 else rng.choice(["2024-01-02", "17", "17.html", "0123456789abcdef0"]) for _ in range(rng.randint(0, 4)))]
        pages.append(f"http://{rng.choice(hosts)}/" + "/".join(parts))
    pages += [None, "", "http://x.com", "nothing", "http://a.net/" + "/".join("abcdefg")]
    made, verdicts = plain_judge(pages)
    assert learnt_templates(spark, [p for p in pages if p]).items() <= made.items()
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, url string")
    got = {r["id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(pages))] == verdicts and {"allow", "block"} <= set(verdicts)


def test_very_deep_paths_are_one_last_segment(spark):
    deep = "http://a.com/" + "/".join(map(str, range(100)))
    (shape,) = {s for _, s in learnt_templates(spark, [deep])}
    assert len(shape) == urls.LEVELS and shape[-1].count("/") == 100 - urls.LEVELS


# 9:


def plain_repeats(texts, width=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + width] for b in data for p in range(len(b) - width + 1))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                cover[p : p + width] = b"\1" * width
        runs = sum(1 for i, c in enumerate(cover) if c and (not i or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


def repeats_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").withColumn("values", F.lit("clash"))
    rows = suffix.deduplicated(df).orderBy("doc_id").collect()
    return [(r["__n_bytes"], r["__n_removed"], r["__n_spans"], r["__kept_sha256"]) for r in rows], rows


@pytest.mark.parametrize("seed", range(3))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n, letters="abcdef ": "".join(rng.choice(letters) for _ in range(n))
    base = [word(rng.randint(150, 900)) for _ in range(15)]
    texts = [None, "", "é" * 300, "é" * 301, "x" * 199, "x" * 200, "x" * 201, "ab" * 400]
    for _ in range(70):
        a, b = rng.choice(base), rng.choice(base)
        c = rng.randrange(len(a))
        edited = list(a)
        for _ in range(rng.randint(0, 4)):
            edited[rng.randrange(len(a))] = "Z"
        texts.append(rng.choice(["".join(edited), a[c : c + rng.randint(195, 420)] + b[rng.randrange(len(b)) :], a, word(rng.randint(0, 500), "abc é"), word(60) + a[:200] + word(60), word(30) + a[:199]]))
    got, rows = repeats_of(spark, texts)
    assert got == plain_repeats(texts)
    for r in rows:
        if r["__kept_text"] is not None and r["__n_removed"] and r["text"].isascii():
            assert hashlib.sha256(r["__kept_text"].encode()).hexdigest() == r["__kept_sha256"]


def test_long_texts_are_cut_into_segments_alike(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    texts = [text[:14_000] + text[3000:3400] + text[14_000:], text[20_000:20_250] + "tail", "y" * 3000]
    want = plain_repeats(texts)
    assert repeats_of(spark, texts)[0] == want
    for size in (4096, 3517, 1024):
        monkeypatch.setattr(suffix, "BLOCK", size)
        assert repeats_of(spark, texts)[0] == want


def test_repeats_of_odd_rows(odd):
    rows = suffix.deduplicated(odd.select("doc_id", "text")).collect()
    assert len(rows) == len(ODD) and suffix.deduplicated(odd.where("false")).count() == 0
    gone = {r["doc_id"]: r["__n_removed"] for r in rows}
    assert gone[1] == gone[2] == 600 and gone[4] == gone[7] == 0 and gone[9] == 5000


# 10:


def test_preference_pairs(spark):
    turns = lambda rows: spark.createDataFrame(rows, "conv long, turn int, role string, text string").withColumn("n", F.lit("clash"))
    chosen = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (2, 0, "user", "only"), (3, 0, "user", "same"), (4, None, None, None), (None, 0, "user", "q")])
    rejected = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "bye"), (3, 0, "user", "same"), (4, None, None, None), (5, 0, "assistant", "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a")])
    got = {r["conv"]: r for r in preferences.format_pairs(chosen, rejected, "conv").collect()}
    one = got[1]
    assert one["prompt"] == "<|user|>\nhi<|end|>\n" and one["prompt_turns"] == 1
    assert one["chosen"] == "<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n" and one["rejected"] == "<|assistant|>\nbye<|end|>\n"
    assert [one["chosen"][m["start"] : m["end"]] for m in one["chosen_mask"]] == ["hello<|end|>"] and [one["rejected"][m["start"] : m["end"]] for m in one["rejected_mask"]] == ["bye<|end|>"]
    assert got[2]["prompt"] == "" and got[2]["rejected"] == "" and got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["prompt_turns"] == 1
    assert got[5]["chosen"] == "" and got[5]["rejected_mask"] and got[4]["prompt"] == "<||>\n<|end|>\n" and got[None]["prompt_turns"] == 1
    assert preferences.format_pairs(chosen.where("false"), rejected.where("false"), "conv").count() == 0


def test_suffix_gathers_copies_once(spark):
    """However many rows share a text, each sampled position of it reaches the gathering buffer's list once."""
    rng = random.Random(5)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(300))
    df = spark.createDataFrame([(text,)] * 60 + [(text[:900] + "other " * 50,)] * 3, "text string").repartition(6)
    keyed = suffix._keyed(df, "text").select(F.col("__k1").alias("k1"), F.col("__k2").alias("k2"), F.col("text").cast("binary").alias("text"))
    rows = suffix._ranked(keyed.mapInArrow(suffix._first_batches, suffix._ROWS), "first", Scratch(spark, "test")).collect()
    assert len(rows) == 2 and all(len(r["told"]) == len(set(r["told"])) > 0 for r in rows)
    done = suffix.deduplicated(df).collect()
    assert len(done) == 63 and all(r["__n_removed"] == r["__n_bytes"] for r in done)
