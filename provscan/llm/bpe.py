"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A word's merges are found without merging. An Aho-Corasick automaton over the
vocabulary gives the longest token at every byte of the word; tokens are taken
left to right and each is checked against its predecessor in a pair
compatibility table: two neighbours are compatible if merging the text of both
from scratch leaves exactly these two. Where no compatible token is left at a
position, the next shorter token is tried, else the encoder steps back. A
sequence whose neighbours are all compatible is the one that merging in rank
order gives, and each (position, token) is visited once.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import types
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
CACHE_WORDS = 800_000  #: words and chunks that a worker remembers before it starts afresh
DECODE_IDS = 1 << 18  #: ids that are decoded together


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, read from a ``tokenizers`` JSON file.

    Symbols are the bytes, and 256 + byte for a word's last byte. Ids must rise
    with the rank of the merge that makes them, which is checked.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["end_of_word_suffix"] != END or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-casing byte-level vocabulary with word ends")
        self.words = regex.compile(split)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = _byte_letters()
        symbols = {letter: b for b, letter in enumerate(letters)} | {letter + END: 256 + b for b, letter in enumerate(letters)}
        size = max(ids.values(), default=-1) + 1
        size = max(size, 1 + max(self.special.values(), default=-1))
        self.text: list[str] = [""] * size  # of a token, as the vocabulary writes it
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.symbol_id = {s: ids[name] for name, s in symbols.items()}
        spelled: list[str] = [""] * size
        for name, i in ids.items():
            self.text[i] = name
        for name, i in self.special.items():
            self.text[i] = name
        for s, i in self.symbol_id.items():
            spelled[i] = chr(s)
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            a, b = ids[left], ids[right]
            i = ids[left + right]
            if i <= last or i <= max(a, b):
                raise ValueError(f"{path}: the ids of its tokens don't rise with the ranks of their merges")
            last = i
            self.merged[a, b] = i
            self.halves[i] = (a, b)
            spelled[i] = spelled[a] + spelled[b]
        # Reversed, so that a match's end is where a token of the word starts.
        self.longest = ahocorasick.Automaton()
        for i, s in enumerate(spelled):
            if s:
                self.longest.add_word(s[::-1], (i, len(s)))
        self.longest.make_automaton()
        self.length = [len(s) for s in spelled]
        by_spelling = {s: i for i, s in enumerate(spelled) if s}
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for i, s in enumerate(spelled):
            for n in range(len(s) - 1, 0, -1):
                if s[:n] in by_spelling:
                    self.shorter[i] = by_spelling[s[:n]]
                    break
        self.compatible: dict[tuple[int, int], bool] = {}
        # Decoding: all token texts end to end, a space after each, and where each starts.
        pieces = [t.encode() + b" " * bool(t) for t in self.text]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both from scratch leaves these two tokens."""
        known = self.compatible.get((left, right))
        if known is None:
            known = self.compatible[left, right] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Undo merges on both sides of the border, latest first; a merge across it that ranks before what was undone would have come first.
        limit, merged, halves = len(self.text), self.merged, self.halves
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            # Equal ids are undone on the right first: the left one was merged first.
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one pre-token of at least one byte."""
        n = len(data)
        last = 256 + data[-1]
        word = data[:-1].decode("latin-1") + chr(last)
        start = [0] * n
        best = [0] * n
        for at, (token, size) in self.longest.iter(word[::-1]):
            at = n - 1 - at
            if size > best[at]:
                best[at], start[at] = size, token
        out: list[int] = []
        at, token, open_ = 0, start[0], [True] * (n + 1)
        length, fits, shorter = self.length, self.fits, self.shorter
        while True:
            end = at + length[token]
            if open_[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, start[end]
                continue
            token = shorter[token]
            if token < 0:
                open_[at] = False
                token = out.pop()
                at -= length[token]

    def decode(self, ids) -> str:
        """The text of ids as the library joins them where a vocabulary names no decoder: by single spaces."""
        return self.decode_many([np.asarray(ids, np.int64)])[0].decode()

    def decode_many(self, rows: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 text of each array of ids, gathered from the blob by the offset table; ids without a token add nothing."""
        out: list[bytes] = []
        some: list[np.ndarray] = []
        size = 0
        for ids in rows:
            some.append(ids)
            size += len(ids)
            if size > DECODE_IDS:
                out += self._gather(some)
                some, size = [], 0
        return out + self._gather(some)

    def _gather(self, rows: list[np.ndarray]) -> list[bytes]:
        if not rows:
            return []
        ids = np.concatenate(rows).astype(np.int64)
        known = (ids >= 0) & (ids < len(self.text))
        ids = np.where(known, ids, 0)
        starts = self.offsets[ids]
        sizes = np.where(known, self.offsets[ids + 1] - starts, 0)
        stops = np.cumsum(sizes)
        text = self.blob[np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)].tobytes()
        bounds = np.concatenate([[0], stops])[np.cumsum([0, *map(len, rows)])].tolist()
        return [text[a : b - 1] if b > a else b"" for a, b in zip(bounds, bounds[1:])]


#: Texts of these characters only are lower-cased and split by Python, which agrees with the library on them; others are split by the library itself.
SIMPLE = regex.compile(r"[\t\n\r\x20-\x7E\u00A1-\u012F\u0131-\u017E\u2018-\u201D\u2026]*")


class Encoder:
    """Encodes whole texts, remembering words and the white-space separated chunks they come in.

    ``miss`` turns a list of words not seen yet into their ids as bytes; ``splitter``
    is a ``tokenizers.Tokenizer`` of the same file, used for normalising and
    splitting texts that hold characters outside SIMPLE.
    """

    def __init__(self, vocabulary: Vocabulary, splitter, miss=None):
        self.v = vocabulary
        self.splitter = splitter
        self.miss = miss or (lambda words: [self._pack(vocabulary.encode_word(w.encode())) for w in words])
        self.bytes_of = {ord(letter): b for b, letter in enumerate(_byte_letters())}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids) -> bytes:
        return array("I", ids).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Adds chunks (runs without white space, lower case) to what is known."""
        known = self.known
        fresh = chunks.difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = chunks
        words = {c for c in fresh if c.isalpha()}
        mixed = {c: self.v.words.findall(c) for c in fresh if c not in words}
        words.update(w for parts in mixed.values() for w in parts)
        words = list(words.difference(known))
        known.update(zip(words, self.miss(words)))
        known.update([(c, b"".join([known[w] for w in parts])) for c, parts in mixed.items()])

    def _split(self, text: str) -> bytes:
        """By the library's own normaliser and splitter, merged here."""
        pieces = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text))
        return b"".join([self._pack(self.v.encode_word(bytes([self.bytes_of[ord(x)] for x in p]))) for p, _ in pieces])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > 1 << 20:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        special = self.v.special
        parts = [self.v.special_split.split(t) if special and any(s in t for s in special) else [t] for t in texts]
        chunks = [[p.lower().split() if SIMPLE.fullmatch(p) else None for p in row[::2]] for row in parts]
        self._learn(set().union(*(part for row in chunks for part in row if part)))
        known, out = self.known, []
        for row, simple in zip(parts, chunks):
            ids = [b"".join([known[c] for c in part]) if part is not None else self._split(p) for p, part in zip(row[::2], simple)]
            for k, name in enumerate(row[1::2]):
                ids[k] += self._pack([special[name]])
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out

    def encode(self, text: str) -> bytes:
        return self._encode([text])[0]


def library_words(vocabulary: Vocabulary, tokenizer):
    """A ``miss`` for Encoder that asks the tokenizers library: words in one text, cut after word ends."""
    ends = np.array([t.endswith(END) for t in vocabulary.text])

    def miss(words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            # The call for batches keeps no offsets.
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
            if len(stops) != len(part):
                raise ValueError("a word was not kept whole")
            blob = ids.tobytes()
            out += [blob[a:b] for a, b in zip([0, *stops], stops)]
        return out

    return miss


def _store() -> dict:
    """What this process keeps from task to task: functions travel by value, so the module they come from is none of the worker's."""
    name = "provscan_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})


def _kept(key: tuple, build):
    store = _store()
    if key not in store:
        store[key] = build()
    return store[key]


def forget() -> None:
    """Frees what this worker keeps: for operators that need its memory for something else."""
    _store().clear()


def vocabulary(path: str) -> Vocabulary:
    return _kept(("vocabulary", path), lambda: Vocabulary(path))


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def encoder(path: str) -> Encoder:
    return _kept(("encoder", path), lambda: Encoder(vocabulary(path), _library(path)))


def library_encoder(path: str) -> Encoder:
    """The same ids with words encoded by the tokenizers library."""

    def build():
        v, tokenizer = vocabulary(path), _library(path)
        return Encoder(v, tokenizer, library_words(v, tokenizer))

    return _kept(("library", path), build)


def _digest_batches(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            encoded = enc.encode_many([t or "" for t in batch.column(1).to_pylist()])
            shown = enc.v.decode_many([np.frombuffer(ids, "<u4") for ids in encoded])
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) for ids, text in zip(encoded, shown)]
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode_batches(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in enc.encode_many([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _decode_batches(path: str):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            listed = batch.column(1).to_pylist()
            texts = v.decode_many([np.array([i for i in ids or () if i is not None], np.int64) for ids in listed])
            shown = [None if ids is None else t.decode() for ids, t in zip(listed, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown, pa.string())], names=["id", "text"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row of ``docs``: whole texts, special tokens recognised, none added.

    A null or empty text has no ids; ids of rows may be null or repeated; rows
    come back as often as they came in; only the two named columns are read.
    """
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode_batches(path), _schema(docs, id_col, "ids array<int>"))


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) per row, read from the vocabulary's offset table.

    A null array gives a null text, no ids an empty one; null ids and ids that
    the vocabulary lacks add nothing. Ids of rows may be null or repeated; an
    empty table gives an empty result; only the two named columns are read.
    """
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(_decode_batches(path), _schema(encoded, id_col, "text string"))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: ``encode`` and ``decode`` of each text in one pass."""
    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_digest_batches(path), _schema(docs, id_col, rest))


def _schema(df: DataFrame, id_col: str, rest: str) -> str:
    return f"id {df.schema[id_col].dataType.simpleString()}, {rest}"
