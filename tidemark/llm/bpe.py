"""BPE encoding and decoding in batches, by numpy merge rounds.

Words of a batch that are not known yet lie in one flat array of symbols. Each round looks up the pairs of neighbours by
binary search over the sorted pair keys, finds the lowest rank of every word and merges it wherever it
occurs in the word, until no word has a pair left. Ids of finished words are kept for the next texts of the task,
up to ``KEPT_WORDS``.

The vocabulary file gives normalisation (NFC, lower case), the split pattern, byte symbols and word ends; its path is a
parameter and the file must be readable on every executor.

Defined results: null and empty texts have no tokens and decode to the empty text; rows that repeat repeat;
texts of any length are encoded whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT_WORDS = 300_000
_CHUNK_CHARS = 1 << 20
#: The vocabulary's split pattern; its white space in full.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.marks = regex.compile("(" + "|".join(regex.escape(s) for s in special) + ")") if special else None
        self.strings = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for text, i in [*vocab.items(), *special.items()]:
            self.strings[i] = text
        self.inner = np.array([vocab[s] for s in byte_symbols()])
        self.last = np.array([vocab[s + end] for s in byte_symbols()])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs])[order]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the offsets of the words in it."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol, word = self.inner[data], np.repeat(np.arange(len(raw)), size)
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[data[ends]]
        place = np.arange(len(data))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        while len(symbol):
            key = symbol[:-1] << 32 | symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            where = np.flatnonzero(hit)
            rank = self.ranks[at[where]]
            best = np.full(len(raw), none)
            np.minimum.at(best, word[where], rank)
            rest = best[word] == none
            if rest.any():
                done.append((symbol[rest], word[rest], place[rest]))
            where = where[rank == best[word[where]]]
            if len(where):
                # of pairs that overlap, as in "aaa", the first goes, then every second
                run = np.append(True, np.diff(where) != 1)
                start = where[np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))]
                where = where[(where - start) % 2 == 0]
                symbol[where] = self.merged[at[where]]
            keep = ~rest
            keep[where + 1] = False
            symbol, word, place = symbol[keep], word[keep], place[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
        symbols, owners, places = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(places, kind="stable")
        return symbols[order], np.append(0, np.cumsum(np.bincount(owners, minlength=len(raw))))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.number]
        if not new:
            return
        ids, offsets = self.merge(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.first = np.append(self.first, offsets[1:] + len(self.ids))
        self.ids = np.append(self.ids, ids)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stand for themselves, after a zero character that no word begins with."""
        if self.marks is not None and "<|" in text:
            parts = self.marks.split(text)
            return [w for p in parts for w in (["\0" + p] if p in self.special else self._words(p))]
        return self._words(text)

    @staticmethod
    def _words(text: str) -> list[str]:
        if not text.isascii():
            # lower case by single characters: the final sigma has no form of its own
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _PIECE.findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.number) > KEPT_WORDS:
            self.forget()
        words = [self.pieces(t) for t in texts]
        every = set().union(*words)
        for mark in [w for w in every if w[:1] == "\0" and w[1:] in self.special and w not in self.number]:
            self.number[mark] = len(self.number)
            self.ids = np.append(self.ids, self.special[mark[1:]])
            self.first = np.append(self.first, len(self.ids))
        self._learn(every)
        out = []
        for own in words:
            at = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
            size = self.first[at + 1] - self.first[at]
            total = np.cumsum(size)
            n = int(total[-1]) if len(total) else 0
            out.append(self.ids[np.arange(n) + np.repeat(self.first[at] - total + size, size)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Token strings with one space between; the vocabulary names no other decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= _CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoder(path: str):
    """A column function from text to its ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        ids = [i for part in _parts([t or "" for t in texts.to_pylist()]) for i in bpe.encode(part)]
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
        offsets = np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode


def decoder(path: str):
    """A column function from ids to text."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = load(path)
        return pa.array([bpe.decode(np.array(i or [], np.int64)) for i in ids.to_pylist()], pa.string())

    return decode


_DIGESTS = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"


def digester(path: str):
    """Encode, decode the ids again, and return the number of tokens and digests of both; ids stay in the task."""

    @F.arrow_udf(_DIGESTS)
    def digest(texts: pa.Array) -> pa.Array:
        bpe = load(path)
        count, coded, decoded = [], [], []
        for part in _parts([t or "" for t in texts.to_pylist()]):
            for ids in bpe.encode(part):
                count.append(len(ids))
                coded.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
            ["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return digest


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = docs.select("doc_id", digester(path)(F.coalesce("text", F.lit(""))).alias("_d"))
    return out.select("doc_id", "_d.n_tokens", "_d.ids_sha256", "_d.decoded_sha256")
