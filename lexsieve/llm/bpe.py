"""BPE encoding and decoding with batched numpy merge rounds.

The symbols of many words lie in one flat array. Each round looks up all neighbouring pairs
at once by binary search over the sorted pair keys, merges in every word its pair of lowest
rank, and drops the words that are finished. A batch encodes each of its different words
once.

A round takes one rank of each word, so a word of very many symbols would need very many rounds over
all of it; such words are merged from a heap of their pairs instead, one merge at a time.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsieve.llm.common import code_points, named, packed, unpacked

NO_RANK = np.iinfo(np.int64).max
# What Unicode calls white space.
SPACE = r"[\t-\r \x85\xa0  -     　]+"
WORDS_KEPT = 200_000
# Words of more bytes than this are merged from a heap.
LONG_WORD = 1_000
LOW = (1 << 32) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from
    U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Tokenizer:
    """A tokenizer file of the kind "BPE with word ends": encode and decode many texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocabulary = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in {**vocabulary, **self.special}.items()}
        self.pattern = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(SPACE)
        self.marks = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters])
        self.final = np.array([vocabulary[c + suffix] for c in letters])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (
            np.array([vocabulary[x] for x in column])
            for column in zip(*[(a, b, a + b) for a, b in pairs], strict=True)
        )
        keys = left.astype(np.int64) << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.made_by = made.tolist()
        self.known: dict[str, bytes] = {}

    def _ranks(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the pair table of each symbol with the next one."""
        keys = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        found = (self.keys[place] == keys) & (word[:-1] == word[1:])
        return np.where(found, self.ranks[place], NO_RANK), place

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: long ones one by one, the others from all their bytes in one array."""
        raw = [w.encode("utf-8") for w in words]
        short = iter(self._encode_short([b for b in raw if len(b) <= LONG_WORD]))
        return [self._encode_long(b) if len(b) > LONG_WORD else next(short) for b in raw]

    def _encode_long(self, raw: bytes) -> np.ndarray:
        """Merges from a heap of (rank, place), the leftmost of equal ranks first."""
        data = np.frombuffer(raw, np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.final[data[-1]]
        rank, _ = self._ranks(symbols, np.zeros(len(symbols), np.int8))
        at = np.flatnonzero(rank != NO_RANK)
        heap = sorted((rank[at] << 32 | at).tolist())  # a sorted list is a heap
        symbol, n = symbols.tolist(), len(symbols)
        following, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank_of, made_by = self.rank_of, self.made_by
        while heap:
            entry = heappop(heap)
            i, r = entry & LOW, entry >> 32
            j = following[i]
            # Entries of symbols that have been merged since are stale.
            if j < 0 or symbol[i] < 0 or rank_of.get(symbol[i] << 32 | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = made_by[r], -1
            following[i] = k = following[j]
            if k >= 0:
                before[k] = i
                if (new := rank_of.get(symbol[i] << 32 | symbol[k])) is not None:
                    heappush(heap, new << 32 | i)
            h = before[i]
            if h >= 0 and (new := rank_of.get(symbol[h] << 32 | symbol[i])) is not None:
                heappush(heap, new << 32 | h)
        return np.array([s for s in symbol if s >= 0], "<u4")

    def _encode_short(self, raw: list[bytes]) -> list[np.ndarray]:
        if not raw:
            return []
        lengths = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[data[ends]]
        word = np.repeat(np.arange(len(raw)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank, place = self._ranks(symbols, word)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(np.r_[rank, NO_RANK], starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            open_ = np.repeat(least != NO_RANK, sizes)
            done.append((word[~open_], symbols[~open_]))
            hit = np.r_[(rank == np.repeat(least, sizes)[:-1]) & (rank != NO_RANK), False]
            at = np.flatnonzero(hit)
            # Of hits in a row (the pair's symbols are the same) every second one counts.
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else at
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[nth % 2 == 0]
            symbols[at] = self.made[place[at]]
            keep = open_
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        words_, ids = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int),) * 2
        order = np.argsort(words_, kind="stable")
        sizes = np.bincount(words_, minlength=len(raw))
        return np.split(ids[order].astype("<u4"), np.cumsum(sizes)[:-1])

    def split(self, text: str) -> list[str | int]:
        """The words of a text, and the ids of the special tokens that stand in it."""
        out: list[str | int] = []
        at = 0
        for mark in self.marks.finditer(text) if self.marks else ():
            out += [*self._words(text[at : mark.start()]), self.special[mark[0]]]
            at = mark.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            # Letters are lowered one by one: a sigma at a word's end is like any other.
            text = self.space.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return self.pattern.findall(self.space.sub(" ", text).lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids of each text."""
        pieces = [self.split(t) for t in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = list({w for p in pieces for w in p if w not in self.known and isinstance(w, str)})
        if new:
            # Bytes, as a small array of numpy takes several times their memory.
            self.known.update(zip(new, (ids.tobytes() for ids in self.encode_words(new)), strict=True))
        special = {i: i.to_bytes(4, "little") for i in self.special.values()}
        return [
            np.frombuffer(b"".join([special[w] if isinstance(w, int) else self.known[w] for w in p]), "<u4")
            for p in pieces
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids joined by spaces, as the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _parts(texts: Iterator[pd.Series], most: int = 1_000_000) -> Iterator[list[str]]:
    """Arrow's batches of texts in parts of about ``most`` characters. Results are given back part
    by part, so that neither a batch of long texts nor its tokens fill the memory."""
    for series in texts:
        part, size = [], 0
        for text in series:
            part.append(text)
            size += len(text)
            if size >= most:
                yield part
                part, size = [], 0
        if part:
            yield part


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows with ``ids`` (array of bigint): the whole text's tokens.

    Null and empty texts have no tokens; there is no shuffle; a column named ``ids`` gives way.
    ``path`` is the tokenizer file as the executors see it, or the name of one given to
    ``SparkContext.addFile``.
    """

    @F.pandas_udf("array<bigint>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = tokenizer(_local(path))
        for part in _parts(texts):
            yield pd.Series([x.astype(np.int64) for x in coder.encode(part)], dtype=object)

    rows = packed(df, ["ids"], text=code_points(named(text)))
    return unpacked(rows.withColumn("ids", ids("text")), "ids")


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All rows with ``decoded``: the text of the tokens; null for null ids."""

    @F.pandas_udf("string")
    def decoded(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = tokenizer(_local(path))
        for series in rows:
            yield pd.Series([None if x is None else coder.decode(np.asarray(x)) for x in series], dtype=object)

    rows = packed(df, ["decoded"], ids=named(ids))
    return unpacked(rows.withColumn("decoded", decoded("ids")), "decoded")


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: each text is encoded,
    its ids are digested as little-endian unsigned 32-bit integers, and the text that they
    decode to in UTF-8. Ids and decoded texts do not leave the task.

    Null and empty texts have no tokens and decode to the empty text.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(_local(path))
        for part in _parts(texts):
            out = []
            for ids in coder.encode(part):
                decoded = coder.decode(ids).encode("utf-8")
                out.append((len(ids), sha256(ids.tobytes()).hexdigest(), sha256(decoded).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    rows = packed(df, outputs, text=code_points(named(text)))
    return unpacked(rows.withColumn("d", digests("text")), *[F.col("d")[c].alias(c) for c in outputs])


def _local(path: str) -> str:
    return path if "/" in path else SparkFiles.get(path)
