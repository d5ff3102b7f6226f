"""Byte pair encoding of many texts at once, and its inverse, in batched numpy merge rounds.

The vocabulary is a public tokenizer file with word ends (lower case, white space dropped); its
path is a parameter, and each Python worker reads it once. A text is cut into words by character
classes, equal words are encoded once, and the symbols of all new words stand in one flat array.
A round finds the rank of each adjacent pair by binary search over the sorted pair keys, takes
the lowest rank of every word and merges all its occurrences, until no word has a known pair.

Nulls and empty texts have no ids. A text may be of any length; texts are taken in chunks of
about ``CHUNK`` characters (a single longer text is a chunk by itself), and the words that a
worker remembers are forgotten when there are more than ``REMEMBERED``, so memory is bounded.
Strings of special tokens inside a text give the special ids, as in the tokenizers library. Other
columns of the input play no part, whatever they are called.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 400_000
REMEMBERED = 250_000
_NONE = np.int32(2**31 - 1)

# Fixed values. The tokenizers library cuts words by the tables of Unicode 16, lowers case by those of 17 and makes normal
# form C by those of 9; Python 3.13 has 15.1. Ranges are (first, last), as hexadecimal code points.
# Letters and numbers that 15.1 doesn't know:
LETTERS_16 = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 "
    "113D1-113D1 113D3-113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF-18CFF 1E5D0-1E5ED 1E5F0-1E5F0"
)
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
# Capital letters that 15.1 has no small letter for, and how far on the small one is:
LOWER_17 = "1C89-1C89:1 A7CB-A7CB:-A567 A7CC-A7CC:1 A7CE-A7CE:1 A7D2-A7D2:1 A7D4-A7D4:1 A7DA-A7DA:1 A7DC-A7DC:-A641 10D50-10D65:20 16EA0-16EB8:1B"
# Marks that Unicode 9 doesn't know: they neither move nor combine.
INERT_MARKS = (
    "07FD-07FD 0898-089F 08CA-08D3 09FE-09FE 0C3C-0C3C 0D3B-0D3C 0EBA-0EBA 1715-1715 1ABF-1ACE 1DF6-1DFA A82C-A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF "
    "10F46-10F50 10F82-10F85 11070-11070 1133B-1133B 1145E-1145E 11839-1183A 11930-11930 11938-11938 1193D-1193E 11943-11943 119E0-119E0 11A34-11A34 "
    "11A47-11A47 11A99-11A99 11D42-11D42 11D44-11D45 11D97-11D97 11F41-11F42 16FF0-16FF1 1E08F-1E08F 1E130-1E136 1E2AE-1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)


def _ranges(spelt: str) -> list[range]:
    ends = [[int(x, 16) for x in r.split("-")] for r in spelt.split()]
    return [range(a, b + 1) for a, b in ends]


_SPANS = "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in _ranges(INERT_MARKS))
_INERT = re.compile(f"([{_SPANS}])")
_LOWER = {c: c + int(step, 16) for spelt, _, step in (x.partition(":") for x in LOWER_17.split()) for c in _ranges(spelt)[0]}


@functools.cache
def _classes() -> np.ndarray:
    """For each code point: 0 white space, 1 letter, 2 number, 3 any other."""
    kind = np.full(sys.maxunicode + 1, 3, np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kind[c] = 1 if major == "L" else 2
    for number, spelt in ((1, LETTERS_16), (2, NUMBERS_16)):
        for r in _ranges(spelt):
            kind[r[0] : r[-1] + 1] = number
    for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        kind[c] = 0
    return kind


@functools.cache
def _mixed() -> np.ndarray:
    """A 64-bit number for each code point (splitmix64), for the hash of a word."""
    with np.errstate(over="ignore"):
        z = np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@functools.cache
def _rare() -> np.ndarray:
    """For each code point whether it is one that Python's tables treat otherwise than the library's."""
    rare = np.zeros(sys.maxunicode + 1, bool)
    rare[[*_LOWER, *(c for r in _ranges(INERT_MARKS) for c in r)]] = True
    return rare


def _has_rare(text: str) -> bool:
    return bool(_rare()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return [c for _, c in sorted([*((b, chr(b)) for b in plain), *((b, chr(256 + n)) for n, b in enumerate(rest))])]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i]+1, ... (counts[i] of them) for every i, in order."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


class WordBpe:
    """An encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 20 | right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.begin = np.empty(1 << 14, np.int64)
        self.count = np.empty(1 << 14, np.int64)
        for text, i in self.special.items():  # white space before: no word is spelt so
            self._remember([" " + text], np.array([i], np.int32), np.array([1]))

    def _remember(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m > len(self.begin):
            self.begin = np.concatenate([self.begin, np.empty_like(self.begin)])
            self.count = np.concatenate([self.count, np.empty_like(self.count)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n : n + m] = self.used + np.cumsum(counts) - counts
        self.count[n : n + m] = counts
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m), strict=True))

    # -- one word each -------------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words, one after another, and how many each has. No word is empty."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        sym, last = self.inner[data], np.zeros(len(data), bool)
        last[ends - 1] = True
        # The end-of-word mark goes to the last symbol, which is a byte here.
        sym[ends - 1] = self.last[data[ends - 1]]
        rank = np.full(len(sym), _NONE, np.int32)
        at = np.flatnonzero(~last)
        rank[at] = self._ranks(sym[at], sym[at + 1])
        which, done = np.arange(len(raw)), []
        while len(which):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            live = best != _NONE
            if not live.all():
                stay = np.repeat(live, size)
                done.append((which[~live], size[~live], sym[~stay]))
                sym, rank, last = sym[stay], rank[stay], last[stay]
                which, size, best = which[live], size[live], best[live]
                if not len(which):
                    break
            hit = rank == np.repeat(best, size)
            if (hit[1:] & hit[:-1]).any():  # equal symbols in a row: every second pair, from the left
                at = np.arange(len(hit))
                first = hit & ~np.concatenate([[False], hit[:-1]])
                hit &= (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            size = size - np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
            new = np.cumsum(keep)[at] - 1
            sym, rank, last = sym[keep], rank[keep], last[keep]
            ended = last[new]
            rank[new[ended]] = _NONE
            new_open = new[~ended]
            rank[new_open] = self._ranks(sym[new_open], sym[new_open + 1])
            before = new[new > 0] - 1
            before = before[~last[before]]
            rank[before] = self._ranks(sym[before], sym[before + 1])
        counts = np.zeros(len(raw), np.int64)
        for which, size, _ in done:
            counts[which] = size
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for which, size, ids in done:
            out[spread(begin[which], size)] = ids
        return out, counts

    # -- whole texts ---------------------------------------------------------------------------

    def _plain(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower-casing goes character by character: no final form of sigma.
        if not _has_rare(text):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        normal = "".join(p if n % 2 else unicodedata.normalize("NFC", p) for n, p in enumerate(_INERT.split(text)))
        return normal.replace("Σ", "σ").lower().translate(_LOWER)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """texts: in normal form and lower case. The ids of all, and how many each has."""
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _classes()[code]
        edge = np.empty(len(kind), bool)
        edge[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == 2
        first = np.flatnonzero(edge)
        end = np.append(first[1:], len(code))
        word = kind[first] != 0
        # 's 't 'm 'd 're 've 'll after an apostrophe that stands alone go with it.
        quote = np.flatnonzero((code[first] == 39) & (end - first == 1))
        quote = quote[quote + 1 < len(first)]
        quote = quote[kind[first[quote + 1]] == 1]
        if len(quote):
            c1 = code[first[quote + 1]]
            two = end[quote + 1] - first[quote + 1] > 1
            c2 = np.where(two, code[np.minimum(first[quote + 1] + 1, len(code) - 1)], 0)
            short = np.isin(c1, [ord(c) for c in "stmd"])
            long = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
            quote, take = quote[short | long], np.where(short, 1, 2)[short | long]
            end[quote] += take
            first[quote + 1] += take
            word &= end > first
        first, end = first[word], end[word]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        owner = np.searchsorted(np.cumsum(lengths + 1), first, side="right")
        if not len(first):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        head, back = self._equal(code, first, end)
        words = [joined[a:b] for a, b in zip(first[head].tolist(), end[head].tolist(), strict=True)]
        place = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = [words[i] for i in new]
            if len(fresh) != len(set(fresh)):
                raise AssertionError("equal words met twice")
            n = len(self.known)
            self._remember(fresh, *self.merge(fresh))
            place[new] = np.arange(n, n + len(new))
        at = place[back]
        counts = self.count[at]
        ids = self.ids[spread(self.begin[at], counts)]
        return ids, np.bincount(owner, counts, len(texts)).astype(np.int64)

    @staticmethod
    def _equal(code: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each class of equal words, and each word's class. By a hash, then checked."""
        with np.errstate(over="ignore"):
            power = np.full(len(code), 0x9E3779B97F4A7C15 | 1, np.uint64)
            power[0] = 1
            np.cumprod(power, out=power)
            below = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(_mixed()[code] * power, out=below[1:])
            inverse = np.full(len(code), pow(0x9E3779B97F4A7C15 | 1, -1, 2**64), np.uint64)
            inverse[0] = 1
            np.cumprod(inverse, out=inverse)
            value = (below[end] - below[first]) * inverse[first] + (end - first).astype(np.uint64)
        _, head, back = np.unique(value, return_index=True, return_inverse=True)
        size = end - first
        same = (size == size[head][back]).all() and (code[spread(first, size)] == code[spread(first[head][back], size)]).all()
        if not same:  # two words share a hash: compare the words themselves
            spelt = [code[a:b].tobytes() for a, b in zip(first, end, strict=True)]
            _, head, back = np.unique(np.array(spelt, object), return_index=True, return_inverse=True)
        return head, back

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of texts, in order: the ids of all and how many each text has."""
        held: list[str] = []
        pieces: list[int] = []  # how many of held make up each text
        size = 0
        for text in texts:
            if len(self.known) > REMEMBERED:
                yield from self._flush(held, pieces)
                held, pieces, size = [], [], 0
                self._forget()
            text = text or ""
            if any(mark in text for mark in self.special):
                parts = [(" " + p) if n % 2 else self._plain(p) for n, p in enumerate(self.special_re.split(text))]
            else:
                parts = [self._plain(text)]
            held += parts
            pieces.append(len(parts))
            size += len(text) + 1
            if size >= CHUNK:
                yield from self._flush(held, pieces)
                held, pieces, size = [], [], 0
        yield from self._flush(held, pieces)

    def _flush(self, held: list[str], pieces: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not pieces:
            return
        if len(held) == len(pieces):
            yield self._chunk(held)
            return
        # Pieces between special tokens are cut into words; the tokens themselves are put between.
        place = np.cumsum(pieces) - pieces
        odd = np.arange(len(held)) - np.repeat(place, pieces)
        ids, counts = self._chunk([h if o % 2 == 0 else "" for h, o in zip(held, odd, strict=True)])
        marks = np.flatnonzero(odd % 2)
        at = (np.cumsum(counts) - counts)[marks]
        ids = np.insert(ids, at, [self.special[held[m][1:]] for m in marks])
        counts[marks] = 1
        yield ids.astype(np.int32), np.add.reduceat(counts, place)

    def texts_of(self, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """kind "decimal" or "token": for each id its text with a space after it, as bytes, starts and sizes."""
        texts = [f"{i} ".encode() if kind == "decimal" else f"{s} ".encode() for i, s in enumerate(self.names)]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size

    def joined(self, kind: str, ids: np.ndarray, counts: np.ndarray) -> Iterator[memoryview]:
        """For each text, its ids in decimal, or its tokens (the decoded text), joined by one space."""
        data, start, size = self._tables(kind)
        sizes = size[ids]
        out = memoryview(data[spread(start[ids], sizes)].tobytes())
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield out[a : max(a, b - 1)]

    @functools.cache  # noqa: B019  one object for each worker and file
    def _tables(self, kind: str):
        return self.texts_of(kind)


@functools.cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def in_texts(texts: pa.Array) -> Iterator[str | None]:
    """The texts of a column, in slices, so that few are held as Python strings."""
    for at in range(0, len(texts), 256):
        yield from texts.slice(at, 256).to_pylist()


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's number of ids, and digests of its ids and of the text decoded from them.

    Columns: id_col, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256.
    One row for each row of docs, repeated rows too; a null or empty text has no ids.
    """

    def run(batches):
        bpe = load(path)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for ids, counts in bpe.encode(in_texts(batch.column(1))):
                n.append(counts)
                ids_hex += [hashlib.sha256(x).hexdigest() for x in bpe.joined("decimal", ids, counts)]
                text_hex += [hashlib.sha256(x).hexdigest() for x in bpe.joined("token", ids, counts)]
            n = np.concatenate(n) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with a column of ids more, in place of one already called so."""
    place = docs.columns.index(text_col)
    kept = [n for n, c in enumerate(docs.columns) if c.lower() != ids_col.lower()]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            got = list(bpe.encode(in_texts(batch.column(place))))
            ids = np.concatenate([x for x, _ in got]) if got else np.empty(0, np.int32)
            ends = np.cumsum(np.concatenate([[0], *(c for _, c in got)]))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), column], names=[*(batch.schema.names[n] for n in kept), ids_col])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[n] for n in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of their ids more, in place of a column already called so: the tokens joined by one space; a null has an empty text."""
    place = rows.columns.index(ids_col)
    kept = [n for n, c in enumerate(rows.columns) if c.lower() != text_col.lower()]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            lists = [x or [] for x in batch.column(place).to_pylist()]
            ids = np.fromiter((i for x in lists for i in x), np.int64)
            texts = [bytes(x).decode() for x in bpe.joined("token", ids, np.array([len(x) for x in lists], np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string())], names=[*(batch.schema.names[n] for n in kept), text_col])

    return rows.mapInArrow(run, T.StructType([*(rows.schema.fields[n] for n in kept), T.StructField(text_col, T.StringType())]))
