"""BPE encoding and decoding with a public byte-level vocabulary, by batched numpy merge rounds.

Texts are cut into words by the vocabulary's split pattern. Words not met before are encoded
together: their symbols lie in one flat array; a round finds the rank of every neighbouring pair
by binary search over the sorted pair keys, takes the lowest rank of each word, and merges that
pair wherever the word has it (left to right). Words without a known pair are done and leave.
A worker remembers the ids of at most ``KNOWN_WORDS`` words and starts afresh beyond that.

Special tokens that stand in a text become their ids, as the library does by default. Decoding
joins the tokens' bytes; what is no UTF-8 becomes U+FFFD.

Results: null and empty texts have no tokens. Rows are independent of each other; long words and
long texts are encoded whole. The vocabulary's path is a parameter.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import lean

KNOWN_WORDS = 400_000
#: The split pattern of byte-level vocabularies (a fixed value), and the same for texts without ODD characters.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
QUICK = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")


@cache
def odd() -> re.Pattern:
    """Characters whose classes differ between the two patterns: marks, numbers that are no decimal digits, separators."""
    import unicodedata

    chars = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and _class(chr(i)) != _quick(chr(i), unicodedata)]
    runs = []
    for i in chars:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


_LETTERS, _NUMBERS, _SPACES = regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"\p{White_Space}")


def _class(c: str) -> str:
    return "L" if _LETTERS.match(c) else "N" if _NUMBERS.match(c) else "S" if _SPACES.match(c) else "O"


def _quick(c: str, unicodedata) -> str:
    if c.isspace():
        return "S"
    if c == "_" or not c.isalnum():
        return "O"
    return "N" if unicodedata.category(c) == "Nd" else "L"


SPLIT_ODD = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")


def split(text: str) -> list[str]:
    if text.isascii() and not _CONTROL.search(text) or not odd().search(text):
        return QUICK.findall(text)
    return SPLIT_ODD.findall(text)


_CONTROL = re.compile("[\x1c-\x1f]")


@cache
def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids, letters = file["model"]["vocab"], byte_letters()
        size = max([*ids.values(), *(x["id"] for x in file["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        key = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.merged = key[order], np.arange(len(pairs))[order].astype(np.int32), merged[order]
        self.by_rank = merged
        self.known: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        none = np.int32(2**31 - 1)
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        out: list[bytes] = [b""] * len(words)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            key = symbols[:-1] << 20 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.rank[at], none)
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            done = least == none
            if done.any():
                ids = symbols.astype("<u4")
                for w, a, n in zip(word[first[done]].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    out[w] = ids[a : a + n].tobytes()
                stay = np.repeat(~done, size)
                symbols, word, rank = symbols[stay], word[stay], rank[stay]
                least, size = least[~done], size[~done]
                if not len(symbols):
                    break
            here = rank == np.repeat(least, size)
            # of merges that would overlap (aaa) every other one goes, from the left
            if (here[1:] & here[:-1]).any():
                places = np.flatnonzero(here)
                begin = np.concatenate([[True], places[1:] != places[:-1] + 1])
                run = np.maximum.accumulate(np.where(begin, np.arange(len(places)), 0))
                here[places[(np.arange(len(places)) - run) % 2 == 1]] = False
            symbols[here] = self.by_rank[rank[here]]
            stay = np.ones(len(symbols), bool)
            stay[1:] = ~here[:-1]
            symbols, word = symbols[stay], word[stay]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        parts: list[list[str]] = []
        special: dict[int, list] = {}
        for i, text in enumerate(texts):
            if self.find_special and any(s in text for s in self.special):
                pieces = self.find_special.split(text)
                special[i] = [(p in self.special, p if p in self.special else split(p)) for p in pieces if p]
                parts.append([w for is_special, p in special[i] if not is_special for w in p])
            else:
                parts.append(split(text))
        fresh = list(set(itertools.chain.from_iterable(parts)) - self.known.keys())
        if len(self.known) + len(fresh) > KNOWN_WORDS and self.known:
            self.known.clear()
            fresh = list(set(itertools.chain.from_iterable(parts)))
        for a in range(0, len(fresh), 50_000):
            some = fresh[a : a + 50_000]
            self.known.update(zip(some, self.encode_words(some), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        for i, pieces in special.items():
            out[i] = b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if is_special else b"".join(map(get, p)) for is_special, p in pieces)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mapped(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], make) -> DataFrame:
    lean(df.sparkSession)
    names = {n.lower() for n, _ in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in names or f.name.lower() == column.lower()]
    source = next(f.name for f in df.schema.fields if f.name.lower() == column.lower())
    schema = T.StructType(keep + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for big in batches:
            for a in range(0, big.num_rows, 256):
                batch = big.slice(a, 256)
                out = f(batch.column(batch.schema.get_field_index(source)).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(k.name)) for k in keep] + out, names=[x.name for x in schema.fields])

    return df.mapInArrow(run, schema)


def with_ids(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``docs`` with the token ids of its texts, an array of integers."""

    def make():
        v = vocabulary(path)

        def run(texts: list) -> list[pa.Array]:
            got = [np.frombuffer(x, "<u4").astype(np.int32) for x in v.encode([t or "" for t in texts])]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(got) if got else np.zeros(0, np.int32)))]

        return run

    return _mapped(docs, text, [(ids, T.ArrayType(T.IntegerType()))], make)


def with_decoded(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of token ids."""

    def make():
        v = vocabulary(path)
        return lambda rows: [pa.array([v.decode(np.array(r or [], "<u4").tobytes()) for r in rows], pa.string())]

    return _mapped(docs, ids, [(decoded, T.StringType())], make)


def with_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, so ids need not leave the worker."""

    def make():
        v = vocabulary(path)

        def run(texts: list) -> list[pa.Array]:
            ids = v.encode([t or "" for t in texts])
            return [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]

        return run

    return _mapped(docs, text, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make)
