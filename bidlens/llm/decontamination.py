"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased (A-Z and U+00C0..U+00DE) and runs of white space become
one space. Lengths, edits and places count bytes of the result in UTF-8, so an edit of a CJK
character may cost three. An item of w bytes is found in a text if it aligns with a part of it
with at most k = floor(rate * w) edits. Such a part shares at least w - q + 1 - k * q q-grams with
the item, each at a place of its own in the text, and their diagonals (place in the text less place
in the item) differ by k at most. So places with shared q-grams are counted per item in overlapping
bands of k + 1 diagonals, bands that reach the bound are kept, and each is verified: an item that
stands unchanged in the text needs no more, others are aligned inside the band.

The items are sent to the workers in slices of at most ``SLICE_BYTES``; a larger benchmark takes
more than one pass. Where the bound is below 1 the item's budget is lowered until it is 1 (no edits
below 2 * Q bytes). Items of Q bytes or fewer are found without edits and at word bounds only:
where a side of the item is a letter, digit or underscore, what stands next to it is none (scripts
written without spaces have no bounds). ``least`` leaves out shorter items, by default none.

Results: a row per (document row, item) found, with the fewest edits and where the first such part
ends in the normalised text (``end_byte``). Null and empty texts and items find nothing; equal items
are found each under its own id, those with a null id in ``clean`` only; repeated rows repeat their
results. Texts are used whole; one that repeats an item's q-grams over and over costs time in
proportion to its length, not memory. Columns of the documents named item_id, edits or end_byte (any
case) give way in ``found``; ``clean`` keeps all columns.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import SPACE, chunks, column_bytes, lean, prefix_sums, substring_hashes
from .toxicity import lowered

Q = 10
RATE = 0.08
LEAST = 1
SLICE_BYTES = 4 << 20
#: Counts of a slice of shared q-grams, and cells of a batch of alignments: what a task holds at once of either.
ENTRIES = 1 << 18
CELLS = 1 << 16
_BITS = 22


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lowered(data)
    space = SPACE[low]
    keep = np.ones(len(low), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    edge = offs[:-1][offs[:-1] < len(low)]
    keep[edge] = True
    low[space] = 32
    return low[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each place on (Q - 1 fewer than bytes)."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = lambda i: np.ndarray((n,), "<u8", data.tobytes() if not data.flags.c_contiguous else data, i, (1,))
    return (at(0) * np.uint64(0x9E3779B97F4A7C15)) ^ (at(Q - 8) * np.uint64(0xC2B2AE3D27D4EB4F))


def _word(code: int) -> bool:
    """Is the code point part of a word that has bounds? Not in Thai to Myanmar, Khmer, kana and ideographs."""
    if 0x0E00 <= code < 0x10A0 or 0x1780 <= code < 0x1800 or 0x2E80 <= code < 0xA000 or 0xF900 <= code < 0xFB00 or code >= 0x20000:
        return False
    return code == 0x5F or unicodedata.category(chr(code))[0] in "LNM"


def word_bytes(data: np.ndarray) -> np.ndarray:
    """For each byte whether its character is part of a word."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    each, at = np.unique(codes, return_inverse=True)
    escaped = (codes >= 0xDC80) & (codes < 0xDD00)
    size = np.where((codes < 0x80) | escaped, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
    return np.repeat(np.array([_word(c) for c in each.tolist()], bool)[at], size)


class Short:
    """The items of Q bytes or fewer, by length."""

    def __init__(self, items: list[tuple[int, bytes]]):
        places: dict[int, dict[bytes, list[int]]] = {}
        for k, (_, t) in enumerate(items):
            if len(t) <= Q:
                places.setdefault(len(t), {}).setdefault(t, []).append(k)
        #: Length: both numbers of the items, and the places of each item by its numbers.
        self.of: dict[int, tuple[list[np.ndarray], dict[tuple[int, int], list[int]]]] = {}
        for size, by in places.items():
            codes = self.packed(np.frombuffer(b"".join(by), np.uint8).reshape(-1, size))
            self.of[size] = codes, dict(zip(zip(*(c.tolist() for c in codes), strict=True), by.values(), strict=True))

    @staticmethod
    def packed(rows: np.ndarray) -> list[np.ndarray]:
        """Two numbers for the bytes of each row, at most 8 and the rest."""
        out = []
        for part in (rows[:, :8], rows[:, 8:]):
            n = np.zeros(len(rows), np.uint64)
            for i in range(part.shape[1]):
                n = (n << np.uint64(8)) | part[:, i]
            out.append(n)
        return out

    def hits(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first end in the row) of items that stand in a row at word bounds."""
        if not self.of or not len(data):
            return
        word = word_bytes(data)
        for size, ((high, low), items) in self.of.items():
            n = len(data) - size + 1
            if n <= 0:
                continue
            a, b = self.packed(np.lib.stride_tricks.sliding_window_view(data, size))
            start = np.flatnonzero(np.isin(a, high) & np.isin(b, low))
            row = np.searchsorted(offs, start, "right") - 1
            end = start + size
            ok = end <= offs[row + 1]
            ok &= (start == offs[row]) | ~word[start] | ~word[np.maximum(start, 1) - 1]
            ok &= (end == offs[row + 1]) | ~word[end - 1] | ~word[np.minimum(end, len(data) - 1)]
            start, row = start[ok], row[ok]
            seen: set[tuple[int, tuple[int, int]]] = set()
            for r, s, *code in zip(row.tolist(), start.tolist(), a[start].tolist(), b[start].tolist(), strict=True):
                key = (r, tuple(code))
                if key in seen:
                    continue
                seen.add(key)
                for k in items.get(key[1], ()):
                    yield r, k, s + size - int(offs[r])


class Items:
    """The q-grams of the items, and for each item its length, edit budget and least count.

    Places of one q-gram in an item are held as intervals inside cells of budget + 1 places, at
    most about 20 for any item however often the q-gram stands in it.
    """

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.ids = [i for i, _ in items]
        self.texts = [np.frombuffer(t, np.uint8) for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.size = size
        # items of Q bytes or fewer have no q-gram to count; they are looked up in self.short
        self.edits = np.maximum(0, np.minimum(np.floor(rate * size).astype(np.int64), (size - Q) // Q))
        self.least = np.maximum(1, size - Q + 1 - self.edits * Q)
        self.step = self.edits + 1
        self.low = size + self.step  # added to a diagonal, it is positive
        keys = [grams(t) for t in self.texts]
        item = np.repeat(np.arange(len(items)), [len(k) for k in keys])
        place = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        cell = place // self.step[item]
        order = np.lexsort((place, item, flat))
        flat, item, place, cell = flat[order], item[order], place[order], cell[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
        at = np.flatnonzero(new)
        flat, self.item, self.least_place = flat[at], item[at], place[at]
        self.most_place = place[np.append(at[1:], len(new)) - 1] if len(at) else place
        self.keys, self.first = np.unique(flat, return_index=True)
        self.end = np.append(self.first[1:], len(flat)) if len(flat) else self.first
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.short = Short(items)

    def candidates(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, first diagonal in the row) of bands that hold enough shared q-grams.

        A band counts places of the text that share a q-gram with the item on one of its diagonals.
        Hits go through in slices of about ``ENTRIES`` counts; bands that the text has passed are
        settled after each, so memory follows the slice and the bands still open.
        """
        none = (np.zeros(0, np.int64),) * 3
        h = grams(data)
        if not len(h) or not len(self.keys):
            return none
        hit = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(hit):
            return none
        where = np.minimum(np.searchsorted(self.keys, h[hit]), len(self.keys) - 1)
        ok = self.keys[where] == h[hit]
        hit, where = hit[ok], where[ok]
        row = np.searchsorted(offs, hit, "right") - 1
        inside = hit + Q <= offs[row + 1]
        # a row with fewer shared q-grams than any item asks for
        inside &= np.bincount(row[inside], minlength=len(offs))[row] >= self.least[self.size > Q].min(initial=self.size.max(initial=1))
        hit, where, row = hit[inside], where[inside], row[inside]
        if not len(hit):
            return none
        per = self.end[where] - self.first[where]
        sums = np.cumsum(per)
        bands = int((len(data) + self.low.max()) // self.step.min()) + 4
        items = len(self.ids)
        open_code, open_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        kept: list[np.ndarray] = []
        a = 0
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + ENTRIES, "right")))
            n = per[a:b]
            entry = np.repeat(self.first[where[a:b]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            item = self.item[entry]
            base = np.repeat(hit[a:b] - offs[row[a:b]], n) + self.low[item]
            step = self.step[item]
            one, two = (base - self.most_place[entry]) // step, (base - self.least_place[entry]) // step  # band b holds cells b - 1 and b
            code = (np.repeat(row[a:b], n) * items + item) * bands
            more = two > one
            code, n = np.unique(np.concatenate([code + one, code + one + 1, code[more] + two[more] + 1]), return_counts=True)
            if len(open_code):
                code, at = np.unique(np.concatenate([open_code, code]), return_inverse=True)
                n = np.bincount(at, np.concatenate([open_n, n])).astype(np.int64)
            if b < len(hit):
                # a band's last place in the row is its number times the item's step
                item = code // bands % items
                past = (code // bands // items < row[b]) | (code % bands * self.step[item] < hit[b] - offs[row[b]])
            else:
                past = np.ones(len(code), bool)
            enough = past & (n >= self.least[code // bands % items])
            kept.append(code[enough])
            open_code, open_n = code[~past], n[~past]
            a = b
        code = np.concatenate(kept)
        item = code // bands % items
        return code // bands // items, item, (code % bands - 1) * self.step[item] - self.low[item]

    def align(self, data: np.ndarray, offs: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each candidate's item inside its band of diagonals, and the end of that part in the row.

        All candidates go through the rows of their alignments together.
        """
        edits = self.edits[item]
        width = 2 * int(self.step[item].max()) + 2 * int(edits.max(initial=0)) + 1
        low = diagonal - int(edits.max(initial=0))
        size, far = self.size[item], np.iinfo(np.int32).max // 2
        length = offs[row + 1] - offs[row]
        steps = np.arange(width)
        text = np.zeros((len(item), int(size.max())), np.uint8)
        for c, i in enumerate(item.tolist()):
            text[c, : size[c]] = self.texts[i]
        end = low[:, None] + steps  # where in the row the alignment of 0 bytes ends
        cost = np.where((end >= 0) & (end <= length[:, None]), 0, far)
        best, at = np.full(len(item), far), np.zeros(len(item), np.int64)
        for i in range(int(size.max())):
            end = low[:, None] + steps + i + 1
            here = (end >= 1) & (end <= length[:, None])
            same = data[np.clip(offs[row][:, None] + end - 1, 0, max(0, len(data) - 1))] == text[:, i : i + 1]
            step = np.where(here, cost + ~same, far)
            step[:, :-1] = np.minimum(step[:, :-1], np.where((end[:, :-1] >= 0) & (end[:, :-1] <= length[:, None]), cost[:, 1:] + 1, far))
            cost = np.minimum.accumulate(step - steps, 1) + steps
            cost = np.where((end >= 0) & (end <= length[:, None]), np.minimum(cost, far), far)
            done = size == i + 1
            if done.any():
                k = cost[done].argmin(1)
                best[done], at[done] = cost[done, k], end[done, k]
        return best, at

    def different(self, data: np.ndarray, offs: np.ndarray, row: np.ndarray, item: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Places of the candidates less those whose part of the row is, byte for byte, that of an earlier one: it aligns alike, further on."""
        if not len(row):
            return np.zeros(0, np.int64)
        start, end = diagonal - self.edits[item], diagonal + 2 * self.step[item] + self.edits[item] + self.size[item]
        length = offs[row + 1] - offs[row]
        sums = prefix_sums(data)
        part = substring_hashes(sums, offs[row] + np.maximum(start, 0), offs[row] + np.minimum(end, length))
        order = np.lexsort((diagonal, np.maximum(end - length, 0), np.minimum(start, 0), part, item, row))
        keys = np.stack([row, item, np.minimum(start, 0), np.maximum(end - length, 0), part.astype(np.int64)])[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
        return np.sort(order[new])

    def verified(self, data: np.ndarray, offs: np.ndarray, any_item: bool) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, edits, end) of what is found among the candidates, more than one of a row and item at times.

        A candidate's item that stands in its row unchanged is found without edits where it first
        stands; the others are aligned. With ``any_item`` a row that has one item is not gone on with.
        """
        row, item, diagonal = self.candidates(data, offs)
        settled = np.zeros(len(row), bool)
        whole: tuple[int, bytes] = (-1, b"")
        pairs, first = np.unique(row * len(self.ids) + item, return_index=True)
        for pair, k in zip(pairs.tolist(), first.tolist(), strict=True):
            r, i = divmod(pair, len(self.ids))
            if settled[k]:
                continue
            if whole[0] != r:
                whole = r, data[offs[r] : offs[r + 1]].tobytes()
            at = whole[1].find(self.texts[i].tobytes())
            if at >= 0:
                yield r, i, 0, at + int(self.size[i])
                a, b = np.searchsorted(row, [r, r + 1])
                settled[a:b] |= True if any_item else item[a:b] == i
        left = np.flatnonzero(~settled)
        left = left[self.different(data, offs, row[left], item[left], diagonal[left])]
        # candidates of like budgets go together, so that a long item doesn't widen the bands of short ones
        left = left[np.argsort(self.step[item[left]], kind="stable")]
        done: set[int] = set()
        a = 0
        while a < len(left):
            most = max(1, CELLS // (4 * int(self.step[item[left[a]]]) + 1))
            part = left[a : a + most]
            part = part[self.step[item[part]] <= 2 * self.step[item[part[0]]]]
            a += len(part)
            if any_item and done:
                part = part[~np.isin(row[part], list(done))]
            if not len(part):
                continue
            best, at = self.align(data, offs, row[part], item[part], diagonal[part])
            for k in np.flatnonzero(best <= self.edits[item[part]]).tolist():
                yield int(row[part[k]]), int(item[part[k]]), int(best[k]), int(at[k])
                if any_item:
                    done.add(int(row[part[k]]))

    def hits(self, column: pa.Array, any_item: bool = False) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, item) to (fewest edits, end) for what is found in a text column; with ``any_item`` at least one item of a row that has any."""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for start, _, d, o in chunks(*column_bytes(column)):
            d, o = normalised(d, o)
            for r, i, end in self.short.hits(d, o):
                out[r + start, i] = (0, end)
            for r, i, edits, end in self.verified(d, o, any_item):
                key, value = (r + start, i), (edits, end)
                out[key] = min(out.get(key, value), value)
        return out


def slices(benchmark: DataFrame, rate: float, least: int, nameless: bool = False) -> Iterator[Items]:
    """The benchmark's items, at most about SLICE_BYTES of text at a time; ``nameless`` keeps those with a null id."""
    lean(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    if not nameless:
        items = items.where("item_id is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // SLICE_BYTES)
    for part in range(n):
        plain = []
        rows = ((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part).distinct().collect())
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            raw = np.frombuffer(t.strip().encode(), np.uint8)
            norm = normalised(raw, np.array([0, len(raw)]))[0].tobytes()
            if len(norm) >= max(least, 1):
                plain.append((i, norm))
        if plain:
            yield Items(plain, rate)


def found(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` but its text, then item_id, edits and end_byte: a row for each item found in a row."""
    spark = docs.sparkSession
    text = next(f.name for f in docs.schema.fields if f.name.lower() == "text")
    keep = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in ("item_id", "edits", "end_byte")]
    schema = T.StructType(keep + [T.StructField(n, T.LongType()) for n in ("item_id", "edits", "end_byte")])
    out = spark.createDataFrame([], schema)
    for items in slices(benchmark, rate, least):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = shared.value.hits(batch.column(batch.schema.get_field_index(text)))
                if got:
                    rows = sorted(got)
                    picked = batch.take(pa.array([r for r, _ in rows], pa.int64()))
                    new = [[shared.value.ids[i] for _, i in rows], [got[x][0] for x in rows], [got[x][1] for x in rows]]
                    yield pa.RecordBatch.from_arrays([picked.column(picked.schema.get_field_index(f.name)) for f in keep] + [pa.array(c, pa.int64()) for c in new], names=schema.names)

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns."""
    text = next(f.name for f in docs.schema.fields if f.name.lower() == "text")
    for items in slices(benchmark, rate, least, nameless=True):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _ in shared.value.hits(batch.column(batch.schema.get_field_index(text)), True)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
