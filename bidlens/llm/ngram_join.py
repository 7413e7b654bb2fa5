"""N-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

Two documents link when ``100 * |A & B| >= 80 * |A | B|`` over their sets of distinct word
5-grams (A-Z lower-cased; words are runs without U+0020 and U+0009..U+000D; a text of one to
four words is one n-gram as a whole). Texts without words, and nulls, link with nothing.

The product A x A' is never formed as a whole:

1. Documents with equal sets are one *node* (a 64-bit signature of the set).
2. N-grams have a total order: first the common ones (by a counting sketch of fixed size,
   summed over all documents) from rare to frequent, ties by hash. Of a set of size n only the
   first ``n - ceil(0.8 n) + 1`` n-grams are kept (any linked partner shares one of them).
3. The kept incidence is cut into blocks by n-gram. Each block's product accumulates overlap
   counts per pair of nodes; counts of all blocks are summed, and a pair whose count plus all
   it could still share stays below the overlap that its two sizes need is discarded.
   For frequent n-grams a block does not form all pairs: it links members to a pivot only.
4. Remaining pairs are verified on the whole sets, first one per node, then those whose ends
   are still in different components; a pair inside a component can change nothing.
5. Nodes that keep frequent n-grams and are tied together by them, but lie in more than one
   component, go through a product in blocks of ``SIDE`` x ``SIDE`` nodes; its pairs of different
   components that reach the needed overlap are verified too.

Results: a row per input row; ``component_id`` is the smallest doc_id reachable by links.
Null texts and empty texts: n_shingles 0, own doc_id. Null doc_ids take part and are
ignored as names (a component of null ids only has a null component_id). Repeated rows stay. Of the
columns only doc_id and text are read, so other names don't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import LOWER, chunks, column_bytes, mix, prefix_sums, remove, settled, small_batches, substring_hashes, words, written

#: The counting sketch has so many slots (as a power of two) that each counts about SLOT_LOAD n-grams, within these limits.
SKETCH_BITS, SLOT_LOAD = (18, 25), 10
#: Kept n-grams in one block of the product.
BLOCK_ENTRIES = 1_000_000
#: An n-gram counts as frequent from this many times the sketch's mean, plus FREQUENT.
FREQUENT_MEANS, FREQUENT = 1.5, 24
#: Nodes and bytes of n-grams on each side of a block of the product over frequent n-grams, and n-grams in one step of it.
SIDE, SIDE_BYTES, STEP = 2048, 16 << 20, 2048
#: Bits of a table that tells wanted rows from most others.
TABLE_BITS = 1 << 26
#: So many edges at most (24 MB) go through one task for their components.
EDGES = 1_500_000

_K = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row the sorted distinct hashes of its word n-grams."""
    if not len(data):
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    lower = LOWER[data]
    starts, ends, at = words(lower, offs)
    h = substring_hashes(prefix_sums(lower), starts, ends)
    grams = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        grams += h[i : i + len(grams)] * _K[i]
    grams = mix(grams)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(grams[a : b - size + 1])
            new = np.empty(len(x), bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            out.append(x[new])
        elif b > a:
            out.append(mix(np.array([(sum(int(h[a + i]) * int(_K[i]) for i in range(b - a)) + b - a) % 2**64], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(x: np.ndarray) -> int:
    """A 64-bit signature of a set of hashes."""
    return int(np.add.reduce(mix(x ^ _K[1]))) & (2**64 - 1)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def kept(n: np.ndarray | int):
    """How many first n-grams of a set of size n are kept."""
    return n - (4 * n + 4) // 5 + 1


def compared(n: np.ndarray | int):
    """How many first n-grams the product over frequent ones compares: three in five."""
    return (3 * n + 4) // 5


def needed(n: np.ndarray, m: np.ndarray, first=kept) -> np.ndarray:
    """What linked sets of sizes n and m share at least of their first n-grams.

    They share 4/9 of n + m. Of the set whose first part ends earlier in the order, what it shares
    later is no more than its rest; which one that is isn't known, so the larger rest counts.
    """
    return np.maximum(1, (4 * (n + m) + 8) // 9 - np.maximum(n - first(n), m - first(m)))


def sketch_bits(docs: DataFrame) -> int:
    """By the planner's estimate of the input's size: about 0.3 n-grams a stored byte."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(SKETCH_BITS[1], max(SKETCH_BITS[0], int(0.3 * size / SLOT_LOAD).bit_length()))


def described(docs: DataFrame, bits: int) -> DataFrame:
    """kind 0: doc_id, n, signature and key of each document; kind 1: each task's sketch of n-gram counts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        shift = np.uint64(64 - bits)
        for batch in batches:
            ids, ns, sigs = batch.column(0), [], []
            for _, _, d, o in chunks(*column_bytes(batch.column(1))):
                sets = shingle_sets(d, o)
                ns += map(len, sets)
                sigs += [signed(signature(x)) if len(x) else None for x in sets]
                np.add.at(counts, (np.concatenate(sets) >> shift).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(ns), pa.int32()), ids, pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), batch.column(2), pa.nulls(len(ns), pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([zlib.compress(counts.tobytes(), 1)])], names=names)

    names = ["kind", "doc_id", "n", "sig", "key", "counts"]
    return docs.select("doc_id", "text", "key").mapInArrow(run, "kind int, doc_id long, n long, sig long, key long, counts binary")


def classes(counts: np.ndarray) -> np.ndarray:
    """0 for n-grams that are not frequent, else 1 and up by the logarithm of the count."""
    line = FREQUENT_MEANS * float(counts.mean()) + FREQUENT
    out = np.zeros(len(counts), np.uint8)
    often = np.flatnonzero(counts > line)
    out[often] = 1 + np.log2(counts[often]).astype(np.uint8)
    return out


def sketch_classes(rows: DataFrame, tasks: int) -> bytes:
    """The class of each slot, compressed: the tasks' sketches summed by a tree of streaming sums that each hold one sketch."""

    def run(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
                total = v.copy() if total is None else np.where(total + v < total, np.uint32(2**32 - 1), total + v)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress((classes(total) if last else total).tobytes(), 1)])], names=["counts"])

    rows = rows.select("counts")
    while True:
        tasks = max(1, -(-tasks // 32))
        rows = rows.repartition(tasks).mapInArrow(lambda b, last=tasks == 1: run(b, last), "counts binary")
        if tasks == 1:
            break
    got = rows.collect()
    return bytes(got[0][0]) if got else b""


def class_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8) if packed else np.zeros(2, np.uint8)


def incidence(docs: DataFrame, table, blocks: int) -> DataFrame:
    """The kept incidence, packed: for a block its nodes (signature, size, kept frequent n-grams), entries a node and entries.

    A task sends a node once, however often its text is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = class_table(table.value)
        shift = np.uint64(65 - len(cls).bit_length())
        seen: set[int] = set()
        held: list[tuple] = []
        entries = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sizes = np.array([len(k) for *_, k in held])
            keys, node = np.concatenate([k for *_, k in held]), np.repeat(np.arange(len(held)), sizes)
            block = (mix(keys) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            keys, node, block = keys[order], node[order], block[order]
            sig, n, hot = (np.array([h[i] for h in held], t) for i, t in ((0, np.uint64), (1, np.uint32), (2, np.uint32)))
            edges = np.flatnonzero(np.diff(block)) + 1
            rows = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)], strict=True):
                own, per = np.unique(node[a:b], return_counts=True)
                rows.append((int(block[a]), sig[own].tobytes(), n[own].tobytes(), hot[own].tobytes(), per.astype(np.uint32).tobytes(), keys[a:b].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["block", "sig", "n", "hot", "per", "entries"])
            held.clear()

        for batch in batches:
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                for x in shingle_sets(d, o):
                    if not len(x) or (s := signature(x)) in seen:
                        continue
                    seen.add(s)
                    c = cls[x >> shift]
                    keys = (c.astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8))
                    p = kept(len(x))
                    keys = np.partition(keys, p - 1)[:p] if p < len(keys) else keys
                    hot = int((keys >> np.uint64(56) > 0).sum())
                    held.append((s, len(x), hot, keys))
                    entries += len(keys)
                if entries > 500_000:
                    yield from flush()
                    entries = 0
        yield from flush()

    return docs.select("text").mapInArrow(run, "block int, sig binary, n binary, hot binary, per binary, entries binary").repartition(blocks, "block")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """A task's blocks one at a time, by ``sorted_entries``; those that wait stay packed."""
    held: dict[int, list[tuple[bytes, ...]]] = {}
    for batch in batches:
        for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(block, []).append(tuple(row))
    while held:
        yield sorted_entries(held.popitem()[1])


def sorted_entries(rows: list[tuple[bytes, ...]]) -> tuple[np.ndarray, ...]:
    """All entries of a block as (key, signature, size, frequent), sorted by key and signature, without repeats."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for sig, n, hot, per, keys in rows:
        per = np.frombuffer(per, np.uint32)
        parts[0].append(np.frombuffer(keys, np.uint64))
        for i, (x, t) in enumerate(((sig, np.uint64), (n, np.uint32), (hot, np.uint32)), 1):
            parts[i].append(np.repeat(np.frombuffer(x, t), per))
    key, sig, n, hot = (np.concatenate(p) for p in parts)
    # entries whose key stands alone cannot pair; they go before the full sort
    order = np.argsort(key)
    key, sig, n, hot = key[order], sig[order], n[order], hot[order]
    same = key[1:] == key[:-1]
    more = np.zeros(len(key), bool)
    more[1:] |= same
    more[:-1] |= same
    key, sig, n, hot = key[more], sig[more], n[more], hot[more]
    order = np.lexsort((sig, key))
    key, sig, n, hot = key[order], sig[order], n[order], hot[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    return key[new], sig[new], n[new], hot[new]


def block_pairs(key: np.ndarray, sig: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Pairs of places whose nodes share an entry and fit by size: (i, j, is the entry frequent?)."""
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    lows, highs = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    frequent = key >> np.uint64(56) > 0
    size = highs - lows
    fits = lambda i, j: 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    for k in np.unique(size):  # groups of equal size go through one product together
        if k < 2:
            continue
        up, down = np.triu_indices(k, 1) if k <= 4096 else (None, None)
        for often in (False, True):
            low = lows[(size == k) & (frequent[lows] == often)]
            if not often and up is None:  # a large group: a row of the product at a time
                for a in low.tolist():
                    for i in range(a, a + k - 1):
                        j = np.arange(i + 1, a + k)
                        j = j[fits(np.full(len(j), i), j)]
                        yield np.full(len(j), i), j, False
                continue
            if often:
                # everyone with the member in the middle by size, and neighbours by size
                for a in low.tolist():
                    by = a + np.argsort(n[a : a + k], kind="stable")
                    for i, j in ((np.full(k, by[k // 2]), by), (by[:-1], by[1:])):
                        ok = fits(i, j) & (i != j)
                        yield i[ok], j[ok], True
                continue
            step = max(1, 200_000 // (k * k))
            for s in range(0, len(low), step):
                i, j = (low[s : s + step, None] + up).ravel(), (low[s : s + step, None] + down).ravel()
                ok = fits(i, j)
                yield i[ok], j[ok], False


PAIR = "a long, b long, na long, nb long, ha long, hb long, c long, f long"


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Overlap counts of pairs of nodes within each block: c over entries that are not frequent, f over frequent ones."""

    def counted(key: np.ndarray, sig: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            i, j, f = (np.concatenate(x) for x in zip(*held, strict=True))
            swap = sig[i] > sig[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            order = np.lexsort((sig[j], sig[i]))
            i, j, f = i[order], j[order], f[order]
            a, b = sig[i], sig[j]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            hots = np.add.reduceat(f.astype(np.int64), first)
            total = np.diff(np.append(first, len(a)))
            i, j = i[first], j[first]
            cols = [sig[i].view(np.int64), sig[j].view(np.int64), n[i], n[j], hot[i], hot[j], total - hots, hots]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=[x.split()[0] for x in PAIR.split(", ")])
            held.clear()

        for i, j, f in block_pairs(key, sig, n):
            if len(i):
                held.append((i, j, np.full(len(i), f)))
                size += len(i)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in unpacked(batches):
            if len(entries[0]):
                yield from counted(*entries)

    return blocks.mapInArrow(run, PAIR)


def frequent_rows(docs: DataFrame, table) -> DataFrame:
    """sig, n, first, ties, keys: nodes that keep frequent n-grams, with the first of these, all, and the n-grams to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, seen = class_table(table.value), set()
        shift = np.uint64(65 - len(cls).bit_length())
        for batch in batches:
            out = []
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                for x in shingle_sets(d, o):
                    c = cls[x >> shift]
                    if not c.any() or (s := signature(x)) in seen:
                        continue
                    seen.add(s)
                    keys = np.sort((c.astype(np.uint64) << np.uint64(56)) | (x >> np.uint64(8)))
                    ties = keys[: kept(len(x))]
                    ties = ties[ties >> np.uint64(56) > 0]
                    if len(ties):
                        out.append((signed(s), len(x), signed(int(ties[0])), ties.tobytes(), keys[: compared(len(x))].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["sig", "n", "first", "ties", "keys"])

    return docs.select("text").mapInArrow(run, "sig long, n long, first long, ties binary, keys binary")


def frequent_pairs(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """a, b, weight: nodes of different components that share as many of their first n-grams as their sizes need.

    Nodes are tied together by frequent n-grams they share; such a group goes through the product in
    blocks of SIDE nodes (or SIDE_BYTES) a side, so no task holds more than two sides. Groups inside
    one component are left out.
    """

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for x in batch.column(0):
                k = np.frombuffer(x.as_buffer(), np.int64).tolist()
                new = [(k[0], y) for y in k[1:] if (k[0], y) not in done]
                if len(done) < 1_000_000:
                    done.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*new, strict=True)], names=["a", "b"])

    tied = components(nodes.select("ties").mapInArrow(ties, "a long, b long").distinct())
    df = nodes.join(tied.withColumnsRenamed({"sig": "first", "comp": "label"}), "first", "left").join(comps, "sig", "left")
    df = df.select(F.coalesce("label", "first").alias("label"), F.coalesce("comp", "sig").alias("comp"), "sig", "n", "keys")
    df = written(df, "frequent")
    groups = df.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / SIDE), F.ceil(F.sum(F.octet_length("keys")) / SIDE_BYTES)).cast("int").alias("sides"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("label", "sides")
    df = df.join(groups, "label").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("sides")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    df = df.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "n", "comp", "keys")

    def product(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own, sig, n, comp, keys = zip(*rows, strict=True)
        own, sig, n, comp = (np.array(x, np.int64) for x in (own, sig, n, comp))
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        if len(np.unique(comp)) < 2:
            return
        flat = np.concatenate([np.frombuffer(k, np.uint64) for k in keys])
        node = np.repeat(np.arange(len(keys)), [len(k) // 8 for k in keys])
        column = np.unique(flat, return_inverse=True)[1]
        place = np.zeros(len(keys), np.int64)
        place[left] = np.arange(len(left))
        shared = np.zeros((len(left), len(right)), np.float32)
        for s in range(0, int(column.max()) + 1, STEP):
            part = (column >= s) & (column < s + STEP)
            sides = []
            for side in (left, right):
                member = np.full(len(keys), -1)
                member[side] = np.arange(len(side))
                use = part & (member[node] >= 0)
                m = np.zeros((len(side), STEP), np.float32)
                m[member[node[use]], column[use] - s] = 1
                sides.append(m)
            shared += sides[0] @ sides[1].T
        nl, nr = n[left][:, None], n[right][None, :]
        ok = (comp[left][:, None] != comp[right][None, :]) & (5 * np.minimum(nl, nr) >= 4 * np.maximum(nl, nr)) & (shared >= needed(nl, nr, compared))
        if own.min() == own.max():
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        if len(i):
            a, b = sig[left[i]], sig[right[j]]
            ua, ub = a.view(np.uint64), b.view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(ua < ub, a, b)), pa.array(np.where(ua < ub, b, a)), pa.array(shared[i, j].astype(np.int64))], names=["a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for label, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, i, j) != at:
                    if held:
                        yield from product(held)
                    at, held = (label, i, j), []
                held.append(tuple(row))
        if held:
            yield from product(held)

    return df.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j").mapInArrow(run, "a long, b long, weight long")


def bit_table(values: DataFrame) -> bytes:
    """TABLE_BITS bits, compressed; those at the longs in the only column of ``values`` (modulo TABLE_BITS) are set.

    Tasks send places, 32 tasks make tables of them and one joins these, so no task holds more than two tables.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(batch.column(0).to_numpy(zero_copy_only=False) % TABLE_BITS).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()])], names=["x"])

    def joined(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for x in batch.column(0):
                table = np.zeros(TABLE_BITS // 8, np.uint8) if table is None else table
                if whole:
                    table |= np.frombuffer(zlib.decompress(x.as_buffer()), np.uint8)
                else:
                    at = np.frombuffer(x.as_buffer(), np.uint32)
                    np.bitwise_or.at(table, at >> np.uint32(3), np.uint8(1) << (at & np.uint32(7)).astype(np.uint8))
        if table is not None:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.tobytes(), 1)])], names=["x"])

    rows = values.mapInArrow(places, "x binary")
    for tasks, whole in ((32, False), (1, True)):
        rows = rows.repartition(tasks).mapInArrow(lambda b, whole=whole: joined(b, whole), "x binary")
    got = rows.collect()
    return bytes(got[0][0]) if got else b""


def unpacked_table(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8) if packed else np.zeros(TABLE_BITS // 8, np.uint8)


def in_table(df: DataFrame, packed: bytes, value: Column) -> Column:
    """Is the bit of ``value`` (a long, not null) set in ``bit_table``'s result? A column of ``df``; few other values share a bit with wanted ones."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        on = unpacked_table(shared.value)
        for x in parts:
            at = x.to_numpy(zero_copy_only=False) % TABLE_BITS
            yield pa.array((on[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return F.arrow_udf(run, "boolean")(value)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, items: the whole sets of the wanted nodes. A bit table of fixed size passes them and few others."""
    bits = TABLE_BITS
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select("sig")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = unpacked_table(shared.value)
        seen: set[int] = set()
        for batch in batches:
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                out = []
                for x in shingle_sets(d, o):
                    if len(x):
                        s = signed(signature(x))
                        at = s % bits
                        if on[at >> 3] >> (at & 7) & 1 and s not in seen:
                            seen.add(s)
                            out.append((s, x.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["sig", "items"])

    return docs.select("text").mapInArrow(run, "sig long, items binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= 80 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # a row holds two whole sets, so few go into a batch
    one = pairs.select("a", "b").join(sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a")
    two = one.join(sets.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    with small_batches(pairs.sparkSession, 100):
        return written(two.mapInArrow(run, "a long, b long"), "verified")


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges (u, v), and for each the smallest node of its component: roots hook onto smaller ones, then paths are cut short."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def components(edges: DataFrame) -> DataFrame:
    """sig, comp: for every node of an edge the smallest node of its component.

    Up to EDGES edges go through one task. Of more, labels fall to the least among neighbours and then
    jump to their label's label, until none changes; such rounds take many jobs each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            found = least_nodes(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["sig", "comp"])

    once = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
    once = written(once, "edges")
    if once.count() <= EDGES:
        out = written(once.coalesce(1).mapInArrow(run, "sig long, comp long"), "labels")
        remove(once)
        return out
    both = once.union(once.select("v", "u"))
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("l")), "labels")
    old = None
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v", "l": "lv"}), "v").groupBy("u").agg(F.min("lv").alias("m"))
        step = labels.join(near, "u").select("u", F.least("l", "m").alias("n"), "l")
        jump = step.alias("s").join(labels.select(F.col("u").alias("n"), F.col("l").alias("nl")), "n", "left").select("u", F.least("n", F.coalesce("nl", "n")).alias("l"), (F.least("n", F.coalesce("nl", "n")) < F.col("l")).alias("moved"))
        new = written(jump, "labels")
        if old is not None:
            remove(old)
        old, labels = new, new.select("u", "l")
        if not new.where("moved").limit(1).count():
            break
    remove(once)
    return labels.select(F.col("u").alias("sig"), F.col("l").alias("comp"))


def linked(pairs: DataFrame, sets: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the links among ``pairs`` (a, b, weight), and the components.

    The heaviest pair of each node is verified first; of the rest only pairs that are then still in
    different components, since a link inside a component would change nothing.
    """
    pair = F.struct("weight", "a", "b")
    best = pairs.select(F.explode(F.array("a", "b")).alias("u"), pair.alias("p")).groupBy("u").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
    best = written(best, "best")
    found = verified(best, sets)
    edges = written(edges.union(found), "links") if edges is not None else found
    comps = components(edges)
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    rest = rest.join(comps.withColumnsRenamed({"sig": "a", "comp": "ca"}), "a", "left").join(comps.withColumnsRenamed({"sig": "b", "comp": "cb"}), "b", "left")
    rest = written(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
    if rest.limit(1).count():
        edges = written(edges.union(verified(rest, sets)), "links")
        comps = components(edges)
    return edges, comps


@settled
def jaccard_components(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns are ignored).

    With ``key`` (a long of each row) also that, and group: one number for all rows of a component, null for rows without words.
    """
    spark = docs.sparkSession
    extra = [] if key is None else ["key", "group"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(None) if key is None else key).cast("long").alias("key"))
    known = written(described(docs, sketch_bits(docs)), "sets")
    rows = known.where("kind = 0")
    nodes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    total, tasks = known.agg(F.coalesce(F.sum(F.expr("case when kind = 0 and n > 0 then n - floor((4 * n + 4) / 5) + 1 end")), F.lit(0)), F.count_if(F.col("kind") == 1)).first()
    table = spark.sparkContext.broadcast(sketch_classes(known.where("kind = 1"), tasks))
    blocks = max(1, -(-int(total) // BLOCK_ENTRIES), min(64, spark.sparkContext.defaultParallelism))

    pairs = pair_counts(incidence(docs, table, blocks)).groupBy("a", "b").agg(*(F.max(x).alias(x) for x in ("na", "nb", "ha", "hb")), F.sum("c").alias("c"), F.sum("f").alias("f"))
    need = F.expr("greatest(1, floor((4 * (na + nb) + 8) / 9) - greatest(floor((4 * na + 4) / 5) - 1, floor((4 * nb + 4) / 5) - 1))")
    pairs = written(pairs.where((F.col("c") + F.least("ha", "hb") >= need)).select("a", "b", "na", "nb", "c", "f"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = written(sets_of(docs, wanted), "whole").dropDuplicates(["sig"])

    edges, comps = linked(pairs.select("a", "b", (F.col("c") * 1_000_000 + F.col("f")).alias("weight")), sets)
    # pairs that the steps above never formed can link, whatever became of those they formed, so this always runs
    fresh = written(frequent_pairs(frequent_rows(docs, table).dropDuplicates(["sig"]), comps), "fresh")
    if fresh.limit(1).count():
        more = written(sets_of(docs, fresh.select(F.explode(F.array("a", "b")).alias("sig")).distinct()), "whole").dropDuplicates(["sig"])
        edges, comps = linked(fresh, more, edges)
    names = nodes.join(comps, "sig", "left").select("sig", "first", F.coalesce("comp", "sig").alias("comp"))
    least = names.groupBy("comp").agg(F.min("first").alias("component_id"))
    names = names.join(least, "comp").select("sig", "component_id", F.col("comp").alias("group"))
    return rows.join(names, "sig", "left").select(*extra, "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
