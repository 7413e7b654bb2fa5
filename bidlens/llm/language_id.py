"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters (what is no letter counts
as a space; n-grams without a letter don't count). The value of an n-gram is its share of the
text's n-grams times its inverse document frequency; document frequencies are counted over all
documents that may be learnt from. Weights are fitted by follow-the-regularised-leader with
L1 and L2 penalties on a bounded sample (``sample_per_language`` documents of each language,
chosen by a hash of the id, equal texts once; of more than ``languages`` languages the rarest are
not learnt); a quarter of the sample fits the temperature of the softmax.

Only documents with a non-null ``lang`` and crc32(doc_id as text) mod 4 != 2 are learnt from.
``lang``, ``source`` and ``doc_id`` are no inputs of a prediction.

Results: null texts and texts without a letter are ``und`` with score 0. Where nothing can be
learnt (an empty table, no languages) every text is ``und``. A null doc_id counts as held out
never (it has no remainder) and is not learnt from. Texts are used whole; equal texts are judged
alike, ties between languages go to the first by name. Columns of the documents named as the results
(any case) give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import chunks, column_bytes, lean, with_columns

BITS = 17
SLOTS = 1 << BITS
GAIN = 100.0
_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of each code point (spaces for what is no letter) and whether it is a letter."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    lower = np.full(0x110000, 32, np.uint32)
    for i in np.flatnonzero(letter).tolist():
        c = chr(i).lower()
        lower[i] = ord(c) if len(c) == 1 else i
    return lower, letter


def slots(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1, 2, 3 the slot of the n-gram at each character (0: none), rows' character offsets, letters by row."""
    lower, letter = tables()
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    is_letter = letter[points]
    c = lower[points]
    n = len(c)
    letters = np.add.reduceat(np.append(is_letter, False).astype(np.int64), np.minimum(at[:-1], n)) * (at[1:] > at[:-1])
    out = [np.where(is_letter, np.maximum((c * _MIX[0]) >> np.uint32(32 - BITS), np.uint32(1)), 0).astype(np.uint32)]
    h, some, ends = c * _MIX[1], is_letter, at[1:][at[1:] > 0]
    for k in (1, 2):
        h = h[:-1] * _MIX[2] + c[k:] * _MIX[3] if k < n else np.zeros(0, np.uint32)
        some = some[:-1] | is_letter[k:] if k < n else np.zeros(0, bool)
        x = np.zeros(n, np.uint32)
        x[: len(h)] = np.where(some, np.maximum(((h ^ (h >> np.uint32(15))) * _MIX[4 if k == 1 else 0]) >> np.uint32(32 - BITS), np.uint32(1)), 0)
        for b in range(1, k + 1):  # those that would run into the next row
            x[ends[ends >= b] - b] = 0
        out.append(x)
    return out, at, letters


def learnable(lang: str = "lang") -> Column:
    return F.col(lang).isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)


def summed(rows: DataFrame, tasks: int) -> np.ndarray | None:
    """Int64 arrays of a binary column summed by streaming tasks, 32 to one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_buffer(), np.int64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    while tasks > 1:
        tasks = -(-tasks // 32)
        rows = rows.repartition(tasks).mapInArrow(run, "sums binary")
    got = rows.collect()
    return np.frombuffer(got[0][0], np.int64) if got else None


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many texts each slot occurs; the last entry is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, here = np.zeros(SLOTS + 1, np.int64), np.zeros(SLOTS, np.uint8)
        part = np.zeros(SLOTS, np.uint16)
        rows = 0
        for batch in batches:
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                grams, at, _ = slots(d, o)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for x in grams:
                        here[x[a:b]] = 1
                    part += here
                    here[:] = 0
                    rows += 1
                    if rows % 60_000 == 0:
                        total[:SLOTS] += part
                        part[:] = 0
        if rows:
            total[:SLOTS] += part
            total[SLOTS] = rows
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    rows = docs.select("text").where("text is not null").mapInArrow(run, "sums binary")
    got = summed(rows, max(2, docs.rdd.getNumPartitions()))
    return got if got is not None else np.zeros(SLOTS + 1, np.int64)


def term_counts(docs: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, slots, counts) of the sampled documents, brought to the driver: the sample is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                grams, at, _ = slots(d, o)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    x, n = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
                    out.append((x[x > 0].astype(np.uint32).tobytes(), n[x > 0].astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], names=["lang", "slots", "n"])

    rows = docs.select("text", "lang").mapInArrow(run, "lang string, slots binary, n binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["slots"], r["n"], r["lang"]))
    return [(r["lang"], np.frombuffer(r["slots"], np.uint32), np.frombuffer(r["n"], np.uint32)) for r in rows]


class Model:
    """Per slot and language the weight times the inverse document frequency; bias; temperature."""

    def __init__(self, langs: list[str], values: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.values, self.bias, self.temperature = langs, values, bias, temperature

    def probabilities(self, sums: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = (sums * (GAIN / np.maximum(total, 1))[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fitted(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model | None:
    """Follow-the-regularised-leader on three quarters of the rows, the temperature on the rest."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    order = np.random.default_rng(7).permutation(len(rows))
    ready = [(langs.index(rows[i][0]), rows[i][1], (rows[i][2] / rows[i][2].sum() * GAIN * idf[rows[i][1]])) for i in order]
    cut = len(ready) - len(ready) // 4
    k = len(langs)
    z, n = np.zeros((SLOTS + 1, k)), np.zeros((SLOTS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for y, at, x in ready[:cut]:
            at, x = np.append(at, SLOTS), np.append(x, 1.0)
            w = weights(at)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SLOTS + 1))
    rest = ready[cut:] or ready
    logits = np.array([x @ w[at] + w[SLOTS] for _, at, x in rest])
    truth = np.array([y for y, _, _ in rest])

    def loss(t: float) -> float:
        q = logits / t
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), truth]).mean())

    lo, hi = np.log(0.5), np.log(20.0)
    for _ in range(60):  # ternary search
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    values = (w[:SLOTS] * idf[:, None]).astype(np.float32)
    values[0] = 0
    return Model(langs, values, w[SLOTS], float(np.exp((lo + hi) / 2)))


def train(docs: DataFrame, sample_per_language: int = 500, languages: int = 1000) -> Model | None:
    """A model learnt from ``docs`` (doc_id, text, lang); of more than ``languages`` languages the rarest are not learnt."""
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(learnable())
    share = docs.where("text is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    share = F.broadcast(share.select("lang", (F.lit(float(sample_per_language)) / F.col("count")).alias("share")))  # a row per language
    picked = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    # equal texts count once, so that a row repeated many times can't make the sample large
    rows = term_counts(docs.where("text is not null").join(share, "lang").where(picked).select("lang", "text").distinct())
    df = document_frequencies(docs)
    idf = (np.log((1 + df[SLOTS]) / (1 + df[:SLOTS])) + 1).astype(np.float64)
    return fitted(rows, idf)


def with_language(docs: DataFrame, model: Model | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(data: np.ndarray, offs: np.ndarray) -> list:
            rows = len(offs) - 1
            if m is None or not len(data):
                return [pa.array(["und"] * rows), np.zeros(rows)]
            grams, at, letters = slots(data, offs)
            full = at[1:] > at[:-1]
            begin = at[:-1][full]
            sums, total = np.zeros((rows, len(m.langs))), np.zeros(rows)
            if len(begin):
                for x in grams:
                    for k in range(len(m.langs)):
                        sums[full, k] += np.add.reduceat(columns[k][x], begin, dtype=np.float64)
                    total[full] += np.add.reduceat(x > 0, begin, dtype=np.int64)
            p = m.probabilities(sums, total)
            best = p.argmax(1)
            some = letters > 0
            return [pa.array([m.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]), np.where(some, p[np.arange(rows), best], 0.0)]

        columns = [np.ascontiguousarray(m.values[:, k]) for k in range(len(m.langs))] if m is not None else []
        return run

    return with_columns(docs, [(lang, T.StringType()), (score, T.DoubleType())], make)
