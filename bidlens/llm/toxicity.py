"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

*Voters* fire on a text or abstain. Each asks for one, two or four words that are, or begin with,
something: a fixed lexicon, and patterns mined from labelled training documents (words and word
beginnings of 4 to 7 bytes that occur in toxic documents far more often than in others).

The *label model* sees only how often voters fire alone and together over all documents. Under
independence given the label the covariance of two voters is the product of their single factors,
so triples of voters give each factor, and with the class prior each voter's firing rates in
toxic and clean texts. What a pair's covariance leaves over is its correlation; correlated voters
share their weight. The posterior of a text follows from the voters that fire.

The *classifier* is a logistic regression on hashed words and word beginnings (that a text has one,
two or four of), fitted with an L1 penalty to posterior labels of a bounded sample of documents
(``sample_toxic`` and ``sample_other`` labelled ones, ``sample_unlabelled`` others). Where a sampled
document has a label, that is one more voter of its posterior, right with odds ``gold`` (1: no vote).
At most ``voters`` voters are used, the best first.

Labels come only from documents with crc32(doc_id as text) mod 5 != 0; labels, lang, source and
doc_id are no inputs of a score. Null and empty texts get the score of a text without features.
Without any labels the lexicon alone votes. A label that is null is none; a document with two
labels counts as toxic if one of them says so. Of labelled rows that repeat an id the first text by
order is learnt from, of unlabelled rows each text once; equal texts have equal scores. Texts are used
whole. A column of the documents named as the score (any case) gives way. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import LOWER, chunks, column_bytes, lean, prefix_sums, substring_hashes, with_columns, words
from .language_id import summed

#: Words that insult, as a fixed starting lexicon.
LEXICON = (
    "idiot", "idiots", "idiotic", "moron", "morons", "stupid", "loser", "losers", "pathetic", "scum", "trash", "worthless", "disgusting", "clown", "dumb", "imbecile",
    "dummkopf", "trottel", "abschaum", "arschloch", "widerlich", "connard", "salaud", "imbécile", "débile", "ordure", "estúpido", "estúpida", "imbécil", "basura", "asqueroso", "idiota", "idiote",
)
#: Bytes of word beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: A feature counts once for each of these numbers of occurrences that a text has.
LEVELS = (1, 2, 4)
BITS = 20
MAX_VOTERS = 128
#: Odds that a label, one voter among the others, is right.
GOLD = 99.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the letters U+00C0 to U+00DE."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    out[at] += 32
    return out


def features(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of words, then of word beginnings of each length."""
    low = lowered(data)
    starts, ends, at = words(low, offs, _LETTER[low])
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    sums = prefix_sums(low)
    yield row, substring_hashes(sums, starts, ends)
    for k in BEGINNINGS:
        long = ends - starts > k
        yield row[long], substring_hashes(sums, starts[long], starts[long] + k) ^ np.uint64(k)


def hashed(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(next(iter(features(data, np.array([0, len(data)]))))[1][0])


def trainable() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def counted(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the distinct pairs, in order."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], key[first], np.diff(np.append(first, len(key)))


def sample_features(docs: DataFrame) -> list[tuple[int | None, np.ndarray, np.ndarray]]:
    """(label, distinct hashes, their counts) of the rows of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                row, h, n = counted(*(np.concatenate(x) for x in zip(*features(d, o), strict=True)))
                n = np.minimum(n, LEVELS[-1]).astype(np.uint8)
                cut = np.searchsorted(row, np.arange(len(o)))
                out += [(h[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], names=["toxic", "hashes", "n"])

    rows = docs.select("text", "toxic").mapInArrow(run, "toxic int, hashes binary, n binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["hashes"], r["n"], -1 if r["toxic"] is None else r["toxic"]))
    return [(r["toxic"], np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["n"], np.uint8)) for r in rows]


def mined(rows: list[tuple[int | None, np.ndarray, np.ndarray]], known: list[tuple[int, int]], most: int = MAX_VOTERS) -> list[tuple[int, int]]:
    """``known`` and then (hash, level) pairs that at least 3 toxic documents have, 15 times as often as others do.

    Best first; a pair that has nearly the documents of one before it is left out.
    """
    toxic, other = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    if not toxic or not other:
        return known[:most]
    doc = np.repeat(np.arange(len(toxic)), [len(h) for _, h, _ in toxic])
    keys, count = np.concatenate([h for _, h, _ in toxic]), np.concatenate([n for *_, n in toxic])
    rest, counts = np.concatenate([h for _, h, _ in other]), np.concatenate([n for *_, n in other])
    found = []
    for level in LEVELS:
        have, n = np.unique(keys[count >= level], return_counts=True)
        have, n = have[n >= 3], n[n >= 3]
        there, m = np.unique(rest[counts >= level], return_counts=True)
        at = np.minimum(np.searchsorted(there, have), max(0, len(there) - 1))
        m = np.where(there[at] == have, m[at], 0) if len(there) else np.zeros(len(have))
        ratio = (n / len(toxic)) / ((m + 0.5) / len(other))
        found += [(-float(k * np.log(r)), int(h), level) for h, k, r in zip(have, n, ratio, strict=True) if r >= 15]
    ordered = [(h, level) for _, h, level in sorted(found)]
    order = np.argsort(keys, kind="stable")
    keys, count, doc = keys[order], count[order], doc[order]

    def members(pair: tuple[int, int]) -> np.ndarray:
        a, b = np.searchsorted(keys, np.uint64(pair[0])), np.searchsorted(keys, np.uint64(pair[0]), "right")
        out = np.zeros(len(toxic), bool)
        out[doc[a:b][count[a:b] >= pair[1]]] = True
        return out

    out = list(known)
    taken = [x for x in map(members, known) if x.any()]
    for pair in ordered:
        if len(out) >= most:
            break
        x = members(pair)
        if all((x & y).sum() < 0.9 * (x | y).sum() for y in taken):
            out.append(pair)
            taken.append(x)
    return out


class Voters:
    """Exact lookup of hashes in a small table; a voter is a hash and the count it asks for."""

    def __init__(self, pairs: list[tuple[int, int]]):
        self.hash, self.level = np.array([h for h, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)
        self.bases = np.unique(self.hash)
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.bases >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def fired(self, row: np.ndarray, h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, voter) pairs, from features with their counts or one by one."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        at = at[self.bases[np.minimum(np.searchsorted(self.bases, h[at]), len(self.bases) - 1)] == h[at]] if len(self.bases) else at[:0]
        row, h, n = counted(row[at], h[at]) if n is None else (row[at], h[at], n[at])
        hit = (h[:, None] == self.hash) & (n[:, None] >= self.level)
        where, voter = np.nonzero(hit)
        return row[where], voter


def vote_counts(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray]:
    """Over all documents: how many, and how often each two voters fire together (a voter alone on the diagonal)."""
    m = len(voters.hash)
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = shared.value, np.zeros(m * m + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, _, d, o in chunks(*column_bytes(batch.column(0))):
                got = [v.fired(row, h) for row, h in features(d, o)]
                row, voter = (np.concatenate(x) for x in zip(*got, strict=True))
                rows, row = np.unique(row, return_inverse=True)
                fired = np.zeros((len(rows), m), np.float32)
                fired[row, voter] = 1
                total[:-1] += np.rint(fired.T @ fired).astype(np.int64).ravel()
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])

    got = summed(docs.select("text").mapInArrow(run, "sums binary"), max(2, docs.rdd.getNumPartitions()))
    if got is None:
        return 0, np.zeros((m, m))
    return int(got[-1]), got[:-1].reshape(m, m).astype(float)


class LabelModel:
    """Firing rates of each voter in toxic and clean texts, and its weight after correlations."""

    def __init__(self, total: int, together: np.ndarray, prior: float):
        m = len(together)
        mean = together.diagonal() / max(total, 1)
        cov = together / max(total, 1) - np.outer(mean, mean)
        factor = np.zeros(m)
        for i in range(m):
            near = [j for j in np.argsort(-cov[i]) if j != i and cov[i, j] > 0][:12]
            found = [cov[i, j] * cov[i, k] / cov[j, k] for a, j in enumerate(near) for k in near[a + 1 :] if cov[j, k] > 0]
            # nested voters (a word and its beginning) can't exceed the voter's own variance
            factor[i] = min(np.sqrt(np.median(found)) if found else 0.0, np.sqrt(max(0.0, mean[i] * (1 - mean[i]))))
        spread = factor / np.sqrt(prior * (1 - prior))
        self.toxic = np.clip(mean + (1 - prior) * spread, 1e-6, 1 - 1e-6)
        self.clean = np.clip(mean - prior * spread, 1e-3, 1 - 1e-6)
        left = np.abs(cov - np.outer(factor, factor))
        std = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
        self.correlation = np.minimum(1, left / np.outer(std, std))
        np.fill_diagonal(self.correlation, 0)
        self.weight = np.where(factor > 0, 1 / (1 + np.where(self.correlation > 0.6, self.correlation, 0).sum(1)), 0.0)
        self.says = np.log(np.maximum(self.toxic, self.clean) / self.clean)
        # voters mostly abstain in clean texts: a text where none fires is toxic only with this probability
        self.silent = np.log(max(prior, 1e-6) * 0.1)

    def posterior(self, fired: np.ndarray) -> float:
        """Probability that a text is toxic given its voters."""
        z = self.silent + float((self.weight * self.says)[fired].sum())
        return float(np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6))


def logistic(rows: list[tuple[np.ndarray, float]], epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> np.ndarray:
    """Weights by slot, the bias last: follow-the-regularised-leader on soft labels."""
    size = len(LEVELS) << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    penalty = np.full(size + 1, l1)
    penalty[size] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return -np.sign(zz) * np.maximum(np.abs(zz) - penalty[at], 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(11).permutation(len(rows))
    for _ in range(epochs):
        for i in order:
            at, y = np.append(rows[i][0], size), rows[i][1]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    out = np.zeros(size + 1)
    used = np.flatnonzero(n)
    out[used] = weights(used)
    return out


def slots(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the weights of hashes with counts: a block of 2**BITS for each level."""
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return np.unique(np.concatenate([at[n >= level] + (i << BITS) for i, level in enumerate(LEVELS)]))


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = 2000, sample_other: int = 4000, sample_unlabelled: int = 1000, gold: float = GOLD, voters: int = MAX_VOTERS) -> np.ndarray:
    """Weights of the classifier, learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(trainable())
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    first = F.xxhash64(F.lit("toxic"), "doc_id")
    chosen = None
    for y, most in ((1, sample_toxic), (0, sample_other)):
        part = labels.where(F.col("toxic") == y).orderBy(first, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    # a text of each id, so the two sample sizes bound the rows; of rows with one id the first text counts
    picked = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    count = docs.count()
    share = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1_000_000)) < 1_000_000 * sample_unlabelled / max(count, 1)
    rows = sample_features(picked)
    more = sample_features(docs.where(trainable()).where(share).select("text", F.lit(None).cast("int").alias("toxic")).distinct())
    found = Voters(mined(rows, [(hashed(w), 1) for w in LEXICON], voters))
    total, together = vote_counts(docs, found)
    prior = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 10)
    model = LabelModel(total, together, prior)
    ready = []
    for y, h, n in rows + more:
        p = model.posterior(found.fired(np.zeros(len(h), np.int64), h, n)[1])
        if y is not None:  # a label is one more voter
            odds = p / (1 - p) * (gold if y else 1 / gold)
            p = odds / (1 + odds)
        ready.append((slots(h, n), p))
    return logistic(ready)


def with_toxicity(docs: DataFrame, weights: np.ndarray, score: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make():
        w = shared.value
        levels = w[:-1].reshape(len(LEVELS), 1 << BITS)
        some = (levels != 0).any(0)

        def run(data: np.ndarray, offs: np.ndarray) -> list:
            rows, slots = [], []
            for row, h in features(data, offs):
                at = (h >> np.uint64(64 - BITS)).astype(np.int64)
                hit = np.flatnonzero(some[at])
                rows.append(row[hit])
                slots.append(at[hit])
            row, at, n = counted(np.concatenate(rows), np.concatenate(slots))
            z = np.full(len(offs) - 1, float(w[-1]))
            for i, level in enumerate(LEVELS):
                z += np.bincount(row[n >= level], levels[i, at[n >= level]], minlength=len(z))
            return [1 / (1 + np.exp(-np.clip(z, -40, 40)))]

        return run

    return with_columns(docs, [(score, T.DoubleType())], make)
