"""Exact and near duplicates of chunks inside their document, and MinHash candidates across documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import text
from bidlens.functions.lineage import written

THRESHOLD = 0.8


def exact(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, first_no: the first chunk of the same fingerprint."""
    return chunks.select("doc_id", "chunk_no", F.min("chunk_no").over(W.partitionBy("doc_id", "fingerprint")).alias("first_no"))


def path_similarity(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(text.jaccard(a, b))


def token_similarity(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def indel(x: str | None, y: str | None) -> float:
    """Twice the longest common subsequence over both lengths, by bit-parallel rows; 1 for two empty texts."""
    x, y = x or "", y or ""
    if x == y:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    ones = (1 << len(x)) - 1
    row = ones
    for c in y:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & ones
    return 2 * (len(x) - row.bit_count()) / (len(x) + len(y))


def indel_ratio(a: Column, b: Column) -> Column:
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel(i, j) for i, j in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


def char_jaccard(a: Column, b: Column) -> Column:
    return text.jaccard(F.array_distinct(text.characters(a)), F.array_distinct(text.characters(b)))


def similarity(content: Column, path: Column, size: Column) -> Column:
    return 0.6 * content + 0.3 * path + 0.1 * size


def pairs(chunks: DataFrame, threshold: float = THRESHOLD, ratio: bool = True) -> DataFrame:
    """doc_id, a_no, b_no, score: pairs of a document's chunks whose score reaches the threshold.

    A pair can only reach it if the content does its part, and content similarity is bounded by the
    lengths (of texts, or of their sets of characters): pairs that can't are left out before any text is compared.
    """
    kinds = F.size(F.array_distinct(text.characters(F.col("content"))))
    c = chunks.select("doc_id", "chunk_no", "content", "chapter_path", "token_count", (F.length("content") if ratio else kinds).alias("len"))
    a, b = (c.select("doc_id", *(F.col(x).alias(f"{s}_{x}") for x in c.columns[1:])) for s in "ab")
    joined = a.join(b, "doc_id").where("a_chunk_no < b_chunk_no")
    path, size = path_similarity(F.col("a_chapter_path"), F.col("b_chapter_path")), token_similarity(F.col("a_token_count"), F.col("b_token_count"))
    low, high = F.least("a_len", "b_len"), F.greatest("a_len", "b_len")
    bound = F.when(high == 0, 1.0).otherwise(2 * low / (low + high) if ratio else low / high)
    joined = joined.withColumns({"_path": path, "_size": size}).where(similarity(bound, F.col("_path"), F.col("_size")) >= threshold - 1e-9)
    content = indel_ratio(F.col("a_content"), F.col("b_content")) if ratio else char_jaccard(F.col("a_content"), F.col("b_content"))
    scored = joined.withColumn("_content", content).withColumn("score", similarity(F.col("_content"), F.col("_path"), F.col("_size")))
    return scored.where(F.col("score") >= threshold).select("doc_id", F.col("a_chunk_no").alias("a_no"), F.col("b_chunk_no").alias("b_no"), "score")


def dedupe(chunks: DataFrame, threshold: float = THRESHOLD, ratio: bool = True) -> DataFrame:
    """doc_id, chunk_no, is_duplicate, duplicate_of, best_score: exact copies, then chunks near any earlier one."""
    same = exact(chunks)
    near = pairs(chunks, threshold, ratio).groupBy("doc_id", F.col("b_no").alias("chunk_no")).agg(F.max("score").alias("best_score"))
    out = same.join(near, ["doc_id", "chunk_no"], "left")
    copy = F.col("first_no") < F.col("chunk_no")
    return out.select("doc_id", "chunk_no", (copy | F.col("best_score").isNotNull()).alias("is_duplicate"), F.when(copy, F.col("first_no")).alias("duplicate_of"), F.when(copy, 1.0).otherwise(F.coalesce("best_score", F.lit(0.0))).alias("best_score"))


def near(chunks: DataFrame, threshold: float = THRESHOLD, ratio: bool = True, loosen: float = 0.8) -> DataFrame:
    """doc_id, chunk_no, other_no, score, rank: for chunks that are no exact copy, the earlier chunks that come near it.

    A candidate needs ``loosen`` times the threshold, as decimals (0.8 of 0.8 is 0.64, which the product of doubles
    is not); ranks run from the highest score, equals by place.
    Exact copies have no candidates of their own, but can be one.
    """
    own = exact(chunks).where("first_no = chunk_no").select("doc_id", "chunk_no")
    found = pairs(chunks, round(threshold * loosen, 12), ratio).select("doc_id", F.col("b_no").alias("chunk_no"), F.col("a_no").alias("other_no"), "score")
    order = W.partitionBy("doc_id", "chunk_no").orderBy(F.desc(F.round("score", 12)), "other_no")
    return found.join(own, ["doc_id", "chunk_no"], "left_semi").withColumn("rank", F.row_number().over(order))


def merged_extractions(spans: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD, ratio: bool = True) -> DataFrame:
    """``spans`` (doc_id, chunk_no, field_name, value, start, end, confidence, ord) with those of similar chunks taken over.

    Exact copies give nothing of their own. Every other chunk has its spans and those of each earlier chunk
    at the threshold; of equal (value, start, end) in a field the chunk's own stays, then that of the most
    similar chunk. ``ord`` counts a field's spans from 0, the surest first, so 0 is its primary value.
    """
    own = exact(chunks).where("first_no = chunk_no").select("doc_id", F.col("chunk_no").alias("_for"), F.col("chunk_no").alias("_from"), F.lit(0).alias("_rank"))
    others = near(chunks, threshold, ratio, 1.0).select("doc_id", F.col("chunk_no").alias("_for"), F.col("other_no").alias("_from"), F.col("rank").alias("_rank"))
    source = spans.withColumnRenamed("chunk_no", "_from")
    taken = own.unionByName(others).join(source, ["doc_id", "_from"])
    once = W.partitionBy("doc_id", "_for", "field_name", "value", "start", "end").orderBy("_rank", "ord")
    order = W.partitionBy("doc_id", "_for", "field_name").orderBy(F.desc("confidence"), "_rank", F.col("_ord"))
    taken = taken.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumnRenamed("ord", "_ord")
    return taken.withColumn("ord", F.row_number().over(order) - 1).withColumnRenamed("_for", "chunk_no").select(*spans.columns)


def kept(chunks: DataFrame, threshold: float = THRESHOLD, ratio: bool = True) -> DataFrame:
    return chunks.join(dedupe(chunks, threshold, ratio).where("is_duplicate"), ["doc_id", "chunk_no"], "left_anti")


def stats(results: DataFrame) -> DataFrame:
    s = F.col("best_score")
    return results.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(~F.col("is_duplicate")).alias("unique_chunks"), F.count_if(s >= 0.9).alias("high"), F.count_if((s >= 0.7) & (s < 0.9)).alias("medium"), F.count_if(s < 0.7).alias("low"), F.avg(s).alias("avg_similarity"))


def exact_documents(docs: DataFrame, key: str, content: str) -> DataFrame:
    """key, first: the smallest key with the same text. Only digests are shuffled, and summed before that."""
    digests = docs.select(key, F.md5(content).alias("_d"))
    first = digests.groupBy("_d").agg(F.min(key).alias("first"))
    return digests.join(first, "_d").select(key, "first")


def signatures(docs: DataFrame, key: str, content: str, permutations: int = 128, k: int = 3) -> DataFrame:
    """key, signature: MinHash over character shingles, each permutation a multiply and shift of one 64-bit hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        rng = np.random.default_rng(128)
        a, b = (rng.integers(1, 2**63, permutations, dtype=np.uint64) | np.uint64(1) for _ in range(2))
        for batch in batches:
            out = []
            for body in batch[content]:
                x = np.frombuffer((body or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
                if len(x) < k:
                    x = np.concatenate([x, np.zeros(k - len(x), np.uint64)])
                h = np.zeros(len(x) - k + 1, np.uint64)
                for i in range(k):
                    h = (h * np.uint64(1_099_511_628_211)) ^ x[i : len(x) - k + 1 + i]
                h = np.unique(h * np.uint64(0x9E3779B97F4A7C15))
                low = np.full(permutations, 2**64 - 1, np.uint64)
                for s in range(0, len(h), 4096):
                    low = np.minimum(low, ((h[s : s + 4096, None] ^ (h[s : s + 4096, None] >> np.uint64(29))) * a + b).min(0))
                out.append((low >> np.uint64(1)).astype(np.int64).tolist())
            yield pd.DataFrame({key: batch[key], "signature": out})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, content).mapInPandas(run, f"{key} {kind}, signature array<bigint>")


def bands_for(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows a band with the smallest sum of wrong candidates below the threshold and missed ones above it, over even similarities."""

    def wrong(bands: int, rows: int) -> float:
        chance = [(x, 1 - (1 - x**rows) ** bands) for x in ((i + 0.5) / 1000 for i in range(1000))]
        return sum(p if x < threshold else 1 - p for x, p in chance)

    return min(((b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)), key=lambda x: (wrong(*x), x))


def _buckets(signed: DataFrame, key: str, bands: int, rows: int) -> DataFrame:
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("signature", i * rows + 1, rows)).alias("bucket")))
    return signed.select(key, F.explode(band).alias("x")).select(key, "x.band", "x.bucket")


def minhash_candidates(docs: DataFrame, key: str, content: str, threshold: float = 0.5, permutations: int = 128) -> DataFrame:
    """band, bucket, a, b: each text b of each bucket that holds more than one, with the bucket's smallest key a.

    Candidate pairs are any two members of a (band, bucket): all of them are given, as rows that grow with the texts and
    not with the square of a bucket. The texts themselves (a = b) are members too.
    """
    bands, rows = bands_for(threshold, permutations)
    buckets = _buckets(signatures(docs, key, content, permutations).withColumnRenamed(key, "b"), "b", bands, rows)
    first = buckets.groupBy("band", "bucket").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return buckets.join(first, ["band", "bucket"]).select("band", "bucket", "a", "b")


def lsh_query(asked: DataFrame, docs: DataFrame, key: str, content: str, threshold: float = 0.5, permutations: int = 128) -> DataFrame:
    """query, first, copies, estimate: for each text of ``asked`` the different texts of ``docs`` that share a band with it.

    ``first`` is the smallest key of a text and ``copies`` its number of rows, by equal signatures; ``estimate`` is the
    share of equal permutations. Copies are asked and looked up once, so rows grow with different texts only.
    """
    bands, rows = bands_for(threshold, permutations)
    signed = lambda df: signatures(df, key, content, permutations).withColumn("_s", F.xxhash64("signature"))
    # a signature is 1 KB a text: of the index the hashes of its bands are dealt out, and signatures of the texts that were hit only
    banded = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    asked_ = signed(asked)
    few = asked_.groupBy("_s").agg(F.first("signature").alias("_a")).withColumnRenamed("_s", "_q")
    index = signed(docs).select("_s", key, banded.alias("_b")).groupBy("_s").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("_b").alias("_b"))
    left = asked_.select(F.col("_s").alias("_q"), F.explode(banded).alias("bucket")).distinct()
    hits = written(left.join(index.select("_s", "first", "copies", F.explode("_b").alias("bucket")), "bucket").select("_q", "_s", "first", "copies").distinct(), "hits")
    found = signed(docs).withColumnRenamed(key, "first").join(hits.select("first", "_s").distinct(), ["first", "_s"], "left_semi").groupBy("first", "_s").agg(F.first("signature").alias("signature"))
    same = F.aggregate(F.zip_with("_a", "signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    scored = hits.join(found, ["first", "_s"]).join(few, "_q").select("_q", "first", "copies", (same / permutations).alias("estimate"))
    return asked_.select(F.col(key).alias("query"), F.col("_s").alias("_q")).join(scored, "_q").drop("_q")
