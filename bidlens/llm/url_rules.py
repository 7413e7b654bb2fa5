"""URL filters by mined association rules.

Given rules (host, path, verdict) decide the urls they fit: a rule fits its host and all
subdomains if the url's path starts with the rule's; the longest wins. These verdicts are the
labels: Spark's FP-growth mines combinations of url tokens (host labels, path segments, suffix,
query keys) that go with a verdict, over all urls that a given rule fits. Mined rules are pruned by
support and confidence, and a rule goes if part of it says the same as surely. The rest of the
urls are judged by the mined rules, found through an inverted index from tokens to rules: the
surest rule whose tokens the url all has wins, ``default`` where there is none.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end; both empty for null urls and urls without ``://``. Those have
no tokens and get the default. Long urls are judged whole. Repeated rows are judged alike, and each of
them counts as a label. Of rules as sure as each other the one of more support, then of fewer tokens, then
the first by its tokens decides. Without any label nothing is mined. Columns of the pages named host,
path, rule, verdict, tokens or mined_verdict (any case) give way.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORT, CONFIDENCE = 0.01, 0.9
#: Tokens of a mined rule at most; with SUPPORT this bounds how many rules there can be.
LONGEST = 3
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWERED)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column, host_: Column, path_: Column) -> Column:
    """The distinct tokens of a url; numbers count as one token."""
    labels = F.transform(F.filter(F.split(host_, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h="), x))
    tops = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d="), F.substring_index(host_, ".", -2)))).otherwise(F.array().cast("array<string>"))
    segments = F.transform(F.filter(F.split(path_, "/"), lambda x: x != ""), lambda x: F.when(x.rlike(r"^[0-9]+(\.[a-z]+)?$"), F.lit("p=#")).otherwise(F.concat(F.lit("p="), x)))
    suffix = F.regexp_extract(path_, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, tops, segments, F.when(suffix != "", F.array(F.concat(F.lit("x="), suffix))).otherwise(F.array().cast("array<string>")), keys))


def given_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else nulls."""
    rule, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def equivalent(labelled: DataFrame, support: float) -> list[list[str]]:
    """The tokens of at least ``support`` of the rows, in groups that stand in just the same rows.

    There are at most (mean tokens of a row) / ``support`` of them. Rows are told by 64-bit hashes.
    """
    rows = labelled.select("tokens", F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    least = support * rows.count()
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("row").alias("rows")).where(F.col("n") >= least)
    groups: dict[tuple[int, int], list[str]] = {}
    for r in sorted(seen.collect()):
        groups.setdefault((r["n"], r["rows"]), []).append(r["token"])
    return sorted(groups.values())


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[frozenset, str, float, float]]:
    """(tokens, verdict, confidence, support) from ``labelled`` (tokens, verdict), the surest first.

    FP-growth gets one token of each group that always stands together, since a group of k would make 2^k
    combinations; rules are then said of every token of a group.
    """
    if not labelled.limit(1).count():
        return []
    groups = {g[0]: g for g in equivalent(labelled, support)}
    some = F.array(*(F.lit(t) for t in groups)) if groups else F.array().cast("array<string>")
    baskets = labelled.select(F.array_union(F.array_intersect("tokens", some), F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith("verdict=") & (F.size("antecedent") <= LONGEST) & ~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    found = sorted(((frozenset(r["antecedent"]), r["consequent"][0][8:], r["confidence"], r["support"]) for r in rules.collect()), key=lambda r: (len(r[0]), -r[2], -r[3], sorted(r[0])))
    kept: list = []
    for r in found:
        if not any(k[0] < r[0] and k[1] == r[1] and k[2] >= r[2] for k in kept):
            kept.append(r)
    each = [(frozenset(tokens), *r[1:]) for r in kept for tokens in itertools.product(*(groups[t] for t in sorted(r[0])))]
    return sorted(each, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0]), r[1]))


def with_mined(df: DataFrame, rules: list[tuple[frozenset, str, float, float]], default: str, verdict: str = "mined_verdict") -> DataFrame:
    """``df`` (with tokens) with the verdict of the surest mined rule whose tokens it has."""
    index: dict[str, list[int]] = {}
    for i, (items, *_) in enumerate(rules):
        for t in items:
            index.setdefault(t, []).append(i)
    shared = df.sparkSession.sparkContext.broadcast((rules, index))
    schema = T.StructType([*df.schema.fields, T.StructField(verdict, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, index = shared.value
        for batch in batches:
            out = []
            for have in batch.column(batch.schema.get_field_index("tokens")).to_pylist():
                met: dict[int, int] = {}
                for t in have or ():
                    for i in index.get(t, ()):
                        met[i] = met.get(i, 0) + 1
                best = min((i for i, n in met.items() if n == len(rules[i][0])), default=None)
                out.append(default if best is None else rules[best][1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict."""
    drop = [c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict", "tokens", "mined_verdict") and c != url]
    df = pages.drop(*drop).withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "verdict": verdict, "tokens": tokens(F.col(url), F.col("host"), F.col("path"))})
    learnt = mined(df.where("verdict is not null").select("tokens", "verdict"))
    return with_mined(df, learnt, default).withColumn("verdict", F.coalesce("verdict", "mined_verdict")).drop("tokens", "mined_verdict")
