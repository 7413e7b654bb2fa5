"""WARC fixity audit with Merkle trees, in DataFrame functions.

The primary's manifest puts its records in order (by id and digest, null ids first) and into files
of ``PER_FILE`` records; equal records (same id, same bytes) are one record of so many copies. A
leaf is the hash of a record's file, offset, length, digest and copies, an inner node the hash of up
to ``FANOUT`` children in order, so it stands for a range of offsets, up to one root.

A replica's records are looked up in the manifest by id and digest, so one that is lost, grown or
out of order doesn't move the others; what the manifest lacks gets places behind it. Two trees are
compared at the root, and only below nodes that differ does the audit go down. What a differing
place lacks and what the replica has too much are paired by id, in order: a pair is ``damaged``, the
rest ``missing`` or ``surplus``.

Only digests are moved between machines, never payloads. Copies are counted before they are
shuffled and a node has at most FANOUT children, whatever is repeated in the data. Null urls and
payloads are empty; null ids are an id like any other; repeated rows are copies, each of which can be
missing; ties among records of one id are settled by digest. An empty replica lacks every record,
an empty primary makes every record of the replica surplus. Other columns of the pages don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import settled, written

FANOUT, PER_FILE = 16, 256


def record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC response record as a string (its bytes are its UTF-8)."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "))
    return F.concat(head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def digests(pages: DataFrame) -> DataFrame:
    """page_id, length, digest and copies of the records of the pages."""
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    each = pages.select("page_id", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    return each.groupBy("page_id", "length", "digest").agg(F.count(F.lit(1)).alias("copies"))


def numbered(df: DataFrame, keys: list[Column], name: str, to: str) -> DataFrame:
    """``df`` with ``to`` = 0 and up by ``keys`` over the whole table.

    Rows are dealt by ranges of the keys, so no task holds one key's rows unless all keys are equal.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    before, total = [], 0
    for p, rows in sorted((r["part"], r["n"]) for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per partition
        before.append((p, total))
        total += rows
    starts = F.broadcast(spark.createDataFrame(before or [(0, 0)], "__part long, __start long"))
    out = ranged.withColumn("__part", part).join(starts, "__part")
    return out.withColumn(to, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__start", "__at")


def manifest(records: DataFrame) -> DataFrame:
    """place, file, offset, page_id, length, digest, copies of ``digests``."""
    placed = numbered(records, [F.col("page_id").asc_nulls_first(), F.col("digest").asc()], "manifest", "place")
    placed = placed.withColumn("file", F.floor(F.col("place") / PER_FILE))
    before = W.partitionBy("file").orderBy("place").rowsBetween(W.unboundedPreceding, -1)  # PER_FILE rows at most
    at = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0))
    return placed.select("place", "file", at.alias("offset"), "page_id", "length", "digest", "copies")


def _key(copies: Column) -> Column:
    """Hash of a leaf; null where there is none."""
    return F.when(copies > 0, F.sha2(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("file", "offset", "length", "digest")), copies.cast("string")), 256))


def parents(nodes: DataFrame) -> DataFrame:
    """node and both replicas' hashes one level up from ``nodes``; a null hash stands for nothing."""
    up = lambda c: F.sha2(F.array_join(F.transform("below", lambda x: F.concat_ws(":", x["node"].cast("string"), x[c])), ";"), 256).alias(c)
    return nodes.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "hash", "hash2"))).alias("below")).select("node", up("hash"), up("hash2"))


def differing(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("hash").eqNullSafe(F.col("hash2"))).select("node")


def leftover(rows: DataFrame, n: str, number: str, name: str) -> DataFrame:
    """A row for each of ``n`` copies, with its number among those of its id."""
    each = rows.where(F.col(n) > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    each = numbered(each, [F.col("page_id").asc_nulls_first(), F.col("digest").asc(), F.col("__copy").asc()], name, "__all")
    first = each.groupBy(F.col("page_id").alias("__id")).agg(F.min("__all").alias("__first"))
    return each.join(first, F.col("page_id").eqNullSafe(F.col("__id"))).withColumn(number, F.col("__all") - F.col("__first")).drop("__id", "__first", "__all", "__copy", n)


@settled
def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """A row for each record that differs, from two ``digests``.

    kind (damaged, missing, surplus), page_id; place, file, offset, length and digest in the
    primary's manifest (null for surplus records); replica_length and replica_digest (null for missing ones).
    """
    mine = manifest(primary)
    theirs = replica.select(F.col("page_id").alias("page_id2"), F.col("length").alias("length2"), F.col("digest").alias("digest2"), F.col("copies").alias("copies2"))
    same = F.col("page_id").eqNullSafe(F.col("page_id2")) & (F.col("digest") == F.col("digest2")) & (F.col("length") == F.col("length2"))
    both = mine.join(theirs, same, "full_outer")
    known = written(both.select("place", "file", "offset", *(F.coalesce(c, c + "2").alias(c) for c in ("page_id", "length", "digest")), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("copies2", F.lit(0)).alias("copies2")), "aligned")
    # records that the manifest lacks get places behind it
    end, more = known.agg(F.coalesce(F.max("place"), F.lit(-1)) + 1, F.count_if(F.col("place").isNull())).first()
    leaves = known.where("place is not null")
    if more:
        behind = numbered(known.where("place is null"), [F.col("page_id").asc_nulls_first(), F.col("digest").asc()], "behind", "__n")
        leaves = leaves.unionByName(behind.withColumn("place", F.col("__n") + F.lit(end)).drop("__n"))
    level = written(leaves.select(F.col("place").alias("node"), _key(F.col("copies")).alias("hash"), _key(F.col("copies2")).alias("hash2")), "leaves")
    levels, nodes = [level], end + more
    while nodes > 1:
        level = written(parents(level), "nodes")
        levels.append(level)
        nodes = -(-nodes // FANOUT)
    bad = differing(levels[-1])
    for level in levels[-2::-1]:
        bad = differing(level.join(bad.withColumnRenamed("node", "up"), F.floor(F.col("node") / FANOUT) == F.col("up"), "left_semi"))
    found = written(leaves.join(bad, leaves["place"] == bad["node"], "left_semi"), "differing")
    lost = leftover(found.select("page_id", "place", "file", "offset", "length", "digest", (F.col("copies") - F.col("copies2")).alias("n")), "n", "number", "lost")
    more = leftover(found.select("page_id", "length", "digest", (F.col("copies2") - F.col("copies")).alias("n")), "n", "number", "more")
    more = more.select(F.col("page_id").alias("page_id2"), F.col("number").alias("number2"), F.col("length").alias("replica_length"), F.col("digest").alias("replica_digest"))
    pairs = lost.join(more, F.col("page_id").eqNullSafe(F.col("page_id2")) & (F.col("number") == F.col("number2")), "full_outer")
    kind = F.when(F.col("number2").isNull(), "missing").when(F.col("number").isNull(), "surplus").otherwise("damaged")
    return pairs.select(kind.alias("kind"), F.coalesce("page_id", "page_id2").alias("page_id"), "place", "file", "offset", "length", "digest", "replica_length", "replica_digest")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of ``pages`` to audit against. By page_id mod 97: 13 has a byte changed, 29 is missing, 41 is
    longer, 53 is there twice, and 67 has a record of an unknown id (its own, negative, less 1) beside it."""
    rest = F.pmod("page_id", F.lit(97))
    changed = F.concat(F.lit("\x07"), F.expr("substring(html, 2)"))
    html = F.when((rest == 13) & (F.length("html") > 0), changed).when(rest == 41, F.concat(F.coalesce("html", F.lit("")), F.lit("more"))).otherwise(F.col("html"))
    ids = F.when(rest == 53, F.array("page_id", "page_id")).when(rest == 67, F.array(F.col("page_id"), -F.col("page_id") - 1)).otherwise(F.array("page_id"))
    return pages.where(~F.coalesce(rest == 29, F.lit(False))).select(F.explode(ids).alias("page_id"), "url", html.alias("html"))
