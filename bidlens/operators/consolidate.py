"""From candidates to fields: deduplication, conflicts, the primary value, the cross-field check.

All groups are per document and field, so windows stay small; nothing is shuffled twice on the
same key. Where the candidates come from one text (``extract.folded``) the same is done of lists, row by row of
documents and without any shuffle: the functions that end in ``_of``.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import dates, money, text
from bidlens.functions.text import WHITE
from bidlens.operators.extract import Span, number

#: The day that date plausibility is judged from, unless another is given.
AS_OF = datetime.date(2026, 1, 1)


def shown(value: str = "value", normalized: str = "normalized_value") -> Column:
    return F.coalesce(normalized, value)


def dedupe(spans: DataFrame) -> DataFrame:
    """One span per document, field and folded value: the surest, the first of equals; ``ord`` stays the group's first."""
    key = F.lower(text.utrim(shown()))
    group = W.partitionBy("doc_id", "field_name", "_key")
    df = spans.withColumn("_key", key).withColumn("_first", F.min("ord").over(group))
    best = W.partitionBy("doc_id", "field_name", "_key").orderBy(F.desc("confidence"), "ord")
    return df.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").withColumn("ord", F.col("_first")).drop("_key", "_first", "_rn")


def by_confidence() -> W:
    return W.partitionBy("doc_id", "field_name").orderBy(F.desc("confidence"), "ord")


def numeric(value: Column, normalized: Column) -> Column:
    return F.coalesce(normalized.try_cast("double"), F.regexp_replace(value, r"[^\d.]", "").try_cast("double"))


def conflicts(spans: DataFrame) -> DataFrame:
    """doc_id, field_name, kind (range, count or null), low, high, n_values: of spans after ``dedupe``.

    ``range``: the largest number is over five times the smallest; else ``count``: over three values.
    """
    df = spans.withColumn("_n", numeric(F.col("value"), F.col("normalized_value")))
    agg = df.groupBy("doc_id", "field_name").agg(F.countDistinct(shown()).alias("n_values"), F.count("_n").alias("_numbers"), F.min("_n").alias("low"), F.max("_n").alias("high"))
    wide = (F.col("_numbers") > 1) & (F.col("high") / F.greatest("low", F.lit(0.01)) > 5)
    kind = F.when((F.col("n_values") > 1) & wide, "range").when(F.col("n_values") > 3, "count")
    return agg.select("doc_id", "field_name", "n_values", kind.alias("kind"), F.when(kind == "range", F.col("low")).alias("low"), F.when(kind == "range", F.col("high")).alias("high"))


def plausible(as_of: datetime.date = AS_OF) -> Column:
    """Whether a span can be its field's primary value."""
    field, value = F.col("field_name"), F.col("value")
    yuan = money.parsed(value, F.col("normalized_value"))
    compact = F.regexp_replace(value, r"(?U)[\s\-]", "")
    reachable = compact.rlike(r"^1[3-9]\d{9}$") | compact.rlike(r"^0\d{2,3}\d{7,8}$") | value.rlike(f"^{text.EMAIL}$")
    return F.coalesce(
        F.when(field.isin("bid_amount", "amount"), money.plausible_amount(yuan))
        .when(field == "deposit", money.plausible_deposit(yuan))
        .when(field.isin("bid_date", "date"), dates.plausible(dates.parsed(value), as_of))
        .when(field.isin("project_number", "number"), value.rlike(r"^[A-Za-z0-9\-_/]{5,30}$"))
        .when(field.isin("contact_info", "contact"), reachable)
        .otherwise(True),
        F.lit(False),
    )


def primary(spans: DataFrame, as_of: datetime.date = AS_OF) -> DataFrame:
    """The primary span of each document and field: the surest plausible one, else the surest."""
    order = W.partitionBy("doc_id", "field_name").orderBy(F.desc("_ok"), F.desc("confidence"), "ord")
    return spans.withColumn("_ok", plausible(as_of)).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_ok", "_rn")


def values(spans: DataFrame) -> DataFrame:
    """doc_id, field_name and all candidates, the surest first."""
    item = F.struct((-F.col("confidence")).alias("k"), "ord", "value", "normalized_value", "confidence", "source", "start", "end")
    return spans.groupBy("doc_id", "field_name").agg(F.sort_array(F.collect_list(item)).alias("values"))


def deposit_check(spans: DataFrame) -> DataFrame:
    """doc_id, bid_amount, deposit, exceeds: the surest of each, where a document has both."""
    top = spans.where(F.col("field_name").isin("bid_amount", "deposit")).withColumn("_rn", F.row_number().over(by_confidence())).where("_rn = 1")
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.col("normalized_value").try_cast("decimal(20,2)"))).alias(f)
    both = top.groupBy("doc_id").agg(pick("bid_amount"), pick("deposit")).where("bid_amount is not null and deposit is not null")
    return both.withColumn("exceeds", (F.col("bid_amount") > 0) & (F.col("deposit") > F.col("bid_amount")))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Spans of both, one per (value, start, end, source) of a document and field; the left's wins."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    once = W.partitionBy("doc_id", "field_name", "value", "start", "end", "source").orderBy("_side", "ord")
    order = W.partitionBy("doc_id", "field_name").orderBy("_side", "ord")
    return both.withColumn("_rn", F.row_number().over(once)).where("_rn = 1").withColumn("ord", F.row_number().over(order) - 1).drop("_rn", "_side")


def low_confidence(fields: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of ``fields`` (confidence, kind of conflict) that need a review."""
    return fields.where((F.col("confidence") < threshold) | F.col("kind").isNotNull())


def fields(spans: DataFrame, as_of: datetime.date = AS_OF) -> DataFrame:
    """doc_id, field_name, primary_value, normalized_value, confidence, n_candidates, kind, start, end, ref, source.

    A deposit above the bid amount has its confidence halved and the conflict kind ``deposit``.
    Spans are dealt out by document once; every window below keeps to that. The number of parts is
    given, since the work on a span is dear for its few bytes, which the planner goes by.
    """
    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = dedupe(spans.repartition(n, "doc_id")).withColumns({"_n": numeric(F.col("value"), F.col("normalized_value")), "_ok": plausible(as_of), "_shown": shown()})
    group, doc = W.partitionBy("doc_id", "field_name"), W.partitionBy("doc_id")
    df = df.withColumns({
        "n_candidates": F.count(F.lit(1)).over(group), "_values": F.size(F.collect_set("_shown").over(group)), "_numbers": F.count("_n").over(group), "_low": F.min("_n").over(group), "_high": F.max("_n").over(group),
        "_sure": F.row_number().over(by_confidence()), "_rn": F.row_number().over(group.orderBy(F.desc("_ok"), F.desc("confidence"), "ord")),
    })
    top = lambda f: F.max(F.when((F.col("field_name") == f) & (F.col("_sure") == 1), F.col("normalized_value").try_cast("decimal(20,2)"))).over(doc)
    df = df.withColumns({"_amount": top("bid_amount"), "_deposit": top("deposit")}).where("_rn = 1")
    over = F.coalesce((F.col("field_name") == "deposit") & (F.col("_amount") > 0) & (F.col("_deposit") > F.col("_amount")), F.lit(False))
    wide = (F.col("_numbers") > 1) & (F.col("_high") / F.greatest("_low", F.lit(0.01)) > 5)
    kind = F.when(over, "deposit").when((F.col("_values") > 1) & wide, "range").when(F.col("_values") > 3, "count")
    return df.select(
        "doc_id", "field_name", F.col("value").alias("primary_value"), "normalized_value", F.when(over, F.col("confidence") * 0.5).otherwise(F.col("confidence")).alias("confidence"),
        "n_candidates", kind.alias("kind"), "start", "end", "ref", "source",
    )


def statistics(fields_: DataFrame) -> DataFrame:
    """Per document: fields, mean confidence, how many need a review."""
    return fields_.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_fields"), F.avg("confidence").alias("avg_confidence"), F.count_if((F.col("confidence") < 0.7) | F.col("kind").isNotNull()).alias("low_confidence_count"))


_NOT_NUMBER, _DASHES, _REACHABLE = re.compile("[^0-9.]"), re.compile(f"[{WHITE}\\-]"), re.compile(r"1[3-9][0-9]{9}|0[0-9]{2,3}[0-9]{7,8}")
_EMAIL, _PROJECT = re.compile(text.EMAIL), re.compile(r"[A-Za-z0-9\-_/]{5,30}")


def dedupe_of(spans: list[Span]) -> list[Span]:
    """``dedupe`` of a document's candidates, which stand in order."""
    best: dict[tuple, Span] = {}
    for s in spans:
        key = s.field_name, (s.value if s.normalized_value is None else s.normalized_value).strip(WHITE).lower()
        had = best.get(key)
        if had is None:
            best[key] = s
        elif s.confidence > had.confidence:
            best[key] = s._replace(ord=had.ord)
    return list(best.values())


def _grouped(spans: Iterable[Span]) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {}
    for s in spans:
        out.setdefault(s.field_name, []).append(s)
    return out


def _spread(own: list[Span]) -> tuple[int, str | None, float | None, float | None]:
    """How many values, kind of conflict, and the ends of the range, of one field's candidates."""
    if len(own) == 1:
        return 1, None, None, None
    different = {s.value if s.normalized_value is None else s.normalized_value for s in own}
    numbers = []
    for s in own:
        n = number(s.normalized_value)
        n = number(_NOT_NUMBER.sub("", s.value)) if n is None else n
        if n is not None:
            numbers.append(n)
    if len(different) > 1 and len(numbers) > 1 and not max(numbers) / max(min(numbers), 0.01) <= 5:
        return len(different), "range", min(numbers), max(numbers)
    return len(different), "count" if len(different) > 3 else None, None, None


CONFLICTS = "field_name string, n_values bigint, kind string, low double, high double"


def conflicts_of(spans: list[Span]) -> list[tuple]:
    """CONFLICTS: ``conflicts`` of a document's candidates after ``dedupe_of``."""
    return [(field, n, kind, low, high) for field, own in _grouped(spans).items() for n, kind, low, high in (_spread(own),)]


def plausible_of(s: Span, since: datetime.date, until: datetime.date) -> bool:
    """``plausible`` of one candidate."""
    field, value = s.field_name, s.value
    if field in ("bid_amount", "amount", "deposit"):
        yuan = number(s.normalized_value)
        if yuan is None:
            yuan = number(_NOT_NUMBER.sub("", value))
            yuan = yuan * 10_000 if yuan is not None and "万" in value else yuan
        low, high = (1e3, 1e9) if field == "deposit" else (1.0, 1e10)
        return yuan is not None and low <= yuan <= high
    if field in ("bid_date", "date"):
        day = dates.day_of(value)
        return day is not None and since <= day <= until
    if field in ("project_number", "number"):
        return _PROJECT.fullmatch(value) is not None
    if field in ("contact_info", "contact"):
        return _REACHABLE.fullmatch(_DASHES.sub("", value)) is not None or _EMAIL.fullmatch(value) is not None
    return True


FIELD = "field_name string, primary_value string, normalized_value string, confidence double, n_candidates bigint, kind string, start int, end int, ref string, source string"


def _sure(s: Span) -> tuple:
    return -s.confidence, s.ord


def fields_of(spans: list[Span], as_of: datetime.date = AS_OF) -> list[tuple]:
    """FIELD: ``fields`` of a document's candidates (after ``dedupe_of`` or before, which it does)."""
    since, until = as_of - datetime.timedelta(days=3650), as_of + datetime.timedelta(days=1825)
    groups = _grouped(dedupe_of(spans))
    amount, deposit = (_cents(min(groups[f], key=_sure).normalized_value) if f in groups else None for f in MONEY)
    out = []
    for field, own in groups.items():
        top = own[0] if len(own) == 1 else min(own, key=lambda s: (not plausible_of(s, since, until), *_sure(s)))
        over = field == "deposit" and amount is not None and deposit is not None and deposit > amount > 0
        out.append((field, top.value, top.normalized_value, top.confidence * 0.5 if over else top.confidence, len(own), "deposit" if over else _spread(own)[1], top.start, top.end, top.ref, top.source))
    return out


MONEY = ("bid_amount", "deposit")
DEPOSIT = "bid_amount decimal(20,2), deposit decimal(20,2), exceeds boolean"


def _cents(normalized: str | None) -> Decimal | None:
    return None if normalized is None else Decimal(normalized)


def deposit_of(spans: list[Span]) -> list[tuple]:
    """DEPOSIT: ``deposit_check`` of a document's candidates after ``dedupe_of``."""
    groups = _grouped(spans)
    amount, deposit = (_cents(min(groups[f], key=_sure).normalized_value) if f in groups else None for f in MONEY)
    return [] if amount is None or deposit is None else [(amount, deposit, amount > 0 and deposit > amount)]


STATISTICS = "total_fields bigint, avg_confidence double, low_confidence_count bigint"


def statistics_of(fields_: list[tuple]) -> list[tuple]:
    """STATISTICS: ``statistics`` of a document's rows of FIELD; no row without fields."""
    if not fields_:
        return []
    return [(len(fields_), sum(f[3] for f in fields_) / len(fields_), sum(f[3] < 0.7 or f[5] is not None for f in fields_))]
