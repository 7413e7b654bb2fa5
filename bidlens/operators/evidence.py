"""Where a span stands in its source: offsets narrowed to the value, lines, section, page."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text
from bidlens.functions.text import WHITE
from bidlens.operators.structure import outline, with_sections


def located(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``spans`` with source_start, source_end, source_text, line_start, line_end, section_path.

    Offsets are code points, -1 where the value can't be found. Inside a match the value is looked
    for first; spans without a place are looked for in the text by value, normalised value, then context.
    """
    df = spans.join(with_sections(docs).select("doc_id", F.col("content").alias("_c"), F.col("heads").alias("_heads")), "doc_id")
    df = df.withColumns({"_in": (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("_c")), "_v": text.utrim(F.col("value")), "_w": text.utrim(F.coalesce("normalized_value", F.lit("")))})
    df = df.withColumn("_body", F.when(F.col("_in"), F.substring("_c", F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("_c")))
    place = lambda part, body: F.when(F.length(part) > 0, F.position(part, body)).otherwise(F.lit(0))
    df = df.withColumn("_pv", place("_v", "_body"))
    df = df.withColumn("_pw", F.when(F.col("_pv") == 0, place("_w", "_body")).otherwise(F.lit(0)))
    lost = ~F.col("_in") & (F.col("_pv") == 0) & (F.col("_pw") == 0)
    df = df.withColumn("_ref", F.when(lost, text.utrim(F.coalesce("ref", F.lit("")))))
    df = df.withColumn("_pr", F.when(lost, place("_ref", "_c")).otherwise(F.lit(0)))
    df = df.withColumns({"_rv": F.when(F.col("_pr") > 0, place("_v", "_ref")).otherwise(F.lit(0)), "_rw": F.when(F.col("_pr") > 0, place("_w", "_ref")).otherwise(F.lit(0))})
    base = F.when(F.col("_in"), F.col("start")).otherwise(F.lit(0))
    in_ref = F.greatest("_rv", F.when(F.col("_rv") == 0, F.col("_rw")).otherwise(F.lit(0)))
    at = (
        F.when(F.col("_pv") > 0, base + F.col("_pv") - 1).when(F.col("_pw") > 0, base + F.col("_pw") - 1).when(F.col("_in"), F.col("start"))
        .when((F.col("_pr") > 0) & (in_ref > 0), F.col("_pr") + in_ref - 2).when(F.col("_pr") > 0, F.col("_pr") - 1).otherwise(F.lit(-1))
    )
    size = (
        F.when(F.col("_pv") > 0, F.length("_v")).when(F.col("_pw") > 0, F.length("_w")).when(F.col("_in"), F.col("end") - F.col("start"))
        .when(F.col("_rv") > 0, F.length("_v")).when(F.col("_rw") > 0, F.length("_w")).when(F.col("_pr") > 0, F.length("_ref")).otherwise(F.lit(0))
    )
    df = df.withColumns({"source_start": at.cast("int"), "source_end": (at + size).cast("int")})
    some = F.col("source_start") >= 0
    df = df.withColumns({
        "source_text": F.when(some, text.utrim(F.substring("_c", F.col("source_start") + 1, F.col("source_end") - F.col("source_start")))),
        "line_start": F.when(some, text.line_of(F.col("_c"), F.col("source_start"))),
        "line_end": F.when(some, text.line_of(F.col("_c"), F.col("source_end"))),
    }).drop("_c", "_in", "_v", "_w", "_body", "_pv", "_pw", "_ref", "_pr", "_rv", "_rw")
    none = F.array().cast("array<string>")
    before = F.filter("_heads", lambda h: h["start"] <= F.col("source_start"))
    section = F.when(F.col("source_start") >= 0, F.try_element_at(before, F.lit(-1))["path"])
    return df.withColumn("section_path", F.coalesce(section, none)).drop("_heads")


PLACE = "source_start int, source_end int, source_text string, line_start int, line_end int, section_path array<string>"


def place_of(body: str, heads: list[dict], start: int, end: int, value: str, normalized: str | None, ref: str | None) -> tuple:
    """PLACE: ``located`` of one span of a text with its ``outline``."""
    inside = 0 <= start < end <= len(body)
    v, w = value.strip(WHITE), (normalized or "").strip(WHITE)
    for part in (v, w):
        at = (body.find(part, start, end) if inside else body.find(part)) if part else -1
        if at >= 0:
            size = len(part)
            break
    else:
        if inside:
            at, size = start, end - start
        else:
            context = (ref or "").strip(WHITE)
            at, size = body.find(context) if context else -1, len(context) if context else 0
            if at >= 0:
                for part in (v, w):
                    i = context.find(part) if part else -1
                    if i >= 0:
                        at, size = at + i, len(part)
                        break
    if at < 0:
        return -1, -1, None, None, None, []
    path: list[str] = []
    for h in heads:
        if h["start"] > at:
            break
        path = h["path"]
    line = body.count("\n", 0, at) + 1
    return at, at + size, body[at : at + size].strip(WHITE), line, line + body.count("\n", at, at + size), path


def pages(spans: DataFrame, page_texts: DataFrame) -> DataFrame:
    """doc_id, field_name, ord, page: the first page that holds a span's longest searchable text (three characters or more)."""
    keys = F.array_distinct(F.filter(F.transform(F.array("source_text", "ref", "value", "normalized_value"), lambda x: text.search_key(F.coalesce(x, F.lit("")))), lambda k: F.length(k) >= 3))
    wanted = spans.select("doc_id", "field_name", "ord", F.explode(keys).alias("key"))
    keyed = page_texts.select("doc_id", "page", text.search_key(F.col("text")).alias("body"))
    found = wanted.join(keyed, "doc_id").where(F.col("body").contains(F.col("key")))
    return found.groupBy("doc_id", "field_name", "ord").agg(F.min_by("page", F.struct(-F.length("key"), F.col("page"))).alias("page"))


def page_of(texts: list[tuple[int, str]], wanted: list[str | None]) -> int | None:
    """``pages`` of one span: the first page (page, search key of its text) with the longest of the wanted texts that is on any."""
    for key in sorted({text.key_of(x or "") for x in wanted}, key=len, reverse=True):
        on = [page for page, body in texts if len(key) >= 3 and key in body]
        if on:
            return min(on)
    return None


def boxes(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, field_name, ord, page, x0, y0, x1, y1, page_width, page_height: where a span's value stands on its page.

    ``spans`` have a page; ``lines`` are those of ``sources.pdf.lines``. The value is looked for, else the source
    text, else the normalised value (one line of up to 160 characters, letter case aside); the first place counts.
    Spans that are on no single line have no row.
    """
    wanted = F.transform(F.array("value", "source_text", "normalized_value"), lambda x: F.lower(text.utrim(F.coalesce(x, F.lit("")))))
    usable = F.filter(wanted, lambda k: (k != "") & ~k.contains("\n") & (F.length(k) <= 160))
    keys = spans.select("doc_id", "field_name", "ord", "page", F.posexplode(usable).alias("_rank", "_key"))
    body = lines.withColumn("_text", F.lower("text")).where(F.length("_text") == F.length("text"))
    found = keys.join(body, ["doc_id", "page"]).withColumn("_at", F.position("_key", "_text")).where("_at > 0")
    edge = lambda i: F.round(F.element_at("xs", i), 3)
    place = F.struct(edge(F.col("_at")).alias("x0"), F.round("y0", 3).alias("y0"), edge(F.col("_at") + F.length("_key")).alias("x1"), F.round("y1", 3).alias("y1"), F.round("page_width", 3).alias("page_width"), F.round("page_height", 3).alias("page_height"))
    best = found.groupBy("doc_id", "field_name", "ord", "page").agg(F.min_by(place, F.struct("_rank", "block_no", "_at")).alias("_box"))
    return best.select("doc_id", "field_name", "ord", "page", "_box.*")


def box_of(wanted: list[str | None], lines: list[tuple]) -> tuple[float, float, float, float] | None:
    """x0, y0, x1, y1 as ``boxes`` places one span on a page's lines (text, xs, y0, y1, ...); ``wanted``: value, source text, normalised value."""
    for key in (w.strip(WHITE).lower() for w in wanted if w):
        for line, xs, y0, y1, *_ in lines if key and "\n" not in key and len(key) <= 160 else ():
            body = line.lower()
            at = body.find(key) if len(body) == len(line) else -1
            if at >= 0:
                return tuple(float(Decimal(repr(float(x))).quantize(Decimal("0.001"), ROUND_HALF_UP)) for x in (xs[at], y0, xs[at + len(key)], y1))
    return None


def box_overlaps(a: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) have an area in common."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def statistics(spans: DataFrame) -> DataFrame:
    page = F.count("page") if "page" in spans.columns else F.lit(0)
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("evidence_span_count"), F.count_if(F.col("source_start") >= 0).alias("evidence_located_count"), page.alias("evidence_page_count"))


def windows(spans: DataFrame, gap: int = 50, around: int = 160) -> DataFrame:
    """doc_id, island, from, to: spans whose gap is at most ``gap`` joined, widened by ``around``."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    df = spans.where("start >= 0 and end > start").select("doc_id", "start", "end").distinct()
    df = df.withColumn("_new", F.when(F.col("start") <= reach + gap, 0).otherwise(1)).withColumn("island", F.sum("_new").over(order))
    return df.groupBy("doc_id", "island").agg(F.greatest(F.min("start") - around, F.lit(0)).alias("from"), (F.max("end") + around).alias("to"))
