"""Values near keywords, and fields by priority: the older, looser way to read a document, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions import text

#: What may stand between a keyword and its value, first come first served, and values that say nothing.
BETWEEN = (r"[：:]\s*([^，。\n]{1,50})", r"[=＝]\s*([^，。\n]{1,50})", r"[为是]\s*([^，。\n]{1,50})")
EMPTY_WORDS = (
    "无 无无 无无无 无无无无 无无无无无 零 零零 零零零 一 二 三 四 五 六 七 八 九 十 壹 贰 叁 肆 伍 陆 柒 捌 玖 拾 日起 之日起 日起之 四川省 中国 成都 成都市 青羊区 北路 东路 南路 西路 公司 集团 企业 有限 股份 责任 "
    "工程 项目 建设 施工 安装 维护 部 局 处 科 室 中心 站 经理 主任 工程师 技术员 负责人 证书 资质 许可证 执照"
).split()
AROUND, CONFIDENCE = 100, 0.8


def meaningful(value: Column) -> Column:
    """Two characters or more, no empty word, and not mostly one character over and over."""
    v = text.utrim(value)
    return (F.length(v) >= 2) & ~v.isin(*EMPTY_WORDS) & (F.size(F.array_distinct(text.characters(value))) >= F.length(value) * 0.3)


def places(content: Column, keyword: str) -> Column:
    """0-based places of a literal, overlaps left out."""
    parts = F.split(content, "\\Q" + keyword + "\\E")
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x)) + (i - 1) * len(keyword))
    return F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<int>"))


def spans(docs: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """doc_id, field_name, keyword, start, value, confidence: the first value within AROUND characters of each keyword."""

    def at(field: str, keyword: str) -> Column:
        return F.transform(places(F.col("content"), keyword), lambda p: F.struct(F.lit(field).alias("field_name"), F.lit(keyword).alias("keyword"), p.cast("int").alias("start")))

    hits = [at(f, k) for f, ks in synonyms.items() for k in ks]
    if not hits:
        return docs.sparkSession.createDataFrame([], "doc_id long, field_name string, keyword string, start int, value string, confidence double")
    df = docs.select("doc_id", "content", F.explode(F.concat(*hits)).alias("x")).select("doc_id", "content", "x.*")
    near = F.substring("content", F.greatest(F.col("start") - AROUND, F.lit(0)) + 1, F.least(F.col("start"), F.lit(AROUND)) + F.length("keyword") - 1 + AROUND)
    df = df.withColumn("_near", near)
    found = F.coalesce(*(F.when(F.col("_near").rlike(p), text.utrim(F.regexp_extract("_near", p, 1))) for p in BETWEEN))
    return df.withColumn("value", found).where(meaningful(F.col("value"))).select("doc_id", "field_name", "keyword", "start", "value", F.lit(CONFIDENCE).alias("confidence"))


def conflicts(spans_: DataFrame) -> DataFrame:
    """doc_id, field_name, repeated, wide: values that occur twice, and numbers over ten times another (none of them zero)."""
    n = F.col("value").try_cast("double")
    return spans_.groupBy("doc_id", "field_name").agg((F.countDistinct("value") < F.count("value")).alias("repeated"), F.coalesce(F.try_divide(F.max(n), F.min(n)) > 10, F.lit(False)).alias("wide"))


def priority(field: Column, priorities: dict[str, list[str]] | None = None) -> Column:
    """The level that lists a field; medium for others."""
    out = None
    for level, names in (priorities or {}).items():
        out = F.when(field.isin(*names), level) if out is None else out.when(field.isin(*names), level)
    return F.lit("medium") if out is None else out.otherwise("medium")


def valid(fields: DataFrame, priorities: dict[str, list[str]] | None = None, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Fields whose confidence reaches their level's threshold (0.7 where none is given) and that have no conflict."""
    level = priority(F.col("field_name"), priorities)
    least = F.lit(0.7)
    for name, t in (thresholds or {}).items():
        least = F.when(level == name, t).otherwise(least)
    return fields.where((F.col("confidence") >= least) & F.col("kind").isNull())


def stats(fields: DataFrame, priorities: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: fields, those of each level, candidates, mean confidence, conflicts."""
    level = priority(F.col("field_name"), priorities)
    return fields.agg(
        F.count(F.lit(1)).alias("total_fields"), *(F.count_if(level == x).alias(x) for x in ("high", "medium", "low")), F.coalesce(F.sum("n_candidates"), F.lit(0)).alias("total_values"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.count_if(F.col("kind").isNotNull()).alias("conflicts_count"),
    )
