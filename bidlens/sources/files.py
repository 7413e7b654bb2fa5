"""Readers of documents, manifests, annotated cases, review queues, model caches and settings.

Texts are read by Spark, so inputs can lie in any store it knows. Formats that need a library which
is not there are reported as rows with an error, not as failures of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions import text as T
from bidlens.sources import docx, pdf

TEXT, MARKDOWN = ("txt",), ("md", "markdown")
DOCUMENTS = "doc_id string, filename string, original_format string, content string, total_pages int, file_size long, error string"


def capabilities() -> dict[str, bool]:
    """Formats that can be read here without a reader of the caller's."""
    return {"txt": True, "md": True, "markdown": True, "pdf": True, "docx": True}


def supported() -> set[str]:
    return {f".{k}" for k, ok in capabilities().items() if ok}


def can_parse(path: str) -> bool:
    return "." + path.rsplit(".", 1)[-1].lower() in supported()


def documents(spark: SparkSession, path: str, pattern: str = "*", readers: dict[str, Callable[[bytes], str | tuple[str, int]]] | None = None) -> DataFrame:
    """DOCUMENTS for the files of a folder (not of folders in it) or one file.

    ``pattern`` ``*`` keeps supported suffixes only. ``readers``: suffix to a function from bytes to
    text, or text and number of pages, for other formats or to replace those for DOCX and PDF (to recognise scans).
    """
    readers = {"docx": docx.markdown, "pdf": pdf.markdown} | (readers or {})
    known = set(capabilities()) | set(readers)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*" if pattern in ("*", "*.*") else pattern).load(path)
    raw = raw.select("path", "length", "content").withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    if pattern in ("*", "*.*"):
        raw = raw.where(F.col("suffix").isin(*sorted(known)))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    plain = F.col("suffix").isin(*TEXT, *MARKDOWN)
    texts = raw.where(plain).select(name.alias("doc_id"), name.alias("filename"), F.when(F.col("suffix").isin(*MARKDOWN), "md").otherwise(F.col("suffix")).alias("original_format"), F.decode("content", "UTF-8").alias("content"), F.lit(1).alias("total_pages"), F.col("length").alias("file_size"), F.lit(None).cast("string").alias("error"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, s, size, body in zip(b["name"], b["suffix"], b["length"], b["content"], strict=True):
                try:
                    got = readers[s](bytes(body)) if s in readers else None
                    content, pages = got if isinstance(got, tuple) else (got, 0)
                    rows.append((n, n, s, content, pages, size, None if s in readers else f"no reader for .{s}"))
                except Exception as e:  # noqa: BLE001  a broken file is a row with its error
                    rows.append((n, n, s, None, 0, size, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCUMENTS.split(", ")])

    others = raw.where(~plain).select(name.alias("name"), "suffix", "length", "content").mapInPandas(parse, DOCUMENTS)
    return texts.unionByName(others.withColumn("content", F.when(F.col("original_format") == "pdf", clean_pdf(F.col("content"))).otherwise(F.col("content"))))


def scanned_page(characters, image_share):
    """Whether a page must be recognised: under 50 characters, or under 150 beside an image of over half of it."""
    return (characters < 50) | ((characters < 150) & (image_share > 0.5))


def blocks_to_markdown(spans: DataFrame) -> DataFrame:
    """doc_id, page, block_no, line of text spans (text, bold, size): headings by size where bold."""
    c, bold, size = T.utrim(F.col("text")), F.col("bold"), F.col("size")
    line = F.when(bold & (F.length(c) < 50), F.concat(F.lit("#### "), c)).otherwise(c)
    for least, marks in reversed(pdf.HEADING_SIZES):
        line = F.when(bold & (size >= least), F.concat(F.lit(marks), c)).otherwise(line)
    return spans.where(c != "").select("doc_id", "page", "block_no", line.alias("line"))


def table_to_markdown(rows):
    """A Markdown table of an array of arrays of cells; rows are cut or filled to the header's width."""
    head = F.element_at(rows, 1)
    width = F.size(head)
    clean = lambda r: F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), 1, width), lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(clean(r)))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(clean(head)), line(F.array_repeat(F.lit("---"), width))), body), "\n")).otherwise(F.lit(""))


def clean_pdf(c):
    """Page numbers and long runs of blank lines taken out."""
    c = F.regexp_replace(c, r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, r"第\s*\d+\s*页\s*共\s*\d+\s*页", "")
    return F.regexp_replace(c, r"(?i)Page\s+\d+\s+of\s+\d+", "")


@dataclass(frozen=True)
class Settings:
    """How a run works; values enter plans as literals."""

    use_modules: bool = True
    use_ner: bool = False
    include_pii: bool = False
    enable_dedupe: bool = True
    confidence_threshold: float = 0.7
    max_chunk_tokens: int = 800
    overlap_tokens: int = 100
    llm_provider: str = "none"
    llm_model: str = ""
    llm_base_url: str = ""
    recover_missing: bool = True
    cache_dir: str = ""
    custom_patterns: dict = field(default_factory=dict)


def settings(data: dict | None = None, **given) -> Settings:
    """Settings from a parsed file (base, chunking, llm, patterns, cache) and given values, which win unless None."""
    data = data or {}
    base, chunking, llm, cache = (data.get(k) or {} for k in ("base", "chunking", "llm", "cache"))
    first = lambda d, *keys: next((d[k] for k in keys if d.get(k) is not None), None)
    found = {
        "use_modules": base.get("use_modules"), "use_ner": base.get("use_ner"), "include_pii": base.get("include_pii"), "enable_dedupe": base.get("enable_dedupe"), "confidence_threshold": base.get("confidence_threshold"),
        "max_chunk_tokens": first(chunking, "max_tokens", "max_chunk_size"), "overlap_tokens": first(chunking, "overlap_tokens", "overlap_size"),
        "llm_provider": llm.get("provider"), "llm_model": llm.get("model"), "llm_base_url": llm.get("base_url"), "recover_missing": llm.get("recover_missing_fields"), "cache_dir": cache.get("dir"), "custom_patterns": data.get("patterns"),
    }
    names = {f.name for f in fields(Settings)}
    unknown = set(given) - names
    if unknown:
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(Settings(), **{k: v for k, v in (found | {k: v for k, v in given.items() if v is not None}).items() if v is not None})


def yaml_file(path: str) -> dict:
    """A mapping from a YAML or JSON file; empty where there is none."""
    import json
    import os

    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        body = f.read()
    if path.endswith(".json"):
        got = json.loads(body)
    else:
        import yaml

        got = yaml.safe_load(body)
    return got if isinstance(got, dict) else {}


PACKAGE = "package_id string, id string, path string, role string, bidder string, logical_name string, revision int, supersedes array<string>, issued_at string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a package manifest, paths made absolute beside it."""
    import os

    data = yaml_file(path)
    here = os.path.dirname(os.path.abspath(path))
    rows = [
        (str(data.get("package_id")), str(d["id"]), os.path.join(here, d["path"]), d.get("role", "other"), d.get("bidder"), d.get("logical_name"), int(d.get("revision", 1)), [str(x) for x in d.get("supersedes") or []], d.get("issued_at"))
        for d in data.get("documents") or []
    ]
    return spark.createDataFrame(rows, PACKAGE)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """case_id, document, field_name, expected, tags of annotated JSON lines; blank lines and lines with # are passed over.

    A single expected string is a list of one; blank values go; a case without a document or fields is an error.
    """
    lines = spark.read.text(path).withColumn("line", F.trim("value")).where("line <> '' and not startswith(line, '#')")
    raw = lines.select("line", F.from_json("line", "id string, document string, expected map<string,string>, tags array<string>").alias("x")).select("line", "x.*")
    checked = raw.withColumn("_ok", F.when((F.coalesce("document", F.lit("")) == "") | F.col("expected").isNull(), F.raise_error(F.concat(F.lit("a gold case must have a document and expected fields: "), F.substring("line", 1, 80)))).otherwise(F.lit(True))).where("_ok")
    df = checked.select(F.coalesce("id", F.concat(F.lit("case-"), F.substring(F.sha2("line", 256), 1, 12))).alias("case_id"), "document", F.explode("expected").alias("field_name", "v"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    return df.select("case_id", "document", "field_name", F.filter(listed, lambda v: F.trim(v) != "").alias("expected"), "tags")


def review_queue(spark: SparkSession, path: str) -> DataFrame:
    from bidlens.operators.review import QUEUE

    return spark.read.schema(QUEUE).option("mode", "FAILFAST").json(path)


def model_cache(spark: SparkSession, path: str) -> DataFrame:
    from bidlens.operators.model_review import ANSWER

    return spark.read.schema(f"key string, {ANSWER}").parquet(path)
