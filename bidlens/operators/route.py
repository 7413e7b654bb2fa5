"""Routing of chunks to topic modules by weighted keywords, and the fields that are still missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.functions import text
from bidlens.functions.passes import each
from bidlens.functions.text import WHITE
from bidlens.operators.rules import MODULES, field_table, keyword_rows

#: A module is kept from this share of the chunk's best score.
NEAR_BEST = 0.6
#: Characters that a context for a missing field reaches at most, and of the document where nothing fits.
CONTEXT, HEAD = 2400, 1200


_KEYWORDS = [(k, m, w) for m, _, k, w in keyword_rows()]
_NAMES, _ORDER = {m: name for m, name, *_ in MODULES}, {m: i for i, (m, *_) in enumerate(MODULES)}


def keywords_in(body: str) -> list[tuple]:
    """The keywords that occur in a text, as ``scores_of`` takes them."""
    return [x for x in _KEYWORDS if x[0] in body]


def scores_of(path: list[str] | None, content: str | None, among: list[tuple] = _KEYWORDS) -> list[tuple[str, float, list[str]]]:
    """module_id, match_score, matched_keywords of the modules with a keyword in a chunk or its path; a hit is counted without overlaps."""
    if path is None or content is None:
        return []
    body = " ".join(x for x in path if x is not None) + " " + content
    out: dict[str, tuple[float, list[str]]] = {}
    for k, m, w in among:
        if k in body:
            score, words = out.get(m, (0.0, []))
            out[m] = score + body.count(k) * w, [*words, k]
    return [(m, *x) for m, x in out.items()]


def of_chunks(one: Callable, rows: list[tuple]) -> list[tuple[tuple, list[tuple]]]:
    """Each of a document's CHUNK rows with ``scores_of`` or ``routes_of`` it; the document's keywords are looked up once."""
    among = keywords_in("\n".join("\n".join((*r[5], r[2])) for r in rows))
    return [(r, one(r[5], r[2], among)) for r in rows]


def scores(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, module_id, match_score, matched_keywords for modules with a hit."""
    return each(chunks, ["doc_id", "chunk_no"], ["chapter_path", "content"], lambda: lambda path, content: scores_of(path, content), "module_id string, match_score double, matched_keywords array<string>")


ROUTE = "module_id string, module_name string, match_score double, matched_keywords array<string>, route_ord int"


def routes_of(path: list[str] | None, content: str | None, among: list[tuple] = _KEYWORDS) -> list[tuple]:
    """ROUTE of one chunk."""
    scored = scores_of(path, content, among)
    if not scored:
        return [("general", "通用抽取", 0.0, [], 0)]
    least = max(s for _, s, _ in scored) * NEAR_BEST
    near = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[1], _ORDER[x[0]]))
    return [(m, _NAMES[m], s, words, i) for i, (m, s, words) in enumerate(near)]


def routes(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_no, module_id, module_name, match_score, matched_keywords, route_ord; ``general`` for chunks without hits."""
    return each(chunks, ["doc_id", "chunk_no"], ["chapter_path", "content"], lambda: lambda path, content: routes_of(path, content), ROUTE)


def summary(routes_: DataFrame) -> DataFrame:
    """Per module name: routes, and five of its keywords in order of spelling."""
    words = routes_.select("module_name", F.explode_outer("matched_keywords").alias("k"))
    kept = words.groupBy("module_name").agg(F.slice(F.sort_array(F.collect_set("k")), 1, 5).alias("top_keywords"))
    return routes_.groupBy("module_name").agg(F.count(F.lit(1)).alias("routes")).join(kept, "module_name")


def expected_fields(routes_: DataFrame) -> DataFrame:
    """doc_id, field_name: the fields of the modules that a document was routed to and a model could recover."""
    table = F.broadcast(field_table(routes_.sparkSession).where("llm_recoverable and module_id is not null"))  # under 50 rows
    return routes_.select("doc_id", "module_id").distinct().join(table, "module_id").select("doc_id", "field_name").distinct()


def missing_fields(routes_: DataFrame, found: DataFrame) -> DataFrame:
    return expected_fields(routes_).join(found.select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti")


def rule_fields_of_routes(routes_: DataFrame) -> DataFrame:
    """doc_id, chunk_no, field_name: what a chunk is scanned for again."""
    table = F.broadcast(field_table(routes_.sparkSession).where("has_rules and module_id is not null"))  # under 50 rows
    return routes_.join(table, "module_id").select("doc_id", "chunk_no", "field_name").distinct()


def missing_context(missing: DataFrame, routes_: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, field_name, context: distinct chunk texts of the field's modules until CONTEXT characters, else the document's head."""
    table = F.broadcast(field_table(routes_.sparkSession).where("module_id is not null").select("module_id", "field_name"))
    pieces = missing.join(routes_.join(table, "module_id").select("doc_id", "field_name", "chunk_no", "route_ord"), ["doc_id", "field_name"]).join(chunks.select("doc_id", "chunk_no", text.utrim(F.col("content")).alias("piece")), ["doc_id", "chunk_no"])
    pieces = pieces.where("piece <> ''").groupBy("doc_id", "field_name", "piece").agg(F.min(F.struct("chunk_no", "route_ord")).alias("at"))
    before = W.partitionBy("doc_id", "field_name").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).where(F.col("_before") < CONTEXT)
    joined = pieces.groupBy("doc_id", "field_name").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "\n---\n"), 1, CONTEXT).alias("context"))
    return missing.join(joined, ["doc_id", "field_name"], "left").join(docs.select("doc_id", F.substring("content", 1, HEAD).alias("_head")), "doc_id").select("doc_id", "field_name", F.coalesce("context", "_head").alias("context"))


_FIELDS = {m: fields.split() for m, *_, fields in MODULES}


def missing_of(routed: list[tuple[int, str | None, list[tuple]]], found: set[str]) -> list[str]:
    """``missing_fields`` of a document: ``routed`` has number, text and ROUTE rows of each chunk, ``found`` the fields it has."""
    expected = {f: None for _, _, rows in routed for m, *_ in rows for f in _FIELDS.get(m, ()) if f != "table_data"}
    return [f for f in expected if f not in found]


def context_of(field: str, routed: list[tuple[int, str | None, list[tuple]]], body: str | None) -> str | None:
    """``missing_context`` of a missing field of a document."""
    first: dict[str, tuple[int, int]] = {}
    for no, content, rows in routed:
        piece = (content or "").strip(WHITE)
        for m, *_, place in rows:
            if piece and field in _FIELDS.get(m, ()):
                first[piece] = min(first.get(piece, (no, place)), (no, place))
    out, before = [], 0
    for piece in sorted(first, key=first.get):
        if before >= CONTEXT:
            break
        out.append(piece)
        before += len(piece)
    return "\n---\n".join(out)[:CONTEXT] if out else None if body is None else body[:HEAD]
