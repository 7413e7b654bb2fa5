"""Hard snippets of procurement texts, and what they must give."""

import datetime

import pytest
from pyspark.sql import functions as F

from bidlens.functions import dates, money, text
from bidlens.operators import consolidate, evidence, extract, packages, people, review, route, similar, structure
from bidlens.operators.rules import bank
from bidlens.plans import pipeline
from bidlens.sources.files import Settings, settings


def fields_of(spark, body, **kw):
    docs = spark.createDataFrame([(1, body)], "doc_id long, content string")
    spans = consolidate.dedupe(extract.spans(docs, **kw))
    rows = consolidate.fields(spans).collect()
    return {r["field_name"]: r for r in rows}, [r.asDict() for r in spans.collect()]


@pytest.mark.parametrize(
    ("body", "field", "value"),
    [
        ("联系人：顾老师\n项目经理：张三\n法定代表人：李四\n", "legal_representative", "李四"),
        ("采购人：上海市奉贤区人口综合管理服务中心\n", "tenderer", "上海市奉贤区人口综合管理服务中心"),
        ("项目名称：上海大学文献资源与学科服务建设项目\n采购人：上海大学\n代理机构：江苏省华采招标有限公司\n", "tenderer", "上海大学"),
        ("本办法自2023年1月1日起施行。\n提交投标文件截止时间：2026 年4 月29 日10:00（北京时间）\n", "bid_date", "2026年4月29日10:00"),
        ("投标人应于2026-06-18 10:00:00 在会议室进行开标。\n", "bid_date", "2026-06-1810:00:00"),
        ("投标截止时间：2026-4-30\n9:30，迟到恕不接受。\n", "bid_date", "2026-4-309:30"),
        ("项目名称：某某大学实验室设备\n采购与安装服务项目\n项目编号/包号：ABC-2026-01\n", "project_name", "某某大学实验室设备采购与安装服务项目"),
        ("项目名称：测试工程项目\n项目编号：TEST-2024-001\n", "project_number", "TEST-2024-001"),
        ("投标人：测试工程集团有限公司\n", "bidder", "测试工程集团有限公司"),
    ],
)
def test_primary_values(spark, body, field, value):
    assert fields_of(spark, body)[0][field]["primary_value"] == value


@pytest.mark.parametrize(
    ("body", "field", "normalized"),
    [
        ("投标金额：人民币壹佰万元整（¥1,000,000.00）\n", "bid_amount", "1000000.00"),
        ("投标保证金：人民币伍万元整\n", "deposit", "50000.00"),
        ("预算金额：9,323,695.00元\n", "bid_amount", "9323695.00"),
        ("投标保证金：5万元\n", "deposit", "50000.00"),
    ],
)
def test_amounts(spark, body, field, normalized):
    assert normalized in {s["normalized_value"] for s in fields_of(spark, body)[1] if s["field_name"] == field}


@pytest.mark.parametrize(("body", "field"), [("设备容量要求为20000万元等值参数", "bid_amount"), ("采购代理机构：江苏省华采招标有限公司\n", "tenderer"), ("采购人通过www.gsxt.gov.cn等渠道查询：供应商的姓名或者名称、地址\n", "tenderer"), ("", "bid_amount")])
def test_not_found(spark, body, field):
    assert field not in fields_of(spark, body)[0]


def test_short_amounts_can_be_left_out(spark):
    docs = spark.createDataFrame([(1, "投标保证金：5万元\n")], "doc_id long, content string")
    assert extract.spans(docs, short_amounts=False).where("field_name = 'deposit'").count() == 0


def test_deposit_above_amount(spark):
    got = fields_of(spark, "投标报价：100,000.00元\n投标保证金：200,000.00元\n")[0]
    assert got["deposit"]["kind"] == "deposit" and got["deposit"]["confidence"] == pytest.approx(0.475)


def test_custom_rules_may_name_fields():
    got = [r for r in bank({"serial": ["A(\\d+)", {"pattern": "B", "confidence": 2}, "(bad", 5]}) if r[0] == "serial"]
    assert [(r[2], r[3]) for r in got] == [("yaml-custom", 0.9), ("yaml-custom", 1.0)]


def test_scalars(spark):
    one = spark.range(1)
    num = lambda s: one.select(money.cn_yuan(F.lit(s))).first()[0]
    assert num("壹亿贰仟万零叁拾伍") == 120000035 and num("拾万") == 100000 and num("零") is None and num("") is None
    day = lambda s: one.select(dates.parsed(F.lit(s))).first()[0]
    assert day("2024-02-29") == datetime.date(2024, 2, 29) and day("2023-02-29") is None and day("3/4/2025") == datetime.date(2025, 3, 4)
    assert one.select(text.normal_value(F.lit(" Ａ（甲）：Straße​，"))).first()[0] == "ａ(甲):strasse,"
    assert one.select(text.mask_text(F.lit("x110101199003078888y"))).first()[0] == "x110101****8888y"
    assert one.select(text.redacted(F.lit("13800138000 a@b.cn"))).first()[0] == "138****8000 [REDACTED_EMAIL]"
    assert one.select(text.jaccard(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("B"), F.lit("C")))).first()[0] == pytest.approx(1 / 3)
    assert similar.indel("", "") == 1 and similar.indel("abcd", "abd") == pytest.approx(6 / 7)


def test_evidence_narrows_and_recovers(spark):
    body = "# 采购\n\n## 一、信息\n\n\n项目编号：AB-12345\n再次 AB-12345\n"
    docs = spark.createDataFrame([(1, body)], "doc_id long, content string")
    spans = extract.spans(docs, fields=["project_number"])
    r = evidence.located(spans, docs).first()
    assert (r["source_text"], r["line_start"], r["section_path"]) == ("AB-12345", 6, ["采购", "一、信息"])
    lost = spans.withColumns({"start": F.lit(-1), "end": F.lit(-1)})
    assert evidence.located(lost, docs).first()["source_start"] == body.index("AB-12345")


def test_people_and_certificates():
    body = "| 1 | 王小明 | 项目经理 | 11010119900307889X |\n技术负责人：赵六，学历本科\n二级注册建造师证书编号：JZ2024001，有效期至：2030年1月1日"
    got = people.people_in(body)  # a number within reach of a label counts as that person's
    assert [(p["name"], p["role"], p["education"]) for p in got] == [("王小明", "项目经理", "本科")]
    alone = people.people_in(body.split("\n", 1)[1])
    assert [(p["name"], p["role"], p["education"]) for p in alone] == [("赵六", "技术负责人", "本科")]
    assert people.certificates_in(body)[0] == {"cert_type": "建造师", "cert_number": "JZ2024001", "holder_name": people.certificates_in(body)[0]["holder_name"], "expiry_date": "2030年1月1日"}


def test_exact_copies_and_routes(spark):
    chunks = spark.createDataFrame([(1, i, c, ["财务"], len(c) // 4, c) for i, c in enumerate(["投标报价与保证金 金额", "投标报价与保证金 金额", "没有关系的文字说明"])], "doc_id long, chunk_no int, content string, chapter_path array<string>, token_count int, fingerprint string")
    got = {r["chunk_no"]: r for r in similar.dedupe(chunks).collect()}
    assert got[1]["is_duplicate"] and got[1]["duplicate_of"] == 0 and not got[2]["is_duplicate"]
    assert {(r["chunk_no"], r["module_name"]) for r in route.routes(chunks).collect()} == {(0, "财务信息"), (1, "财务信息"), (2, "通用抽取")}


PACKAGE = "package_id string, id string, role string, bidder string, logical_name string, revision int, supersedes array<string>"


def test_packages(spark):
    docs = spark.createDataFrame([("p", "a", "tender", None, "t", 1, []), ("p", "b", "tender", None, "t", 2, []), ("p", "c", "amendment", None, None, 1, []), ("p", "d", "bid", "B1", None, 1, []), ("p", "e", "bid", "B2", None, 1, ["d"])], PACKAGE)
    got = {r["id"]: r["reason"] for r in packages.resolutions(docs).collect()}
    assert got == {"a": "newer_revision", "b": None, "c": None, "d": "superseded", "e": None}
    assert {(r["id"], r["problem"]) for r in packages.problems(docs).collect()} == {("e", "target of another scope")}
    fields = spark.createDataFrame([("b", "x", "old", 0.9, ["old"]), ("c", "x", "new", 0.5, ["new"])], "doc_id string, field_name string, primary_value string, confidence double, values array<string>")
    r = packages.effective(docs, fields).first()
    assert (r["primary_value"], r["selected_from"], r["conflicts"]) == ("new", "c", ["old"])
    ring = spark.createDataFrame([("p", "a", "tender", None, None, 1, ["b"]), ("p", "b", "tender", None, None, 1, ["a"])], PACKAGE)
    assert packages.cycles(ring).count() == 2


def test_review_is_idempotent(spark):
    fields = spark.createDataFrame([("d", "f", "v", 0.4, None, ["v", "V ", "w"], "regex")], "document string, field_name string, primary_value string, confidence double, kind string, values array<string>, source string")
    q = review.items(fields, "t1")
    assert q.first()["candidate_values"] == ["v", "w"]
    again = review.upsert(q, review.items(fields, "t2"))
    assert [(r["created_at"], r["updated_at"]) for r in again.collect()] == [("t1", "t2")]
    done = review.resolved(again, again.select("id", F.lit("reject").alias("action"), F.lit(None).cast("array<string>").alias("values")), "t3")
    assert review.upsert(done, review.items(fields, "t4")).first()["status"] == "resolved"
    assert review.gold(done).first()["expected"] == []


def test_whole_pipeline(spark):
    body = "# 文件\n\n## 商务\n\n项目名称：测试工程建设项目\n投标报价：1,234,567.00元\n联系电话：13800138000\n姓名：王五，身份证号：110101199003078886\n"
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, content string")
    out = pipeline.run(docs, Settings(llm_provider="stub", llm_model="m"), client=lambda s, p: '{"extracted_values": ["答"], "confidence": 0.5}')
    got = {r["field_name"]: r["primary_value"] for r in out.fields.where("doc_id = 1").collect()}
    assert got["bid_amount"] == "1234567.00元" and got["project_name"] == "测试工程建设项目"
    assert "答" in {r["value"] for r in out.spans.where("source = 'llm'").collect()}
    assert out.people.first()["id_card"] in ("110101****8886",) or out.people.count() == 1


def test_settings():
    s = settings({"base": {"use_ner": True}, "chunking": {"max_chunk_size": 5}}, llm_provider="x", use_modules=None)
    assert (s.use_ner, s.max_chunk_tokens, s.llm_provider, s.use_modules) == (True, 5, "x", True)


def test_chunking(spark):
    assert structure.recursive_split("一二三四。五六七八。", 1) and "".join(structure.recursive_split("ab cd ef gh", 1)).replace(" ", "") == "abcdefgh"
    docs = spark.createDataFrame([(1, "# A\n\ntext one\n\n## B\n\ntext two\n"), (2, "")], "doc_id long, content string")
    got = structure.chunks(docs).collect()
    assert [(r["content"], r["chapter_path"]) for r in got] == [("text one", ["A"]), ("text two", ["A", "B"])]


def test_minhash_candidates_against_brute_force(spark):
    """Recall over all pairs at Jaccard 0.5 and more, and pairs whose bucket has a smaller key."""
    import itertools
    import random

    assert similar.bands_for(0.5, 128) == (25, 5)
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)]
        for edits in (0, 0, 5, 12, 20, 30):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(300)] = rng.choice("0123456789")
            texts.append("".join(t))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    buckets = {}
    for r in similar.minhash_candidates(df, "doc_id", "text").collect():
        buckets.setdefault((r["band"], r["bucket"]), []).append(r["b"])
        assert r["a"] <= r["b"]
    got = {p for b in buckets.values() for p in itertools.combinations(sorted(b), 2)}
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    score = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in itertools.combinations(range(len(sets)), 2)}
    recall = {}
    for low, high in ((0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 1.1)):
        pairs = {p for p, x in score.items() if low <= x < high}
        recall[low] = len(pairs & got) / len(pairs)
        print(low, len(pairs), round(recall[low], 3))
    assert recall[0.5] > 0.6 and recall[0.6] > 0.85 and recall[0.7] > 0.95 and recall[0.8] > 0.99


def test_lsh_query_against_brute_force(spark):
    """Every text of the index that is like the asked one is found once, with its number of copies."""
    import random

    rng = random.Random(7)
    texts = []
    for _ in range(30):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)]
        for edits in (0, 0, 5, 10):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(300)] = rng.choice("0123456789")
            texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate([*texts, "", "", None])), "doc_id long, text string").repartition(3)
    got = {(r["query"], r["first"]): (r["copies"], r["estimate"]) for r in similar.lsh_query(df.where("doc_id % 4 = 0 or doc_id = 121"), df, "doc_id", "text").collect()}
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    for q in range(0, len(texts), 4):
        near = {j for j in range(len(texts)) if len(sets[q] & sets[j]) / len(sets[q] | sets[j]) >= 0.7} - {q + 1}
        assert near <= {f for a, f in got if a == q} and got[q, q] == (2, 1.0)
        assert all(f // 4 == q // 4 for a, f in got if a == q)
    assert got[121, 120] == (3, 1.0)  # empty and null texts are alike


def test_near_list_and_merged_extractions(spark):
    bodies = ["甲乙丙丁戊己庚辛壬癸", "甲乙丙丁戊己庚辛壬癸", "甲乙丙丁戊己庚辛壬子", "甲乙丙丁戊己庚丑寅卯", "东西南北春夏秋冬上下"]
    chunks = spark.createDataFrame([(1, i, c, ["章"], 2, c) for i, c in enumerate(bodies)], "doc_id long, chunk_no int, content string, chapter_path array<string>, token_count int, fingerprint string")
    near = [(r["chunk_no"], r["other_no"], r["rank"]) for r in similar.near(chunks).orderBy("chunk_no", "rank").collect()]
    assert near == [(2, 0, 1), (2, 1, 2), (3, 0, 1), (3, 1, 2), (3, 2, 3)]  # an exact copy has no list of its own
    rows = [(1, 0, "f", "a", 0, 1, 0.9, 0), (1, 0, "f", "b", 2, 3, 0.5, 1), (1, 1, "f", "z", 0, 1, 0.9, 0), (1, 2, "f", "a", 0, 1, 0.3, 0), (1, 2, "g", "c", 0, 1, 0.4, 0), (1, 4, "f", "d", 0, 1, 0.2, 0)]
    spans = spark.createDataFrame(rows, "doc_id long, chunk_no int, field_name string, value string, start int, end int, confidence double, ord int")
    got = [(r["chunk_no"], r["field_name"], r["ord"], r["value"], r["confidence"]) for r in similar.merged_extractions(spans, chunks).orderBy("chunk_no", "field_name", "ord").collect()]
    assert [x for x in got if x[0] == 0] == [(0, "f", 0, "a", 0.9), (0, "f", 1, "b", 0.5)]
    assert not [x for x in got if x[0] == 1]
    assert [x for x in got if x[0] == 2] == [(2, "f", 0, "z", 0.9), (2, "f", 1, "b", 0.5), (2, "f", 2, "a", 0.3), (2, "g", 0, "c", 0.4)]
    assert [x for x in got if x[0] == 4] == [(4, "f", 0, "d", 0.2)]


def test_near_at_the_loosened_threshold(spark):
    """0.6 of 0.4 characters in common, 0.3 and 0.1 make 0.64, which 0.8 of 0.8 lets in."""
    chunks = spark.createDataFrame([(1, 0, "甲乙丙丁戊己庚", ["章"], 2, "a"), (1, 1, "甲乙丙丁辛壬癸", ["章"], 2, "b")], "doc_id long, chunk_no int, content string, chapter_path array<string>, token_count int, fingerprint string")
    assert [(r["chunk_no"], r["other_no"], r["score"]) for r in similar.near(chunks, ratio=False).collect()] == [(1, 0, 0.64)]


ODD = ["", None, "\n", "# 一\n## 报价\n投标报价：12,345元\n投标报价：1.234567万元 合计12元\n投标保证金：壹万贰仟元整\n## 空\n", "项目编号：AB-1234 \n采购人：（某某大学）\n开标时间：2026年3月4日 10:30\n2027年2月30日，3/4/2026 a@b.cn 0571-12345678 13800138000", "投标保证金：200,000.00元\n投标报价：99元\n法定代表人：无\n邮箱：x@y.com、z@y.com"]


def test_one_pass_gives_what_windows_give(spark):
    """What is folded in a document's own pass against the same by windows and joins; the pass shuffles nothing."""
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, content string")
    spans = consolidate.dedupe(extract.spans(docs))

    def place(body, rows):
        heads = structure.outline(body or "")
        return [(s.ord, *evidence.place_of(body, heads, s.start, s.end, s.value, s.normalized_value, s.ref)) for s in consolidate.dedupe_of(rows)]

    for fold, schema, windows in [
        (lambda body, rows: consolidate.dedupe_of(rows), extract.SPAN, spans),
        (lambda body, rows: consolidate.fields_of(rows), consolidate.FIELD, consolidate.fields(spans)),
        (lambda body, rows: consolidate.conflicts_of(consolidate.dedupe_of(rows)), consolidate.CONFLICTS, consolidate.conflicts(spans)),
        (lambda body, rows: consolidate.deposit_of(consolidate.dedupe_of(rows)), consolidate.DEPOSIT, consolidate.deposit_check(spans)),
        (lambda body, rows: consolidate.statistics_of(consolidate.fields_of(rows)), consolidate.STATISTICS, consolidate.statistics(consolidate.fields(spans))),
        (place, f"ord int, {evidence.PLACE}", evidence.located(spans, docs)),
    ]:
        df = extract.folded(docs, fold, schema)
        assert "Exchange" not in df._jdf.queryExecution().toString()
        rows = sorted(map(str, df.collect()))
        assert rows and rows == sorted(map(str, windows.select(df.columns).collect()))


def test_matches_are_those_of_a_whole_scan():
    import random

    rng = random.Random(5)
    bits = [*"0123456789,.-/ \n年月日元万@aKſ：", "万元", "2024年1月2日", "2024-01-02", "a@b.cn", "投标保证金：", "保证金：人民币", "（大写）壹佰元", "¥"]
    for _ in range(300):
        body = "".join(rng.choice(bits) for _ in range(60))
        for r in extract.compiled(tuple(bank())):
            want = [m.span() for m in r.pattern.finditer(body)]
            assert want == [m.span() for m in extract.matches(r, body)] and (not want or all(c in body for c in r.must))


def test_a_sum_too_long_is_no_error(spark):
    got = fields_of(spark, "投标报价：1234567890123456789012元\n")[0]
    assert got["bid_amount"]["normalized_value"] is None


@pytest.mark.parametrize("name", ["field_conflicts", "field_report", "missing_context", "chunks_merged", "route_selected", "sections", "section_asof", "evidence_page", "ner_entities", "reference_paragraph"])
def test_texts_are_not_shuffled(spark, name):
    """After the corpus is rendered its texts stay where they are."""
    from bidlens.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" in plan and "Exchange" not in plan[: plan.index("xxhash64") - 200] and plan.count("xxhash64") == 1


@pytest.mark.parametrize("name", ["pdf_markdown", "evidence_box", "docx_markdown"])
def test_files_are_read_by_all_cores(spark, name):
    """A table in one file is dealt out before its rows become files, and the files are read in one pass."""
    from bidlens.plans.catalogue import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") == 1 == plan.count("Scan parquet") and "Exchange" not in plan[: plan.index("xxhash64") - 200]
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rings_against_taking_edges_away():
    """Random packages, and a chain long enough that a pass over it for each link would not end."""
    import random

    rng = random.Random(2)
    for _ in range(300):
        pairs = [(a, b) for a, b in ((rng.choice("abcdefg"), rng.choice("abcdefg")) for _ in range(rng.randrange(12))) if a != b]
        live, old = set(pairs), None
        while live != old:
            old, live = live, {(a, b) for a, b in live if a in {y for _, y in live} and b in {x for x, _ in live}}
        assert packages.rings(pairs) == [(a,) for a in sorted({a for a, _ in live})]
    assert packages.rings([(f"{i:06d}", f"{i + 1:06d}") for i in range(100_000)]) == []


def test_lsh_query_does_not_deal_out_signatures_of_the_index(spark):
    """Hashes of bands are dealt out; of signatures (1 KB a text) only those of texts that were hit. Keys that repeat stay apart."""
    rows = [(0, "abcdefghij" * 9), (1, "abcdefghij" * 9), (1, "another text altogether, of letters"), (2, "another text altogether, of letters")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = similar.lsh_query(df, df, "doc_id", "text")
    got = sorted((r["query"], r["first"], r["copies"], r["estimate"]) for r in out.collect())
    assert got == [(0, 0, 2, 1.0), (1, 0, 2, 1.0), (1, 1, 2, 1.0), (2, 1, 2, 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/hits-") + plan.count("Relation") >= 2 and "LeftSemi" in plan
