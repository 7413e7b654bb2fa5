"""Readers, writers, the command line and the stream."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from bidlens import cli
from bidlens.operators import evidence
from bidlens.plans.queries import _pdf_file
from bidlens.sources import docx, files, pdf, providers, sinks
from bidlens.streaming import incremental

TENDER = "# 文件\n\n## 信息\n项目编号：AB-2024-01\n投标报价：1,234,567.00元\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.md").write_text(TENDER, encoding="utf-8")
    (tmp_path / "b.txt").write_text("投标保证金：5万元\n", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-")
    (tmp_path / "d.bin").write_bytes(b"x")
    return tmp_path


def test_documents(spark, folder):
    got = {r["filename"]: r for r in files.documents(spark, str(folder)).collect()}
    assert set(got) == {"a.md", "b.txt", "c.pdf"} and got["a.md"]["content"] == TENDER and got["a.md"]["original_format"] == "md"
    assert got["c.pdf"]["error"] and got["c.pdf"]["content"] is None
    read = files.documents(spark, str(folder), readers={"pdf": lambda b: b.decode()}).where("filename = 'c.pdf'").first()
    assert read["content"] == "%PDF-" and read["error"] is None
    assert files.can_parse("x.MD") and not files.can_parse("x.xyz")


def docx_file(body, styles=""):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {ns}>{styles}</w:styles>")
    return out.getvalue()


def style(key, name, default=""):
    return f'<w:style w:type="paragraph" w:styleId="{key}" {default}><w:name w:val="{name}"/></w:style>'


def paragraph(body, key=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{key}"/></w:pPr><w:r><w:t>{body}</w:t></w:r></w:p>'


def cell(body, more=""):
    return f"<w:tc><w:tcPr>{more}</w:tcPr>{paragraph(body)}</w:tc>"


def test_docx_blocks():
    styles = style("1", "heading 1") + style("t", "标题 2") + style("h", "Heading") + style("9", "heading 9") + style("l", "List Bullet")
    body = paragraph("招标公告", "1") + paragraph("a", "t") + paragraph("b", "h") + paragraph("c", "9") + paragraph("d", "l") + paragraph(" ") + paragraph("e", "none")
    assert docx.markdown(docx_file(body, styles)) == "# 招标公告\n\n## a\n\n### b\n\n###### c\n\n- d\n\ne"
    assert docx.markdown(docx_file(paragraph("x"), style("n", "heading 2", 'w:default="1"'))) == "## x"
    runs = '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink><w:r><w:br w:type="page"/></w:r><w:del><w:r><w:delText>d</w:delText></w:r></w:del></w:p>'
    assert docx.markdown(docx_file(runs)) == "a\tb\nc"
    assert docx.markdown(docx_file("")) == "" and docx.markdown(docx_file("<w:tbl/>")) == ""


def test_docx_tables():
    wide, start, on = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    rows = (cell("a") + cell("b"), cell("1", start) + cell("2"), cell("", on) + cell("3"), cell("w", wide) + cell("lost"), cell("one"), "<w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc>")
    got = docx.markdown(docx_file("<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"))
    assert got == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 1 | 3 |\n| w | w |\n| one |  |\n| x y |  |"


def test_docx_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx_file(paragraph("项目编号：DOCX-2026-001", "1"), style("1", "heading 1")))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r["filename"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["content"] == "# 项目编号：DOCX-2026-001" and got["a.docx"]["original_format"] == "docx" and got["a.docx"]["error"] is None
    assert got["b.docx"]["content"] is None and got["b.docx"]["error"]
    assert files.can_parse("x.DOCX")


def test_gold_and_manifest(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('# note\n\n{"id": "x", "document": "a.md", "expected": {"f": "v", "g": ["a", " "]}}\n{"document": "b.md", "expected": {"f": []}}\n', encoding="utf-8")
    got = {(r["case_id"][:1], r["field_name"]): r["expected"] for r in files.gold(spark, str(tmp_path / "g.jsonl")).collect()}
    assert got == {("x", "f"): ["v"], ("x", "g"): ["a"], ("c", "f"): []}
    (tmp_path / "bad.jsonl").write_text('{"id": "x"}\n', encoding="utf-8")
    with pytest.raises(Exception, match="gold case"):
        files.gold(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "p.json").write_text(json.dumps({"package_id": "p", "documents": [{"id": "a", "path": "a.md", "role": "tender", "supersedes": ["b"]}]}))
    r = files.manifest(spark, str(tmp_path / "p.json")).first()
    assert (r["path"], r["revision"], r["supersedes"]) == (str(tmp_path / "a.md"), 1, ["b"])


def test_markdown_of_tables_and_blocks(spark):
    one = spark.createDataFrame([([["a", "b"], ["1"], ["x\ny", "2", "3"]],)], "rows array<array<string>>")
    assert one.select(files.table_to_markdown(F.col("rows"))).first()[0] == "| a | b |\n| --- | --- |\n| 1 |  |\n| x y | 2 |"
    spans = spark.createDataFrame([(1, 1, 1, "Big", True, 20.0), (1, 1, 2, "small bold", True, 10.0), (1, 1, 3, "plain", False, 30.0)], "doc_id int, page int, block_no int, text string, bold boolean, size double")
    assert [r["line"] for r in files.blocks_to_markdown(spans).orderBy("block_no").collect()] == ["# Big", "#### small bold", "plain"]
    assert spark.range(1).select(files.clean_pdf(F.lit("a\n\n\n\n\nb 第 1 页 共 9 页 Page 2 of 3"))).first()[0] == "a\n\n\nb  "


def test_command_line(spark, folder, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["extract", str(folder), "--out", str(folder / "out")]) == 1  # the PDF has no reader
    got = {r["doc_id"]: json.loads(r["value"]) for r in spark.read.json(str(folder / "out")).collect()}
    assert got["a.md"]["fields"]["bid_amount"]["normalized_value"] == "1234567.00" and "deposit" in got["b.txt"]["fields"]
    (folder / "g.jsonl").write_text('{"id": "x", "document": "a.md", "expected": {"project_number": "ab-2024-01", "deposit": "9"}}\n', encoding="utf-8")
    assert cli.main(["eval", str(folder / "g.jsonl"), "--fail-under", "0.5"]) == 0
    assert cli.main(["eval", str(folder / "g.jsonl"), "--fail-under", "0.99"]) == 2
    assert cli.main(["providers"]) == 0 and "DeepSeek" in capsys.readouterr().out


def test_providers():
    assert providers.provider("Claude").id == "anthropic" and providers.provider(None).kind == "none"
    assert len(providers.BY_ID) == 31 and len(providers.listed()) == 25
    with pytest.raises(ValueError, match="unknown"):
        providers.provider("nobody")
    assert providers.client(providers.provider("none")) is None


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, TENDER), (2, "nothing")], "doc_id long, content string")
    docs.write.parquet(str(tmp_path / "in"))
    q = incremental.into_fields(incremental.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {r["field_name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"project_number", "bid_amount"}


def test_snapshot(spark, tmp_path):
    q = spark.createDataFrame([("i", "d", "f")], "id string, document string, field_name string")
    name = sinks.write_snapshot(q, str(tmp_path))
    assert files.review_queue(spark, name).first()["id"] == "i"


def test_pdf_pages_and_boxes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(_pdf_file([(1, 18, "招标公告", True), (1, 10, "Page 1 of 2", False), (2, 10, "投标报价：1234.00元", False), (2, 10, "𠀀 end", False)]))
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.4 nothing")
    got = {r["filename"]: r for r in files.documents(spark, str(tmp_path)).collect()}
    assert got["a.pdf"]["content"] == "# 招标公告\n\n\n投标报价：1234.00元\n𠀀 end" and got["a.pdf"]["total_pages"] == 2
    assert got["b.PDF"]["content"] is None and got["b.PDF"]["error"]
    lines = pdf.lines(spark, str(tmp_path))
    assert lines.count() == 4 and pdf.page_texts(lines).where("page = 2").first()["text"] == "投标报价：1234.00元\n𠀀 end"
    spans = spark.createDataFrame([("a.pdf", "f", 0, 2, "1234.00元", None, None), ("a.pdf", "g", 0, 1, "x", None, None)], "doc_id string, field_name string, ord int, page int, value string, source_text string, normalized_value string")
    boxes = evidence.boxes(spans, lines).collect()
    assert [tuple(b) for b in boxes] == [("a.pdf", "f", 0, 2, 75.0, 40.0, 115.0, 52.0, 600.0, 800.0)]


def raw_pdf(*objects, trailer="<< /Root 1 0 R >>"):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o if isinstance(o, bytes) else o.encode()) for n, o in objects) + f"trailer {trailer}\n".encode()


def stream(body, head=""):
    body = body if isinstance(body, bytes) else body.encode("latin-1")
    return f"<< /Length {len(body)} {head} >>\nstream\n".encode() + body + b"\nendstream"


def test_pdf_operators_and_fonts():
    cmap = "1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfchar <41> <62db> endbfchar 2 beginbfrange <42> <43> <6807> <44> <45> [<0031> <00320033>] endbfrange"
    text = r"BT /F 10 Tf 12 TL 10 700 Td (ab(c\)\051\101)) Tj T* [(x) -50 (y) -400 (z)] TJ (next) ' /T 10 Tf 0 -20 Td (ABCDE) Tj ET q 2 0 0 2 0 0 cm BT /D 10 Tf 5 100 Td <0102> Tj ET Q BT bad Tj /F Tf ET BI /W 1 ID \x01(\x02 EI /X Do"
    form = "BT /F 10 Tf 10 20 Td (form) Tj ET /X Do"
    packed = "7 0 8 26 " + "<< /Type /Font /X /Y >>   " + "<< /Type /Font /Subtype /Type1 /Encoding << /Differences [1 /uni4E2D /percent] >> >>"
    first = packed.index("<<")
    objects = [
        (1, "<< /Type /Catalog /Pages 2 0 R >>"), (2, "<< /Type /Pages /Kids [3 0 R 2 0 R 3 0 R] /MediaBox [0 0 100 800] >>"),
        (3, "<< /Type /Page /Contents [4 0 R] /Resources << /Font << /F 5 0 R /T 6 0 R /D 8 0 R >> /XObject << /X 10 0 R >> >> >>"),
        (4, stream(zlib.compress(text.encode("latin-1")), "/Filter [/FlateDecode]")), (5, "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"),
        (6, "<< /Type /Font /Subtype /Type1 /ToUnicode 9 0 R >>"), (9, stream(cmap)), (10, stream(form, "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 0]")),
        (11, stream(zlib.compress(packed.encode()), f"/Type /ObjStm /N 2 /First {first} /Filter /FlateDecode")),
        (12, stream(b"99 0 obj (not one) endobj")),
    ]
    pages = pdf.read(raw_pdf(*objects))
    assert len(pages) == 1  # a page tree that names itself or a page twice gives each page once
    assert [x[0] for x in pages[0][2]] == ["ab(c))A)", "xy z", "next", "招标" + chr(0x6808) + "123", "中%", "form"]
    assert [x[5] for x in pages[0][2]] == [True, True, True, False, False, True] and pages[0][2][4][4] == 20
    with pytest.raises(ValueError, match="encrypted"):
        pdf.read(raw_pdf(*objects, trailer="<< /Root 1 0 R /Encrypt 5 0 R >>"))
    for broken in (b"", b"%PDF-", raw_pdf(objects[0]), raw_pdf(objects[0], (2, "<< /Type /Catalog"))):
        with pytest.raises(ValueError):
            pdf.read(broken)
