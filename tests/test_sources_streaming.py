"""Files, page geometry, numbered texts, providers and streams on small fixtures."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docweave.operators import hierarchy, providers
from docweave.operators.citations import resolve_scheme
from docweave.sources import office, pdf_lines
from docweave.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_rels", "_rels"), text)
    return out.getvalue()


def docx():
    p = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, m="": f"<w:tc><w:tcPr>{m}</w:tcPr>{p(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("a", "<w:vMerge w:val=\"restart\"/>")}{cell("b")}</w:tr><w:tr>{cell("a", "<w:vMerge/>")}{cell("c")}</w:tr></w:tbl>'
    return package(**{"word/document.xml": f"<w:document {W}><w:body>{p('Top', 'Heading1')}{p('text')}{p('one', 'ListParagraph')}{table}</w:body></w:document>"})


def xlsx():
    rows = "".join(f'<row>{"".join(f"<c r={chr(34)}{c}{n}{chr(34)} t={chr(34)}inlineStr{chr(34)}><is><t>{v}</t></is></c>" for c, v in zip("ABC", r) if v)}</row>' for n, r in enumerate((("x", "y", "z"), ("1", "", "3")), 1))
    return package(**{"xl/workbook.xml": f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sh" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"})


def test_office_files(spark, tmp_path):
    for name, raw in (("a.docx", docx()), ("b.xlsx", xlsx()), ("c.csv", "이름,값\n가,1\n".encode("cp949")), ("d.csv", b"\xff\xfe\xff"), ("e.bin", b"x"), ("f.md", b"# T\n- i\np"), ("g.html", b"<h1>H</h1><script>x</script><p>a<p>b")):
        (tmp_path / name).write_bytes(raw)
    rows = office.file_blocks(spark.read.format("binaryFile").load(str(tmp_path))).withColumn("f", F.element_at(F.split("path", "/"), -1)).orderBy("f", "block_no").collect()
    found = {n: [(r.text, r.block_type, r.section) for r in rows if r.f == n] for n in {r.f for r in rows}}
    assert found["a.docx"] == [("Top", "heading", "Top"), ("text", "paragraph", "Top"), ("one", "list_item", "Top"), ("a", "table_cell", "Top"), ("b", "table_cell", "Top"), ("c", "table_cell", "Top")]
    assert found["b.xlsx"] == [("Sh", "heading", "Sh"), ("x: 1 | z: 3", "paragraph", "Sh")]
    assert found["c.csv"] == [("이름: 가 | 값: 1", "paragraph", None)]
    assert found["g.html"] == [("H", "heading", "H"), ("a", "paragraph", "H"), ("b", "paragraph", "H")]
    assert {r.f for r in rows if r.error} == {"d.csv", "e.bin"}
    assert office.xml_lines(b"<a><b>1</b><c><d> x </d></c></a>") == "b: 1\nd: x"


def test_page_geometry():
    w = pdf_lines.Word
    words = [w("left", 50, 90, 100), w("side", 95, 120, 101), w("right", 300, 340, 100), w("low", 50, 80, 130)]
    assert [x.text for x in pdf_lines.page_lines(words)] == ["left side", "low", "right"]
    assert pdf_lines.is_heading("1.2 Scope") and not pdf_lines.is_heading("1.2 Scope ..... 7") and not pdf_lines.is_heading("상표 등록")
    assert pdf_lines.page_unreadable("(cid:1)" * 20) and not pdf_lines.page_unreadable("short")
    pages = [[w("Header", 50, 90, 10), w(f"body text {n} goes on here.", 50, 200, 100)] for n in range(6)]
    blocks = pdf_lines.document_blocks(pages)
    assert [b["text"] for b in blocks][:2] == ["Header", "body text 0 goes on here."] and sum(b["text"] == "Header" for b in blocks) == 1
    assert blocks[-1]["section"] == "Header" and blocks[-1]["page"] == 6


def test_numbered_text(spark):
    scheme = resolve_scheme({"preset": "korean_legal"})
    lines = ["머리말", "제3장 출원", "제36조(상표등록출원) 다음 각 호의 사항을 적는다.", "① 출원인은 적어야 한다.", "1. 상표", "2. 상품", "② 둘째 항"]
    blocks = [{"text": t, "block_type": "paragraph", "section": None} for t in lines]
    out = hierarchy.hierarchical(blocks, scheme, 1000, 1000, count=len)
    assert [p for _, p in out] == [None, "", "조36", "조36/항1", "조36/항2"]
    third = out[3][0]
    assert third.content.startswith("제3장 출원 > 제36조(상표등록출원) 다음") and "1. 상표\n2. 상품" in third.content
    df = spark.createDataFrame([(1, n, t, "paragraph") for n, t in enumerate(lines)], "doc_id long, block_no int, text string, block_type string")
    assert hierarchy.chunk_hierarchy(df, scheme).count() == 5


def test_providers(spark):
    assert [len(b) for b in providers.embed_batches(["a" * 6, "b" * 6, "c"], 2, 10)] == [1, 2]
    assert providers.ordered_vectors([(1, [2.0]), (0, [1.0])], 2, 1) == [[1.0], [2.0]]
    for answer in ([(0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])]):
        with pytest.raises(providers.ProviderError):
            providers.ordered_vectors(answer, 2, 1)
    asked = spark.createDataFrame([(1, "질문", '1. 상표 출원\n- "상표  출원"\nenglish\n2) 질문\n특허'), (2, "a", "\n".join(f"가{k}" for k in range(9))), (3, "b", None), (4, "c", "가" * 201)], "query_id long, question string, answer string")
    got = [(r.query_id, r["at"], r.variant) for r in providers.expansions(asked, 99).orderBy("query_id", "at").collect()]
    assert got == [(1, 1, "상표 출원"), (1, 2, "특허"), *((2, k + 1, f"가{k}") for k in range(5))]
    assert providers.expansions(asked, 0).count() == 0 and providers.expansions(asked, 1).count() == 2
    assert providers.recast(lambda q: "pass", "q") is None and providers.recast(lambda q: 1 / 0, "q") is None
    assert providers.condense(lambda q: "a\nb", "q") == "q" and providers.intent(lambda q: "Chat", "q") == "chat"
    said = spark.createDataFrame([(1, 1, "- a\n- A\n2) b\nnone\n\"c\""), (1, 2, "a\nd\ne\nf"), (2, 1, "none"), (3, 1, "x" * 400)], "owner long, turn int, answer string")
    known = spark.createDataFrame([(1, "B"), (2, "a")], "owner long, text string")
    assert [(r.owner, r["at"], r.fact) for r in providers.facts(said, "owner", ["turn"], known).orderBy("at").collect()] == [(1, 1, "a"), (1, 2, "c"), (1, 3, "d"), (1, 4, "e")]
    got = providers.rerank(lambda p: "1 0", "q", [{"content": "a"}, {"content": "b"}])
    assert [(c["content"], c["rerank_score"]) for c in got] == [("b", 1.0), ("a", 0.5)]
    assert providers.markdown_blocks("# T [1]\n|a|b|\n|-|-|\n|1|\ntext $x$\nmore\n\n- i") == [{"kind": "heading", "level": 1, "text": "T"}, {"kind": "table", "rows": [["a", "b"], ["1", ""]]}, {"kind": "paragraph", "text": "text x more"}, {"kind": "item", "text": "i"}]
    df = spark.createDataFrame([("a", "xx"), ("b", None)], "chunk_id string, content string")
    assert {r.chunk_id: r.embedding for r in providers.embed_table(df, lambda t: [(i, [float(len(x))]) for i, x in enumerate(t)], 1).collect()} == {"a": [2.0], "b": [0.0]}


def test_watched_folder_sees_a_file_once(spark, tmp_path):
    src, led, ck = (str(tmp_path / x) for x in ("in", "ledger", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    (tmp_path / "in/b.txt").write_text("one")
    ingest.watch_folder(spark, src, led, ck).awaitTermination()
    (tmp_path / "in/c.txt").write_text("one")
    (tmp_path / "in/d.txt").write_text("two")
    ingest.watch_folder(spark, src, led, ck).awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: r.status for r in spark.read.parquet(led).collect()}
    assert got == {"a.txt": "registered", "b.txt": "duplicate", "c.txt": "duplicate", "d.txt": "registered"}


def test_rolling_summaries_and_windows(spark, tmp_path, data):
    src = str(tmp_path / "msgs")
    spark.createDataFrame([(1, n, f"t{n}") for n in range(7)], "conv_id long, turn long, text string").coalesce(1).write.parquet(src)
    stream = ingest.rolling_summaries(spark.readStream.schema("conv_id long, turn long, text string").parquet(src), 2, 3)
    stream.writeStream.format("memory").queryName("sums").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    assert [(r.summary, r.summary_through, r.waiting) for r in spark.table("sums").collect()] == [("t0 t1 t2 t3 t4", 4, 2)]
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = ingest.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    stream.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert spark.table("wins").agg(F.sum("n")).first()[0] == events.count()
