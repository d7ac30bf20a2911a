"""Readers of whole files against small files that hold one of each thing."""

import io
import json
import zipfile

import pytest

from ledgerloom.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def of(rows, part):
    return [(r["kind"], r["text"]) for r in rows if r["part"] == part]


def test_docx():
    p = lambda text, style="": f'<w:p><w:pPr>{style and f"<w:pStyle w:val=\'{style}\'/>"}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    rows = files.read_bytes("a/b.DOCX", zipped({
        "word/document.xml": f'<w:document {W}><w:body>{p("Order", "T1")}{p("Part", "Heading1")}{p("")}{p("one", "ListBullet")}{p("two")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="T1"><w:name w:val="Title"/></w:style></w:styles>',
        "word/header1.xml": f"<w:hdr {W}>{p('PO 12')}</w:hdr>", "word/footer1.xml": f"<w:ftr {W}>{p('SIRET')}</w:ftr>",
        "docProps/core.xml": '<c xmlns:dc="x"><dc:title>T</dc:title><dc:creator>Me</dc:creator></c>',
    }))
    assert of(rows, "block") == [("title", "Order"), ("heading", "Part"), ("list_item", "one"), ("paragraph", "two"), ("footer", "SIRET"), ("header", "PO 12")]
    assert of(rows, "cell") == [("table_1", "a"), ("table_1", "b")]
    assert json.loads(of(rows, "structured")[0][1])["author"] == "Me"


def workbook(cells):
    return zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Prix" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Réf</t></si><si><r><t>Q</t></r><r><t>té</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="2"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
    })


def test_xlsx():
    rows = files.read_bytes("x.xlsx", workbook('<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A3"><v>12</v></c><c r="B3" s="1"><v>45292</v></c><c r="C3" s="2"><v>1.5</v></c><c r="D3"><f>A3*2</f><v>24</v></c><c r="E3" t="b"><v>1</v></c></row>'))
    blocks = [(r["row"], r["column"], r["text"], r["sheet"]) for r in rows if r["part"] == "block"]
    assert blocks == [(1, 1, "Réf", "Prix"), (1, 2, "Qté", "Prix"), (3, 1, "12", "Prix"), (3, 2, "2024-01-01T00:00:00", "Prix"), (3, 3, "1.5", "Prix"), (3, 4, "=A3*2", "Prix"), (3, 5, "True", "Prix")]
    sheet = json.loads(of(rows, "structured")[0][1])
    assert sheet["formulas"] == {"D3": "=A3*2"} and sheet["merged_ranges"] == ["A1:B1"] and (sheet["max_row"], sheet["max_column"]) == (3, 5)
    assert of(rows, "count") == [("sheets", "1")]
    assert [r["row"] for r in rows if r["part"] == "table"] == [2]


def test_xlsx_is_cut_with_a_warning():
    cells = "".join(f'<row><c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i}</v></c></row>' for i in range(1, 9))
    rows = files.read_bytes("x.xlsx", workbook(cells), most_cells=6)
    assert len(of(rows, "block")) == 6 and "truncated to 3 rows" in of(rows, "warning")[0][1]


def test_pptx():
    shape = lambda text, holder="": f'<p:sp><p:nvSpPr><p:nvPr>{holder and f"<p:ph type=\'{holder}\'/>"}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    rows = files.read_bytes("x.pptx", zipped({
        "ppt/slides/slide2.xml": f"<p:sld {A}>{shape('Later')}</p:sld>",
        "ppt/slides/slide1.xml": f'<p:sld {A}>{shape("Prices", "title")}{shape("All net")}<a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl><p:pic><p:nvPicPr><p:cNvPr id="4" name="Logo"/></p:nvPicPr></p:pic></p:sld>',
        "ppt/slides/_rels/slide1.xml.rels": f'<Relationships {R}><Relationship Id="r" Type="http://x/notesSlide" Target="../notesSlides/n1.xml"/></Relationships>',
        "ppt/notesSlides/n1.xml": f"<p:notes {A}>{shape('Say it', 'body')}{shape('7', 'sldNum')}</p:notes>",
    }))
    assert of(rows, "block") == [("title", "Prices"), ("paragraph", "All net"), ("paragraph", "Say it"), ("paragraph", "Later")]
    assert of(rows, "cell") == [("slide_1_table", "x")] and of(rows, "object") == [("image", "Logo")] and of(rows, "count") == [("slides", "2")]


@pytest.mark.parametrize(("name", "text", "blocks"), [
    ("a.csv", "ref;qte\nA1;2\n;\n", [("cell", "ref"), ("cell", "qte"), ("cell", "A1"), ("cell", "2")]),
    ("a.tsv", "a,b\tc\n", [("cell", "a,b"), ("cell", "c")]),
    ("a.md", "# Title\n\n- one\n2) two\n2)three\nend", [("heading", "# Title"), ("list_item", "- one"), ("list_item", "2) two"), ("paragraph", "2)three"), ("paragraph", "end")]),
    ("a.xml", "<r><a>one</a> tail <b x='1'> two </b></r>", [("paragraph", "one"), ("paragraph", "tail"), ("paragraph", "two")]),
    ("a.htm", "<h2>T</h2><p>a <b>b</b></p><script>no</script><ul><li>i</li></ul><table><tr><td>c</td></tr></table>", [("heading", "T"), ("paragraph", "a b"), ("list_item", "i")]),
    ("a.json", '{"a": [1]}', [("code", '{\n  "a": [\n    1\n  ]\n}')]),
])
def test_texts(name, text, blocks):
    assert of(files.read_bytes(name, text.encode()), "block") == blocks


def test_eml():
    rows = files.read_bytes("m.eml", b"Subject: =?utf-8?q?Commande_n=C2=B0_4?=\r\nFrom: a@b.fr\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nBonjour\r\n--X\r\nContent-Type: text/html\r\n\r\n<p>no</p>\r\n--X\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=po.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nJVBERi0=\r\n--X--\r\n")
    assert of(rows, "block") == [("key_value", "Subject: Commande n° 4"), ("key_value", "From: a@b.fr"), ("paragraph", "Bonjour")]
    found = next(r for r in rows if r["part"] == "object")
    assert found["text"] == "po.pdf" and json.loads(found["metadata"])["size_bytes"] == 5


def test_bad_files_are_rows():
    for name, data in (("a.pdf", b"%PDF-"), ("a.zzz", b""), ("noending", b""), ("a.docx", b"no zip"), ("a.xml", b"<r>"), ("a.json", b"{")):
        assert [r["part"] for r in files.read_bytes(name, data)] == ["error"]
    assert files.decoded("é".encode("cp1252")) == "é" and files.decoded("é".encode("utf-16")) == "é"


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "sub" / "b.txt").write_text("one\ntwo")
    (tmp_path / "c.bin").write_bytes(b"%PDF-1.4")
    rows = files.read_folder(spark, str(tmp_path), "*.txt").collect()
    assert sorted((r["path"].rsplit("/", 1)[-1], r["ix"], r["text"]) for r in rows) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.txt", 1, "one"), ("b.txt", 2, "two")]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    assert files.distinct_files(raw).count() == 2 and files.sample_files(raw, 1, 7).count() == 1
    assert [r["path"].rsplit("/", 1)[-1] for r in raw.where(files.is_pdf(raw["content"])).collect()] == ["c.bin"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    good, counts = files.jsonl(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and tuple(counts.first()) == (3, 1)


def test_writers_never_overwrite(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from ledgerloom.operators import addressbook, contract

    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    contract.write_new(rows, str(tmp_path / "new"))
    with pytest.raises(AnalysisException):
        contract.write_new(rows, str(tmp_path / "new"))
    contract.write_report([rows, spark.createDataFrame([(2, 0.5)], "id int, score double")], str(tmp_path / "report"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "report")).collect())) == [("1", "a", None), ("2", None, "0.5")]
    contract.write_report([rows.where("false")], str(tmp_path / "empty"))
    assert spark.read.option("header", True).csv(str(tmp_path / "empty")).columns == ["id", "name"]
    book = spark.createDataFrame([("1", None, "rue X", "69000", "Lyon"), ("2", None, "rue X", "20000", "Ajaccio")], "number string, repetition string, street string, postal_code string, city string")
    keys, streets = addressbook.build_index(book)
    contract.write_index(keys, streets, str(tmp_path / "index"))
    back = spark.read.option("basePath", str(tmp_path / "index/keys")).parquet(str(tmp_path / "index/keys"))
    assert sorted(r["department"] for r in back.collect()) == ["2A", "2B", "69"]
    found = addressbook.verify(book.withColumns({"id": book["number"], "country": book["repetition"]}), back, spark.read.parquet(str(tmp_path / "index/streets"))).collect()
    assert {r["id"]: r["status"] for r in found} == {"1": "EXACT_MATCH", "2": "EXACT_MATCH"}


def test_small_files_share_frames():
    import pandas as pd

    from ledgerloom.sources import files

    batch = pd.DataFrame({"path": [f"{i}.txt" for i in range(3000)] + ["null.txt"], "content": [b"a\nb"] * 3000 + [None]})
    made = list(files.frames(iter([batch, batch])))
    assert len(made) <= 10
    assert sum(map(len, made)) == len(pd.concat(made)[["path", "ix", "text"]]) and pd.concat(made)["part"].eq("block").sum() == 12000
