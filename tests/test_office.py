import hashlib
import io
import json
import zipfile

from factloom.operators import chunking
from factloom.plans import ingest
from factloom.sources import office, readers

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">%s</Relationships>'
CORE = '<cp:coreProperties xmlns:cp="c" xmlns:dc="d" xmlns:dcterms="t"><dc:title>%s</dc:title><dc:creator>A. Writer</dc:creator><dc:subject>On it</dc:subject><dcterms:created>2021-03-15T00:00:00Z</dcterms:created></cp:coreProperties>'


def zipped(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook(sheets: dict[str, str], title: str = "") -> bytes:
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="m" xmlns:r="{R}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS % rels,
        "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>Name</t></si><si><r><t>Two </t></r><r><t>parts</t></r><rPh><t>x</t></rPh></si></sst>',
        "xl/styles.xml": '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="46"/></cellXfs></styleSheet>',
        "docProps/core.xml": CORE % title,
    }
    return zipped(**parts, **{f"xl/worksheets/sheet{i}.xml": f'<worksheet xmlns="m"><dimension ref="A1:D9"/><sheetData>{rows}</sheetData></worksheet>' for i, rows in enumerate(sheets.values(), 1)})


def test_cells():
    rows = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="4"><c r="B4"><v>5</v></c><c r="C4"><v>2.50</v></c><c r="D4" t="b"><v>1</v></c><c r="AA4" t="inlineStr"><is><t>far</t></is></c></row>
<row><c s="1"><v>44270</v></c><c s="2"><v>44270.5</v></c><c s="3"><v>7</v></c><c t="e"><v>#DIV/0!</v></c><c s="4"><v>1.5</v></c><c s="1"><v>0.25</v></c><c/></row><row r="9"/>"""
    book = office.Workbook(workbook({"One": rows}))
    (name, path), *_ = book.sheets
    got = dict(book.rows(path))
    assert name == "One" and list(got) == [2, 4, 5]
    assert got[2] == ["Name", None, "Two parts", None]
    assert got[4][:4] == [None, "5", "2.5", "True"] and got[4][26] == "far" and len(got[4]) == 27
    assert got[5] == ["2021-03-15 00:00:00", "2021-03-15 12:00:00", "7", "#DIV/0!", "1 day, 12:00:00", "06:00:00", None]


def test_sheets_become_chunks(spark, tmp_path):
    body = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(3, 34))
    # an empty row, and a value without a header, in between
    body += '<row r="34"><c r="B34"><v>9</v></c></row><row r="36"><c r="C36" t="inlineStr"><is><t>end</t></is></c></row>'
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
    content = workbook({"Long": head + body, "Bare": "", "Head only": head})
    (tmp_path / "a.xlsx").write_bytes(content)
    (tmp_path / "b.xlsx").write_bytes(content[: len(content) // 2])
    (tmp_path / "c.xlsx").write_bytes(b"")
    (tmp_path / "d.md").write_text("not a sheet")
    rows = office.sheet_rows(readers.folder(spark, str(tmp_path)))
    got = chunking.sheet_chunks(rows).orderBy("part").collect()
    doc = hashlib.sha256(content).hexdigest()
    wanted = ["Sheet: Long\nName | Two parts\n" + "\n".join(f"{i} | " for i in range(3, 33)), "Sheet: Long\nName | Two parts\n33 | \n | end"]
    assert [(r.document_id, r.heading, r.page, r.part, r.content) for r in got] == [(doc, "Long", 1, n, c) for n, c in enumerate(wanted)]
    assert [r.chunk_id for r in got] == [hashlib.sha256(f"{doc}:{c}".encode()).hexdigest() for c in wanted]
    assert chunking.sheet_chunks(rows.limit(0)).count() == 0


def test_a_sheet_without_a_header_row(spark):
    """No row fills a quarter of the width: the first is the header, be it empty or not."""
    cells = lambda *some: [*some, *[None] * (8 - len(some))]
    rows = [("d", "u", "S", 1, 1, cells("a")), ("d", "u", "S", 1, 2, cells("b")), ("d", "u", "T", 2, 4, cells("c")), ("d", "u", "U", 3, 2, cells("x", "y")), ("d", "u", "U", 3, 1, cells("over")), ("d", "u", "U", 3, 3, cells("1"))]
    got = chunking.sheet_chunks(spark.createDataFrame(rows, office.SHEET_ROWS)).orderBy("page").collect()
    assert [r.content for r in got] == ["Sheet: S\na\nb", "Sheet: U\nx | y\n1 | "]


W = '<w:document xmlns:w="w"><w:body>%s</w:body></w:document>'


def styled(text: str, style: str = "") -> str:
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def show(*shapes: str, title: str = "") -> bytes:
    slide = '<p:sld xmlns:p="p" xmlns:a="a">%s</p:sld>'
    # the second file is shown first
    return zipped(**{
        "ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS % '<Relationship Id="rId1" Target="slides/slide1.xml"/><Relationship Id="rId2" Target="/ppt/slides/slide2.xml"/>',
        "ppt/slides/slide1.xml": slide % shape("last"),
        "ppt/slides/slide2.xml": slide % "".join(shapes),
        "docProps/core.xml": CORE % title,
    })


def shape(text: str, place: str = "") -> str:
    return f"<p:sp><p:nvSpPr>{place}</p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"


def test_parts(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    body = styled("before") + styled("Part", "Heading1") + styled("one") + styled("Inner", "Heading2") + '<w:p><w:r><w:t>two</w:t><w:br w:type="page"/></w:r></w:p>' + table + styled(" ") + styled("Next", "Heading1") + styled("three")
    (tmp_path / "a.docx").write_bytes(zipped(**{"word/document.xml": W % body}))
    (tmp_path / "b.pptx").write_bytes(show(shape("free text"), shape("The Title", "<p:nvPr><p:ph type='title'/></p:nvPr>")))
    (tmp_path / "c.docx").write_bytes(b"PK not an archive")
    got = office.parts(readers.folder(spark, str(tmp_path))).orderBy("source_url", "pos").collect()
    assert [(r.page, r.heading, r.content) for r in got] == [
        (1, None, "before"), (1, "Part", "one"), (1, "Part", "two"), (2, "Part", "a | b"), (2, "Next", "three"), (1, "The Title", "free text"), (2, None, "last"),
    ]


def test_titles_of_files(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(show(shape("small"), shape("a longer text"), title="Untitled"))
    (tmp_path / "b.pptx").write_bytes(show(shape("a longer text"), title="The deck"))
    (tmp_path / "c.pptx").write_bytes(show(shape("Shown", "<p:nvPr><p:ph type='title'/></p:nvPr>"), title="The deck"))
    (tmp_path / "d.xlsx").write_bytes(workbook({"S": ""}))
    (tmp_path / "e.docx").write_bytes(zipped(**{"word/document.xml": W % (styled("1") + styled("A Study of Long Things") + styled("Institute of Things")), "docProps/core.xml": CORE % "Microsoft Word - x.doc"}))
    (tmp_path / "f.docx").write_bytes(b"broken")
    props = chunking.titled(office.properties(readers.folder(spark, str(tmp_path))))
    got = {r.source_url.rpartition("/")[2]: r for r in props.collect()}
    assert {k: r.title for k, r in got.items()} == {"a.pptx": "a longer text", "b.pptx": "The deck", "c.pptx": "Shown", "d.xlsx": "d", "e.docx": "A Study of Long Things", "f.docx": ""}
    assert (got["e.docx"].authors, got["e.docx"].year, got["e.docx"].abstract) == ("A. Writer", "2021", "On it") and got["f.docx"].year == ""


class Librarian:
    """Knows some pages."""

    def chat(self, prompt: str, max_tokens: int) -> str:
        if "page of b" in prompt:
            return "no idea"
        assert "title, authors" in prompt and "year" not in prompt.split("\n")[0]
        return "```json\n" + json.dumps({"title": " Found ", "authors": "", "year": "1900"}) + "\n```"


def test_what_is_lacking_is_asked_for(spark):
    rows = [("a", "", None, "2020", "x", "page of a"), ("b", "", "w", "2020", "x", "page of b"), ("c", "", "", "", "", ""), ("d", "t", "w", "2020", "x", "page of d")]
    meta = spark.createDataFrame(rows, "document_id string, title string, authors string, year string, abstract string, first_page string")
    got = {r.document_id: (r.title, r.authors, r.year, r.inferred) for r in ingest.with_inferred(meta, Librarian).collect()}
    assert got == {"a": ("Found", None, "2020", ["title"]), "b": ("", "w", "2020", []), "c": ("", "", "", []), "d": ("t", "w", "2020", [])}
