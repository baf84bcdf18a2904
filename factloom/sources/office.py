"""Office files: spreadsheets as rows of cells, text documents and slides as parts, and what files say of themselves.

The three formats are zip archives of XML, read with the standard library. Each takes rows of
readers.folder() and leaves alone the types that it doesn't read; a file that can't be read
gives no rows, and one that breaks off those before. Sheets are parsed as a stream, a row at
a time.
"""

from __future__ import annotations

import datetime
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SHEET_ROWS = "document_id string, source_url string, sheet string, sheet_no int, pos long, cells array<string>"
PARTS = "document_id string, source_url string, pos long, page int, heading string, content string"
PROPERTIES = "document_id string, source_url string, doc_type string, title string, slide_title string, authors string, year string, abstract string, first_page string"

#: Rows that go back to the JVM at once, and bytes of files that come from it at once.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: What a broken archive or its XML may raise.
UNREADABLE = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, IndexError, EOFError, RuntimeError)


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def own(element, name: str) -> str | None:
    """An attribute by its name without the name space."""
    return next((v for k, v in element.attrib.items() if local(k) == name), None)


def targets(archive: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Where the relations of a part lead, by their ids."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels".lstrip("/")
    if path not in archive.namelist():
        return {}
    rows = ElementTree.fromstring(archive.read(path))
    return {r.get("Id"): posixpath.normpath(posixpath.join("/", folder, r.get("Target"))).lstrip("/") for r in rows}


def said(element) -> str:
    """The text of a shared string or a cell, without how it is pronounced."""
    out = []

    def walk(e):
        for child in e:
            if local(child.tag) == "t":
                out.append(child.text or "")
            elif local(child.tag) != "rPh":
                walk(child)

    walk(element)
    return "".join(out)


# --- spreadsheets --------------------------------------------------------------------------

#: Numbers of the built-in formats that show a date or a time, and of those that show a duration. Fixed values.
DATE_FORMATS, DURATION_FORMATS = {*range(14, 23), 45, 47}, {46}


def kinds_of_styles(archive: zipfile.ZipFile) -> list[str]:
    """For each cell style: 'date', 'duration' or ''."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    codes = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if local(e.tag) == "numFmt"}

    def kind(number: int) -> str:
        code = re.sub(r'"[^"]*"|\\.|_.|\*.', "", codes.get(number, "")).split(";")[0]
        if number in DURATION_FORMATS or re.search(r"(?i)\[(h+|m+|s+)\]", code):
            return "duration"
        plain = re.sub(r"\[[^\]]*\]", "", code)
        return "date" if number in DATE_FORMATS or re.search(r"(?i)[dmyhs]", plain) and "general" not in plain.lower() else ""

    styles = next((e for e in root if local(e.tag) == "cellXfs"), ())
    return [kind(int(x.get("numFmtId") or 0)) for x in styles]


def moment(value: float, kind: str, since_1904: bool) -> str:
    """A day number as a date and time; below one day as a time."""
    span = datetime.timedelta(milliseconds=round(value * 86_400_000))
    if kind == "duration":
        return str(span)
    if 0 <= value < 1 and not since_1904:
        return str((datetime.datetime.min + span).time())
    # day 60 of this calendar, 29 February 1900, never was
    start = datetime.datetime(1904, 1, 1) if since_1904 else datetime.datetime(1899, 12, 31 if value < 60 else 30)
    return str(start + span)


def column_number(place: str) -> int:
    """'C7' is in column 3."""
    n = 0
    for c in place:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n


class Workbook:
    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        root = ElementTree.fromstring(self.archive.read("xl/workbook.xml"))
        paths = targets(self.archive, "xl/workbook.xml")
        self.since_1904 = any(local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in root.iter())
        self.sheets = [(e.get("name"), paths.get(own(e, "id"), "")) for e in root.iter() if local(e.tag) == "sheet"]
        self.styles = kinds_of_styles(self.archive)
        self.shared: list[str] = []
        if "xl/sharedStrings.xml" in self.archive.namelist():
            with self.archive.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if local(e.tag) == "si":
                        self.shared.append(said(e))
                        e.clear()

    def value(self, cell) -> str | None:
        kind = cell.get("t") or "n"
        if kind == "inlineStr":
            return said(cell)
        raw = next((v.text for v in cell if local(v.tag) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return str(raw.strip() in ("1", "true"))
        if kind != "n":
            return raw
        number = float(raw)
        style = int(cell.get("s") or 0)
        how = self.styles[style] if style < len(self.styles) else ""
        if how:
            try:
                return moment(number, how, self.since_1904)
            except OverflowError:  # no such day
                return raw
        return str(number) if re.search(r"[.eE]", raw) else raw.strip()

    def rows(self, path: str) -> Iterator[tuple[int, list[str | None]]]:
        """(number from 1, cells) of a sheet's rows that hold anything, as wide as the sheet says, or wider."""
        width, at, waiting = 0, 0, None
        with self.archive.open(path) as f:
            for event, e in ElementTree.iterparse(f, events=("start", "end")):
                tag = local(e.tag)
                if event == "start":
                    waiting = e if tag == "sheetData" else waiting
                elif tag == "dimension":
                    width = column_number((e.get("ref") or "").rpartition(":")[2])
                elif tag == "row":
                    at = int(e.get("r") or at + 1)
                    cells: dict[int, str | None] = {}
                    last = 0
                    for c in e:
                        if local(c.tag) == "c":
                            last = column_number(c.get("r") or "") or last + 1
                            cells[last] = self.value(c)
                    if cells:
                        yield at, [cells.get(i) for i in range(1, max(width, *cells) + 1)]
                    waiting.clear()


def sheet_rows(files: DataFrame) -> DataFrame:
    """Rows of each sheet, numbered from 1 as in the file; empty cells are null."""

    def rows(doc: str, url: str, content: bytes) -> Iterator[tuple]:
        book = Workbook(content)
        for n, (name, path) in enumerate(book.sheets, 1):
            if path in book.archive.namelist():
                for pos, cells in book.rows(path):
                    yield doc, url, name, n, pos, cells

    return from_files(files, ("xlsx",), rows, SHEET_ROWS)


# --- text documents and slides -------------------------------------------------------------


def paragraph(p) -> str:
    out = []
    for e in p.iter():
        tag = local(e.tag)
        out.append((e.text or "") if tag == "t" else "\t" if tag == "tab" and not e.attrib else "\n" if tag in ("br", "cr") and own(e, "type") != "page" else "")
    return "".join(out).strip()


def document_parts(content: bytes) -> Iterator[tuple[int, str | None, str]]:
    """(page, heading, text) of a text document's paragraphs and tables; the heading is the outermost one."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    body = next(e for e in ElementTree.fromstring(archive.read("word/document.xml")) if local(e.tag) == "body")
    page, above = 1, []
    for block in body:
        kind, first = local(block.tag), above[0][1] if above else None
        if kind == "p":
            style = next((own(e, "val") or "" for e in block.iter() if local(e.tag) == "pStyle"), "")
            text, level = paragraph(block), re.match(r"(?i)(title$|heading\s*(\d))", style)
            if text and level:
                depth = int(level.group(2) or 0)
                above = [*(a for a in above if a[0] < depth), (depth, text)]
            elif text:
                yield page, first, text
        elif kind == "tbl":
            lines = [" | ".join(" ".join(filter(None, map(paragraph, (p for p in c.iter() if local(p.tag) == "p")))) for c in r if local(c.tag) == "tc") for r in block if local(r.tag) == "tr"]
            yield page, first, "\n".join(lines)
        page += sum(local(e.tag) == "lastRenderedPageBreak" or local(e.tag) == "br" and own(e, "type") == "page" for e in block.iter())


def slides(archive: zipfile.ZipFile) -> Iterator[list[tuple[bool, str]]]:
    """For each slide, in the order of the show, the texts of its shapes and whether one is a title."""
    paths = targets(archive, "ppt/presentation.xml")
    root = ElementTree.fromstring(archive.read("ppt/presentation.xml"))
    for e in root.iter():
        if local(e.tag) != "sldId":
            continue
        # a slide's own number is its attribute without a name space
        path = paths[next(v for k, v in e.attrib.items() if k.endswith("}id"))]
        shapes = []
        for shape in ElementTree.fromstring(archive.read(path)).iter():
            if local(shape.tag) == "sp":
                holder = next((x for x in shape.iter() if local(x.tag) == "ph"), None)
                text = "\n".join(filter(None, (paragraph(p) for p in shape.iter() if local(p.tag) == "p")))
                if text:
                    shapes.append((holder is not None and int(holder.get("idx") or 0) in (0, 1), text))
        yield shapes


def slide_parts(content: bytes) -> Iterator[tuple[int, str | None, str]]:
    """(page, heading, text) of a show's shapes; a slide's title is its heading."""
    for page, shapes in enumerate(slides(zipfile.ZipFile(io.BytesIO(content))), 1):
        heading = next((i for i, (title, _) in enumerate(shapes) if title), None)
        for i, (_, text) in enumerate(shapes):
            if i != heading:
                yield page, shapes[heading][1] if heading is not None else None, text


def parts(files: DataFrame) -> DataFrame:
    """What text documents and slides say, part by part, with page and heading."""

    def rows(doc: str, url: str, content: bytes) -> Iterator[tuple]:
        how = document_parts if "word/document.xml" in zipfile.ZipFile(io.BytesIO(content)).namelist() else slide_parts
        for pos, (page, heading, text) in enumerate(how(content)):
            yield doc, url, pos, page, heading, text

    return from_files(files, ("docx", "pptx"), rows, PARTS)


# --- what files say of themselves ----------------------------------------------------------


def properties(files: DataFrame) -> DataFrame:
    """Title, authors, year and abstract of office files, the title of a first slide, and the text of its page.

    A file that says nothing, or can't be read, has empty fields.
    """

    def rows(doc: str, url: str, content: bytes) -> Iterator[tuple]:
        core: dict[str, str] = {}
        slide_title, first_page = "", ""
        try:
            archive = zipfile.ZipFile(io.BytesIO(content))
            if "docProps/core.xml" in archive.namelist():
                core = {local(e.tag): (e.text or "").strip() for e in ElementTree.fromstring(archive.read("docProps/core.xml"))}
            if "ppt/presentation.xml" in archive.namelist():
                shapes = next(slides(archive), [])
                slide_title = next((t for title, t in shapes if title), "")
                first_page = "\n".join(t for _, t in shapes)
            elif "word/document.xml" in archive.namelist():
                first_page = "\n".join(text for page, _, text in document_parts(content) if page == 1)
        except UNREADABLE:
            pass
        year = re.search(r"\d{4}", core.get("created", ""))
        yield doc, url, url.rpartition(".")[2].lower(), core.get("title", ""), slide_title, core.get("creator", ""), year.group() if year else "", core.get("subject", ""), first_page[:FIRST_PAGE]

    return from_files(files, ("docx", "pptx", "xlsx"), rows, PROPERTIES)


#: How much of a first page a reader of metadata sees. A fixed value.
FIRST_PAGE = 3000


def from_files(files: DataFrame, types: tuple[str, ...], rows, kind: str) -> DataFrame:
    """What ``rows(document_id, source_url, content)`` yields for each file of these types; files that fail end there."""
    spark = files.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                found = rows(*(b.column(k)[i].as_py() for k in range(3)))
                try:
                    for row in found:
                        held.append(row)
                        if len(held) >= BATCH_ROWS:
                            yield batch(held)
                            held = []
                except UNREADABLE:
                    continue
        if held:
            yield batch(held)

    wanted = files.where(F.col("doc_type").isin(*types)).select("document_id", "source_url", "content")
    return wanted.mapInArrow(run, kind)
