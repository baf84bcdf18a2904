"""From texts to chunks."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import ids

CHUNK_CHARS = 150


def groups_of(array, size: int, glue: str):
    """A column of arrays in groups of ``size``, each joined: one expression, no shuffle."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), F.lit(size))
    return F.when(F.size(array) > 0, F.transform(starts, lambda s: F.array_join(F.slice(array, s + 1, size), glue))).otherwise(F.array().cast("array<string>"))


def newline_chunks(docs: DataFrame, size: int = 4) -> DataFrame:
    """(document_id, pos, content, chunk_id): blocks of non-empty trimmed lines."""
    lines = F.split(F.replace("text", F.lit("\n\n"), F.lit("\n")), "\n")
    lines = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    # a column of its own: within the groups' lambda the text would be split again for each group
    out = docs.select("document_id", lines.alias("lines")).select("document_id", F.posexplode(groups_of("lines", size, " ")).alias("pos", "content"))
    return out.withColumn("chunk_id", ids.chunk_id("document_id", "content"))


def sentence_chunks(docs: DataFrame, size: int = 4) -> DataFrame:
    """Sentences (an array column) in groups; the rest makes the last chunk."""
    out = docs.select("document_id", F.posexplode(groups_of("sentences", size, " ")).alias("pos", "content"))
    return out.withColumn("chunk_id", ids.chunk_id("document_id", "content"))


def sentences(text):
    """Split after an end mark that white space and a capital or a quote follow. The pattern is a fixed value."""
    return F.split(text, r'(?<=[.!?])\s+(?=[A-Z"])')


MERGED = "document_id string, pos long, content string, page long, heading string"


def merge_short(chunks: DataFrame, least: int = CHUNK_CHARS) -> DataFrame:
    """Neighbours merge while both are short, on one page, and their headings agree.

    chunks: document_id, pos, content, page, heading. Whether a chunk merges depends on what
    those before it have become, so a document's chunks are folded one after the other: in one
    pass over rows that are sorted by document and place, which holds no more than one chunk.
    """

    def run(batches):
        held, pos = None, 0  # document, parts, page, heading

        def row():
            return held[0], pos, "\n".join(held[1]), held[2], held[3]

        for batch in batches:
            out = []
            for doc, content, page, heading in zip(*(batch.column(k).to_pylist() for k in ("document_id", "content", "page", "heading"))):
                if held and held[0] == doc:
                    short = sum(map(len, held[1])) + len(held[1]) - 1 < least and len(content) < least
                    if short and held[2] == page and (held[3] is None or heading is None or held[3] == heading):
                        held[1].append(content)
                        held[3] = heading if held[3] is None else held[3]
                        continue
                if held:
                    out.append(row())
                    pos = pos + 1 if held[0] == doc else 0
                held = [doc, [content], page, heading]
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, r)) for r in out], schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, row()))], schema=schema)

    schema = to_arrow_schema(StructType.fromDDL(MERGED))
    own = chunks.select(F.col("document_id").cast("string"), "pos", "content", F.col("page").cast("long"), "heading")
    out = own.repartition("document_id").sortWithinPartitions("document_id", "pos").mapInArrow(run, MERGED)
    return out.withColumn("chunk_id", ids.chunk_id("document_id", "content"))


NAMES = ("document_id", "pos", "content", "page", "heading")


def first_per_title(articles: DataFrame) -> DataFrame:
    """The first occurrence of each title wins."""
    return articles.groupBy("title").agg(F.min_by("sentences", "pos").alias("sentences"))


def distractors(paragraphs: DataFrame, golds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paragraphs whose title isn't gold for their own example, and the share that went."""
    kept = paragraphs.join(golds.select("example_id", "title").distinct(), ["example_id", "title"], "left_anti")
    total, left = paragraphs.agg(F.count("*").alias("total")), kept.agg(F.count("*").alias("kept"))
    share = total.join(left, F.lit(True)).select("total", (F.col("total") - F.col("kept")).alias("stripped"))
    share = share.withColumn("contamination", F.when(F.col("total") > 0, F.round(F.col("stripped") / F.col("total"), 4)).otherwise(0.0))
    return kept, share


def sheet_chunks(rows: DataFrame, size: int = 30) -> DataFrame:
    """Spreadsheet rows (document_id, source_url, sheet, sheet_no, pos from 1, cells) as texts of thirty rows.

    The header is the first row that fills a quarter of its width, one cell at least; failing
    that, the very first. Columns without a header and rows without a value are left out.
    """
    of_sheet = ["document_id", "sheet_no"]
    filled = F.size(F.filter("cells", lambda c: c.isNotNull()))
    fits = (filled >= F.greatest(F.lit(1), F.floor(F.size("cells") / 4))).alias("fits")
    tops = rows.select(*of_sheet, "pos", "cells", fits).where("fits OR pos = 1").groupBy(of_sheet)
    header = tops.agg(F.min_by(F.struct("pos", "cells"), F.struct(~F.col("fits"), "pos")).alias("top"))
    named = F.filter(F.sequence(F.lit(0), F.size("top.cells") - 1), lambda i: F.get("top.cells", i).isNotNull())
    header = header.where(F.size("top.cells") > 0).select(*of_sheet, F.col("top.pos").alias("after"), F.col("top.cells").alias("names"), named.alias("columns")).where(F.size("columns") > 0)
    line = lambda cells: F.array_join(F.transform("columns", lambda i: F.coalesce(F.get(cells, i), F.lit(""))), " | ")
    own = rows.join(header, of_sheet).where(F.col("pos") > F.col("after")).where(F.exists("columns", lambda i: F.get("cells", i).isNotNull()))
    # a sheet has no more than 1,048,576 rows
    own = own.withColumn("n", F.row_number().over(Window.partitionBy(of_sheet).orderBy("pos")) - 1)
    grouped = own.withColumn("names", line("names")).withColumn("line", line("cells")).groupBy(*of_sheet, F.floor(F.col("n") / size).alias("part"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line)
    out = grouped.agg(F.first("source_url").alias("source_url"), F.first("sheet").alias("heading"), F.first("names").alias("names"), lines.alias("lines"))
    content = F.concat(F.lit("Sheet: "), "heading", F.lit("\n"), "names", F.lit("\n"), F.array_join("lines", "\n"))
    out = out.select("document_id", "source_url", F.col("sheet_no").alias("page"), "heading", "part", content.alias("content"))
    return out.withColumn("chunk_id", ids.chunk_id("document_id", "content"))


def resolve_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Types of mentions: by exact name, without '(TYPE)', trimmed, or without spaces; else UNKNOWN."""
    known = entities.groupBy("name").agg(F.min("type").alias("type"))
    squeezed = entities.groupBy(F.replace("name", F.lit(" "), F.lit("")).alias("key")).agg(F.min("type").alias("type"))
    bare = F.trim(F.regexp_replace("mention", r"\s*\([^)]*\)$", ""))
    out = mentions.withColumn("bare", bare).withColumn("tight", F.replace(F.col("bare"), F.lit(" "), F.lit("")))
    out = out.join(known.select(F.col("name").alias("mention"), F.col("type").alias("t1")), "mention", "left")
    out = out.join(known.select(F.col("name").alias("bare"), F.col("type").alias("t2")), "bare", "left")
    out = out.join(squeezed.select(F.col("key").alias("tight"), F.col("type").alias("t3")), "tight", "left")
    return out.withColumn("type", F.coalesce("t1", "t2", "t3", F.lit("UNKNOWN"))).drop("bare", "tight", "t1", "t2", "t3")


#: What tells a line of authors, their places, or of what follows a title. A fixed value: which lines
#: end a title must be the same wherever titles are read, so it stands as it is published.
AUTHORS = r"(?i)@|\buniversity\b|\binstitute\b|\blaborator\b|\bdepartment\b|\bcenter\b|\bnasa\b|\babstract\b|\bintroduction\b|\breceived\b"
#: What programs write where a title should be. Fixed values.
NO_TITLE = r"(?i)microsoft\s+word|openoffice|libreoffice|latex|untitled|\.docx?|\.tex\b"


def first_title(text, least: int = 8, most_lines: int = 3):
    """A first page's title: the block that begins with its first line of ``least`` letters and more.

    The block ends with the third line, or before a shorter or blank one or one of authors; where
    it begins with one of authors there is no title.
    """
    lines = F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    begins = F.array_position(F.transform(lines, lambda x: F.length(x) >= least), True).cast("int")
    block = F.slice(lines, F.greatest(begins, F.lit(1)), F.lit(most_lines))
    behind = F.array_position(F.transform(block, lambda x: (F.length(x) < least) | x.rlike(AUTHORS)), True).cast("int")
    return F.when(begins == 0, "").otherwise(F.array_join(F.when(behind == 0, block).otherwise(F.slice(block, F.lit(1), behind - 1)), " "))


def titled(props: DataFrame) -> DataFrame:
    """Properties of office files with the title that fits their type.

    Slides: the first slide's title, a real title of the file, the first text of eight letters
    and more. Spreadsheets: the file's title or name. Text documents: a real title of the file,
    or what looks like one on the first page.
    """
    empty = F.lit("")
    real = F.when((F.col("title") != "") & ~F.col("title").rlike(NO_TITLE), F.col("title"))
    text = F.get(F.filter(F.split("first_page", "\n"), lambda x: F.length(x) >= 8), F.lit(0))
    stem = F.regexp_extract("source_url", r"([^/]*?)(\.[^./]*)?$", 1)
    slides = F.coalesce(F.when(F.col("slide_title") != "", F.col("slide_title")), real, text, empty)
    sheets = F.when(F.col("title") != "", F.col("title")).otherwise(stem)
    title = F.when(F.col("doc_type") == "pptx", slides).when(F.col("doc_type") == "xlsx", sheets).otherwise(F.coalesce(real, first_title(F.col("first_page")), empty))
    return props.withColumn("title", title).drop("slide_title")


#: What a fact must have, and how the records of a reply name it.
FULL = {"subj": "subject", "subj_type": "subject_type", "rel": "relation", "obj": "object", "obj_type": "object_type"}


def best_of_list(chunks: DataFrame, said: str) -> DataFrame:
    """best_triple() of chunks that hold what is said of them as a list of records; ``pos`` is a fact's place there.

    A list is sorted by (s, r, o), certainty and place, and the first of each (s, r, o) stays.
    """

    def record(t, pos):
        c, key = t["certainty"], ("subj", "rel", "obj")
        falling = (c.isNull(), ~F.isnan(c), -c)  # as in a descending order: NaN is first, null last
        names = [t[FULL[n]].alias(n) for n in (*key, "subj_type", "obj_type")]
        return F.struct(*names[:3], *(x.alias(f"by{i}") for i, x in enumerate(falling)), pos.alias("pos"), *names[3:], c.alias("certainty"), t["evidence_text"].alias("evidence_text"))

    whole = F.filter(F.transform(said, record), lambda t: reduce(lambda a, b: a & b, (F.coalesce(t[n], F.lit("")) != "" for n in FULL)))
    # a column of its own: within the lambda the list would be sorted again for each of its facts
    lists = chunks.withColumn(said, F.sort_array(whole))
    same = lambda t, i: reduce(lambda a, b: a & b, (t[n] == F.get(F.col(said), i - 1)[n] for n in ("subj", "rel", "obj")))
    best = F.explode(F.filter(said, lambda t, i: (i == 0) | ~same(t, i))).alias("__best")
    fields = ("pos", *FULL, "certainty", "evidence_text")
    return lists.select(*(c for c in chunks.columns if c != said), best).select("*", *(F.col(f"__best.{n}").alias(n) for n in fields)).drop("__best")


def best_triple(rows: DataFrame) -> DataFrame:
    """Per chunk and (s, r, o) the most certain of an extraction; the first wins ties."""
    full = rows.where(" AND ".join(f"coalesce({c}, '') <> ''" for c in FULL))
    key = ["chunk_id", "subj", "rel", "obj"]
    # dealt out before the window, rows are sorted once, not also where they come from; and by a hash first, so that
    # few of the long keys, which begin alike, are compared
    dealt = full.repartition(*key).withColumn("__hash", F.xxhash64(*key))
    w = Window.partitionBy("__hash", *key).orderBy(F.desc("certainty"), "pos")
    return dealt.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "__hash")

