import json
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import chunking, delta, store
from factloom.plans import ingest
from factloom.sources import catalogue, paged, readers
from factloom.streaming import streams


def test_json(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"id": 1, "q": "a"}, {"id": 2, "q": "b"}]')
    (tmp_path / "dict.json").write_text('{"data": [{"id": 3, "q": "c"}], "n": 1}')
    (tmp_path / "rows.jsonl").write_text('{"id": 4, "q": "d"}\n\n{"id": 5, "q": "e"}\n')
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(readers.json_list(spark, str(tmp_path / "list.json"), "id:long,q:string")) == [1, 2]
    assert ids(readers.json_list(spark, str(tmp_path / "dict.json"), "id:long,q:string")) == [3]
    assert ids(readers.json_lines(spark, str(tmp_path / "rows.jsonl"), "id long, q string")) == [4, 5]
    assert spark.range(1).select(readers.as_answers(F.lit("x"), T.StringType()).alias("a")).head().a == ["x"]


def test_folder_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "sub" / "b.html").write_text("two")
    (tmp_path / "c.bin").write_text("three")
    assert sorted(r.doc_type for r in readers.folder(spark, str(tmp_path)).collect()) == ["html", "md"]
    page = spark.createDataFrame([(1, "u", "<html><head><title>T</title></head><body><script>x</script>a &lt; b<p>c</p></body></html>")], "page_id long, url string, html string")
    assert readers.page_texts(page).head().asDict() == {"page_id": 1, "url": "u", "title": "T", "text": "a < b c"}


def test_sessions_and_settings(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text('{"session_id": "x"}')
    (tmp_path / "s" / "b.json").write_text("{broken")
    assert [r.session_id for r in readers.sessions(spark, str(tmp_path / "s"), "session_id string").collect()] == ["x"]
    (tmp_path / "x.toml").write_text("[a]\nb = 1\nc = 2\n")
    (tmp_path / "deep").mkdir()
    assert readers.layered(readers.settings("x.toml", tmp_path / "deep"), {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_a_study_and_its_settings(spark, tmp_path):
    (tmp_path / "questions.json").write_text('{"questions": [{"id": "q1", "text": "Which?"}]}')
    assert [r.id for r in readers.study_table(spark, str(tmp_path), "questions", "id string, text string").collect()] == ["q1"]
    assert readers.study_table(spark, str(tmp_path), "agents", "id string").collect() == []
    assert ingest.least_confidence({}) == 0.6 and ingest.least_confidence({"ingest": {"min_ingest_confidence": "0.7"}}) == 0.7
    assert ingest.model_settings({"llm": {"model": "m"}}) == {**ingest.MODEL, "model": "m"}
    assert ingest.model_settings({"llm": {"model": "m"}, "ingest_llm": {"workers": 4}}) == {**ingest.MODEL, "workers": 4}
    assert store.places("/x/", "ann")["description"] == "/x/ann/ann.meta.json"


def write_pages(folder, pages):
    for n, rows in pages.items():
        (folder / f"page-{n}.json").write_text(json.dumps({"results": rows}))


def record(i, has=True):
    return {"id": i, "title": f"t{i}", "downloadsAvailable": has, "downloads": [{"mimetype": "application/pdf", "links": {"pdf": f"/{i}.pdf"}}], "subjectCategories": ["c"]}


def test_catalogue(spark, tmp_path):
    write_pages(tmp_path, {n: [record(n * 3 + i, i != 1) for i in range(3)] for n in range(2)})
    read = lambda offset: sorted(r.id for r in catalogue.catalogue(spark, str(tmp_path), 3, offset).collect())
    assert read(0) == [0, 2, 3, 5] and read(3) == [3, 5] and read(4) == [5] and read(99) == []
    assert catalogue.catalogue(spark, str(tmp_path / "nowhere"), 3).count() == 0


def test_offsets_of_pages(tmp_path):
    write_pages(tmp_path, {0: [record(i) for i in range(3)], 1: [record(3)]})
    source = paged.PagedStreamReader({"path": str(tmp_path), "page_size": 3, "offset": 1})
    assert source.initialOffset() == {"page": 0, "record": 1} and source.latestOffset() == {"page": 1, "record": 1}
    parts = source.partitions(source.initialOffset(), source.latestOffset())
    assert [p.value for p in parts] == [(0, 1, 3), (1, 0, 1)]
    assert [(r[0], r[1], json.loads(r[2])["id"], r[3]) for p in parts for r in source.read(p)] == [(0, 1, 1, 2), (0, 2, 2, 3), (1, 0, 3, 4)]
    write_pages(tmp_path, {1: [record(i) for i in range(3, 6)], 2: []})  # a page that has grown, and an empty one
    assert source.latestOffset() == {"page": 2, "record": 0}
    assert [p.value for p in source.partitions({"page": 1, "record": 1}, {"page": 2, "record": 0})] == [(1, 1, 3)]
    assert source.partitions({"page": 2, "record": 0}, {"page": 2, "record": 0}) == []


def test_a_failed_record_blocks_the_offset(spark, tmp_path):
    pages, failing, asked = tmp_path / "pages", set(), []
    pages.mkdir()
    write_pages(pages, {0: [record(i) for i in range(4)], 1: [record(i) for i in range(4, 7)]})
    lake = delta.Lake(spark, str(tmp_path / "lake"), {"records": delta.Spec(("id",), "id long, title string, resume_offset long"), "state": streams.STATE})

    def process(rows):
        asked.append(sorted(r.id for r in rows.collect()))
        return rows.withColumn("status", F.when(F.col("id").isin(list(failing)) if failing else F.lit(False), "download_failed").otherwise("committed"))

    def run():
        stream = catalogue.catalogue(spark, str(pages), 4, stream=True).select("id", "title", "resume_offset")
        streams.ingest_in_order(stream, lake, "records", "state", "q", process, str(tmp_path / "checkpoint"))

    offset = lambda: [r.next_offset for r in lake.read("state").collect()]
    held = lambda: sorted(r.id for r in lake.read("records").collect())
    failing |= {2, 5}
    for _ in range(2):  # it fails again: nothing moves
        with pytest.raises(StreamingQueryException, match="RecordFailed"):
            run()
        assert offset() == [2] and held() == [0, 1, 3, 4, 6]
    assert asked == [[0, 1, 2, 3, 4, 5, 6], [2, 5]]  # what is in the table isn't processed again
    failing.remove(2)
    with pytest.raises(StreamingQueryException, match="RecordFailed"):
        run()
    assert offset() == [5] and held() == [0, 1, 2, 3, 4, 6]
    failing.clear()
    run()
    assert offset() == [7] and held() == list(range(7))
    write_pages(pages, {1: [record(i) for i in range(4, 8)], 2: [record(8)]})
    run()
    assert offset() == [9] and held() == list(range(9)) and asked[-1] == [7, 8]


def test_streamed_upserts_go_on_where_they_ended(spark, tmp_path):
    kind = "id string, v long, seq long"
    lake = delta.Lake(spark, str(tmp_path / "table"), {"t": delta.Spec(("id",), "id string, v long")})

    def arrive(rows, n):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        streams.ingest(source, lake, "t", "seq", str(tmp_path / "state"))
        assert lake.manifest()["version"] == n

    arrive([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], 1)
    arrive([("b", 3, 3)], 2)
    assert {r.id: r.v for r in lake.read("t").collect()} == {"a": 2, "b": 3}


def test_many_pages_are_dealt_to_few_tasks(spark, tmp_path, monkeypatch):
    write_pages(tmp_path, {n: [record(n)] for n in range(600)})
    source = paged.PagedStreamReader({"path": str(tmp_path), "page_size": 1})
    parts = source.partitions({"page": 0, "record": 0}, {"page": 600, "record": 0})
    assert len(parts) <= paged.MOST_TASKS
    asked = []
    listing = paged.Pages._folder
    monkeypatch.setattr(paged.Pages, "_folder", lambda self: asked.append(1) or listing(self))
    assert [json.loads(row[2])["id"] for p in parts for row in source.read(p)] == list(range(600))
    assert not asked  # a page is opened by its name, not looked for among all
    (tmp_path / "page-7.json").rename(tmp_path / "page-007.json")
    assert [json.loads(row[2])["id"] for row in source.read(parts[2])] == [6, 7, 8] and len(asked) == 1


def test_a_batch_of_pages_is_bounded_by_bytes(spark, tmp_path):
    """Forty files of one page each are one batch, not two of twenty files or four of ten."""
    for n in range(40):
        (tmp_path / f"{n}.json").write_text(json.dumps({"page": n, "results": [record(n)]}) + "\n")
    lake = delta.Lake(spark, str(tmp_path / "lake"), {"t": delta.Spec(("id",), "id long, resume_offset long")})
    streams.ingest(catalogue.page_records(catalogue.page_stream(spark, str(tmp_path / "*.json")), 1), lake, "t", "resume_offset", str(tmp_path / "state"))
    assert lake.manifest()["version"] == 1 and sorted(r.id for r in lake.read("t").collect()) == list(range(40))


def test_a_document_of_many_lines_is_chunked_in_linear_time(spark):
    docs = spark.createDataFrame([("d", "\n".join(f" line {i} " for i in range(40_000)))], "document_id string, text string")
    began = time.time()
    rows = chunking.newline_chunks(docs).where("pos % 5000 = 0").collect()
    assert [r.content for r in sorted(rows)] == ["line 0 line 1 line 2 line 3", "line 20000 line 20001 line 20002 line 20003"]
    assert time.time() - began < 60
