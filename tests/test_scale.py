"""What queries over large tables do no more: work that grows faster than the rows that call for it."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import chunking, evidence, graph, harmonic, trust
from factloom.plans import index, ingest, isolated, tables
from factloom.queries import ORACLES, QUERIES
from factloom.shared import kept


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_plain_evidence_is_not_gone_through_in_python(spark, monkeypatch):
    import pandas as pd

    seen = []
    monkeypatch.setattr(evidence, "signals", lambda *r, f=evidence.signals: seen.append(r) or f(*r))
    none = pd.Series([None, None, None], dtype=object)
    out = evidence._signals(none, none, pd.Series([0.0] * 3), none, none)
    assert not seen and len(out) == 3 and out["confidence"].isna().all()
    some = lambda x: pd.Series([None, x, None], dtype=object)
    out = evidence._signals(some("Ann"), some("Bob"), pd.Series([0.0] * 3), some("ANN met  bob."), some("Then Ann met Bob. Ok."))
    assert len(seen) == 1 and list(out["start"].isna()) == [True, False, True] and out["evidence"][1] == "Ann met Bob."


@pytest.mark.parametrize("own", ["", " ", "Ab  C\t\nd ", "\x1cA\x1f B", "x" * 9, "\x0bQ\x0cR\x85"])
def test_ascii_is_normal_in_one_go(own):
    assert evidence.normal(own) == evidence.with_origins(own)[0]


def test_sentences_are_looked_for_where_spans_need_them(monkeypatch):
    seen = []
    monkeypatch.setattr(evidence, "trimmed_sentences", lambda t, f=evidence.trimmed_sentences: seen.append(t) or f(t))
    content = "Ann met Bob. More."
    assert evidence.signals("Ann", "Bob", 1.0, "Ann met Bob.", content)["anchor"] == 1.0 and content not in seen


def test_answers_are_made_normal_once(spark):
    own = spark.createDataFrame([("a b", ["b", "c"])], "p string, g array<string>")
    times = lambda c: plan(own.select(c), "analyzed").count(r"\p{Punct}")
    once = times(text.normal_answer(F.col("p")))
    assert times(text.token_f1(F.col("p"), F.col("g"))) == times(text.exact_match(F.col("p"), F.col("g"))) == 2 * once  # the prediction and, in their lambda, the answers


def test_known_entities_come_from_the_store(spark, small):
    files = QUERIES["entity_resolution"](spark, small).inputFiles()
    assert any("store-entities" in f for f in files) and not any("store-edges" in f for f in files)


def test_edges_meet_relevance_and_provenance_in_one_join(spark, small):
    assert plan(QUERIES["composite_trust"](spark, small)).count("Join ") == 2  # the other one is of distinct facts


def test_best_triples_are_sorted_once(spark):
    rows = spark.range(9).select(*((F.col("id") % 1).cast("string").alias(c) for c in ("chunk_id", "subj", "subj_type", "rel", "obj", "obj_type")), F.col("id").cast("double").alias("certainty"), F.col("id").alias("pos"))
    best = chunking.best_triple(rows)
    assert plan(best, "executedPlan").count("Sort ") == 1 and [r.pos for r in best.collect()] == [8]


def test_names_are_set_right_in_found_facts_alone(spark):
    edges = spark.createDataFrame([("c", "A nn", "met", "Bob"), ("c", "Bob", "is", "bob"), ("d", "x", "y", "z")], "chunk_id string, subj string, rel string, obj string")
    out = graph.context_triples(edges, spark.createDataFrame([("q", "c")], "q_id string, chunk_id string"))
    assert "Join " not in plan(out) and [(r.q_id, r.subj) for r in out.collect()] == [("q", "Ann")]


def test_waiting_chunks_arrive_in_files_that_their_number_does_not_bound(spark, small, monkeypatch):
    from factloom import queries_more

    dealt = []
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a, f=type(spark.range(0)).repartition: dealt.append(a) or f(self, *a))
    assert queries_more.extract_stream(spark, small).count() > 0
    assert not any(isinstance(a[0], int) and len(a) == 1 for a in dealt)


def test_scorers_meet_the_facts_in_one_join(spark):
    e = spark.createDataFrame([("s", "r", "o", "c", 0.5), ("s", "r", "o", "d", 0.5), ("t", "r", "o", "c", 0.5)], "subj string, rel string, obj string, chunk_id string, certainty double")
    key, runs = ["subj", "rel", "obj", "chunk_id"], spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: (runs.add(1), x)[1], "double").asNondeterministic()
    scorers = {n: (lambda rows, n=n: rows.where("subj = 's'").select(*key, F.lit(2).alias(n))) for n in ("relevance_score", "provenance_count")}
    out, failed = trust.with_signals(kept(e).withColumn("certainty", counted("certainty")), scorers)
    got = sorted((r.subj, r.chunk_id, r.relevance_score, r.grounding_score, r.provenance_count) for r in out.collect())
    assert got == [("s", "c", 2.0, None, 2), ("s", "d", 2.0, None, 2), ("t", "c", None, None, 1)] and not failed
    assert runs.value == 3 and plan(out).count("Join ") == 1


def test_vectors_are_written_where_the_memo_is(spark, tmp_path, monkeypatch):
    from factloom.functions.models import HashingEmbedder
    from factloom.operators.delta import Lake

    names = []
    monkeypatch.setattr(index, "kept", lambda df, name: names.append((name, df.columns)) or kept(df, name))
    lake = Lake(spark, str(tmp_path / "lake"), index.TABLES)
    chunks = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "chunk_id string, content string")
    assert index.update(lake, chunks, HashingEmbedder) == {"indexed": 3, "embedded": 2}
    assert index.update(lake, chunks, HashingEmbedder) == {"indexed": 0, "embedded": 0}
    assert lake.read("memo").count() == 2 and not any("vec" in cols for _, cols in names)


def test_a_question_looks_its_own_names_up(spark):
    questions = spark.createDataFrame([("1", "what did supplier#7 sell to Ann B. Miller?"), ("2", "Assembly plans of Hot Bolt Makers"), ("3", "nothing")], "q_id string, text string")
    names = ["supplier#7", "Ann Miller", "Ann B. Miller", "Assemblyline works", "hot bolt makers", "Hot Bolt Makers", "Bolt", "Millers Corp", None, "plans", "suppliers are", "nothing"]
    own = spark.createDataFrame([(q, n) for q in "123" for n in names], "q_id string, name string")
    found = graph.match_anchors(own, questions, scope=("q_id",))
    want = {tuple(r) for q in "123" for r in graph.match_anchors(own.where(F.col("q_id") == q).select("name"), questions.where(F.col("q_id") == q)).collect()}
    assert {tuple(r) for r in found.collect()} == want and len(want) > 3
    assert "Generate" not in plan(found)  # no stretches, no beginnings


def test_the_best_of_a_list_is_the_best_triple(spark):
    full = ("s", "S", "r", "o", "O")
    fact = lambda names, certainty, said: dict(zip(("subject", "subject_type", "relation", "object", "object_type"), names)) | {"certainty": certainty, "evidence_text": said}
    nan = float("nan")
    lists = {
        "again": [fact(full, 0.5, "a"), fact(("t", *full[1:]), 0.1, "b"), fact(full, 0.9, "c"), fact(full, 0.9, "d"), fact(("s", "X", "r", "o", "O"), 0.7, "e")],
        "odd": [fact(full, None, "a"), fact(full, -1.0, "b"), None, fact(full, nan, "c"), fact(full, nan, "d"), fact(full, 2.0, "e")],
        "null": [fact(full, None, "a"), fact(full, None, "b"), fact(("sr", "S", "", "o", "O"), 1.0, "c"), fact(("s", "S", "r", None, "O"), 1.0, "d"), fact(("s", None, "r", "o", "O"), 1.0, "e")],
        "zero": [fact(full, -0.0, "a"), fact(full, 0.0, "b"), fact(("S", "S", "r", "o", "O"), 0.0, "c"), fact(("s", "S", "ro", "o", "O"), 0.0, "d")],
        "none": [], "no": None,
    }
    rows = spark.createDataFrame(list(lists.items()), f"chunk_id string, said {ingest.TRIPLES}")
    apart = rows.select("chunk_id", F.posexplode("said").alias("pos", "t"))
    names = [F.col(f"t.{b}").alias(a) for a, b in chunking.FULL.items()]
    want = chunking.best_triple(apart.select("chunk_id", "pos", *names, "t.certainty", "t.evidence_text"))
    got = chunking.best_of_list(rows, "said").select(want.columns)
    told = lambda df: sorted(map(repr, df.collect()))
    assert told(got) == told(want) and got.count() == 7
    assert plan(got).count("sort_array") == 1  # a list isn't sorted again for each of its facts


def test_extraction_shuffles_nothing(spark):
    text = "Ann supplies bolt. Ann supplies bolt. Bob ordered bolt."
    rows = [("a", text, None), ("a", text, None), ("b", None, None), ("c", text, "then"), (None, text, None)]
    found = ingest.extracted(spark.createDataFrame(rows, "chunk_id string, content string, extracted_at string"))
    assert "Exchange" not in plan(found, "executedPlan") and "Join " not in plan(found)
    assert plan(found, "executedPlan").count("ArrowEvalPython") == 1
    got = sorted((r.chunk_id, r.subj, r.pos, r.raw_certainty, r.confidence, r.start) for r in found.collect())
    assert got == sorted([("a", "Ann", 0, 0.8, 0.98, 0), ("a", "Bob", 2, 0.8, 0.98, 38)] * 2)


def test_chunks_are_made_of_parts_that_fit_in_memory(spark, small, monkeypatch):
    want = tables.fact_chunks(spark, small).collect()
    few = tables.fact_chunks.__wrapped__(spark, small)
    monkeypatch.setattr(tables, "FACTS_AT_ONCE", 2000)
    n = -(-tables.edges(spark, small).count() // 2000)
    many = tables.fact_chunks.__wrapped__(spark, small)
    assert n > 4 and f", {n}), REPARTITION_BY_NUM" in plan(many, "executedPlan") and "REPARTITION_BY_NUM" not in plan(few, "executedPlan")
    assert sorted(many.collect()) == sorted(want)


def test_each_expert_has_a_file_however_rows_are_dealt(spark, small):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.slug: r.n for r in QUERIES["registry_scan"](spark, small).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.read.parquet(f"{small}/customer.parquet").groupBy("c_mktsegment").count().collect()
    assert got == {r.c_mktsegment: r["count"] for r in rows}


def test_a_neighbourhood_without_a_cap_is_whole(spark):
    hub = spark.range(3000).select(F.lit("a").alias("subj"), F.lit("r").alias("rel"), F.format_string("b%04d", "id").alias("obj"), F.lit(0.5).alias("certainty"), F.col("id").cast("string").alias("chunk_id"))
    again = hub.limit(1).withColumn("certainty", F.lit(0.9))
    rim = hub.select(F.col("obj").alias("subj"), "rel", F.concat(F.lit("c"), "obj").alias("obj"), "certainty", "chunk_id")
    e = hub.unionByName(again).unionByName(rim)
    a = spark.createDataFrame([("q", "a")], "q_id string, name string")
    nodes, walked = graph.ego(e, a, 2, None)
    assert {r.hop: r["count"] for r in nodes.groupBy("hop").count().collect()} == {0: 1, 1: 3000, 2: 3000}
    assert walked.count() == 6000 and walked.agg(F.sum("certainty")).first()[0] == pytest.approx(3000.4)
    some = [sorted(map(tuple, rows.collect())) for most in (2000, None) for rows in graph.ego(hub.limit(9), a, 1, most)]
    assert some[:2] == some[2:]


def test_harmonic_scores_takes_all_nodes(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(harmonic, "ego", lambda *r, f=graph.ego: asked.append(r[3]) or f(*r))
    QUERIES["harmonic_scores"](spark, small)
    assert asked == [None] and "LIMIT" not in ORACLES["harmonic_scores"]


def test_a_question_s_graph_is_dealt_out_once(spark):
    questions = spark.createDataFrame([("q1", "What has Acme Widgets Ltd supplied?")], "q_id string, text string")
    passages = spark.createDataFrame([("q1", "Acme Widgets Ltd supplies hot bolt.\n\nhot bolt has brand Brand#7.")], "q_id string, text string")
    own = isolated.answers(questions, passages)
    # texts, who has them, both sides of what is said of them, facts, and questions: seven windows move nothing
    assert plan(own, "executedPlan").count("Exchange hashpartitioning") <= 6
    assert [(r.place, r.subj, r.obj) for r in own.orderBy("place").collect()] == [(1, "Acme Widgets Ltd", "hot bolt"), (2, "hot bolt", "Brand#7")]


def test_scorers_may_speak_of_facts_by_number(spark, tmp_path):
    key = ["subj", "rel", "obj", "chunk_id"]
    facts = spark.createDataFrame([("s", "r", "o", "c1", 0.9), ("t", "r", "o", "c2", 0.5)], "subj string, rel string, obj string, chunk_id string, certainty double")
    by_number = lambda rows: rows.where("subj = 's'").select("fact", F.lit(0.25).alias("relevance_score"))
    by_key = lambda rows: rows.select(*key, F.lit(0.5).alias("grounding_score"))
    rows, failed = trust.with_signals(facts, {"relevance_score": by_number, "grounding_score": by_key, "provenance_count": lambda rows: rows.select("fact", F.lit(3).alias("provenance_count"))})
    assert not failed and "fact" not in rows.columns
    assert {r.subj: (r.relevance_score, r.grounding_score, r.provenance_count) for r in rows.collect()} == {"s": (0.25, 0.5, 3), "t": (None, 0.5, 3)}


def test_what_scorers_say_goes_along_by_number(spark, small):
    said = plan(QUERIES["one_scorer_fails"](spark, small)).split("Aggregate [")[1].splitlines()[0]
    assert said.startswith("fact#") and "subj" not in said


def test_sentences_are_made_behind_the_shuffle(spark, small):
    above = plan(QUERIES["evidence_exact"](spark, small)).split("Join ")
    assert len(above) == 2 and "concat(" not in above[1]


def test_found_facts_leave_their_chunk_s_text(spark):
    rows = [("c", "Ann supplies bolt.", None)]
    assert "content" not in ingest.extracted(spark.createDataFrame(rows, "chunk_id string, content string, extracted_at string")).columns


def test_the_store_is_written_small(spark):
    import pyarrow.parquet as pq

    path = kept(spark.range(9)).inputFiles()[0].removeprefix("file:")
    assert pq.ParquetFile(path).metadata.row_group(0).column(0).compression == "ZSTD"


def test_evidence_that_comes_again_is_looked_for_once(monkeypatch):
    import pandas as pd

    seen = []
    monkeypatch.setattr(evidence, "candidates", lambda *r, f=evidence.candidates: seen.append(r) or f(*r))
    some = lambda x: pd.Series([x] * 5, dtype=object)
    out = evidence._signals(some("Ann"), some("Bob"), pd.Series([0.0, 0.5, 1.0, 0.2, 0.0]), some("ANN met  bob."), some("Then Ann met Bob. Ok."))
    assert len(seen) == 1 and list(out["raw"]) == [0.0, 0.5, 1.0, 0.2, 0.0] and list(out["confidence"]) == [0.9, 0.95, 1.0, 0.92, 0.9]


def test_waiting_chunks_are_picked_where_the_stream_reads(spark, small, monkeypatch):
    from factloom.streaming import streams

    seen = []
    monkeypatch.setattr(streams, "run_to_end", lambda stream, *rest: seen.append(stream))
    QUERIES["extract_stream"](spark, small)
    assert seen[0].columns == ["chunk_id", "content", "extracted_at"] and "isnull(extracted_at" in plan(seen[0], "analyzed")
