"""Exact resampling, the feed, the index with a memory, question graphs, progress."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import models
from factloom.operators import delta, registry, resampling, store, trust
from factloom.plans import index, isolated, progress, tables
from factloom.streaming import feed


def test_draws_sum_to_n_in_every_resample():
    for sizes in ([5, 0, 17, 1, 300, 0, 0, 77], [1], [0, 3], [10] * 64):
        parts = list(resampling.counts(sizes, 500, seed=7))
        assert (sum(parts) == sum(sizes)).all() and all((p >= 0).all() for p in parts)
        assert all((p == 0).all() for p, n in zip(parts, sizes) if n == 0)
    parts = np.array(list(resampling.counts([100, 300, 600], 20_000)))
    # multinomial: means, variances and covariances
    assert parts.mean(1) == pytest.approx([100, 300, 600], rel=0.01)
    assert np.cov(parts)[0, 0] == pytest.approx(1000 * 0.1 * 0.9, rel=0.05) and np.cov(parts)[0, 2] == pytest.approx(-1000 * 0.1 * 0.6, rel=0.1)


def test_exact_resampling(spark):
    rng = np.random.default_rng(0)
    rows = [("a", float(v), float(w)) for v, w in zip(rng.integers(0, 2, 400), rng.normal(size=400))] + [("b", 1.0, 2.0)] * 3 + [("c", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    drawn = {r.g: r for r in resampling.sums(df, ["g"], {"v": F.col("v"), "w": F.col("w")}, 2000).collect()}
    assert set(drawn) == {"a", "b"} and drawn["a"].n == 400 and set(drawn["a"].draws) == {400} and set(drawn["b"].v) == {3.0} and set(drawn["b"].w) == {6.0}
    again = resampling.sums(df.repartition(13), ["g"], {"v": F.col("v"), "w": F.col("w")}, 2000).where("g = 'a'").first()
    assert again.v == drawn["a"].v  # however rows are dealt
    means = np.array(drawn["a"].v) / 400
    v = np.array([r[1] for r in rows[:400]])
    assert means.mean() == pytest.approx(v.mean(), abs=0.003) and means.std() == pytest.approx(v.std() / 20, rel=0.08)
    whole = resampling.mean_ci(df.where("g = 'a'"), [], F.col("v"), 2000).first()
    assert (whole.n, whole.least, whole.most) == (400, 400, 400) and whole.lo < whole.mean < whole.hi
    same = resampling.difference_ci(df.where("g = 'a'"), ["g"], F.col("v"), F.col("v"), 200).first()
    assert (same["diff"], same.lo, same.hi, same.significant) == (0.0, 0.0, 0.0, False)
    assert resampling.mean_ci(df.where("g = 'c'"), ["g"], F.col("v"), 200).count() == 0


def test_a_feed_goes_on_behind_its_cap(spark, tmp_path):
    lake = delta.Lake(spark, str(tmp_path / "lake"), {"rings": feed.RINGS, "cursors": feed.CURSORS})
    client = spark.createDataFrame([("c",)], "client string")
    given = []
    for low, high in ((0, 30), (30, 33), (33, 90)):
        spark.range(low, high).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("odd")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, odd long").parquet(str(tmp_path / "in"))
        feed.run(stream, lake, "id", str(tmp_path / "state"), most=10, shards=3)
        given.append(sorted(r.at for r in feed.poll(lake, client, 10).collect()))
    assert given == [list(range(20, 30)), [30, 31, 32], list(range(80, 90))]
    assert feed.poll(lake, client, 10).count() == 0
    late = feed.poll(lake, spark.createDataFrame([("new",)], "client string"), 10).collect()
    assert sorted(r.at for r in late) == list(range(80, 90)) and json.loads(next(r.record for r in late if r.at == 80)) == {"id": 80, "odd": 80}


def test_texts_are_embedded_once(spark, tmp_path):
    lake = delta.Lake(spark, str(tmp_path / "lake"), index.TABLES)
    chunks = lambda rows: spark.createDataFrame(rows, "chunk_id string, content string")
    assert index.update(lake, chunks([("a", "one"), ("b", "two"), ("c", "one"), ("n", None)]), models.HashingEmbedder) == {"indexed": 4, "embedded": 3}
    assert index.update(lake, chunks([("a", "one"), ("b", "two")]), models.HashingEmbedder) == {"indexed": 0, "embedded": 0}
    assert index.update(lake, chunks([("a", "two"), ("d", "three"), ("e", "one")]), models.HashingEmbedder) == {"indexed": 3, "embedded": 1}
    index.remove(lake, chunks([("b", "")]))
    got = {r.chunk_id: r for r in index.read(lake).collect()}
    assert sorted(got) == ["a", "c", "d", "e", "n"] and got["e"].vec == got["c"].vec and {r.run for r in got.values()} == {1, 2}
    assert got["a"].vec == models.HashingEmbedder().embed(["two"])[0]
    assert index.update(lake, chunks([("b", "two")]), models.HashingEmbedder) == {"indexed": 1, "embedded": 0}


def test_batches_are_bounded_by_tokens():
    texts = ["x" * 40, "x" * 40, "x" * 4000, "", "x" * 8]
    assert list(index.batches(texts, 25)) == [texts[:2], texts[2:3], texts[3:]] and list(index.batches([], 5)) == []


def test_questions_answered_together_equal_each_alone(spark):
    said = ["Acme Corporation supplies blue widget. Bolts Limited supplies red widget.", "blue widget has brand Brandname One. red widget has brand Brandname Two.", "Acme Corporation is located in Northland.", "no facts here", ""]
    texts = {"q1": said[:2], "q2": [said[0], said[2]], "q3": [said[1]], "q4": said[3:], "q5": said[:3]}
    asked = {"q1": "What does Acme Corporation supply?", "q2": "Where is Acme Corporation?", "q3": "Where is Acme Corporation?", "q4": "Acme Corporation?", "q5": "Who makes Brandname Two?"}
    questions = spark.createDataFrame(list(asked.items()), "q_id string, text string")
    passages = spark.createDataFrame([(q, t) for q, own in texts.items() for t in own], "q_id string, text string")
    key = lambda r: (r.q_id, r.place, r.subj, r.rel, r.obj, r.chunk_id)
    together = sorted(key(r) for r in isolated.answers(questions, passages).collect())
    alone = []
    for q in ("q1", "q3", "q5"):
        alone += [key(r) for r in isolated.answers(questions.where(F.col("q_id") == q), passages.where(F.col("q_id") == q)).collect()]
    assert [r for r in together if r[0] in ("q1", "q3", "q5")] == sorted(alone) and {r[0] for r in together} == {"q1", "q2", "q5"}
    assert not [r for r in together if r[0] == "q1" and r[3] == "is located in"]  # what only another question's passages say


def test_progress_counts_by_the_way(spark, tmp_path):
    told = []
    run = progress.Progress(lambda step, counts: told.append((step, counts)))
    run.step("first", spark.range(10), lambda df: df.write.parquet(str(tmp_path / "a")), even=F.count_if(F.col("id") % 2 == 0))
    run.step("none", spark.range(0), lambda df: df.write.parquet(str(tmp_path / "b")), sum=F.sum("id"))
    assert told[0] == ("first", {"rows": 10, "even": 5}) and told[1][1]["rows"] == 0
    assert sorted(tuple(r) for r in run.table(spark).collect()) == [("first", "even", 5), ("first", "rows", 10), ("none", "rows", 0)]


def test_scorers_fail_one_by_one(spark):
    facts = spark.createDataFrame([("s", "r", "o", "c1", 0.9), ("t", "r", "o", "c2", 0.5)], "subj string, rel string, obj string, chunk_id string, certainty double")
    key = ["subj", "rel", "obj", "chunk_id"]

    def broken(rows):
        raise ConnectionError("away")

    some = lambda rows: rows.where("subj = 's'").select(*key, F.lit(0.25).alias("relevance_score"))
    rows, failed = trust.with_signals(facts, {"relevance_score": some, "grounding_score": broken})
    got = {r.subj: (r.relevance_score, r.grounding_score, r.provenance_count) for r in rows.collect()}
    assert got == {"s": (0.25, None, 1), "t": (None, None, 1)} and list(failed) == ["grounding_score"]


def test_registries(spark, tmp_path):
    lake = delta.Lake(spark, str(tmp_path / "lake"), {"sessions": registry.SESSION, "conversations": registry.CONVERSATION})
    rows = lambda *own: spark.createDataFrame(list(own), registry.SESSION.schema)
    registry.create(lake, "sessions", rows(("s1", "p", "in_progress", "{}", "1"), ("s2", "p", "in_progress", "{}", "2"), ("s3", "q", "submitted", "{}", "3")))
    registry.create(lake, "sessions", rows(("s1", "x", "submitted", "", "9")))
    registry.change(lake, "sessions", spark.createDataFrame([("s1", '{"answers": 1}', "5", None), ("nobody", "{}", "9", None)], "session_id string, state string, updated_at string, status string"))
    people = spark.createDataFrame([("p",), ("q",)], "participant string")
    assert [(r.session_id, r.state, r.status) for r in registry.loaded(lake, people).collect()] == [("s1", '{"answers": 1}', "in_progress")]
    registry.create(lake, "conversations", spark.createDataFrame([(1, "u", "first"), (2, "u", "second")], registry.CONVERSATION.schema))
    registry.change(lake, "conversations", spark.createDataFrame([(2, "renamed")], "conv_id long, title string"))
    registry.delete(lake, "conversations", spark.createDataFrame([(1,)], "conv_id long"))
    assert [tuple(r) for r in lake.read("conversations").collect()] == [(2, "u", "renamed")]


def test_a_share_that_lies_halfway(spark):
    blocks = "array(named_struct('q_id', 1L, 'responses', array(named_struct('alias', 'A', 'agent_id', 'a', 'agent_label', 'l', 'expert_slug', 's'))))"
    rows = spark.sql(f"SELECT done, flatten(array_repeat({blocks}, 80)) AS question_blocks, 0 AS current_index, map_from_arrays(sequence(1, done), sequence(1, done)) AS evaluations FROM VALUES (23), (49), (51), (22) AS t(done)")
    # 28.75, 61.25, 63.75 and 27.5: shares by division alone lie beside the middle
    assert {r.done: r.percent_complete for r in registry.session_payload(rows).collect()} == {23: 28.8, 49: 61.2, 51: 63.8, 22: 27.5}


def test_only_names_of_several_types_are_sorted_for_the_last(spark):
    rows = [("a", "X", "1"), ("a", "X", "9"), ("b", "X", "2"), ("b", "Y", "1"), (None, "X", "1"), (None, "Y", "2"), ("c", "X", None), ("d", "X", None), ("d", "Y", "1"), ("e", None, "1")]
    out = store.last_types(spark.createDataFrame(rows, "name string, type string, seq string"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", "X"), ("b", "X"), (None, "Y"), ("c", None), ("d", "Y"), ("e", None)], key=repr)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_keys_that_stand_twice_multiply_only_their_own_facts(spark, small, tmp_path):
    """A line's facts are made in one pass; who supplies it and who buys it don't multiply each other."""
    for name in ("region", "nation", "part", "customer"):
        tables.read(spark, small, name).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("supplier", "orders"):
        own = tables.read(spark, small, name)
        (own.union(own) if name == "supplier" else own).write.parquet(f"{tmp_path}/{name}.parquet")
    items = tables.read(spark, small, "lineitem").limit(50)
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    read = [p for p in tables.edges(spark, str(tmp_path)).groupBy("rel").count().collect()]
    counts = {r.rel: r["count"] for r in read}
    assert counts["supplies"] == 100 and counts["ordered"] == 50
    # chunks are grouped where their facts meet: one exchange of plain rows
    plan = tables.fact_chunks.__wrapped__(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan
