"""More queries: lookups, registry, study, grounding, runs and their analysis."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from .functions import ids, models, text
from .operators import chunking, components, delta, evaluation, graph, prompt, registry, resampling, store, trust, vectors
from .plans import experiments, index, ingest, isolated, local, progress, tables
from .queries import ASKED, CHUNKS, DOCS, EDGES, HELD, LINES, RESULTS, anchors_sql, asked_anchors, held, query
from .sources import catalogue, readers, sinks
from .streaming import feed, streams

# --- store ---------------------------------------------------------------------------------


@query(f"WITH {EDGES}, {CHUNKS} SELECT chunk_id, content, 'C7' AS wanted FROM chunks WHERE chunk_id = 'C7'")
def lookup_chunk(spark, sf_dir):
    """By id: an equality that reaches the scan."""
    return tables.fact_chunks(spark, sf_dir).where("chunk_id = 'C7'").select("chunk_id", "content", F.lit("C7").alias("wanted"))


@query(f"WITH {DOCS} SELECT document_id, doc_type, first_id, copies FROM docs WHERE 'doc://' || first_id = 'doc://0'")
def lookup_url(spark, sf_dir):
    """By address: an equality that reaches the scan."""
    return tables.documents(spark, sf_dir).where("source_url = 'doc://0'").select("document_id", "doc_type", "first_id", "copies")


@query("SELECT coalesce(max(event_id + 1), 0) AS next_offset FROM events WHERE event_type <> 'error' AND user_id = 3")
def state_offset(spark, sf_dir):
    done = tables.seen_records(spark, sf_dir).where(F.col("status").isin(store.DONE))
    state = done.groupBy(F.col("seq_key").cast("string").alias("query_key")).agg(F.max("resume_offset").alias("next_offset"))
    return store.next_offset(state, "3")


@query(f"WITH {EDGES}, {CHUNKS} SELECT count(*) FILTER (WHERE extracted_at IS NULL) AS skipped, 0::BIGINT AS waiting, count(*) AS chunks FROM chunks")
def skip_unextracted(spark, sf_dir):
    c = tables.fact_chunks(spark, sf_dir)
    after = store.skip_unextracted(c, F.lit("now"))
    return after.agg(F.count_if(F.col("extracted_at") == "now").alias("skipped"), F.count_if(F.col("extracted_at").isNull()).alias("waiting"), F.count("*").alias("chunks"))


@query(f"WITH {EDGES}, {CHUNKS} SELECT count(*) AS unstamped, 0::BIGINT AS edges, 0::BIGINT AS entities FROM chunks")
def clear_all(spark, sf_dir):
    e = tables.edges(spark, sf_dir)
    c, left, names = store.clear_all(tables.fact_chunks(spark, sf_dir), e, graph.entities(e))
    out = c.agg(F.count_if(F.col("extracted_at").isNull()).alias("unstamped"))
    return out.join(left.agg(F.count("*").alias("edges")), F.lit(True)).join(names.agg(F.count("*").alias("entities")), F.lit(True))


# --- registry and study --------------------------------------------------------------------

EXPERTS = "experts AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '')) AS slug, c_name AS name, c_mktsegment AS personality, CASE WHEN c_custkey % 3 = 0 THEN []::VARCHAR[] ELSE ['u' || (c_custkey % 5), 'u9'] END AS allowed_users FROM customer)"


def experts(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    users = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), (F.col("c_custkey") % 5).cast("string")), F.lit("u9")))
    return c.select(F.col("c_custkey").alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit(""))).alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("personality"), users.alias("allowed_users"))


@query(f"WITH {EXPERTS} SELECT id, slug FROM experts WHERE len(allowed_users) = 0 OR list_contains(allowed_users, 'u2')")
def experts_visible(spark, sf_dir):
    return registry.visible(experts(spark, sf_dir), "u2").select("id", "slug")


@query(f"WITH {EXPERTS} SELECT slug, CASE WHEN id % 10 = 0 THEN 'Renamed ' || id ELSE name END AS name, CASE WHEN id % 4 = 0 THEN 'stern' ELSE personality END AS personality FROM experts")
def experts_updated(spark, sf_dir):
    """Partial changes; unknown fields and unknown experts change nothing, the last change of a field wins."""
    e = experts(spark, sf_dir)
    change = lambda rows, field, value, seq: rows.select("slug", F.lit(field).alias("field"), value.alias("value"), F.lit(seq).alias("seq"))
    tenth, fourth = e.where("id % 10 = 0"), e.where("id % 4 = 0")
    changes = change(tenth, "name", F.lit("first"), 1).union(change(tenth, "name", F.concat(F.lit("Renamed "), F.col("id").cast("string")), 2))
    changes = changes.union(change(fourth, "personality", F.lit("stern"), 1)).union(change(e, "unknown", F.lit("x"), 9))
    changes = changes.union(change(e.withColumn("slug", F.lit("nobody")), "name", F.lit("x"), 9))
    return registry.updated(e.select("slug", "name", "personality"), changes)


@query("SELECT conv_id, 'A' AS alias, 'agent ' || role AS text FROM conversations WHERE turn = 0")
def blinded_responses(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").where("turn = 0")
    fields = (F.lit("A").alias("alias"), F.col("role").alias("agent_id"), F.lit("label").alias("agent_label"), F.lit("slug").alias("expert_slug"), F.concat(F.lit("agent "), F.col("role")).alias("text"))
    own = registry.blinded(c.select("conv_id", F.array(F.struct(*fields)).alias("responses")))
    return own.select("conv_id", F.explode("responses").alias("r")).select("conv_id", "r.*")


BANK = "bank AS (SELECT conv_id AS q_id, role AS agent_id, arg_min(text, turn) AS text FROM conversations GROUP BY ALL), wanted AS (SELECT q_id, agent_id FROM (SELECT DISTINCT conv_id AS q_id FROM conversations), (SELECT unnest(['user', 'assistant', 'nobody']) AS agent_id))"


def bank(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations")
    agents = spark.range(1).select(F.explode(F.array(*map(F.lit, ("user", "assistant", "nobody")))).alias("agent_id"))
    wanted = registry.cross_product(c.select(F.col("conv_id").alias("q_id")).distinct(), agents)
    return wanted, c.select(F.col("conv_id").alias("q_id"), F.col("role").alias("agent_id"), "text", F.col("turn").alias("pos"))


@query(f"WITH {BANK} SELECT q_id, agent_id, coalesce(text, '') AS text FROM wanted LEFT JOIN bank USING (q_id, agent_id)")
def bank_texts(spark, sf_dir):
    return registry.bank_texts(*bank(spark, sf_dir))


@query(f"WITH {BANK} SELECT q_id, agent_id, CASE WHEN coalesce(text, '') <> '' THEN text WHEN agent_id = 'nobody' THEN 'live ' || q_id ELSE '' END AS text FROM wanted LEFT JOIN bank USING (q_id, agent_id)")
def agent_dispatch(spark, sf_dir):
    wanted, texts = bank(spark, sf_dir)
    wanted = wanted.withColumn("class", F.when(F.col("agent_id") == "nobody", "live").otherwise("stored"))
    out = registry.dispatched(wanted, texts, {"live": F.concat(F.lit("live "), F.col("q_id").cast("string"))})
    return out.select("q_id", "agent_id", "text")


SESSIONS = "sessions AS (SELECT user_id AS session_id, count(*) AS total FROM events GROUP BY user_id), ratings AS (SELECT user_id AS session_id, event_id AS q_id, (event_id % 5 + 1)::BIGINT AS accuracy, (event_id % 4 + 1)::BIGINT AS humanness FROM events WHERE event_type <> 'error')"


def sessions(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    rated = e.where("event_type <> 'error'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("q_id"), (F.col("event_id") % 5 + 1).alias("accuracy"), (F.col("event_id") % 4 + 1).alias("humanness"))
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("total")), rated


@query(f"WITH {SESSIONS} SELECT session_id, total, count(q_id) AS done, round(100.0::DOUBLE * count(q_id) / greatest(total, 1), 1) AS percent, count(q_id) >= total AS ready FROM sessions LEFT JOIN ratings USING (session_id) GROUP BY session_id, total")
def session_progress(spark, sf_dir):
    return evaluation.progress(registry.submittable(*sessions(spark, sf_dir))).select("session_id", "total", "done", "percent", "ready")


@query(f"WITH {SESSIONS} SELECT round(avg(accuracy), 4) AS accuracy, round(avg(humanness), 4) AS humanness, count(*) AS n FROM ratings")
def mean_ratings(spark, sf_dir):
    own = sessions(spark, sf_dir)[1].groupBy("session_id").agg(F.collect_list(F.struct("accuracy", "humanness")).alias("ratings"))
    return registry.mean_ratings(own)


@query(f"WITH {SESSIONS} SELECT session_id, q_id, CASE WHEN q_id % 7 = 0 THEN 5 ELSE accuracy END::BIGINT AS accuracy, CASE WHEN q_id % 7 = 0 THEN 1 ELSE humanness END::BIGINT AS humanness FROM ratings")
def ratings_upsert(spark, sf_dir):
    rows = sessions(spark, sf_dir)[1]
    again = rows.where("q_id % 7 = 0")
    changes = again.withColumns({"accuracy": F.lit(1).cast("long"), "seq": F.lit(1)}).unionByName(again.withColumns({"accuracy": F.lit(5).cast("long"), "humanness": F.lit(1).cast("long"), "seq": F.lit(2)}))
    return registry.rated(rows, changes)


BLOCKS = "s AS (SELECT user_id AS session_id, count(*) AS total, count(*) FILTER (WHERE event_id % 3 = 0) AS done, min(event_id) AS first, list(event_id ORDER BY event_id) AS q_ids FROM events GROUP BY user_id)"


def shown(spark, sf_dir):
    """A session for each user: its events are the questions, and every third is answered."""
    e = tables.read(spark, sf_dir, "events")
    response = F.struct(F.lit("A").alias("alias"), F.col("event_type").alias("text"), F.lit("a1").alias("agent_id"), F.lit("L").alias("agent_label"), F.lit("s").alias("expert_slug"))
    block = F.struct(F.col("event_id").alias("q_id"), F.array(response).alias("responses"))
    answers = F.map_from_entries(F.collect_list(F.when(F.col("event_id") % 3 == 0, F.struct(F.col("event_id").cast("string"), F.lit(5)))))
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.array_sort(F.collect_list(block)).alias("question_blocks"), answers.alias("evaluations"), F.lit(1).alias("current_index"), F.lit("in_progress").alias("status"), F.lit("x").alias("updated_at"), F.lit(None).cast("string").alias("completed_at"))


@query(f"""WITH {BLOCKS} SELECT session_id, total AS total_questions, done AS completed_questions, round_even(100.0::DOUBLE * done / total, 1) AS percent_complete,
q_ids[2] AS q_id, CASE WHEN total > 1 THEN 'alias,text' END AS told, done >= total AS ready_to_submit FROM s""")
def session_payload(spark, sf_dir):
    """What participants see of their sessions: no names of agents."""
    own = registry.session_payload(shown(spark, sf_dir))
    told = ",".join(own.schema["current_question"].dataType["responses"].dataType.elementType.names)
    question = F.col("current_question.q_id")
    return own.select("session_id", F.col("total_questions").cast("long").alias("total_questions"), F.col("completed_questions").cast("long").alias("completed_questions"), "percent_complete", question.alias("q_id"), F.when(question.isNotNull(), F.lit(told)).alias("told"), "ready_to_submit")


@query(f"WITH {BLOCKS} SELECT session_id, session_id % 2 = 0 AS logged, CASE WHEN session_id % 2 = 0 THEN 'completed' ELSE 'in_progress' END AS status, CASE WHEN session_id % 2 = 0 THEN 'now' END AS completed_at, CASE WHEN session_id % 2 = 0 THEN 'now' ELSE 'x' END AS updated_at FROM s")
def sessions_submitted(spark, sf_dir):
    own = shown(spark, sf_dir)
    after, log = registry.submitted(own, own.where("session_id % 2 = 0").unionByName(own.withColumn("session_id", -F.col("session_id") - 1)), F.lit("now"))
    logged = log.select("session_id", F.lit(True).alias("logged"))
    return after.join(logged, "session_id", "left").select("session_id", F.coalesce("logged", F.lit(False)).alias("logged"), "status", "completed_at", "updated_at")


@query("SELECT lang AS expert, string_agg(url, ' ' ORDER BY url) AS urls FROM (SELECT lang, CASE WHEN doc_id % 2 = 0 THEN 'https://x/' || doc_id END AS url FROM documents) WHERE url IS NOT NULL GROUP BY lang")
def expert_urls(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select(F.col("lang").alias("expert"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).otherwise(F.when(F.col("doc_id") % 3 == 0, F.lit(""))).alias("source_url"))
    return registry.document_urls(d).select("expert", F.array_join("urls", " ").alias("urls"))


# --- prompts and answers -------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN s <= 0 THEN 0 WHEN s <= 0.30 THEN 1 WHEN s <= 0.60 THEN 2 WHEN s <= 0.90 THEN 3 ELSE 4 END::BIGINT AS tier, s > 0.30 AS nudged, s >= 0.5 AS abstains,
CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '⚠️ Not grounded in the knowledge graph. ' || p_name END AS answer FROM (SELECT *, (p_size - 1) / 49.0::DOUBLE AS s FROM part)""")
def personas(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part").withColumn("s", (F.col("p_size") - 1) / 49.0)
    return p.select("p_partkey", prompt.persona_tier(F.col("s")).alias("tier"), prompt.nudged(F.col("s")).alias("nudged"), prompt.abstains(F.col("s")).alias("abstains"), prompt.warned(F.col("p_name"), 1 - F.col("p_partkey") % 2).alias("answer"))


@query(f"WITH {EDGES} SELECT DISTINCT 'q1' AS q_id, subj || ' ' || rel || ' ' || obj || '.' AS line FROM edges WHERE rel = 'is part of'")
def narrative(spark, sf_dir):
    e = tables.edges(spark, sf_dir).where("rel = 'is part of'")
    return prompt.narrative_lines(e.withColumn("q_id", F.lit("q1"))).distinct()


@query("SELECT p_partkey, 2 + (p_partkey % 2) AS n, p_name || ' rests.' AS plain FROM part")
def citation_counts(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    answer = F.concat(F.lit("Fact_1 and Fact_2, Fact_1; Fact_"), F.when(F.col("p_partkey") % 2 == 1, "33").otherwise("2"))
    plain = text.without_citations(F.concat("p_name", F.lit(" rests (Fact_00ab12, Fact_00ab13).")))
    return p.select("p_partkey", text.cited_numbers(answer).alias("n"), plain.alias("plain"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Hello! I am an AI assistant that answers from a knowledge graph. Ask me anything about it.' WHEN 1 THEN 'I am an AI for ' || p_name ELSE 'Said ' || p_brand || ' I am an AI assistant.' END AS intro,
CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS answer, lower(p_brand) AS caller, p_brand AS tail FROM part""")
def introductions(spark, sf_dir):
    p = tables.read(spark, sf_dir, "part")
    given = F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("I am an AI for "), F.col("p_name"))).when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("Said "), F.col("p_brand")))
    short = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name", F.lit(" "))).otherwise(F.lit(" "))
    return p.select(
        "p_partkey", text.introduction(given).alias("intro"), text.short_answer(short, F.col("p_brand")).alias("answer"),
        ids.caller(F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).alias("caller"), ids.url_tail(F.concat(F.lit("https://x.y/"), F.col("p_brand"), F.lit("//"))).alias("tail"),
    )


@query("SELECT lang AS title, arg_min(text, doc_id) AS sentences FROM documents GROUP BY lang")
def articles_first(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return chunking.first_per_title(d.select(F.col("lang").alias("title"), F.col("text").alias("sentences"), F.col("doc_id").alias("pos")))


# --- graph and trust -----------------------------------------------------------------------


@query(f"""WITH {EDGES}, both_ AS (SELECT subj AS a, obj AS b FROM edges WHERE rel IN ('is located in', 'is part of') UNION SELECT obj, subj FROM edges WHERE rel IN ('is located in', 'is part of')),
f AS (SELECT a AS name, b AS near, 1 AS degree FROM both_ WHERE a = 'NATION_3' UNION ALL SELECT 'NATION_3', y.b, 2 FROM both_ x JOIN both_ y ON x.b = y.a WHERE x.a = 'NATION_3' AND y.b <> 'NATION_3')
SELECT name, near, min(degree)::BIGINT AS degree FROM f GROUP BY ALL""")
def second_degree(spark, sf_dir):
    e = tables.edges(spark, sf_dir).where("rel IN ('is located in', 'is part of')")
    return graph.second_degree(e, spark.range(1).select(F.lit("NATION_3").alias("name")))


@query(f"WITH {EDGES}, f AS (SELECT * FROM edges ORDER BY subj, obj, rel, chunk_id LIMIT 500) SELECT subj, obj, max(rel) AS rel FROM f GROUP BY ALL")
def graph_export(spark, sf_dir):
    return graph.export(tables.edges(spark, sf_dir))


@query(f"WITH {EDGES}, {anchors_sql(ASKED)} SELECT q_id, name FROM anchors")
def anchors_first_seen(spark, sf_dir):
    """Names that differ in case alone are one anchor, the first."""
    a = asked_anchors(spark, sf_dir).withColumn("place", F.lit(0))
    return graph.first_seen(a.unionByName(a.withColumns({"name": F.upper("name"), "place": F.lit(1)}))).select("q_id", "name")


GROUNDED = """t AS (SELECT subj, rel, obj, chunk_id, certainty, CASE WHEN rel = 'has brand' THEN 0.7 WHEN rel = 'is part of' THEN 1.0 WHEN rel = 'is located in' AND subj_type = 'SUPPLIER' THEN 0.5 ELSE 0.5 END::DOUBLE AS grounding_score FROM edges WHERE rel IN ('has brand', 'is part of', 'is located in'))"""


def grounded(spark, sf_dir):
    e = tables.edges(spark, sf_dir).where("rel IN ('has brand', 'is part of', 'is located in')")
    said = F.when(F.col("rel") == "has brand", "I would say 0.7 here").when(F.col("rel") == "is part of", "5 of 5").when(F.col("subj_type") == "SUPPLIER", "no idea")
    replies = e.withColumn("reply", said).where("reply IS NOT NULL").select("subj", "rel", "obj", "chunk_id", "reply")
    return trust.with_grounding(e.select("subj", "rel", "obj", "chunk_id", "certainty"), replies)


@query(f"WITH {EDGES}, {GROUNDED} SELECT * FROM t")
def grounding(spark, sf_dir):
    """A judge's replies as numbers; facts without a reply, and replies without a number, get 0.5."""
    return grounded(spark, sf_dir)


@query(f"WITH {EDGES}, {GROUNDED} SELECT subj, rel, obj, chunk_id, round((0.4::DOUBLE * certainty + 0.2::DOUBLE * 0.25::DOUBLE + 0.3::DOUBLE * grounding_score) / (0.4::DOUBLE + 0.2::DOUBLE + 0.3::DOUBLE), 9) AS composite_trust FROM t")
def grounded_trust(spark, sf_dir):
    w = trust.Weights(grounding=0.3, grounded=True)
    rows = grounded(spark, sf_dir).withColumn("provenance_count", F.lit(2))
    return trust.composite(rows, w).select("subj", "rel", "obj", "chunk_id", "composite_trust")


@query(f"WITH {EDGES} SELECT subj, rel, obj, chunk_id, round((0.4::DOUBLE * certainty) / (0.4::DOUBLE + 0.2::DOUBLE), 9) AS composite_trust FROM edges WHERE rel = 'has brand'")
def trust_without_scorers(spark, sf_dir):
    """What facts are worth where every scorer fails."""
    e = tables.edges(spark, sf_dir).where("rel = 'has brand'").select("subj", "rel", "obj", "chunk_id", "certainty")
    return trust.composite(trust.without_signals(e)).select("subj", "rel", "obj", "chunk_id", "composite_trust")


@query(f"""WITH {EDGES}, prov AS (SELECT subj, rel, obj, count(*) AS n FROM edges GROUP BY ALL)
SELECT DISTINCT subj, rel, obj, chunk_id, certainty, round((0.4::DOUBLE * certainty + 0.4::DOUBLE * (length(subj) % 10) / 10.0::DOUBLE + 0.2::DOUBLE * least(n - 1, 4) / 4.0::DOUBLE) / 1.0::DOUBLE, 6) AS composite_trust, 'grounding_score' AS failed FROM edges JOIN prov USING (subj, rel, obj)""")
def one_scorer_fails(spark, sf_dir):
    """Of three scorers the judge of grounding breaks off; the other two count as ever."""
    e = tables.edges(spark, sf_dir).select("subj", "rel", "obj", "chunk_id", "certainty").distinct()
    key = ["subj", "rel", "obj", "chunk_id"]
    scorers = {
        "relevance_score": lambda rows: rows.select("fact", (F.length("subj") % 10 / 10.0).alias("relevance_score")),
        "grounding_score": lambda rows: rows.select("fact", F.raise_error(F.lit("the judge is away")).cast("double").alias("grounding_score")),
        "provenance_count": lambda rows: trust.with_provenance(rows.select("fact", *trust.FACT), tables.edges(spark, sf_dir), few=False).select("fact", "provenance_count"),
    }
    rows, failed = trust.with_signals(e, scorers)
    out = trust.composite(rows, trust.Weights(grounded=True, grounding=0.3))
    return out.select(*key, "certainty", F.round("composite_trust", 6).alias("composite_trust"), F.lit(",".join(sorted(failed))).alias("failed"))


# --- runs and their analysis ---------------------------------------------------------------


@query(f"WITH {RESULTS} SELECT type, count(*) AS n FROM results WHERE type IN ('en', 'de') AND acknowledged GROUP BY type")
def type_filter(spark, sf_dir):
    return tables.result_rows(spark, sf_dir).where("type IN ('en', 'de') AND acknowledged").groupBy("type").agg(F.count("*").alias("n"))


PROFILES = ["web", "books"]
ANALYSIS = f"""{HELD}, seen AS (SELECT gold_id, bool_or(text_id % 2 = 0) AS r FROM held GROUP BY gold_id),
res AS (SELECT item_id AS id, 'web' AS profile, (item_id % 2)::DOUBLE AS em, (item_id % 3) / 2.0::DOUBLE AS f1 FROM benchmark UNION ALL SELECT item_id, 'books', 1.0, 0.5 FROM benchmark WHERE item_id % 5 = 0),
a AS (SELECT item_id AS id, s.gold_id IS NOT NULL AS in_original_context, coalesce(s.r, false) AS in_retrieved_chunks, CASE WHEN s.gold_id IS NULL THEN 'context_gap' WHEN NOT s.r THEN 'retrieval' ELSE 'reasoning' END AS failure_mode FROM benchmark LEFT JOIN seen s ON s.gold_id = item_id)"""


def analysis(spark, sf_dir, only=None):
    b = tables.read(spark, sf_dir, "benchmark")
    golds = b.select(F.col("item_id").alias("id"), F.col("text").alias("gold"), F.when(F.col("item_id") % 2 == 0, "bridge").otherwise("comparison").alias("type"))
    d = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    # what each question's own passages are: those that hold its answer, by the automaton
    own = held(spark, sf_dir).join(d, "text_id").select(F.col("gold_id").alias("id"), "text_id", "text")
    em = lambda rows, name, em_, f1: rows.select(F.col("item_id").alias("id"), F.lit(name).alias("profile"), em_.cast("double").alias("answer_em"), f1.cast("double").alias("answer_f1"))
    results = em(b, "web", F.col("item_id") % 2, (F.col("item_id") % 3) / 2.0).union(em(b.where("item_id % 5 = 0"), "books", F.lit(1.0), F.lit(0.5)))
    return evaluation.oracle_analysis(golds, own, own.where("text_id % 2 = 0"), results, PROFILES, only)


@query(f"""WITH {ANALYSIS} SELECT a.*, w.em AS web_em, w.f1 AS web_f1, k.em AS books_em, k.f1 AS books_f1 FROM a LEFT JOIN res w ON w.id = a.id AND w.profile = 'web' LEFT JOIN res k ON k.id = a.id AND k.profile = 'books'""")
def oracle_analysis(spark, sf_dir):
    return analysis(spark, sf_dir).drop("gold", "type")


@query(f"WITH {ANALYSIS} SELECT failure_mode, count(*) AS n FROM a WHERE id % 2 = 0 GROUP BY failure_mode")
def oracle_by_type(spark, sf_dir):
    """One type of question alone."""
    return analysis(spark, sf_dir, ["bridge"]).groupBy("failure_mode").agg(F.count("*").alias("n"))


@query(f"WITH {ANALYSIS} SELECT count(*) AS n, round(avg(em), 4) AS em FROM a JOIN res USING (id) WHERE profile = 'web' AND failure_mode = 'reasoning'")
def reasoning_em(spark, sf_dir):
    return evaluation.reasoning_em(analysis(spark, sf_dir), "web")


SETTINGS = {"global": {"depth": 1}, "profiles": {"plain": {}, "deep": {"depth": 2}, "off": {"enabled": False}}}


@query("""WITH r AS (SELECT profile, doc_id, CASE WHEN profile = 'deep' OR doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS em FROM documents, (SELECT unnest(['plain', 'deep']) AS profile))
SELECT profile, count(*) AS count, round(avg(em), 4) AS avg_answer_em, round(avg(em), 4) AS avg_answer_f1 FROM r GROUP BY profile""")
def profile_matrix(spark, sf_dir):
    """Questions under every enabled profile, written as JSON, read again and summed up."""
    d = tables.read(spark, sf_dir, "documents")
    questions = d.select(F.col("doc_id").alias("id"), F.lit("Which?").alias("question"), F.array(F.concat(F.lit("w"), F.col("doc_id").cast("string"))).alias("answers"))
    names = spark.createDataFrame([(n, own["depth"]) for n, own in experiments.profiles(SETTINGS).items()], "profile string, depth int")
    answer = F.when((F.col("depth") == 2) | (F.col("id") % 3 == 0), F.col("answers")[0]).otherwise(F.lit("unknown thing"))
    rows = experiments.answered(questions, names, answer)
    path = f"{tables.shared_dir(spark)}/run-{uuid.uuid4().hex}"
    sinks.write_rows(rows.select("profile", "id", "answer_em", "answer_f1"), path)
    back = sinks.read_rows(spark, path, "profile string, id long, answer_em double, answer_f1 double")
    return experiments.matrix(back, ["answer_em", "answer_f1"])


@query("SELECT user_id AS session_id, count(*) AS lines FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id")
def evaluation_log(spark, sf_dir):
    """An append-only log of JSON lines, written twice and read back."""
    e = tables.read(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    path = tables.scratch(spark, "log")
    for kind in ("error", "signup"):
        sinks.append_log(e.where(F.col("event_type") == kind), path)
    return sinks.read_log(spark, path, "session_id long, event_id long, event_type string").groupBy("session_id").agg(F.count("*").alias("lines"))


# --- sources that arrive, and what is built from them --------------------------------------


def part_pages(spark, sf_dir):
    """Parts as pages (page, results) of 50 publications, two thirds of which have a PDF."""
    n = F.col("p_partkey") - 1
    link = F.struct(F.concat(F.lit("https://x/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("pdf"))
    other = F.struct(F.lit("text/html").alias("mimetype"), F.lit("n").alias("name"), F.struct(F.lit(None).cast("string").alias("pdf")).alias("links"))
    file = F.struct(F.lit("application/pdf").alias("mimetype"), F.lit("n").alias("name"), link.alias("links"))
    record = F.struct(n.alias("n"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_partkey") % 3 != 0).alias("downloadsAvailable"), F.array(other, file).alias("downloads"), F.array("p_brand").alias("subjectCategories"))
    return tables.read(spark, sf_dir, "part").where("p_partkey > 0").groupBy(F.floor(n / 50).cast("int").alias("page")).agg(F.array_sort(F.collect_list(record)).alias("results"))


RECORDS = delta.Spec(("id",), "id long, title string, pdf_url string, categories array<string>, resume_offset long")


@query("SELECT p_partkey AS id, p_name AS title, 'https://x/' || p_partkey || '.pdf' AS pdf_url, p_partkey AS resume_offset FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 0")
def catalogue_stream(spark, sf_dir):
    """Pages of 50 records arrive, some at a time; each batch is upserted, and a second run finds nothing new."""
    path = tables.scratch(spark, "pages")
    part_pages(spark, sf_dir).select(F.to_json(F.struct("page", "results")).alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    lake = delta.Lake(spark, tables.scratch(spark, "records"), {"records": RECORDS})
    state = tables.scratch(spark, "state")
    for _ in range(2):
        streams.ingest(catalogue.page_records(catalogue.page_stream(spark, path), 50), lake, "records", "resume_offset", state)
    return lake.read("records").select("id", "title", "pdf_url", "resume_offset")


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey AS resume_offset FROM part WHERE p_partkey % 3 <> 0 AND p_partkey > 0),
bad AS (SELECT min(id) AS b FROM r WHERE id % 89 = 5)
SELECT id, resume_offset, (SELECT coalesce(max(resume_offset), 0) FROM r WHERE id < coalesce((SELECT b FROM bad), id + 1)) AS stopped_at, CASE WHEN id % 89 = 5 THEN 2 ELSE 1 END AS run, (SELECT max(resume_offset) FROM r) AS next_offset FROM r""")
def paged_ingest(spark, sf_dir):
    """A paged source with offsets of its own: some records fail at first, which stops the stream before the first of them; the next run goes on there."""
    specs = {"records": delta.Spec(("id",), "id long, resume_offset long, run int"), "state": streams.STATE}
    path, lake = tables.scratch(spark, "pages"), delta.Lake(spark, tables.scratch(spark, "records"), specs)
    # a file for each page is slow to make: many tasks write them, and put them in place themselves
    pages = part_pages(spark, sf_dir).select("page", F.to_json(F.struct("results")).alias("value")).repartition(64, "page")
    pages.write.option("mapreduce.fileoutputcommitter.algorithm.version", 2).partitionBy("page").text(path)
    checkpoint = tables.scratch(spark, "state")

    def attempt(n: int):
        failing = (F.col("id") % 89 == 5) & F.lit(n == 1)
        process = lambda rows: rows.withColumn("status", F.when(failing, "download_failed").otherwise("committed")).withColumn("run", F.lit(n))
        stream = catalogue.catalogue(spark, path, 50, stream=True).select("id", "resume_offset", F.lit(0).alias("run"))
        streams.ingest_in_order(stream, lake, "records", "state", "parts", process, checkpoint)

    try:
        attempt(1)
    except StreamingQueryException as e:
        if "RecordFailed" not in str(e):
            raise
    stopped = lake.manifest()["version"]
    attempt(2)
    offset = lambda version, name: F.broadcast(lake.read("state", version).select(F.col("next_offset").alias(name)))  # noqa: E731  (a row)
    return lake.read("records").join(offset(stopped, "stopped_at"), F.lit(True)).join(offset(None, "next_offset"), F.lit(True))


FACTS = delta.Spec(("chunk_id",), "chunk_id string, subj string, rel string, obj string, certainty double")


@query(f"WITH {EDGES}, {CHUNKS} SELECT DISTINCT chunk_id, subj, rel, obj, 0.98::DOUBLE AS certainty FROM edges JOIN chunks USING (chunk_id) WHERE extracted_at IS NULL")
def extract_stream(spark, sf_dir):
    """Waiting chunks arrive as files; each batch replaces the facts of its chunks."""
    path, lake = tables.scratch(spark, "arriving"), delta.Lake(spark, tables.scratch(spark, "facts"), {"facts": FACTS})
    own = tables.fact_chunks(spark, sf_dir)
    own.write.option("compression", "zstd").parquet(path)
    stream = spark.readStream.schema(own.schema).option("maxBytesPerTrigger", 256 << 20).parquet(path)  # files and batches are bounded, not dealt into a fixed number
    facts = lambda chunks: ingest.extracted(chunks).select("chunk_id", "subj", "rel", "obj", "certainty")
    streams.extract_incremental(stream.select("chunk_id", "content", "extracted_at"), lake, "facts", facts, tables.scratch(spark, "state"))
    return lake.read("facts")


@query("SELECT vec_id::VARCHAR AS chunk_id, len(embedding) AS width FROM embeddings WHERE embedding IS NOT NULL")
def index_stream(spark, sf_dir):
    """Vectors arrive twice over; the index holds each once, and readers of the view see whole versions."""
    path, lake = tables.scratch(spark, "arriving"), delta.Lake(spark, tables.scratch(spark, "index"), {"vectors": delta.Spec(("chunk_id",), "chunk_id string, vec array<float>")})
    own = tables.vectors(spark, sf_dir).where("vec IS NOT NULL").select(F.col("key").cast("string").alias("chunk_id"), "vec")
    own.union(own).repartition(4).write.parquet(path)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 2).parquet(path)
    streams.index_incremental(stream, lake, "vectors", tables.scratch(spark, "state"))
    view = f"index_{uuid.uuid4().hex}"
    streams.swapped(lake, "vectors", view)
    return spark.table(view).select("chunk_id", F.size("vec").alias("width"))


@query(f"""WITH {DOCS}, {LINES}, gone AS (SELECT document_id FROM docs WHERE first_id % 10 = 3)
SELECT document_id, doc_type, CASE WHEN first_id % 2 = 0 THEN 'first' ELSE 'unknown' END AS origin, (SELECT count(DISTINCT chunk_id) FROM textchunks t WHERE t.document_id = d.document_id) AS chunks FROM docs d WHERE document_id NOT IN (SELECT document_id FROM gone)""")
def lake_versions(spark, sf_dir):
    """Documents and chunks in one commit, a commit that fails, a column that comes later, a deletion: what the newest version holds."""
    where = tables.scratch(spark, "lake")
    chunks = delta.Spec(("document_id",), "document_id string, chunk_id string")
    old = delta.Lake(spark, where, {"docs": delta.Spec(("document_id",), "document_id string, doc_type string"), "chunks": chunks})
    d, c = tables.documents(spark, sf_dir), store.distinct_chunks(tables.text_chunks(spark, sf_dir))
    with old.commit() as change:
        odd = d.where("first_id % 2 = 1")
        change.upsert("docs", odd)
        change.replace("chunks", c.join(odd.select("document_id"), "document_id", "left_semi"), touched=odd)
    try:
        with old.commit() as change:
            change.replace("docs", d.select("document_id", F.lit("wrong").alias("doc_type")))
            change.replace("chunks", c.select("document_id", F.raise_error(F.lit("broken")).cast("string").alias("chunk_id")))
    except Exception as e:
        if "broken" not in str(e):
            raise
    new = delta.Lake(spark, where, {"docs": delta.Spec(("document_id",), "document_id string, doc_type string, origin string", defaults={"origin": "unknown"}), "chunks": chunks})
    with new.commit() as change:
        even = d.where("first_id % 2 = 0")
        change.upsert("docs", even.withColumn("origin", F.lit("first")))
        change.replace("chunks", c.join(even.select("document_id"), "document_id", "left_semi"), touched=even)
    with new.commit() as change:
        gone = d.where("first_id % 10 = 3").select("document_id")
        change.delete("docs", gone)
        change.delete("chunks", gone)
    counts = new.read("chunks").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return new.read("docs").join(counts, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


@query(f"WITH {DOCS}, {LINES}, known AS (SELECT document_id FROM docs WHERE first_id % 2 = 0) SELECT d.document_id, count(DISTINCT chunk_id) AS chunks FROM docs d JOIN textchunks USING (document_id) WHERE d.document_id NOT IN (SELECT document_id FROM known) AND trim(d.text) <> '' GROUP BY ALL")
def ingest_records(spark, sf_dir):
    """Texts whose content or address is known are not taken again."""
    d = tables.documents(spark, sf_dir)
    docs, chunks = ingest.records(d.select("source_url", "doc_type", "text"), d.where("first_id % 2 = 0").select("document_id", "source_url"))
    return store.chunk_counts(docs, chunks)


@query(f"WITH {EDGES}, v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings) SELECT vec_id, greatest(0.0, round(c, 6)) AS relevance FROM v")
def relevance(spark, sf_dir):
    """A question's cosine with each vector, nothing below 0."""
    own = vectors.scores(tables.vectors(spark, sf_dir).select("key", vectors.normalised(F.col("vec")).alias("vec")), tables.question_vector(spark, sf_dir))
    return own.select(F.col("key").alias("vec_id"), F.greatest(F.lit(0.0), trust.finite(F.col("score"))).alias("relevance"))


@query("SELECT c_mktsegment AS slug, count(*) AS n FROM customer GROUP BY c_mktsegment")
def registry_scan(spark, sf_dir):
    """A folder of JSON files, one for each expert; one that can't be read is skipped."""
    path = tables.scratch(spark, "registry")
    own = tables.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("slug")).agg(F.count("*").alias("n"))
    own.select(F.to_json(F.struct("slug", "n")).alias("value")).unionByName(spark.range(1).select(F.lit('{"slug": "broken', ).alias("value"))).write.option("maxRecordsPerFile", 1).text(path)  # however rows are dealt, no file has two
    return readers.sessions(spark, path, "slug string, n long")


# --- the feed ------------------------------------------------------------------------------


def fed(spark, sf_dir):
    """Events arrive in three parts. One client asks after each, another at the end: the lake, and what clients were given."""
    lake = delta.Lake(spark, tables.scratch(spark, "feed"), {"rings": feed.RINGS, "cursors": feed.CURSORS})
    path, state = tables.scratch(spark, "arriving"), tables.scratch(spark, "state")
    own = tables.read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    size = F.broadcast(own.agg(F.count("*").alias("n")))  # one row
    given = []
    for part in range(3):
        own.join(size, F.lit(True)).where(F.floor(F.col("event_id") * 3 / F.col("n")) == part).drop("n").coalesce(1).write.mode("append").parquet(path)
        feed.run(spark.readStream.schema(own.schema).parquet(path), lake, "event_id", state)
        asking = ["steady"] if part < 2 else ["steady", "late"]
        given.append(feed.poll(lake, spark.createDataFrame([(c,) for c in asking], "client string")).withColumn("part", F.lit(part)))
    return lake, given


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def rolling_feed(spark, sf_dir):
    """The newest 500 events, from the rings of a stateful stream."""
    lake, _ = fed(spark, sf_dir)
    return feed.newest(lake).select(F.from_json("record", "event_id long, user_id long, event_type string").alias("r")).select("r.*")


@query("""WITH e AS (SELECT event_id, floor(event_id * 3 / (SELECT count(*) FROM events))::BIGINT AS part FROM events),
steady AS (SELECT 'steady' AS client, part, event_id, row_number() OVER (PARTITION BY part ORDER BY event_id DESC) AS rn FROM e),
late AS (SELECT 'late' AS client, 2 AS part, event_id, row_number() OVER (ORDER BY event_id DESC) AS rn FROM e)
SELECT client, part, count(*) AS given, min(event_id) AS first, max(event_id) AS last FROM (SELECT * FROM steady UNION ALL SELECT * FROM late) WHERE rn <= 500 GROUP BY ALL""")
def feed_clients(spark, sf_dir):
    """What each client was given, long after 500 events have passed."""
    _, given = fed(spark, sf_dir)
    every = given[0].unionByName(given[1]).unionByName(given[2])
    return every.groupBy("client", "part").agg(F.count("*").alias("given"), F.min("at").alias("first"), F.max("at").alias("last"))


# --- resampling, components, an index with a memory, a graph for each question ----------------


@query("""SELECT source AS profile, count(*) AS n, count(*) AS least, count(*) AS most, round(avg(quality), 6) AS mean, true AS plausible FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY source""")
def bootstrap_exact(spark, sf_dir):
    """Every resample draws as many rows as there are; the interval lies where the normal law has it, but for steps of a row."""
    rows = tables.result_rows(spark, sf_dir)
    ci = resampling.mean_ci(rows, ["profile"], F.col("answer_em"))
    error = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    near = lambda c, z: F.abs(F.col(c) - F.col("mean") - z * error) <= 0.75 * error + 1 / F.col("n")
    return ci.select("profile", "n", "least", "most", F.round("mean", 6).alias("mean"), (near("lo", -1.96) & near("hi", 1.96)).alias("plausible"))


@query("""WITH x AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i) WHERE embedding IS NOT NULL), y AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM x),
c AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / count(*) AS c FROM y a JOIN y b USING (vec_id) GROUP BY a.i, b.i)
SELECT (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS n, round((SELECT sum(c) FROM c WHERE i = j), 8) AS total, round((SELECT sum(c * c) FROM c), 8) AS squares,
round((SELECT sum(a.c * b.c * d.c) FROM c a JOIN c b ON b.i = a.j JOIN c d ON d.i = b.j AND d.j = a.i), 8) AS cubes""")
def component_variances(spark, sf_dir):
    """The variances along the principal directions, by the sums of their powers, which the covariances give, too."""
    found = components.fit(tables.vectors(spark, sf_dir))
    powers = [float((found.variances**p).sum()) for p in (1, 2, 3)]
    return spark.createDataFrame([(found.n, *powers)], "n long, total double, squares double, cubes double").select("n", *(F.round(c, 8).alias(c) for c in ("total", "squares", "cubes")))


@query(f"""WITH {DOCS}, {LINES}, first AS (SELECT DISTINCT substr(content, 1, 2200) AS c FROM textchunks JOIN docs USING (document_id) WHERE first_id % 2 = 0)
SELECT DISTINCT chunk_id, 64 AS width, CASE WHEN substr(content, 1, 2200) IN (SELECT c FROM first) THEN 1 ELSE 2 END AS run, 0 AS again FROM textchunks""")
def memo_index(spark, sf_dir):
    """Half of the documents' chunks are indexed, then all, then all once more: what each run embedded."""
    lake = delta.Lake(spark, tables.scratch(spark, "index"), index.TABLES)
    own = tables.text_chunks(spark, sf_dir)
    half = own.join(tables.documents(spark, sf_dir).where("first_id % 2 = 0").select("document_id"), "document_id", "left_semi")
    for chunks in (half, own):
        index.update(lake, chunks, models.HashingEmbedder)
    again = index.update(lake, own, models.HashingEmbedder)
    return index.read(lake).select("chunk_id", F.size("vec").alias("width"), "run", F.lit(again["embedded"]).alias("again"))


@query(f"""WITH {EDGES}, {CHUNKS}, {DOCS}, {LINES}
SELECT 'documents' AS step, unnest(['rows', 'copies']) AS counted, unnest([(SELECT count(*) FROM docs), (SELECT sum(copies)::BIGINT FROM docs)]) AS n
UNION ALL SELECT 'chunks', unnest(['rows', 'characters']), unnest([count(*), sum(length(content))::BIGINT]) FROM (SELECT DISTINCT chunk_id, content FROM textchunks)
UNION ALL SELECT 'facts', unnest(['rows', 'confident']), unnest([count(*), count(*) FILTER (0.98 >= 0.6)]) FROM (SELECT DISTINCT chunk_id, subj, rel, obj FROM edges JOIN chunks USING (chunk_id) WHERE extracted_at IS NULL)""")
def run_progress(spark, sf_dir):
    """Counts of an ingest's steps, observed while they are written."""
    run, path = progress.Progress(), tables.scratch(spark, "ingest")
    to = lambda name: lambda df: df.write.option("compression", "zstd").parquet(f"{path}/{name}")
    run.step("documents", tables.documents(spark, sf_dir), to("documents"), copies=F.sum("copies"))
    run.step("chunks", store.distinct_chunks(tables.text_chunks(spark, sf_dir)), to("chunks"), characters=F.sum(F.length("content")))
    run.step("facts", ingest.extracted(tables.fact_chunks(spark, sf_dir)), to("facts"), confident=F.count_if(F.col("certainty") >= store.LEAST_CONFIDENCE))
    return run.table(spark)


@query(f"""WITH {EDGES}, {CHUNKS}, lines AS (SELECT DISTINCT 'O' || l_orderkey AS q_id, 'L' || l_orderkey || '-' || l_linenumber AS lc, 'P' || l_partkey AS pc FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
own AS (SELECT DISTINCT q_id, content FROM (SELECT q_id, lc AS chunk_id FROM lines UNION SELECT q_id, pc FROM lines) JOIN chunks USING (chunk_id)),
f AS (SELECT DISTINCT q_id, subj, rel, obj, sha256(sha256(content) || ':' || content) AS chunk_id FROM own JOIN chunks c USING (content) JOIN edges e ON e.chunk_id = c.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY subj, rel, obj, chunk_id) AS place FROM f) SELECT q_id, place, subj, rel, obj, chunk_id, 0.98::DOUBLE AS certainty FROM r WHERE place <= 40""")
def question_graphs(spark, sf_dir):
    """A question for each order, with passages on its lines and parts: every one answered within a graph of its own."""
    t = lambda name: tables.read(spark, sf_dir, name)
    asked = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    questions = asked.select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("q_id"), F.concat(F.lit("What has "), "c_name", F.lit(" ordered, from whom, and of which brand?")).alias("text"))
    lines = t("lineitem").select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("q_id"), F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("lc"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("pc"))
    lines = lines.join(questions.select("q_id"), "q_id", "left_semi")
    passages = lines.select("q_id", F.explode(F.array("lc", "pc")).alias("chunk_id")).join(tables.fact_chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("text")), "chunk_id")
    return isolated.answers(questions, passages.select("q_id", "text"), k=40)


# --- whole ingests, and a registry that changes ------------------------------------------------


@query(f"""WITH {EDGES}, {CHUNKS}, f AS (SELECT DISTINCT subj, rel, obj, chunk_id FROM edges WHERE rel IN ('has brand', 'is part of', 'is located in'))
SELECT 'facts' AS what, count(*) AS n, count(DISTINCT subj) AS names FROM (SELECT DISTINCT subj, rel, obj FROM f) UNION ALL SELECT 'again', 0, 0 UNION ALL SELECT 'documents', count(DISTINCT left(chunk_id, 1)), 0 FROM f""")
def folder_ingest(spark, sf_dir):
    """Text files in a folder become documents, chunks, facts and vectors, in one commit; the same folder again changes nothing."""
    path = tables.scratch(spark, "files")
    own = tables.fact_chunks(spark, sf_dir).where("heading <> 'L'").select("heading", F.concat("content", F.lit("\n")).alias("value"))
    own.repartition("heading").write.partitionBy("heading").text(path)
    lake = delta.Lake(spark, tables.scratch(spark, "lake"), local.TABLES)
    files = lambda: local.texts(readers.folder(spark, path, types=["txt"]))
    first, again = (local.ingest(lake, files(), models.TemplateExtractor, models.HashingEmbedder) for _ in range(2))
    facts = lake.read("facts").select("subj", "rel", "obj").distinct().agg(F.lit("facts").alias("what"), F.count("*").alias("n"), F.count_distinct("subj").alias("names"))
    rows = [("again", again["documents"] + again["indexed"], 0), ("documents", first["documents"], 0)]
    return facts.unionByName(spark.createDataFrame(rows, "what string, n long, names long"))


@query(f"WITH {EXPERTS} SELECT slug, CASE WHEN id % 4 = 1 THEN 'Renamed ' || id ELSE name END AS name, personality FROM experts WHERE id % 4 <> 0 UNION ALL SELECT 'new-one', 'New One', 'kind'")
def registry_changes(spark, sf_dir):
    """Experts are created, some are renamed, some deleted; an expert that is there already isn't created again."""
    lake = delta.Lake(spark, tables.scratch(spark, "registry"), {"experts": registry.EXPERT})
    e = experts(spark, sf_dir)
    registry.create(lake, "experts", e)
    registry.create(lake, "experts", e.where("id % 2 = 0").withColumn("name", F.lit("taken")).unionByName(spark.createDataFrame([(-1, "new-one", "New One", "kind", [])], e.schema)))
    registry.change(lake, "experts", e.where("id % 4 = 1").select("slug", F.concat(F.lit("Renamed "), F.col("id").cast("string")).alias("name")))
    registry.delete(lake, "experts", e.where("id % 4 = 0"))
    return lake.read("experts").select("slug", "name", "personality")
