"""Transcripts, experts and study sessions as tables."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .delta import Lake, Spec


def conversations(messages: DataFrame, owner: str | None = None) -> DataFrame:
    """An owner's conversations, the last active first."""
    out = messages if owner is None else messages.where(F.col("owner") == owner)
    return out.groupBy("conv_id", "owner").agg(F.count("*").alias("messages"), F.max("at").alias("last_at")).orderBy(F.desc("last_at"), F.desc("conv_id"))


def last_turns(messages: DataFrame, turns: int) -> DataFrame:
    """The last 2 * turns messages of each conversation; 0 turns mean all of them."""
    if turns == 0:
        return messages
    w = Window.partitionBy("conv_id").orderBy(F.desc("at"))
    return messages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2 * turns).drop("rn")


def delete_conversation(convs: DataFrame, messages: DataFrame, conv_id) -> tuple[DataFrame, DataFrame]:
    return convs.where(F.col("conv_id") != conv_id), messages.where(F.col("conv_id") != conv_id)


def cited_ids(raw):
    """A JSON list of ids; what can't be read is an empty list."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def visible(experts: DataFrame, caller: str) -> DataFrame:
    """Experts that a caller may use: open ones, and those that list the caller."""
    return experts.where((F.size("allowed_users") == 0) | F.array_contains("allowed_users", caller))


def expertise(docs: DataFrame) -> DataFrame:
    """Distinct categories of an expert's documents in the order of first sight."""
    flat = docs.select("expert", F.col("pos").alias("doc_pos"), F.posexplode("categories").alias("pos", "category"))
    first = flat.groupBy("expert", "category").agg(F.min(F.struct("doc_pos", "pos")).alias("at"))
    return first.groupBy("expert").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x.category).alias("areas"))


def latest_session(sessions: DataFrame) -> DataFrame:
    """Per participant the session in progress that changed last."""
    own = sessions.where("status = 'in_progress'")
    return own.groupBy("participant").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("session_id"))


def blinded(blocks: DataFrame, column: str = "responses") -> DataFrame:
    """Responses without what would tell who wrote them."""
    return blocks.withColumn(column, F.transform(column, lambda r: r.dropFields("agent_id", "agent_label", "expert_slug")))


def bank_texts(wanted: DataFrame, bank: DataFrame) -> DataFrame:
    """The first stored text of each question and agent, else an empty one."""
    first = bank.groupBy("q_id", "agent_id").agg(F.min_by("text", "pos").alias("text"))
    return wanted.join(first, ["q_id", "agent_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def mean_ratings(sessions: DataFrame) -> DataFrame:
    flat = sessions.select(F.explode("ratings").alias("r"))
    return flat.agg(F.round(F.avg("r.accuracy"), 4).alias("accuracy"), F.round(F.avg("r.humanness"), 4).alias("humanness"), F.count("*").alias("n"))


def session_plan(questions: list[str], agents: list[str], n_questions: int, seed: int) -> list[dict]:
    """A session's questions and blinded agents, drawn with one seed on the driver (a handful of rows)."""
    rng = random.Random(seed)
    out = []
    for q in rng.sample(questions, min(n_questions, len(questions))):
        order = agents[:]
        rng.shuffle(order)
        out.append({"q_id": q, "responses": [{"alias": chr(ord("A") + i), "agent_id": a} for i, a in enumerate(order)]})
    return out


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Questions by agents, or profiles by data sets: both sides are configuration."""
    return left.join(F.broadcast(right), F.lit(True))


def updated(experts: DataFrame, changes: DataFrame, key: str = "slug") -> DataFrame:
    """Experts after partial changes: (slug, field, value) rows; unknown fields and slugs are ignored, the last change of a field wins.

    changes also has a number ``seq``.
    """
    fields = [c for c in experts.columns if c != key]
    last = changes.where(F.col("field").isin(fields)).groupBy(key).pivot("field", fields).agg(F.max_by("value", "seq"))
    out = experts.join(last.select(key, *(F.col(f"`{c}`").alias(f"__{c}") for c in fields)), key, "left")
    return out.select(key, *(F.coalesce(F.col(f"__{c}").cast(experts.schema[c].dataType), F.col(c)).alias(c) for c in fields))


def rated(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """A session's ratings by question, the last one of each; changes carry a number ``seq``."""
    every = ratings.withColumn("seq", F.lit(-1).cast("long")).unionByName(changes.withColumn("seq", F.col("seq").cast("long")))
    cols = [c for c in ratings.columns if c not in ("session_id", "q_id")]
    return every.groupBy("session_id", "q_id").agg(F.max_by(F.struct(*cols), "seq").alias("x")).select("session_id", "q_id", "x.*")


def submittable(sessions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Sessions (session_id, total) with how many questions are rated, and whether all are."""
    done = ratings.groupBy("session_id").agg(F.countDistinct("q_id").alias("done"))
    out = sessions.join(done, "session_id", "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
    return out.withColumn("ready", (F.col("done") >= F.col("total")) & (F.col("total") > 0))


def dispatched(wanted: DataFrame, bank: DataFrame, answers: dict) -> DataFrame:
    """Responses by agents of several classes: a stored text wins, else the class's own expression answers.

    wanted: q_id, agent_id, class, question. answers: class to a column expression over wanted.
    """
    live = F.lit("")
    for name, column in answers.items():
        live = F.when(F.col("class") == name, column).otherwise(live)
    return bank_texts(wanted, bank).withColumn("text", F.when(F.col("text") != "", F.col("text")).otherwise(live))


def session_payload(sessions: DataFrame, blind: bool = True) -> DataFrame:
    """Sessions as they are shown: the question in turn, the progress, and whether all is answered.

    sessions: question_blocks (an array with the field responses), current_index, evaluations
    (by question) and columns that stay. A share rounds to the even neighbour; it is multiplied
    before it is divided, so that one that lies halfway is exactly there. Blind sessions don't
    tell who wrote a response.
    """
    blocks = F.col("question_blocks")
    if blind:
        blocks = F.transform(blocks, lambda b: b.withField("responses", F.transform(b.responses, lambda r: r.dropFields("agent_id", "agent_label", "expert_slug"))))
    own = sessions.withColumn("question_blocks", blocks)
    own = own.withColumns({"total_questions": F.coalesce(F.size("question_blocks"), F.lit(0)), "completed_questions": F.coalesce(F.size("evaluations"), F.lit(0))})
    own = own.withColumn("percent_complete", F.when(F.col("total_questions") > 0, F.bround(100.0 * F.col("completed_questions") / F.col("total_questions"), 1)).otherwise(0.0))
    ready = (F.col("completed_questions") >= F.col("total_questions")) & (F.col("total_questions") > 0)
    return own.withColumns({"current_question": F.get("question_blocks", F.col("current_index")), "ready_to_submit": ready}).drop("question_blocks")


def submitted(sessions: DataFrame, wanted: DataFrame, when) -> tuple[DataFrame, DataFrame]:
    """Sessions after those wanted (session_id) are handed in at ``when``, and what goes to the log of evaluations.

    Ids that no session has change nothing; a session that is handed in again is stamped anew.
    """
    mark = wanted.select("session_id", F.lit(True).alias("__in")).distinct()
    out = sessions.join(mark, "session_id", "left")
    stamps = {"status": F.lit("completed"), "completed_at": when, "updated_at": when}
    out = out.withColumns({c: F.when(F.col("__in"), v).otherwise(F.col(c)) for c, v in stamps.items()})
    return out.drop("__in"), out.where("__in").drop("__in")


def document_urls(docs: DataFrame) -> DataFrame:
    """Per expert the addresses of its documents; documents without one are left out."""
    own = docs.where("coalesce(source_url, '') <> ''")
    return own.groupBy("expert").agg(F.array_sort(F.collect_list("source_url")).alias("urls"))


# --- registries that change, as tables of a lake ----------------------------------------------

EXPERT = Spec(("slug",), "slug string, id long, name string, personality string, allowed_users array<string>")
CONVERSATION = Spec(("conv_id",), "conv_id long, owner string, title string")
#: A session is created for a participant, and saved as a whole.
SESSION = Spec(("session_id",), "session_id string, participant string, status string, state string, updated_at string")


def create(lake: Lake, table: str, rows: DataFrame) -> None:
    """New rows; those whose key is there already are left as they are."""
    key = list(lake.specs[table].key)
    with lake.commit() as change_:
        change_.replace(table, rows.dropDuplicates(key).join(lake.read(table).select(*key), key, "left_anti"))


def change(lake: Lake, table: str, rows: DataFrame) -> None:
    """The given columns of rows that are there; unknown keys change nothing, a null leaves a column as it is."""
    key = list(lake.specs[table].key)
    given = [c for c in rows.columns if c not in key and c in lake.specs[table].fields()]
    fresh = rows.select(*key, *(F.col(c).alias(f"__{c}") for c in given)).dropDuplicates(key)
    out = lake.read(table).join(fresh, key).withColumns({c: F.coalesce(f"__{c}", c) for c in given})
    with lake.commit() as change_:
        change_.replace(table, out)


def delete(lake: Lake, table: str, keys: DataFrame) -> None:
    with lake.commit() as change_:
        change_.delete(table, keys)


def loaded(lake: Lake, participants: DataFrame) -> DataFrame:
    """Each participant's session in progress that changed last; a participant without one has none."""
    last = latest_session(lake.read("sessions")).join(participants.select("participant").distinct(), "participant", "left_semi")
    return lake.read("sessions").join(last.select("session_id"), "session_id", "left_semi")
