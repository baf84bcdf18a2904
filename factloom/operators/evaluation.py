"""Evaluation: answers, failures, rates, summaries, bootstrap intervals."""

from __future__ import annotations

import math

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import normal_answer
from ..shared import arrow_files, kept, scratch

MODES = ["context_gap", "retrieval", "reasoning"]


#: Characters of gold answers that one automaton holds.
AUTOMATON_CHARS = 16 << 20


def holds_gold(golds: DataFrame, texts: DataFrame) -> DataFrame:
    """(gold_id, text_id) where the normalised gold answer stands in the normalised text.

    The answers make an automaton that finds all of them in one pass over a text, however many
    there are. They are written to the shared folder, where each task reads them; a question set
    of more than AUTOMATON_CHARS characters is cut into parts by hash, each an automaton of its
    own, and the texts are read once for each. No answer passes the driver.
    """
    spark = golds.sparkSession
    own = golds.select("gold_id", normal_answer(F.col("gold")).alias("g")).where("gold_id IS NOT NULL AND g IS NOT NULL")
    own = kept(own, "golds")
    chars = own.agg(F.sum(F.length("g").cast("long") + 1)).first()[0] or 0
    parts = -(-chars // AUTOMATON_CHARS)
    path = scratch(spark, "golds")
    own.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(max(parts, 1))).cast("int")).repartition(max(parts, 1), "part").write.partitionBy("part").parquet(path)
    plain = texts.select("text_id", normal_answer(F.col("text")).alias("t")).where("t IS NOT NULL")
    kind = f"gold_id {golds.schema['gold_id'].dataType.simpleString()}, text_id {texts.schema['text_id'].dataType.simpleString()}"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    out = plain.select(F.lit(None).cast(golds.schema["gold_id"].dataType).alias("gold_id"), "text_id").where("false")
    for part in range(parts):

        def run(batches, part=part):
            import ahocorasick
            import pyarrow.parquet as pq

            system, root = arrow_files(f"{path}/part={part}")
            held: dict[str, list] = {}
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    rows = pq.read_table(info.path, filesystem=system, columns=["gold_id", "g"], partitioning=None)
                    for gold_id, g in zip(rows["gold_id"].to_pylist(), rows["g"].to_pylist()):
                        held.setdefault(g, []).append(gold_id)
            automaton, always = ahocorasick.Automaton(), held.get("", [])
            for answer, ids in held.items():
                if answer:
                    automaton.add_word(answer, ids)
            automaton.make_automaton()
            for batch in batches:
                found: tuple[list, list] = ([], [])
                for text_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hits = {id(ids): ids for _, ids in automaton.iter(text)} if len(automaton) else {}
                    for gold_id in [*always, *(g for ids in hits.values() for g in ids)]:
                        found[0].append(gold_id)
                        found[1].append(text_id)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, schema.types)], schema=schema)

        out = out.unionByName(plain.mapInArrow(run, kind))
    return out


def failure_mode(in_context, in_retrieved):
    """Also given where the answer was right: then it says where the gold answer stood."""
    return F.when(~in_context, "context_gap").when(~in_retrieved, "retrieval").otherwise("reasoning")


def em_by(rows: DataFrame, condition: str) -> DataFrame:
    """Exact match with and without a condition, over rows that have one."""
    own = rows.where("answer_em IS NOT NULL")
    out = own.groupBy("profile").agg(
        F.round(F.avg(F.when(F.col(condition), F.col("answer_em"))), 4).alias("em_with"),
        F.count_if(F.col(condition)).alias("n_with"),
        F.round(F.avg(F.when(~F.col(condition), F.col("answer_em"))), 4).alias("em_without"),
        F.count_if(~F.col(condition)).alias("n_without"),
    )
    return out.withColumn("condition", F.lit(condition))


def mean_finite(c):
    x = F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return F.coalesce(F.avg(x), F.lit(0.0))


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Nulls count as 0 before averages are taken."""
    aggs = [F.round(mean_finite(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), 4).alias(f"avg_{m}") for m in metrics]
    return rows.groupBy("profile").agg(F.count("*").alias("count"), *aggs)


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count("*").alias("count"), F.round(F.avg("answer_em"), 4).alias("em"), F.round(F.avg("answer_f1"), 4).alias("f1"))


def warned_category(acknowledged, em):
    return F.when(acknowledged, "warned").when(em == 1.0, "confident_correct").otherwise("hallucinated")


def faithful_category(acknowledged, verdict):
    return F.when(acknowledged, "acknowledged").when(verdict == "unfaithful", "hallucinated").when(verdict == "faithful", "faithful").otherwise("abstain")


def rate(condition, of=None):
    """Share of rows (of those that ``of`` holds for); 0 where there are none."""
    total = F.count("*") if of is None else F.count_if(of)
    hit = F.count_if(condition if of is None else condition & of)
    return F.round(hit / F.greatest(total, F.lit(1)), 4)


def hallucination_rates(rows: DataFrame) -> DataFrame:
    c = F.col("category")
    return rows.groupBy("type").agg(
        F.count("*").alias("n"),
        rate(c == "hallucinated").alias("hallucination_rate"),
        rate(c == "warned").alias("acknowledgment_rate"),
        rate(c == "confident_correct").alias("confident_correct_rate"),
    )


def faithfulness_rates(rows: DataFrame) -> DataFrame:
    c, gold = F.col("category"), F.col("gold_hallucinated")
    return rows.agg(
        F.count("*").alias("total"),
        rate(c == "hallucinated", ~F.col("acknowledged")).alias("hallucination_rate"),
        rate(c == "acknowledged").alias("acknowledgment_rate"),
        rate(c == "faithful").alias("faithfulness_rate"),
        F.count_if(gold).alias("n_gold_hallucinated"),
        rate(c == "hallucinated", gold).alias("rate_on_gold_hallucinated"),
        rate(c == "hallucinated", ~gold).alias("rate_on_gold_clean"),
    )


#: The prime field in which draws are mixed, so that any engine draws the same; and the least
#: values of the field at which a Poisson variable of mean 1 reaches 1, 2, 3 ...
PRIME = 2**31 - 1
STEPS = [int(PRIME * sum(math.exp(-1) / math.factorial(k) for k in range(n + 1))) for n in range(9)]


def with_draws(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (id, b, ...) with ``w``, how often resample b draws row id: Poisson with mean 1, by a hash of both.

    A row's count in a resample of a large set follows that law, and no row needs to know of
    the others: neither numbering nor a join. Each round of mixing is a projection of its own,
    so that its value is computed once and not copied into what follows.
    """
    out = rows.withColumn("x", F.pmod(F.col("id") * 7919 + F.col("b") * 104729 + seed, F.lit(PRIME)))
    x = F.col("x")
    for a in (48271, 69621, 16807):
        out = out.withColumn("x", (x * x % PRIME * a + x + a) % PRIME)
    return out.withColumn("w", sum(((x >= step).cast("int") for step in STEPS[1:]), (x >= STEPS[0]).cast("int"))).drop("x")


def resampled(scores: DataFrame, value, samples: int, seed: int) -> DataFrame:
    """(b, mean) of each resample of the rows (id and a value), summed where the rows are."""
    each = scores.select(F.col("id").cast("long").alias("id"), value.cast("double").alias("v")).where("v IS NOT NULL")
    each = with_draws(each.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long")))), seed)
    sums = each.groupBy("b").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n")).where("n > 0")
    return sums.select("b", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


def interval(means: DataFrame, samples: int, alpha: float) -> DataFrame:
    """The means at the percentile places of all resamples (as many rows as resamples)."""
    ranked = means.withColumn("place", F.row_number().over(Window.orderBy("mean", "b")) - 1)
    low, high = int(samples * alpha / 2), min(int(samples * (1 - alpha / 2)), samples - 1)
    return ranked.agg(F.max(F.when(F.col("place") == low, F.col("mean"))).alias("lo"), F.max(F.when(F.col("place") == high, F.col("mean"))).alias("hi"))


def bootstrap_ci(scores: DataFrame, samples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """mean, n, lo, hi of the column score. scores: id (a number that is a row's own) and score."""
    head = scores.agg(F.round(F.avg("score"), 6).alias("mean"), F.count("score").alias("n"))
    return head.join(interval(resampled(scores, F.col("score"), samples, seed), samples, alpha), F.lit(True))


def _significant(head: DataFrame, means: DataFrame, samples: int, alpha: float) -> DataFrame:
    out = head.join(interval(means, samples, alpha), F.lit(True))
    return out.withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


def bootstrap_diff(scores: DataFrame, samples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The paired difference a - b, drawn together; it tells something if its interval leaves 0 out."""
    diff = F.col("a") - F.col("b")
    head = scores.agg(F.round(F.avg(diff), 6).alias("diff"), F.count(diff).alias("n"))
    return _significant(head, resampled(scores, diff, samples, seed), samples, alpha)


def bootstrap_unpaired(a: DataFrame, b: DataFrame, samples: int = 10_000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """The difference of the means of two result sets (id, score) that are drawn each by itself."""
    head = a.agg(F.avg("score").alias("ma"), F.count("score").alias("n_a")).join(b.agg(F.avg("score").alias("mb"), F.count("score").alias("n_b")), F.lit(True))
    head = head.select(F.round(F.col("ma") - F.col("mb"), 6).alias("diff"), "n_a", "n_b")
    other = resampled(b, F.col("score"), samples, seed + 1).withColumnRenamed("mean", "other")
    means = resampled(a, F.col("score"), samples, seed).join(other, "b").select("b", F.round(F.col("mean") - F.col("other"), 6).alias("mean"))
    return _significant(head, means, samples, alpha)


def progress(sessions: DataFrame) -> DataFrame:
    """Done and all questions of each session, and the share in percent."""
    return sessions.withColumn("percent", F.round(100 * F.col("done") / F.greatest(F.col("total"), F.lit(1)), 1))


def coverage(paths: DataFrame, every: DataFrame, baseline: DataFrame) -> DataFrame:
    """How many paths there are, how many are kept, and how many of their chunks the baseline has too."""
    counts = every.groupBy("q_id").agg(F.count_if(F.col("hops") == 1).alias("one_hop"), F.count_if(F.col("hops") == 2).alias("two_hop"))
    kept = paths.groupBy("q_id").agg(F.count("*").alias("kept"))
    own = paths.select("q_id", F.explode(F.array("chunk_id", "chunk2")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    shared = own.join(baseline.select("q_id", "chunk_id").distinct(), ["q_id", "chunk_id"], "left_semi").groupBy("q_id").agg(F.count("*").alias("overlap"))
    out = counts.join(kept, "q_id", "left").join(own.groupBy("q_id").agg(F.count("*").alias("path_chunks")), "q_id", "left").join(shared, "q_id", "left")
    return out.na.fill(0)


def profile_columns(rows: DataFrame, profiles: list[str], metrics: tuple[str, ...] = ("answer_em", "answer_f1")) -> DataFrame:
    """One row for each id: every profile's metrics side by side, null where a profile has no row."""
    wide = rows.groupBy("id").pivot("profile", profiles).agg(*(F.max(m).alias(m) for m in metrics))
    short = {m: m.removeprefix("answer_") for m in metrics}
    return wide.select("id", *(F.col(f"`{p}_{m}`").alias(f"{p}_{short[m]}") for p in profiles for m in metrics))


def oracle_analysis(golds: DataFrame, contexts: DataFrame, retrieved: DataFrame, results: DataFrame, profiles: list[str], only_types: list[str] | None = None) -> DataFrame:
    """Where each question's gold answer stood, and what every profile made of it.

    golds: id, gold, type. contexts, retrieved: id, text, of the question's own passages and of
    what was retrieved for it. results: id, profile, answer_em, answer_f1.
    """
    golds = golds if only_types is None else golds.where(F.col("type").isin(only_types))

    def held(texts: DataFrame, name: str) -> DataFrame:
        own = texts.join(golds.select("id", "gold"), "id").where(normal_answer(F.col("text")).contains(normal_answer(F.col("gold"))))
        return own.select("id").distinct().withColumn(name, F.lit(True))

    out = golds.join(held(contexts, "in_original_context"), "id", "left").join(held(retrieved, "in_retrieved_chunks"), "id", "left")
    out = out.na.fill(False, ["in_original_context", "in_retrieved_chunks"])
    out = out.withColumn("failure_mode", failure_mode(F.col("in_original_context"), F.col("in_retrieved_chunks")))
    return out.join(profile_columns(results, profiles), "id", "left")


def reasoning_em(analysis: DataFrame, profile: str) -> DataFrame:
    """Exact match of a profile over the questions whose answer was retrieved."""
    own = analysis.where("failure_mode = 'reasoning'")
    return own.agg(F.count("*").alias("n"), F.round(F.avg(f"{profile}_em"), 4).alias("em"))
