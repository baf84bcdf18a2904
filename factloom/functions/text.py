"""Text: names, answers, titles, replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sign and the phrases by which an answer admits that it lacks the facts.
SIGN = "⚠️"
ADMISSIONS = [
    "knowledge graph does not contain",
    "not contain information",
    "based on general knowledge",
    "general training knowledge",
]


def join_split_letters(name) -> Column:
    """'A ssemblers' to 'Assemblers': a letter that a scan parted from its word."""
    return F.regexp_replace(name, r"\b([A-Za-z]) ([a-z])", "$1$2")


def words(text) -> Column:
    """Python's split(): no empty words."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def without_initials(name) -> Column:
    """Middle initials go if any was there and two words at least are left."""
    every = words(name)
    kept = F.filter(every, lambda w: ~w.rlike(r"^[A-Za-z]\.$"))
    return F.when((F.size(kept) >= 2) & (F.size(kept) < F.size(every)), F.array_join(kept, " ")).otherwise(name)


def query_words(text) -> Column:
    return words(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def normal_answer(text) -> Column:
    """Lower case; articles go before punctuation (ASCII only) does."""
    value = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(words(F.regexp_replace(value, r"\p{Punct}", "")), " ")


def exact_match(prediction, golds) -> Column:
    return _once(normal_answer(prediction), lambda own: F.coalesce(F.exists(golds, lambda g: normal_answer(g) == own), F.lit(False)).cast("double"))


def _once(value: Column, then) -> Column:
    """then(value), with a value that is computed once: one that a lambda names is computed anew for each of its items."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _f1(p: Column, g: Column) -> Column:
    times = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(times(p, w), times(g, w)))
    # 2PR / (P + R) with P = common / |p| and R = common / |g|
    return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(p) + F.size(g)))


def token_f1(prediction, golds) -> Column:
    """The best F1 over multisets of words; nothing predicted or expected gives 0."""
    wanted = F.transform(golds, lambda g: words(normal_answer(g)))
    best = _once(words(normal_answer(prediction)), lambda p: F.array_max(F.transform(wanted, lambda g: _f1(p, g))))
    return F.coalesce(best, F.lit(0.0))


def admits(answer) -> Column:
    """Whether an answer carries a warning sign or says that it lacks the facts."""
    low = F.lower(answer)
    return reduce(lambda a, b: a | b, [answer.contains(SIGN), *(low.contains(p) for p in ADMISSIONS)])


def cited_labels(answer) -> Column:
    """Labels of facts in the order of their first mention."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"Fact_([0-9a-f]{6})"), 1))


def cited_numbers(answer) -> Column:
    """How many distinct numbered facts are named: the older, numeric form."""
    return F.size(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"Fact_\d+"), 0)))


def without_citations(answer) -> Column:
    return F.regexp_replace(answer, r"\s*\(Fact_[0-9a-f]{6}(?:,\s*Fact_[0-9a-f]{6})*\)", "")


def without_thinking(answer) -> Column:
    return F.trim(F.regexp_replace(answer, r"(?s)<think>.*?</think>", ""))


def fallback_title(text, most: int = 60) -> Column:
    """The text's start, cut at its last space beyond the twentieth character."""
    head = F.substring(text, 1, most)
    last = F.lit(most) - F.locate(" ", F.reverse(head)) + 1
    cut = F.when(last.between(21, most), F.substring(head, F.lit(1), last - 1)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def first_year(text) -> Column:
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")


def reply_number(reply) -> Column:
    """A judge's number in [0, 1]: the first one like 0.7 or 1.0, else its first word, else 0.5.

    The pattern and 0.5 are fixed values.
    """
    found = F.regexp_extract(reply, r"\b(1\.0+|0\.\d+)\b", 1).try_cast("double")
    first = F.get(words(reply), F.lit(0)).try_cast("double")
    return F.coalesce(found, F.when(first.isNotNull(), F.least(F.greatest(first, F.lit(0.0)), F.lit(1.0))), F.lit(0.5))


def salvaged_json(reply, schema: str) -> Column:
    """A list of records from a model's reply: fences go; a list that breaks off ends at its last whole record."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(reply, r"(?s)^\s*```[a-z]*\s*", ""), r"(?s)\s*```\s*$", ""))
    whole = F.when(plain.rlike(r"(?s)\]\s*$"), F.from_json(plain, schema))
    cut = F.concat(F.regexp_extract(plain, r"(?s)^(.*\})", 1), F.lit("]"))
    return F.coalesce(whole, F.from_json(cut, schema))


def percent(value) -> Column:
    """A share without decimals, as in '87%'."""
    return F.concat(F.bround(value * 100, 0).cast("int").cast("string"), F.lit("%"))


def grounding_score(reply) -> Column:
    """A judge's number for a fact that has a chunk; without one (no reply) it is 0.5, a fixed value."""
    return F.coalesce(F.when(reply.isNotNull(), reply_number(reply)), F.lit(0.5))


def short_answer(short, verbose, most: int = 2000) -> Column:
    """What a model has cut an answer down to; the answer's own beginning where it gave nothing."""
    return F.coalesce(F.nullif(F.trim(short), F.lit("")), F.substring(verbose, 1, most))


#: What an expert says who has no words of its own, and what must be said in an introduction.
INTRODUCTION = "Hello! I am an AI assistant that answers from a knowledge graph. Ask me anything about it."
DISCLAIMER = " I am an AI assistant."


def introduction(given) -> Column:
    """An expert's introduction; one that doesn't say that it is an AI is told to."""
    own = F.coalesce(F.nullif(F.trim(given), F.lit("")), F.lit(INTRODUCTION))
    return F.when(own.rlike(r"(?i)\b(ai|artificial intelligence)\b"), own).otherwise(F.concat(own, F.lit(DISCLAIMER)))
