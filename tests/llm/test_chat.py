import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import chat, layouts

SCHEMA = "conv_id long, turn long, role string, text string, place long, sub int, at long, loss string"
PIECES = [*chat.CONTROLS, "\\", "<", "</", "[", "]", "/", "|>", "s>", "é", "\n", "\U0001f600", "a", "<<", "role", "SYS>>"]
odd_texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA).select("conv_id", "turn", "role", "text")


def want(rows):
    """What the digests should be, from the rows alone."""
    last = lambda v: (v is None, v or 0)
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (last(r[0]), last(r[1]), r[2] or "", (r[3] or "").encode())):
        own = out.setdefault(c, [0, "", "", 0])
        own[0] += 1
        own[1] += f"{role or ''}\n{text or ''}\n"
        own[2] += (text or "") if role == "assistant" else ""
        own[3] += len(chat.turn_text(role or "", text or "")[0])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (n, sha(a), len(loss), sha(loss), chars) for c, (n, a, loss, chars) in out.items()}


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in rows}
    assert len(out) == len(rows)
    return out


def run(spark, rows):
    return got(chat.digests(chat.formatted(chat.canonical(table(spark, rows)))))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]) | odd_texts, odd_texts), max_size=6))
def test_any_turns_come_back(turns):
    text, spans = "", []
    for role, said in turns:
        piece, start, end = chat.turn_text(role, said)
        assert not any(c in piece[start:end] for c in chat.CONTROLS)
        spans.append((role, len(text) + start, len(text) + end))
        text += piece
    assert list(chat.read_turns(text)) == spans
    assert [chat.unescaped(text[a:b]) for _, a, b in spans] == [said for _, said in turns]


def test_rows_of_every_kind(spark):
    rows = [
        (1, 0, "user", "hello"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "assistant", "a\\b\\\\</s>"), (2, 0, "assistant", "a\\b\\\\</s>"), (2, 0, "user", "same turn"),  # ties and repeated rows
        (3, None, "user", "no number"), (3, 5, None, None), (None, 0, "user", "no id"), (None, 1, "assistant", "none"), (4, 0, "<|role|>x", "<|end|>"),
        (5, 0, "assistant", "long </s> " * 100_000), (6, -3, "system", "é\U0001f600"),
    ]
    assert run(spark, rows) == want(rows)
    assert run(spark, []) == {}


def test_a_conversation_that_spans_tasks_and_parts(spark, monkeypatch):
    """A hot conversation is dealt out to several tasks, in several parts each, and read back in order."""
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i} " + "x" * (i % 50)) for i in range(3000)] + [(c, 0, "user", "one") for c in (1, 2, 8, 9)]
    assert run(spark, rows) == want(rows)
    long = [(7, i, "assistant", f"{i} " + "word " * 2000) for i in range(400)] + [(8, 0, "user", "b")]
    parts = chat.formatted(chat.canonical(table(spark, long)))
    held = sorted(((r.conv_id, r.at, r.text) for r in parts.collect()))
    assert len({at >> 33 for c, at, _ in held if c == 7}) > 1 and len(held) > 4
    assert max(len(t) for _, _, t in held) < 2 * chat.PART
    assert got(chat.digests(parts)) == want(long)


RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "system": "s"},
    "conversations": {"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "dialogue": {"conversation": {"turns": [{"speaker": "system", "utterance": "s"}, {"speaker": "user", "utterance": "q"}, {"speaker": "assistant", "utterance": "a"}]}},
    "instruction": {"instruction": "q", "output": "a", "system": "s"},
    "prompt_completion": {"system": "s", "prompt": "q", "completion": "a"},
    "prompt_response": {"system": "s", "prompt": "q", "response": "a"},
    "question_answer": {"system_prompt": "s", "question": "q", "response": "a"},
    "nested": {"input": {"prompt": "q", "system": "s"}, "output": {"text": "a"}},
}


def test_layouts_of_records_become_the_same_turns(spark):
    rows = [(json.dumps({**r, "conv_id": i, "extra": {"deep": [1, 2]}}),) for i, r in enumerate(RECORDS.values())]
    turns = chat.canonical(spark.createDataFrame(rows, "record string"), json_col="record")
    found = {}
    for r in turns.orderBy("conv_id", "sub").collect():
        found.setdefault((r.conv_id, r.layout), []).append((r.role, r.text))
    assert found == {(i, name): [("system", "s"), ("user", "q"), ("assistant", "a")] for i, name in enumerate(RECORDS)}
    assert len({r.fingerprint for r in turns.collect()}) == len(RECORDS)
    sums = got(chat.digests(chat.formatted(turns)))
    assert len(set(sums.values())) == 1 and len(sums) == len(RECORDS)


def test_odd_records(spark):
    texts = ["", None, "not json", "[1, 2]", "{}", '{"unheard": 1, "of": 2}', '{"conv_id": 1, "messages": []}', '{"conv_id": 2, "messages": null}', '{"conv_id": "3", "data": ["q", "a", "q2"]}',
             '{"conv_id": 4, "messages": [{"role": "user"}, {"content": "a", "role": null}]}', '{"conv_id": 5, "prompt": "\\ud800", "completion": null}', '{"conv_id": 99999999999999999999, "prompt": "q", "completion": "a"}']
    turns = chat.canonical(spark.createDataFrame([(t,) for t in texts], "record string"), json_col="record")
    found = {}
    for r in turns.where("layout IS NOT NULL").orderBy("conv_id", "sub").collect():
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    assert found == {3: [("user", "q"), ("assistant", "a"), ("user", "q2")], 4: [("user", ""), ("", "a")], 5: [("user", "?")], None: [("user", "q"), ("assistant", "a")]}
    assert sum(r.n for r in chat.unknown(turns).collect()) == 6


def test_fingerprints_are_of_paths_not_of_values_or_order():
    r = layouts.Registry()
    one, two = {"prompt": "x", "completion": "y", "z": 1}, {"completion": None, "prompt": ""}
    assert r.find(one) == r.find(two) and r.find(one)[1].name == "prompt_completion"
    assert r.find({"prompt": "x"})[1] is None
    with pytest.raises(ValueError, match="share"):
        layouts.Registry((*layouts.LAYOUTS, layouts.Layout("again", many="messages", role="role", text="content")))
