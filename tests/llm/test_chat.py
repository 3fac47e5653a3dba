"""Folding of logs, rendering and reading back."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwell.llm import chat, queries

from .helpers import rows, table

EVENTS = "conv_id long, seq long, message_id string, kind string, role string, text string, extra string"


def check(got, turns):
    by = {}
    for r in turns:
        by.setdefault(r["conv_id"], []).append(r)
    by[-1] = [{"turn": 0, "role": "user", "text": queries.HOSTILE}, {"turn": 1, "role": "assistant", "text": queries.HOSTILE}]
    assert sorted(r["conv_id"] for r in got) == sorted(by)
    for r in got:
        want = sorted(by[r["conv_id"]], key=lambda t: t["turn"])
        told = "".join(f"{t['role']}\n{t['text'] or ''}\n" for t in want)
        loss = "".join(t["text"] or "" for t in want if t["role"] == "assistant")
        assert r["n_turns"] == len(want) and r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] > len(told) - 2 * len(want)


def test_op9(spark, small):
    check(rows(queries.op9_chat(spark, small)), table(small, "conversations"))


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 5, "m2", "delta", None, "lo", "x"), (1, 4, "m2", "message", "assistant", "hel", "x"), (1, 1, "m1", "message", "user", "hi", "x"),
        (1, 6, "m2", "regenerate", None, None, "x"), (1, 7, "m2", "delta", None, "good", "x"), (1, 8, "m2", "delta", None, "bye", "x"),
        (1, 9, "m1", "edit", None, "hey", "x"), (2, 1, "m1", "delta", "assistant", "alone", "x"), (None, 1, "a", None, None, None, None), (None, None, None, None, None, None, None),
    ]
    made = chat.format_chats(spark.createDataFrame(log, EVENTS))
    got = {r["conv_id"]: [(t.role, t.text) for t in r["t"]] for r in rows(made.select("conv_id", chat.parse(F.col("formatted"), F.col("loss_mask")).alias("t")))}
    assert got == {1: [("user", "hey"), ("assistant", "goodbye")], 2: [("assistant", "alone")], None: [("", ""), ("", "")]}
    assert rows(chat.format_chats(spark.createDataFrame([], EVENTS))) == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from([*"<|>[]/\\startendINS \né\U0001f600", "<|start|>", "<|text|>", "<|end|>", "[INST]", "</s>", "\\<|"]), max_size=12).map("".join), min_size=1, max_size=6))
def test_any_text_comes_back(spark, texts):
    log = [(1, i, str(i), "message", "assistant" if i % 2 else "us<|text|>er", t, "") for i, t in enumerate(texts)]
    r = rows(chat.format_chats(spark.createDataFrame(log, EVENTS)).select("formatted", "loss_spans", chat.parse(F.col("formatted"), F.col("loss_mask")).alias("t")))[0]
    assert [t.text for t in r["t"]] == texts
    assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == len(texts) and "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    inside = spark.createDataFrame([(r["formatted"][s.start : s.end],) for s in r["loss_spans"]], "x string").select(chat.unescape(F.col("x")).alias("x"))
    assert [x["x"] for x in rows(inside)] == texts[1::2]


def test_one_long_conversation(spark):
    turns = spark.range(20_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "cast(id as string) as text")
    made = chat.format_chats(chat.events_of_turns(turns))
    got = rows(made.select(chat.parse(F.col("formatted"), F.col("loss_mask")).alias("t")))[0]["t"]
    assert [t.text for t in got] == [str(i) for i in range(20_000)]
