from __future__ import annotations

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, n string"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_conversations(df)
    return {r["conv_id"]: r for r in made.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}


def test_segments_carry_loss(spark):
    r = formatted(spark, [(1, 1, "assistant", "fine </s>", "x"), (1, 0, "user", "hi [INST]", "x")])[1]
    assert r["formatted"] == "[INST]hi [\\cINST][/INST]<s>fine <\\c/s></s>"
    assert [(s["text"], s["loss"]) for s in r["segments"]] == [("[INST]", False), ("hi [\\cINST]", False), ("[/INST]", False), ("<s>", False), ("fine <\\c/s>", True), ("</s>", False)]
    assert [tuple(t) for t in r["turns"]] == [("user", "hi [INST]"), ("assistant", "fine </s>")]
    assert r["valid"] and r["n_violations"] == 0 and r["first_violation"] is None


def test_machine_finds_bad_orders(spark):
    got = formatted(
        spark,
        [(1, 0, "assistant", "a", ""), (1, 1, "assistant", "b", ""), (2, 0, "system", "s", ""), (2, 1, "user", "u", ""), (3, 0, "user", "u", ""), (3, 1, "tool", "t", ""), (3, 2, "assistant", "a", "")],
    )
    assert (got[1]["valid"], got[1]["n_violations"], got[1]["first_violation"]) == (False, 2, 0)
    assert (got[2]["valid"], got[2]["n_violations"]) == (False, 0)  # ends before an answer
    assert (got[3]["valid"], got[3]["n_violations"], got[3]["first_violation"]) == (False, 2, 1)
    assert [tuple(t) for t in got[3]["turns"]][1] == ("tool", "t")


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "assistant", None, "")]
    got = formatted(spark, rows)
    assert [tuple(t) for t in got[None]["turns"]] == [("", "")]
    assert [tuple(t) for t in got[1]["turns"]] == [("assistant", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


pieces = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", ">>", "\\", "\\c", "\\b", "<", "[", "/s>", "x", " ", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool>>", ""]), pieces), min_size=1, max_size=60))
def test_any_text_reads_back(spark, turns):
    got = formatted(spark, [(1, k, r, t, "") for k, (r, t) in enumerate(turns)])[1]
    assert [tuple(t) for t in got["turns"]] == turns


def test_probe_and_digests(spark, sf_dir):
    r = {x["conv_id"]: x for x in chat.op3_chat_formatting(spark, sf_dir).collect()}[-7]
    text = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_templates_that_texts_could_break_are_refused():
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Role("aa", "ab"), "bot": chat.Role("xab", "yy")}, moves={}, ends=())
    with pytest.raises(ValueError):
        chat.Template(roles={"user": chat.Role("<", "</u>")}, moves={}, ends=())


def test_loss_spans_are_places_of_the_formatted_text(spark):
    long = "word </s> \U0001f600 " * 30_000
    rows = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "é </s>\\ \U0001f600", ""), (1, 2, "user", long, ""), (1, 3, "assistant", long, ""), (2, 0, "tool", "x", ""), (2, 1, "assistant", None, "")]
    got = formatted(spark, rows)
    for conv, want in ((1, ["é </s>\\ \U0001f600", long]), (2, [""])):
        cut = [got[conv]["formatted"][a:b] for a, b in got[conv]["loss_spans"]]
        assert [x.replace("\\c", "").replace("\\b", "\\") for x in cut] == want
        assert "".join(t["text"] for t in got[conv]["turns"] if t["role"] == "assistant") == "".join(want)
