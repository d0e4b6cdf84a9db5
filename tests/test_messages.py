import json

import pytest
from pyspark.sql import functions as F

from foldwise.functions import epoch, jsonval, text
from foldwise.operators import messages as M
from foldwise.operators import normalize as N


def excerpt(spark, conversation, limit=250):
    df = spark.createDataFrame([(0, json.dumps(conversation))], "pos int, raw string")
    return N.with_excerpt(df, M.clean_word_limit(limit)).first().prompt_excerpt


def variants(spark, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i int, j string").withColumn("v", F.parse_json("j")).orderBy("i")


def said(role, content, **more):
    return {"author": {"role": role}, "content": content, **more}


def test_to_epoch(spark):
    values = [
        None, 42, 1700000000000, "2024-01-01T12:34:56Z", "not-a-timestamp", {"a": 1}, True, "1700000000000",
        "2024-01-01", "20240101", "2024-01-01 00:00:01.5+01:00", "2024-W01-1", "1_000", " 7.5 ", "2024-13-01",
        "2024-02-30", "2024", [1], "", "1970-01-01T00:00:50Z", "1e3", "1d",
    ]
    want = [
        None, 42.0, 1.7e9, 1704112496.0, None, None, 1.0, 1.7e12,
        1704067200.0, 1704067200.0, 1704067201.5 - 3600, 1704067200.0, 1000.0, 7.5, None,
        None, 2024.0, None, None, 50.0, 1000.0, None,
    ]
    got = [r.e for r in variants(spark, values).select(F.expr(epoch.to_epoch("v")).alias("e")).collect()]
    assert got == want


def test_text_fragments(spark):
    values = [
        None, 0.5, ["\tred ", {"text": " blue\n"}], {"data": {"text": "after", "code": "x = y"}},
        {"content_type": "web_page", "text": "hidden"}, {"type": "text", "parts": ["a", ["b", {"value": "c"}]]},
        {"text": 5, "value": "hidden by a truthy number"}, {"text": "", "value": "v"}, {"parts": "no list", "text": "t"},
        "  padded ", {"content_type": {"k": "a search"}, "text": "hidden"},
    ]
    want = [[], [], ["red", "blue"], ["x = y", "after"], [], ["a", "b", "c"], [], ["v"], ["t"], ["padded"], []]
    got = [r.t for r in variants(spark, values).select(F.expr(M.text_fragments("v")).alias("t")).collect()]
    assert got == want


def test_content_of_any_depth(spark):
    deep = ["x[{"]
    for level in range(60):
        deep = [f"{level}", {"parts": [deep], "text": f"after {level}"}]
    rounds = [str(n) for n in range(59, -1, -1)] + ["x[{"] + [f"after {n}" for n in range(60)]
    got = variants(spark, [deep, []]).select(F.expr(M.text_fragments("v")).alias("t")).collect()
    assert [r.t for r in got] == [rounds, []]


def test_message_block_filters(spark):
    base = said("user", {"parts": [" green "]}, id="n")
    marks = [
        ({}, True), ({"metadata": {"is_system_message": True}}, False), ({"metadata": {"is_system_message": "yes"}}, True),
        ({"metadata": {"message_source": "Web crawl"}}, False), ({"message_type": "thinking-aloud"}, False), ({"message_type": "plain"}, True),
        ({"metadata": {"description": ["search"]}}, True), ({"author": "user"}, False), ({"author": {"role": "tool"}}, False), ({"content": "\t"}, False),
    ]
    got = [r.b for r in variants(spark, [{**base, **mark} for mark, _ in marks]).select(F.expr(M.message_block("v")).alias("b")).collect()]
    assert got == ["User: green" if shown else None for _, shown in marks]


def test_excerpt_takes_turns_by_time_until_the_limit(spark):
    turns = [(9, "assistant", "p q r s"), (4, "user", "k l m"), (7, "assistant", "n o")]
    listed = [said(role, {"parts": [words]}, create_time=at) for at, role, words in turns[:1]]
    nodes = {f"k{at}": {"message": said(role, words, create_time=at)} for at, role, words in turns[1:]}
    conversation = {"messages": listed, "mapping": nodes}
    whole = ["User: k l m", "Assistant: n o", "Assistant: p q r s"]
    assert excerpt(spark, conversation, 0) == "\n\n".join(whole)
    # a role label counts as a word of its block
    for limit, last in ((7, []), (9, ["Assistant: p"]), (10, ["Assistant: p q"]), (12, whole[2:])):
        assert excerpt(spark, conversation, limit) == "\n\n".join(whole[:2] + last)


def test_limits_that_mean_none_or_the_default(spark):
    conversation = {"messages": [said("user", " ".join(f"n{k}" for k in range(400)))]}
    assert len(excerpt(spark, conversation, 0).split()) == len(excerpt(spark, conversation, -1).split()) == 401
    assert len(excerpt(spark, conversation, object()).split()) == M.DEFAULT_WORD_LIMIT


def test_roles_and_marks_that_hide_a_message(spark):
    hidden = [
        said("system", "s1"), said("tool", "t1"), said("assistant", "w1", metadata={"source": "my search index"}),
        said("user", "f1", metadata={"is_thought": True}), said("user", [{"type": "thinking", "text": "h1"}]), said("user", {"text": ""}),
    ]
    shown = [said("user", {"value": "v1"}), said("assistant", [{"type": "thinking", "text": "h2"}, {"text": "m1"}])]
    mixed = [m for pair in zip(hidden[:2], shown) for m in pair] + hidden[2:]
    assert excerpt(spark, {"messages": mixed}) == "User: v1\n\nAssistant: m1"


def test_first_copy_of_an_id_counts_even_when_hidden(spark):
    copies = [("x", "user", "kept"), ("x", "user", "later copy"), ("y", "tool", "hidden first"), ("y", "user", "not shown"), ("z", "user", "end")]
    conversation = {"messages": [said(role, words, id=i, create_time=k) for k, (i, role, words) in enumerate(copies)]}
    assert excerpt(spark, conversation) == "User: kept\n\nUser: end"


def test_excerpt_of_nothing(spark):
    assert excerpt(spark, {"mapping": {"node": {"message": None}}, "messages": []}) is None
    assert excerpt(spark, {}) is None


def test_mapping_keeps_node_order_and_untimed_messages_come_last(spark):
    node = lambda text, **k: {"message": said("user", text, **k)}
    conversation = {"mapping": {"z": node("one"), "a": node("two"), "m": node("zero", create_time=5), "x": "no node"}}
    assert excerpt(spark, conversation) == "User: zero\n\nUser: one\n\nUser: two"


def test_truncated_block_loses_inner_space_whole_block_keeps_it(spark):
    conversation = {"messages": [said("user", "a  b\nc"), said("user", "d  e\nf")]}
    assert excerpt(spark, conversation, 7) == "User: a  b\nc\n\nUser: d e"


@pytest.mark.parametrize("limit", [0, 3, 7, 20])
def test_turn_table_matches_row_form(spark, limit):
    import random

    rng = random.Random(limit)
    rows, conversations = [], []
    for chat in range(6):
        messages = []
        for o in range(rng.randint(1, 30)):
            ts = rng.choice([None, float(rng.randint(0, 5))])
            body = " ".join(rng.choice(["a", "bb", "c\nd"]) for _ in range(rng.randint(0, 6)))
            id_ = rng.choice([None, f"m{rng.randint(0, 9)}"])
            role = rng.choice(["user", "assistant", "system"])
            messages.append(said(role, body, id=id_, create_time=ts))
            rows.append((chat, id_, o, ts, role, body))
        conversations.append((chat, json.dumps({"messages": messages})))
    turns = spark.createDataFrame(rows, "chat_id int, msg_id string, ord int, ts double, role string, body string")
    block = F.expr(M.labelled_text("role", f"array({text.strip('body')})"))
    got = M.excerpts_of_turns(M.first_message_copies(turns).withColumn("block", block), limit)
    got = {r.chat_id: r.prompt_excerpt for r in got.collect()}
    df = spark.createDataFrame(conversations, "pos int, raw string")
    want = {r.pos: r.prompt_excerpt for r in N.with_excerpt(df, limit).collect() if r.prompt_excerpt}
    assert got == want


def test_truthiness(spark):
    values = [None, 0, 0.0, "", "0", [], {}, False, True, 1, -0.5, [0], {"a": None}]
    got = [r.t for r in variants(spark, values).select(F.expr(jsonval.truthy("v")).alias("t")).collect()]
    assert got == [bool(v) for v in values]
