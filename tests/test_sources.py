import json

import pytest
from pyspark.sql import functions as F

from foldwise.operators import normalize as N
from foldwise.operators import split
from foldwise.sources import export, strict


def said(text):
    return [{"author": {"role": "user"}, "content": {"parts": [text]}}]


def write(tmp_path, value, name="export.json"):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def chats(spark, path, layout=export.AUTO):
    return N.normalize_chats(export.read_export(spark, path, layout))


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


def test_items_themselves_and_what_they_wrap(spark, tmp_path):
    lone = {"id": "k1", "title": "Alpha", "create_time": 86_400, "update_time": 90_000, "messages": said("a b"), "metadata": {"folder": "f9"}}
    held = {"id": "k2", "title": "Beta", "created_at": "1970-01-03T00:00:00Z", "messages": said("c"), "workspace": "w2"}
    spelled = json.dumps({"id": "never", "title": "a string is no object"})
    data = [7, {"first": spelled, "second": held, "third": [held]}, spelled, None, [lone], {"deep": {"deeper": held}}, lone]
    got = N.with_excerpt(chats(spark, write(tmp_path, data))).orderBy("pos").collect()
    assert [(r.id, r.title, r.project_id, r.prompt_excerpt) for r in got] == [("k2", "Beta", "w2", "User: c"), ("k1", "Alpha", "f9", "User: a b")]
    assert [r.create_time for r in got] == [172_800.0, 86_400.0]


def test_lists_of_a_container_then_the_container(spark, tmp_path):
    item = lambda i: {"id": i, "title": i.upper()}
    data = {"id": "root", "title": "R", "data": [item("d"), {"title": "no id"}], "items": [{"w": item("not searched")}, {"conversation": item("i")}], "conversations": [item("c")]}
    assert ids(chats(spark, write(tmp_path, data))) == ["c", "i", "d", "root"]
    data |= {"items": json.dumps([item("spelled")]), "data": [json.dumps(item("spelled"))]}
    assert ids(chats(spark, write(tmp_path, data))) == ["c", "root"]


def test_id_and_title_choices(spark, tmp_path):
    data = [
        {"id": "", "title": "Blank"},
        {"id": None, "uuid": "u", "title": ""},
        {"id": 0, "conversation_id": 7, "title": 5, "create_time": 0, "created_at": "1970-01-01T00:01:00Z"},
        {"id": True, "title": None, "conversation": {"title": "inner", "update_time": 9}},
    ]
    got = chats(spark, write(tmp_path, data)).orderBy("pos").collect()
    assert [(r.id, r.title, r.create_time, r.update_time) for r in got] == [
        ("u", "(untitled)", None, None), ("7", "5", 60.0, None), ("True", "inner", None, 9.0),
    ]


def test_filing_marks(spark):
    cases = [
        ({"conversation": {"workspace_id": "c"}, "metadata": {"project": 31}}, "31"), ({"folder": "here", "metadata": {"folder": "there"}}, "here"),
        ({"conversation": {"folder_id": 8.5}}, "8.5"), ({"metadata": {}}, None),
        ({"project_id": "", "folder": 0, "metadata": {"workspace": []}, "Project_ID": "x"}, None), ({"project": True}, "True"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, raw string")
    got = df.select("i", F.expr(N.filed_under("from_json(raw, 'map<string,variant>')")).alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == [want for _, want in cases]


def test_shape(spark):
    cases = [({"title": None, "id": None}, True), ({"conversation": {"title": "t"}, "id": "x"}, True), ({"title": "t"}, False), ([1], False)]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, raw string")
    got = df.select("i", F.expr(N.looks_like_conversation("raw")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [want for _, want in cases]


def test_lines_and_dedup(spark, tmp_path):
    versions = [("p", "draft", 40), ("q", "only timed", 3), ("p", "newest", 41), ("p", "as new but later in the file", 41), ("q", "untimed", None)]
    rows = [{"id": i, "title": t, **({"update_time": at} if at else {})} for i, t, at in versions]
    path = write(tmp_path, "\n\n".join(json.dumps(r) for r in rows) + "\n")
    for layout in (export.AUTO, export.LINES):
        got = N.dedup_latest(chats(spark, path, layout)).orderBy("id").collect()
        assert [(r.id, r.title) for r in got] == [("p", "newest"), ("q", "only timed")]


def test_one_line_is_a_document(spark, tmp_path):
    path = write(tmp_path, json.dumps({"conversations": [{"id": "a", "title": "t"}]}) + "\n")
    assert ids(chats(spark, path)) == ["a"]
    assert ids(chats(spark, write(tmp_path, json.dumps([{"id": "b", "title": "t"}], indent=2), "p.json"))) == ["b"]


def test_mixed_folder(spark, tmp_path):
    write(tmp_path, [{"id": "a", "title": "t"}], "1.json")
    write(tmp_path, '{"id":"b","title":"t"}\n{"id":"c","title":"t"}\n', "2.json")
    assert ids(chats(spark, str(tmp_path))) == ["a", "b", "c"]


def test_unreadable(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        export.read_export(spark, str(tmp_path / "nothing.json"))
    with pytest.raises(Exception, match="not valid JSON"):
        chats(spark, write(tmp_path, "[1, 2")).collect()
    with pytest.raises(Exception, match="not valid JSON"):
        chats(spark, write(tmp_path, '{"id":1,"title":"t"}\n{"id":'), export.LINES).collect()


def test_strict(spark, tmp_path):
    assert strict.read_strict(spark, write(tmp_path, [{"a": 1}, {}])).count() == 2
    assert strict.read_strict(spark, write(tmp_path, {"conversations": [{"a": 1}]})).count() == 1
    assert strict.read_strict(spark, write(tmp_path, '{"a":1}\n\n{"b":2}\n')).count() == 2
    for value, message in (([{}, 3], "item 1 "), ({"items": []}, 'under the key "conversations"'), ("7", "neither a list"),
                           ([json.dumps({"a": 1})], "item 0 "), ('[{"id":"a"}] trailing', "not exactly one JSON value"), ({"conversations": "[{}]"}, "under the key"),
                           ('{"a":1}\n\n[2]\n', "line 3 .*not a JSON object"), ('{"a":1}\nnope\n', "line 2 .*invalid JSON")):
        with pytest.raises(Exception, match=message):
            strict.read_strict(spark, write(tmp_path, value)).collect()


def test_split_files(spark, tmp_path):
    data = [{"id": "a b", "title": "é"}, {"title": "T!"}, {"x": 1}]
    named = split.named_conversations(strict.read_strict(spark, write(tmp_path, data)))
    paths = [r.path for r in split.write_conversation_files(named, str(tmp_path / "out")).collect()]
    assert sorted(p.rsplit("/", 1)[1] for p in paths) == ["0000-a-b.json", "0001-T.json", "0002-conversation-0002.json"]
    assert (tmp_path / "out" / "0000-a-b.json").read_text() == json.dumps(data[0], ensure_ascii=False, indent=2) + "\n"
    twice = named.select(F.lit("same.json").alias("file_name"), "raw")
    with pytest.raises(ValueError, match="duplicate"):
        split.write_conversation_files(twice, str(tmp_path / "out"))
