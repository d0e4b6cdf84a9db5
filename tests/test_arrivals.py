"""Documents read in splits, versions that arrive apart, and files that appear whole."""

import json
import random
from datetime import datetime

import pytest
from oracle import differences
from pyspark.sql import functions as F

from foldwise.operators import normalize as N
from foldwise.operators import split
from foldwise.plans.oracles import ORACLES
from foldwise.plans.queries import QUERIES
from foldwise.session import scratch_path
from foldwise.sources import export, split_list
from foldwise.streaming import latest

DATA = "/root/testdata/sf0.01"


@pytest.fixture
def tiny_splits(spark, request):
    """Splits of a few bytes, so that borders fall into strings, escapes and brackets."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    spark.conf.set(names[2], "1")
    yield
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def items(seed):
    rng = random.Random(seed)
    odd = ['a "quoted" }{ [x] \\\\', "}}}}", "[[[", '\\"', "\\\\", "é 漢字 🙂 }", "line\nbreak\t}", "", "{" * 30, ",", "]"]
    value = lambda: rng.choice([rng.choice(odd), 1.5, None, True, [rng.choice(odd), {"k": rng.choice(odd)}], {"deep": {rng.choice(odd) or "x": [1, {}]}}])
    out = []
    for k in range(14):
        chat = {"id": f"c{k}", "title": rng.choice(odd), "x": value(), "update_time": k, "messages": [{"content": {"parts": [rng.choice(odd)]}}]}
        out.append(rng.choice([chat, chat, {"wrap": chat, "other": value()}, rng.choice(odd), 7, [chat], None, {}]))
    return out


@pytest.mark.parametrize("tiny_splits", ["40", "1000000"], indirect=True)
def test_split_documents_equal_whole_ones(spark, tmp_path, tiny_splits):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps(items(k), ensure_ascii=k == 1, indent=None if k else 1))
    for k, value in enumerate(("[]", " [ 1, \"}\" ] ", "[{}]\n", '[{"id": 1, "title": "t"}, 2]', '["{", {"id": 2, "title": "]"}]')):
        (tmp_path / f"small{k}.json").write_text(value)
    key = lambda r: (r.file, r.n)

    def rows(df):
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("pos.file").orderBy("pos"))
        return sorted(((r.file, r.n, r.raw) for r in df.select(F.col("pos.file").alias("file"), place.alias("n"), "raw").collect()))

    got = rows(split_list.read_list(spark, str(tmp_path)))
    assert got == rows(export.read_export(spark, str(tmp_path), export.DOCUMENT)) and len(got) > 20


@pytest.mark.parametrize("tiny_splits", ["9"], indirect=True)
@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}]]', '[{"a": 1},]', '[{"a": 1}{"b": 2}]', '[{"a": 1}], [{"b": 2}]', '[{"a": "x}]', '{"a": 1}', '[{"a": 1}] x'])
def test_broken_documents_raise(spark, tmp_path, tiny_splits, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception, match="not a closed JSON list|not valid JSON"):
        split_list.read_list(spark, str(tmp_path)).collect()


def test_missing_export(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        split_list.read_list(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("name", ["scan_export_split", "incremental_latest", "split_file_contents"])
def test_queries_match_sql(spark, name):
    assert differences(spark, DATA, name, QUERIES, ORACLES) == ""


def test_arrivals_in_any_order_give_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, rng.choice(("hot", "hot", "a", "b", None)), f"t{k}", rng.choice((None, 0.0, 1.0, 2.0))) for k in range(80)]
    schema = "pos bigint, id string, title string, update_time double"
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    for step in range(3):
        arrived = rng.sample(rows, 40) + ([rows[0]] * 3 if step else [])
        df = spark.createDataFrame(arrived if step < 2 else rows, schema)
        df.write.parquet(f"{folder}/{step}")
        latest.keep_latest(latest.arriving(spark, folder, df.schema), target, str(tmp_path / "progress"))
    key = lambda r: (r.id or "", r.pos, r.title, r.update_time)
    want = N.dedup_latest(spark.createDataFrame(rows, schema))
    assert sorted(map(key, latest.read_latest(spark, target).collect()), key=str) == sorted(map(key, want.collect()), key=str)
    latest.keep_latest(latest.arriving(spark, folder, want.select("pos", "id", "title", "update_time").schema), target, str(tmp_path / "progress"))


def test_a_failing_job_leaves_no_file(spark, tmp_path):
    rows = [(k, f"{k:04d}-x.json", json.dumps({"id": k}) if k != 37 else "{broken") for k in range(60)]
    named = spark.createDataFrame(rows, "row_index bigint, file_name string, raw string").repartition(4)
    with pytest.raises(Exception):
        split.write_conversation_files(named, str(tmp_path / "out"))
    assert [p for p in (tmp_path / "out").glob("*.json")] == []
    good = named.where("row_index <> 37")
    paths = {r.path for r in split.write_conversation_files(good, str(tmp_path / "out")).collect()}
    assert paths == {str(p) for p in (tmp_path / "out").glob("*.json")} and len(paths) == 59
    assert all(json.loads(p.read_text())["id"] == int(p.name[:4]) for p in (tmp_path / "out").glob("*.json"))


def test_chats_without_times_are_written_too(spark, tmp_path):
    turns = [(c, t, ("user", "assistant")[t % 2], f"word{c} more {t}") for c in range(24) for t in range(3)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    times = [(c, datetime(2024, 1, 1 + c) if c % 2 else None) for c in range(12)]
    spark.createDataFrame(times, "event_id bigint, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.id: r for r in QUERIES["split_file_contents"](spark, str(tmp_path)).collect()}
    assert sorted(found, key=int) == [str(c) for c in range(24)] and all(r.title.startswith(f"word{c} ") for c, r in found.items())
    assert {int(c) for c, r in found.items() if r.create_time is not None} == {1, 3, 5, 7, 9, 11}


def test_files_go_where_spark_reads_on_a_cluster_too(spark, tmp_path, monkeypatch):
    """Below the shared folder a path needs no scheme, whatever the master; blanks stand in URIs as they are."""
    named = spark.createDataFrame([(k, f"{k:04d}-x.json", json.dumps({"id": k})) for k in range(9)], "row_index bigint, file_name string, raw string")
    shared = "/" + scratch_path(spark, "split").removeprefix("file:").lstrip("/")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for target in (shared, f"file:{tmp_path}/a b", f"file://{tmp_path}/c d/"):
        paths = {r.path for r in split.write_conversation_files(named, target).collect()}
        assert paths == {f"{target.rstrip('/')}/{k:04d}-x.json" for k in range(9)}
        assert spark.read.text(target, wholetext=True).count() == 9
    with pytest.raises(ValueError, match="name the file system"):
        split.write_conversation_files(named, str(tmp_path / "own"))
