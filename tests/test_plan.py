import json
import re
import sys
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from foldwise import PlanParameters, build_move_plan, write_plan
from foldwise.plans import move_plan as P
from foldwise.sources import store
from foldwise.streaming import incremental


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def conversation(i, topic, **more):
    messages = [{"author": {"role": "user"}, "content": {"parts": [f"{topic} question {i}"]}}]
    return {"id": f"chat-{i}", "title": f"{topic} Chat", "create_time": 1_700_000_000 + i, "messages": messages, **more}


class Topics:
    """Vectors by the first word, close together within a topic."""

    calls: list = []

    def __call__(self, texts):
        out = np.zeros((len(texts), 8))
        for row, text in enumerate(texts):
            if text[0] == "E":  # opposite to all others
                out[row, :4] = -1.0
            else:
                out[row, "ABCD".index(text[0])] = 1.0
            out[row, 7] = (len(text) % 5) * 0.02
        return out


def titles(request):
    return json.dumps(
        [{"cluster_id": c["cluster_id"], "label": c["titles"][0], "project_folder_slug": "slug", "project_title": "T", "confidence": 0.9}
         for c in json.loads(request)]
    )


def export(tmp_path, items, name="export.json"):
    path = tmp_path / name
    path.write_text(json.dumps(items))
    return str(path)


def document(plan, tmp_path, name="plan"):
    write_plan(plan, str(tmp_path / name), "2024-01-01T00:00:00+00:00")
    parts = sorted((tmp_path / name).glob("part-*"))
    return json.loads("".join(p.read_text() for p in parts))


def test_plan_end_to_end(spark, tmp_path):
    items = [conversation(i, "Alpha") for i in range(3)] + [conversation(3, "Gamma", metadata={"project_id": "x"})]
    items += [conversation(i, "Beta \"q\"") for i in range(4, 7)] + [conversation(7, "Eta")]
    items += [conversation(0, "Alpha", update_time=5)]
    kept = str(tmp_path / "store")
    plan = build_move_plan(spark, export(tmp_path, items), make_embedder=Topics, make_labeller=lambda: titles, store_path=kept)
    got = document(plan, tmp_path)
    assert [[c["id"] for c in cluster["chats"]] for cluster in got["clusters"]] == [
        ["chat-0", "chat-1", "chat-2"], ["chat-4", "chat-5", "chat-6"],
    ]
    assert [m["chats"] for m in got["proposed_moves"]] == [["chat-0", "chat-1", "chat-2"], ["chat-4", "chat-5", "chat-6"]]
    assert got["clusters"][1]["label"] == 'Beta "q" Chat' and got["clusters"][1]["cluster_id"] == 1
    assert got["skipped"] == {"clusters_low_confidence": [], "singletons": ["chat-7"], "already_in_project": ["chat-3"]}
    assert got["parameters"]["time_decay_days"] == 30.0 and got["plan_generated_at"].startswith("2024")
    first = got["clusters"][0]
    assert first["confidence_combined"] == pytest.approx(0.65 * 0.9 + 0.35 * first["confidence_cohesion"], abs=1e-4)
    assert first["chats"][0] == {"id": "chat-0", "title": "Alpha Chat", "create_time": 1.7e9, "update_time": 5.0}
    assert store.read_store(spark, kept).count() == 7

    class Never:
        def __call__(self, texts):
            raise AssertionError("everything is stored")

    again = build_move_plan(spark, export(tmp_path, items), PlanParameters(limit=3), make_embedder=Never, store_path=kept)
    assert [r.id for r in again.members.orderBy("pos").collect()] == ["chat-0", "chat-1", "chat-2"]
    assert again.clusters.first().confidence_model == 0.5


def test_nothing_left_to_file(spark, tmp_path):
    items = [conversation(1, "A", metadata={"project_id": "p"}), conversation(2, "B", conversation={"workspace": "abc"})]
    got = document(build_move_plan(spark, export(tmp_path, items), make_embedder=lambda: None), tmp_path)
    assert got["clusters"] == got["proposed_moves"] == []
    assert got["skipped"] == {"clusters_low_confidence": [], "singletons": [], "already_in_project": ["chat-1", "chat-2"]}


def test_broken_store_is_given_up(spark, tmp_path, capsys):
    bad = tmp_path / "file"
    bad.write_text("no store")
    items = [conversation(i, "Alpha") for i in range(3)]
    plan = build_move_plan(spark, export(tmp_path, items), make_embedder=Topics, store_path=str(bad))
    assert plan.members.count() + plan.singletons.count() == 3
    assert "treated as empty" in capsys.readouterr().out


def test_each_group_is_stored_before_the_next_is_asked_for(spark, tmp_path):
    items = [conversation(i, "Alpha") for i in range(4)]
    kept = str(tmp_path / "store")

    class Failing(Topics):
        def __call__(self, texts):
            if any("2" in text for text in texts):
                raise ConnectionError("gone")
            return super().__call__(texts)

    p = PlanParameters(embedding_batch_words=1)
    with pytest.raises(Exception, match="gone"):
        build_move_plan(spark, export(tmp_path, items), p, make_embedder=Failing, store_path=kept)
    assert sorted(r.id for r in store.read_store(spark, kept).collect()) == ["chat-0", "chat-1"]


def test_chat_without_vector_is_a_singleton(spark):
    chats, assigned, vectors, filed = many(spark, 3)
    plan = P.assemble(chats, assigned, vectors.where("pos <> 4"), filed, PlanParameters())
    assert [r.id for r in plan.singletons.collect()] == ["c4"] and plan.members.count() == 5


def many(spark, n):
    chats = spark.createDataFrame(
        [(i, f"c{i}", f"Topic {i // 2}", 1.0, None) for i in range(2 * n)], "pos bigint, id string, title string, create_time double, update_time double"
    )
    assigned = chats.selectExpr("pos", "pos div 2 as cluster_id")
    vectors = chats.selectExpr("pos", "array(1.0D, pos div 2) as vector")
    return chats, assigned, vectors, chats.limit(0)


def test_summary_of_many_moves(spark):
    plan = P.assemble(*many(spark, 51), PlanParameters(confidence_threshold=0.6))
    lines = [r.text for r in P.summary(plan).orderBy("line").collect()]
    assert lines[0].startswith("Clusters: 51 | Proposed moves: 51 |") and lines[-1] == "  ... and 1 more" and len(lines) == 52


def test_low_confidence(spark, tmp_path):
    plan = P.assemble(*many(spark, 2), PlanParameters(confidence_threshold=0.9))
    got = document(plan, tmp_path)
    assert got["proposed_moves"] == [] and got["skipped"]["clusters_low_confidence"] == ["0", "1"]


def test_large_document_keeps_its_order_over_parts(spark, tmp_path):
    got = document(P.assemble(*many(spark, 12), PlanParameters()), tmp_path)
    assert [c["cluster_id"] for c in got["clusters"]] == list(range(12))


def test_keys_and_absolute_path_of_the_document(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    path = export(tmp_path, [conversation(i, "Alpha") for i in range(3)])
    relative = str(path)[len(str(tmp_path)) + 1 :]
    plan = build_move_plan(spark, relative, make_embedder=Topics)
    got = document(plan, tmp_path)
    assert got["source"] == {"type": "conversations_json", "path": str(tmp_path / relative)} and list(got["collections"]) == ["qdrant_collection"]


def test_a_stopped_job_asks_for_nothing_twice(spark, tmp_path):
    """The model fails at one text; what was requested in groups before is stored, and only the rest is asked for again."""
    asked, kept = tmp_path / "asked", str(tmp_path / "kept")
    asked.mkdir()
    fail = asked / "fail"
    fail.touch()

    class Failing(Topics):
        def __call__(self, texts):
            for text in texts:
                if fail.exists() and text.split()[-1] == "9":
                    raise ValueError("model is gone")
                with (asked / f"text-{text.split()[-1]}").open("a") as f:
                    f.write("x")
            return super().__call__(texts)

    items = [conversation(i, "Alpha") for i in range(12)]
    p = PlanParameters(embedding_batch_words=4, embedding_batch_parallelism=2)
    with pytest.raises(Exception):
        build_move_plan(spark, export(tmp_path, items), p, make_embedder=Failing, store_path=kept)
    stored = {r.id for r in store.read_store(spark, kept).collect()}
    assert 0 < len(stored) < 12
    fail.unlink()
    plan = build_move_plan(spark, export(tmp_path, items), p, make_embedder=Failing, store_path=kept)
    assert plan.members.count() + plan.singletons.count() == 12
    assert all((asked / f"text-{k.rsplit('-', 1)[1]}").read_text() == "x" for k in stored)


def test_parameters():
    p = PlanParameters(time_weight=3, min_samples=0, min_cluster_size=1, embedding_batch_words=-1, conversation_word_limit="oops")
    assert (p.time_weight, p.min_samples, p.min_cluster_size, p.embedding_batch_words, p.conversation_word_limit) == (1.0, 1, 2, 1, 250)
    assert PlanParameters(conversation_word_limit=-7).conversation_word_limit == 0


def test_stream_fills_the_store_once(spark, tmp_path):
    arrivals, kept, progress = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "progress")
    arrivals.mkdir()
    asked = tmp_path / "asked"
    asked.mkdir()

    class Counting(Topics):
        def __call__(self, texts):
            for text in texts:
                name = text.split()[-1]
                assert not (asked / name).exists()
                (asked / name).write_text("")
            return super().__call__(texts)

    for name, numbers in (("1.ndjson", (0, 1)), ("2.ndjson", (1, 2))):
        (arrivals / name).write_text("\n".join(json.dumps(conversation(i, "Alpha")) for i in numbers))
        incremental.fill_from_stream(spark, str(arrivals), kept, progress, Counting)
    assert sorted(r.id for r in store.read_store(spark, kept).collect()) == ["chat-0", "chat-1", "chat-2"]


def numbered(spark, n):
    return spark.createDataFrame([(k, f"c{k}", f"t{k}", f"A {k}") for k in range(n)], "pos bigint, id string, title string, text string").repartition(3)


def test_groups_take_no_job_each(spark, tmp_path):
    """Forty groups in few jobs; when a group is requested, all before it are in the store."""
    kept, context = str(tmp_path / "kept"), spark.sparkContext
    pairs = PlanParameters(embedding_batch_words=4, embedding_batch_parallelism=2)  # two texts of two words in a batch, four in a group

    class Ordered(Topics):
        def __call__(self, texts):
            files = (tmp_path / "kept").rglob("group-*.parquet")
            assert {int(f.stem[6:]) for f in files} >= set(range(int(texts[0].split()[1]) // 4))
            return super().__call__(texts)

    context.setJobGroup("few-jobs", "")
    try:
        made = P.embed_in_groups(numbered(spark, 160), pairs, Ordered, kept, run_bytes=400)
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(name, None)
    assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) < 40
    assert {(r.id, r.group_id) for r in made.collect()} == {(f"c{k}", k // 4) for k in range(160)}
    stored = {r.id: (r.title, r.vector) for r in store.read_store(spark, kept).collect()}
    assert {k: v[0] for k, v in stored.items()} == {f"c{k}": f"t{k}" for k in range(160)}
    assert {r.id: r.vector for r in made.collect()} == {k: v[1] for k, v in stored.items()}


def test_a_repeated_attempt_asks_for_nothing_twice(spark, tmp_path):
    from pyspark.sql import functions as F

    log = store.group_log(spark, str(tmp_path / "kept"))
    rows = numbered(spark, 24).withColumn("batch_id", F.floor(F.col("pos") / 2)).withColumn("group_id", F.floor(F.col("pos") / 6))

    class Counting(Topics):
        def __call__(self, texts):
            for text in texts:
                assert text != "A 15" or (tmp_path / "mended").exists()
                with (tmp_path / f"asked-{text[2:]}").open("a") as f:
                    f.write("x")
            return super().__call__(texts)

    run = lambda: P.embedding.embed_group_after_group(rows, Counting, 3, log, delay=0).collect()
    with pytest.raises(Exception, match="AssertionError"):
        run()
    (tmp_path / "mended").touch()
    assert {(r.id, r.group_id, r.problem) for r in run()} == {(f"c{k}", k // 6, None) for k in range(24)}
    assert all((tmp_path / f"asked-{k}").read_text() == "x" for k in [*range(12), *range(18, 24)])


def test_a_store_that_tasks_cannot_write_is_given_up(spark, tmp_path, capsys):
    kept = str(tmp_path / "kept")
    store.upsert(spark, kept, spark.createDataFrame([("old", [1.0, 2.0])], "id string, vector array<float>"))
    texts, p = numbered(spark, 6), PlanParameters(embedding_batch_words=4)
    made = P.embed_in_groups(texts, p, Topics, kept, may_fail=True, run_bytes=8)
    assert made.count() == 6 and capsys.readouterr().out.count("different dimensions: [2, 8]") == 1
    with pytest.raises(Exception, match="different dimensions"):
        P.embed_in_groups(texts, p, Topics, kept)
    assert [r.id for r in store.read_store(spark, kept).collect()] == ["old"]


def test_groups_where_tasks_know_no_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "placed", lambda *_: None)
    kept, p = str(tmp_path / "kept"), PlanParameters(embedding_batch_words=4, embedding_batch_parallelism=2)
    made = P.embed_in_groups(numbered(spark, 6), p, Topics, kept)
    assert {(r.id, r.group_id) for r in made.collect()} == {(f"c{k}", k // 4) for k in range(6)}
    assert {r.id: r.title for r in store.read_store(spark, kept).collect()} == {f"c{k}": f"t{k}" for k in range(6)}
    assert len(list((tmp_path / "kept").glob("step=*"))) == 2


def test_batches_of_a_group_wait_together(spark, tmp_path):
    """A request is answered when all three of its group are there."""
    from pyspark.sql import functions as F

    rows = numbered(spark, 12).withColumn("batch_id", F.floor(F.col("pos") / 2)).withColumn("group_id", F.floor(F.col("pos") / 6))

    class Together(Topics):
        def __call__(self, texts):
            first = min(int(text[2:]) for text in texts)  # rows of a batch come in any order
            (tmp_path / f"asked-{first}").write_text("")
            until = time.time() + 30
            while not all((tmp_path / f"asked-{first // 6 * 6 + k}").exists() for k in (0, 2, 4)):
                assert time.time() < until
                time.sleep(0.01)
            return super().__call__(texts)

    made = P.embedding.embed_group_after_group(rows, Together, 3, None, attempts=1)
    assert {(r.id, r.group_id) for r in made.collect()} == {(f"c{k}", k // 6) for k in range(12)}


def test_a_model_in_the_task_takes_no_threads(spark, tmp_path):
    from pyspark.sql import functions as F

    class Here(Topics):
        waits = False

        def __call__(self, texts):
            assert threading.current_thread() is threading.main_thread()
            return super().__call__(texts)

    batched = numbered(spark, 24).withColumn("batch_id", F.floor(F.col("pos") / 2)).withColumn("group_id", F.floor(F.col("pos") / 6))
    batched.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    here, threads = (P.embedding.embed_group_after_group(rows, m, 3, None, attempts=1) for m in (Here, Topics))
    assert sorted(map(str, here.collect())) == sorted(map(str, threads.collect()))
    assert "Exchange" not in here._jdf.queryExecution().executedPlan().toString()  # files are read by the task itself


def test_hashed_words_end_at_every_blank():
    blanks = [chr(c) for c in range(0x110000) if re.match(r"\s", chr(c))]
    assert len(blanks) > 20
    texts = ["", " ", *blanks, *(f"{b}Ärger{b}{b}in İstanbul{b}ΑΣ 12\u200b{b}" for b in blanks)]
    found = P.embedding.HashingEmbedder(16)(texts)
    for text, row in zip(texts, found):
        words = [zlib.crc32(w.encode()) % 16 for w in re.findall(r"\S+", text.lower())]
        assert row.tolist() == [words.count(k) for k in range(16)]
