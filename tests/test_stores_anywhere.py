"""Chats, leaderboards, runs and stores on any file system; parts of a run by name."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import generation
from marlstone.plans import components, service
from marlstone.plans.components import Choice
from marlstone.sources import files, records
from marlstone.sources.chatlog import ChatLog
from marlstone.sources.vectors import InsertStore, VectorStore

TURNS = "conv_id string, turn long, role string, text string"


@pytest.fixture()
def log(spark, tmp_path):
    return ChatLog(spark, f"file://{tmp_path}/chats")


def held(log, chat=None):
    return sorted((tuple(r) for r in log.turns(chat).collect()), key=str)


def test_chat_log(spark, log):
    assert held(log) == [] and log.summaries().count() == 0 and log.compact() == 0
    first = [("a", 0, "user", "What of  revenue?"), ("a", 1, "assistant", "It rose."), ("b", 0, "user", "Risks"), ("c", None, None, None)]
    assert log.save(spark.createDataFrame(first, TURNS)) == 0
    assert held(log) == sorted(first, key=str)
    log.save(spark.createDataFrame([("a", 0, "user", "Anew")], TURNS), spark.createDataFrame([("a", "By hand"), ("e", "Empty")], "conv_id string, title string"))
    assert held(log, "a") == [("a", 0, "user", "Anew")]
    got = {r.conv_id: (r.title, r.n_messages) for r in log.summaries().collect()}
    assert got == {"a": ("By hand", 1), "b": ("Risks", 1), "c": ("New chat", 1), "e": ("Empty", 0)}
    assert [r.conv_id for r in log.search(" RISK ").collect()] == ["b"] and log.search(" ").count() == 4
    gone = spark.createDataFrame([("b",), ("zz",), ("b",)], "conv_id string")
    assert log.delete(gone) == 1 and log.delete(gone) == 0
    was, heads = held(log), sorted(map(tuple, log.summaries().collect()))
    assert log.compact() == 3 and len(log.sink.blocks()) == 1
    assert held(log) == was and sorted(map(tuple, log.summaries().collect())) == heads
    assert "b" not in {r.conv_id for r in log.summaries().collect()}


def test_chat_log_refuses_bad_ids(spark, log):
    for bad in ("../x", "", None, "a" * 65, "a\n"):
        with pytest.raises(Exception, match="bad chat id"):
            log.save(spark.createDataFrame([(bad, 0, "user", "x")], TURNS))
    assert log.sink.blocks() == []


def test_compaction_cut_short_brings_nothing_back(spark, log, monkeypatch):
    log.save(spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "y")], TURNS))
    log.delete(spark.createDataFrame([("a",)], "conv_id string"))
    took = log.sink.remove
    calls = iter([True, False])

    def dies(number):
        if next(calls):
            return took(number)
        raise OSError("lost")

    monkeypatch.setattr(log.sink, "remove", dies)
    with pytest.raises(OSError):
        log.compact()
    assert held(log) == [("b", 0, "user", "y")]


def test_long_chat_is_matched_by_parts(spark, log):
    turns = spark.range(5000).select(F.lit("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    log.save(turns)
    log.save(turns.filter("turn < 3000"))
    assert log.turns().count() == 3000 and log._parts().count() == 3
    plan = log.turns("long")._jdf.queryExecution().toString()
    assert "EqualTo(id,long)" in plan


def test_chat_store_by_uri(spark, tmp_path):
    s = records.ChatStore(f"file://{tmp_path}/c", spark)
    assert s.list() == [] and s.load("x") is None and s.turns().count() == 0
    s.save({"id": "x", "title": "é", "settings": {"k": 5}, "messages": [{"role": "user", "content": "hi", "citations": [1]}]})
    s.save({"id": "y", "title": "later", "messages": []})
    (tmp_path / "c" / "by_hand.json").write_text(json.dumps({"id": "by_hand", "title": "t", "updated_at": "1999", "messages": []}, indent=2))
    (tmp_path / "c" / "broken.json").write_text("{")
    (tmp_path / "c" / "bytes.json").write_bytes(b"\xff\xfe")
    assert [(c["id"], c["n_messages"]) for c in s.list()] == [("y", 0), ("x", 1), ("by_hand", 0)]
    assert s.load("x")["title"] == "é" and s.load("x")["settings"] == {"k": 5}
    assert [tuple(r) for r in s.turns().collect()] == [("x", 0, "user", "hi")]
    with pytest.raises(json.JSONDecodeError):
        s.load("broken")
    assert s.delete("y") and not s.delete("y") and len(s.list()) == 2


def test_files_are_whole_or_not_there(spark, tmp_path):
    at = f"file://{tmp_path}/f/x.json"
    assert files.write(spark, at, "1") and not files.write(spark, at, "2") and files.read(spark, at) == "1"
    assert files.write(spark, at, "3", replace=True) and files.read(spark, at) == "3"
    assert [x.getPath().getName() for x in files.listed(spark, f"file://{tmp_path}/f")] == ["x.json"]


def test_leaderboard_and_runs_by_uri(spark, tmp_path):
    top = f"file://{tmp_path}/board"
    board = {"last_updated": "2024-01-02T00:00:00Z", "categories": {"fast": {"metric": "m", "winner": "a", "winner_value": 1.5, "runner_up": None}}}
    paths = [records.write_leaderboard(board, top) for _ in range(3)]
    assert [p.rsplit("/", 1)[1] for p in paths] == ["leaderboard_20240102000000.json", "leaderboard_20240102000000_1.json", "leaderboard_20240102000000_2.json"]
    assert json.loads(files.read(spark, f"{top}/leaderboard.json")) == board
    assert {(r.category, r.winner, r.winner_value) for r in records.read_snapshots(spark, top).collect()} == {("fast", "a", 1.5)}
    for n in ("r1", "r2"):
        files.write(spark, f"{top}/runs/{n}/per_question.jsonl", "{}")
    assert records.newest_run(f"{top}/runs").endswith("r2") and records.newest_run(f"{top}/none") is None


def test_insert_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("a", [1.0, 0.0])], "id string, v array<double>")
    VectorStore(spark, str(tmp_path)).upsert(rows)
    s = InsertStore(spark, str(tmp_path))
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, v array<double>")
    assert len(s) == 0 and s.query(q, 2).count() == 0
    assert s.upsert(rows) == 3 and s.upsert(rows.limit(0)) == 0 and len(s) == 3
    got = s.query(q, 5).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.distance) for r in got] == [("a", 1.0, 0.0), ("b", 0.0, 1.0)]
    with pytest.raises(ValueError):
        s.upsert_lists(["a"], [])


def test_parts_by_name(spark, monkeypatch):
    assert components.parts() == components.Parts()
    monkeypatch.setattr(components, "_makers", {})
    with pytest.raises(ValueError, match="unknown embedder 'far'"):
        components.parts(Choice(embedder="far"))
    for kind, made in (("embedder", lambda texts: [[float(len(t)), 1.0] for t in texts]), ("generator", lambda p: f"said {p.count('[')}"), ("expander", lambda q, n: [q.upper()]), ("writer", lambda q: "none")):
        components.register(kind, "far", lambda c, made=made: made, ("project",))
    with pytest.raises(RuntimeError, match="embedder 'far' needs project"):
        components.parts(Choice(embedder="far"))
    chosen = Choice.of({"X_EMBEDDER": "far", "X_GENERATOR": "far", "X_EXPANDER": "far", "X_WRITER": "far", "X_PROJECT": " p ", "X_REGION": " "}, "X_")
    assert chosen.project == "p" and chosen.region == ""
    for bad in (("nothing", "far", ()), ("embedder", "mock", ()), ("embedder", "x", ("nothing",))):
        with pytest.raises(ValueError):
            components.register(bad[0], bad[1], lambda c: None, bad[2])
    sections = spark.createDataFrame([("d", "item_1", "alpha beta"), ("e", "item_1", "gamma delta epsilon")], "doc_key string, section_id string, text string")
    settings = service.Settings(multi_query=True, hypothetical=True, top_k=2)
    bundle = service.bundle_of(sections, settings, components.parts(chosen))
    q = spark.createDataFrame([(0, "what?"), (1, "which?")], "qid long, question string")
    top = service.rankings(bundle, q, settings, components.parts(chosen))
    got = {r.qid: r.answer for r in generation.generate(q, top.filter("qid = 0"), bundle.chunks, components.parts(chosen).generate).collect()}
    assert got == {0: "said 2", 1: generation.REFUSAL}
    assert len(bundle.vectors("chunks").first().v) == 2
    assert service.Engine(sections, settings, parts=components.parts(chosen)).ask("what?")["answer"] == "said 2"
