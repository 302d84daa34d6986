import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunking, ledger, retrieval
from marlstone.plans import service
from marlstone.sources import filings, records, vectors
from marlstone.streaming import costs


def test_vector_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = vectors.VectorStore(spark, path, recreate=True)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, v array<double>")
    assert len(s) == 0 and s.query(q, 5).count() == 0
    s.upsert_lists(["a", "b"], [[1.0, 0.0], [0.0, 1.0]])
    s.upsert_lists(["b", "c"], [[0.9, 0.1], [0.5, 0.5]])
    assert len(s) == 3
    assert [r.chunk_id for r in s.query(q, 2).orderBy("rank").collect()] == ["a", "b"]
    assert s.query(q, 0).count() == 0
    with pytest.raises(ValueError):
        s.upsert_lists(["x"], [])
    again = vectors.VectorStore(spark, path)
    assert again.attachable(3) and not again.attachable(4)
    again.close()
    assert len(vectors.VectorStore(spark, path, recreate=True)) == 0


def test_ledger_files(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("exp_name,timestamp,n_questions,hit_at_5,faithfulness,mean_latency_ms\na,2024-01-01,139,0.8,None,10\nb,2024-01-02,139,0.6,,11\n")
    rows = records.read_ledger(spark, str(path)).orderBy("ord").collect()
    assert rows[0].hit_at_5 == 0.8 and rows[0].faithfulness is None and rows[0].hit_at_5_content is None
    code, said = service.guard(spark, str(path), "a", str(path))
    assert code == 1 and said["breaches"] == ["hit_at_5"]
    assert service.guard(spark, str(path), "nobody", str(path))[0] == 2
    board = service.leaderboard(spark, str(path))
    assert board["categories"]["end_to_end"]["winner"] is None and board["last_updated"] == "2024-01-02"
    a, b = records.write_leaderboard(board, str(tmp_path)), records.write_leaderboard(board, str(tmp_path))
    assert a != b and b.endswith("_1.json")
    records.append_ledger(records.read_ledger(spark, str(path)), f"{tmp_path}/out")
    records.append_ledger(records.read_ledger(spark, str(path)), f"{tmp_path}/out")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/out").count() == 4


def test_records(spark, tmp_path):
    qa = tmp_path / "qa.jsonl"
    qa.write_text('{"id": "q_0002", "question": "b"}\n\n{"id": "q_0001", "question": "a"}\n')
    assert [r.id for r in records.read_questions(spark, str(qa), 1).collect()] == ["q_0001"]
    log = tmp_path / "cost.jsonl"
    with pytest.raises(RuntimeError):
        with service.recorded(str(log), "generate", "gemini-2.5-pro", 1_000_000) as call:
            call["output_tokens"] = 1_000_000
            raise RuntimeError
    assert records.read_costs(spark, str(log)).first().cost_usd == pytest.approx(6.25)
    records.log_cost("/no/such/folder/x", "a", "b", 0, 0, 0, 0)
    assert records.newest_run(str(tmp_path)) is None
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "per_question.jsonl").write_text("{}")
    assert records.newest_run(str(tmp_path)).endswith("run1")
    assert records.between_markers("a<!-- t:start -->old<!-- t:end -->b", "t", "new") == "a<!-- t:start -->\nnew\n<!-- t:end -->b"
    with pytest.raises(ValueError):
        records.between_markers("a", "t", "b")


def test_chat_store(spark, tmp_path):
    s = records.ChatStore(str(tmp_path))
    s.save({"id": "c1", "title": "T", "updated_at": "2024", "messages": [{"role": "user", "content": "hi"}]})
    (tmp_path / "bad.json").write_text("{")
    assert [c["id"] for c in s.list()] == ["c1"] and s.load("c1")["title"] == "T"
    with pytest.raises(json.JSONDecodeError):
        s.load("bad")
    with pytest.raises(ValueError):
        s.load("../x")
    assert s.delete("c1") and not s.delete("c1")


def test_filings(spark, tmp_path):
    sent = json.dumps({"filings": {"recent": {"accessionNumber": ["0-1-2", "0-1-3"], "filingDate": ["2024-02-01", "2023-02-01"], "reportDate": ["", "2022-12-31"], "form": ["10-K", "10-K"], "primaryDocument": ["a.htm", "b.htm"]}}})
    df = spark.createDataFrame([("AAPL", "0000320193", sent)], "ticker string, cik string, json string")
    got = filings.unzipped(df, "10-K").orderBy("filing_date").collect()
    assert [r.fiscal_year for r in got] == [2022, 2024] and got[0].url.endswith("/320193/013/b.htm")
    assert filings.unzipped(df, "10-Q").count() == 0
    path = filings.write_sample(str(tmp_path / "s.html"))
    html = filings.raw_html(spark, path)
    got = service.sections_of(html)
    assert {r.section_id for r in got.collect()} == {"item_1", "item_1a", "item_7"}


def test_cache():
    c = service.AnswerCache(2)
    for q in ("a", "b", "a", "c"):
        c.put(q, q, "dense", 5, False)
    assert c.get("a", "dense", 5, False) is None and c.get(" B ", "dense", 5, False) == "b"
    assert c.stats()["hit_rate"] == 0.5 and service.AnswerCache().stats()["hit_rate"] == 0.0


def test_engine_and_experiment(spark):
    sections = spark.createDataFrame([("d", "item_1", "the firm sells rain gauges to farms"), ("e", "item_1a", "suppliers of steel may fail in winter")], "doc_key string, section_id string, text string")
    e = service.Engine(sections, service.Settings(strategy="hybrid", dim=64, rerank=True))
    got = e.ask("which suppliers may fail?")
    assert got["citations"][0] == "e_item_1a::0000" and got["cache"] == "MISS"
    assert e.ask("Which  suppliers may fail?")["cache"] == "HIT"
    for bad in ("", "   ", "x" * 2001):
        with pytest.raises(ValueError):
            e.ask(bad)
    with pytest.raises(ValueError):
        e.ask("ok then", 21)
    qa = spark.createDataFrame([(0, "suppliers of steel", "lookup", "e_item_1a::0000", "may fail", "e")], "qid long, question string, qa_type string, source_id string, span string, filing string")
    for s in (service.Settings(multi_query=True, dim=64), service.Settings(strategy="parent_doc", hypothetical=True, dim=64)):
        rows, total = service.run_experiment(service.bundle_of(sections, s), qa, s, "x")
        assert rows.first().hit and total.first().hit_at_5 == 1.0
    assert chunking.CHUNKERS.keys() >= {"naive", "semantic"}


def test_prewarmed_store(spark, tmp_path):
    sections = spark.createDataFrame([("d", "item_1", "rain gauges"), ("e", "item_1", "steel suppliers")], "doc_key string, section_id string, text string")
    s = service.Settings(dim=32)
    q = spark.createDataFrame([(0, "steel")], "qid long, question string")
    for _ in range(2):
        b = service.bundle_of(sections, s)
        store = service.prewarm(b, f"file://{tmp_path}/store")
        assert len(store) == 2 and store.version == 1
        assert service.rankings(b, q, s).orderBy("rank").first().chunk_id == "e_item_1::0000"


def test_model_answers(spark):
    from marlstone.operators import generation

    df = spark.createDataFrame([("a",), ("bad",)], "p string")
    got = df.select(generation.structured(lambda p: '{"x": 1}' if p == "a" else "[1]")("p").alias("x"), generation.spoken(lambda p: ["one ", p] if p == "a" else 1 / 0)("p").alias("y")).collect()
    assert [(r.x, r.y) for r in got] == [('{"x": 1}', "one a"), (None, "")]


def test_streaming_costs(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    q = costs.spending(costs.events(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("spent").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("spent").count() == want.count()
    assert spark.table("spent").agg(F.sum("n")).first()[0] == events.count()


def test_ledger_keeps_the_order_of_appends(spark, tmp_path):
    for name in ("a", "bbbbbbbbbbbbbbb", "cc", "ddddd"):  # files of other sizes come in another order
        rows = spark.createDataFrame([(name, "2024-01-01", 0.5, 0), (name + "2", "2024-01-01", 0.5, 1)], "exp_name string, timestamp string, hit_at_5 double, ord long")
        records.append_ledger(rows, f"{tmp_path}/ledger")
    got = records.read_ledger(spark, f"{tmp_path}/ledger").orderBy("ord").collect()
    assert [r.exp_name for r in got] == ["a", "a2", "bbbbbbbbbbbbbbb", "bbbbbbbbbbbbbbb2", "cc", "cc2", "ddddd", "ddddd2"]
    assert [r.ord for r in got] == list(range(8))
    best = {r.category: r.winner for r in ledger.winners(records.read_ledger(spark, f"{tmp_path}/ledger")).collect()}
    assert best["chunking_content"] is None


def test_a_store_that_can_not_be_read_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    vectors.VectorStore(spark, path).upsert_lists(["a"], [[1.0, 0.0]])
    for f in (tmp_path / "store").glob("v1-*/**/*.parquet"):
        f.write_text("broken")
    with pytest.raises(Exception):
        vectors.VectorStore(spark, path)


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = vectors.VectorStore(spark, path, buckets=8)
    want = {f"c{i:02d}": [float(i), 1.0] for i in range(60)}
    store.upsert_lists(list(want), list(want.values()))
    first = dict(store.folders)
    assert len(first) > 4 and store.table.columns == ["id", "v", "point", "version"]
    store.upsert_lists(["c07"], [[-1.0, 0.5]])
    want["c07"] = [-1.0, 0.5]
    assert len([b for b in first if store.folders[b] != first[b]]) == 1
    again = vectors.VectorStore(spark, path, buckets=3)
    assert again.buckets == 8 and again.folders == store.folders and again.version == 2
    again.upsert(spark.createDataFrame([], "id string, v array<double>"))
    assert again.folders == store.folders
    again.upsert_lists(["c07", "new"], [[2.0, 2.0], [3.0, 3.0]])
    want |= {"c07": [2.0, 2.0], "new": [3.0, 3.0]}
    rows = again.table.collect()
    assert len(rows) == 61 and {r.id: list(r.v) for r in rows} == want
    assert {r.id: r.version for r in rows if r.version != 1} == {"c07": 4, "new": 4}
    empty = vectors.VectorStore(spark, f"file://{tmp_path}/empty")
    empty.upsert(spark.createDataFrame([], "id string, v array<double>"))
    assert empty.table.columns == store.table.columns and len(empty) == 0
    empty = vectors.VectorStore(spark, f"file://{tmp_path}/empty")
    assert len(empty) == 0 and empty.version == 1
    empty.upsert_lists(["a"], [[1.0]])
    assert [(r.id, r.version) for r in empty.table.collect()] == [("a", 2)]


def test_store_without_buckets_is_dealt_out(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    old = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, v array<double>")
    old.selectExpr("id", "v", "cast(0 as decimal(20,0)) point", "5L version").write.parquet(f"{path}/v5-old")
    spark.createDataFrame([("5 v5-old",)], "value string").coalesce(1).write.text(f"{path}/current")
    store = vectors.VectorStore(spark, path)
    assert len(store) == 2
    store.upsert_lists(["b", "c"], [[0.5, 0.5], [1.0, 1.0]])
    assert {r.id: (list(r.v), r.version) for r in vectors.VectorStore(spark, path).table.collect()} == {"a": ([1.0, 0.0], 5), "b": ([0.5, 0.5], 6), "c": ([1.0, 1.0], 6)}


def test_attached_store(spark, tmp_path):
    store = vectors.VectorStore(spark, f"file://{tmp_path}/store")
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 16))
    store.upsert_lists([f"c{i:03d}" for i in range(500)], x.tolist())
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 500, 50)], "qid long, v array<double>")
    want = [tuple(r) for r in store.query(q, 5).orderBy("qid", "rank").collect()]
    assert not store.attach(100) and store.attach()
    assert [tuple(r) for r in store.query(q, 5).orderBy("qid", "rank").collect()] == want
    assert [n for n, _ in store.nearest(x[7].tolist(), 3)][0] == "c007"


def test_approximate_search_recall(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(4000, 24))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, v array<double>")
    q = v.filter("id % 50 = 0").withColumnRenamed("id", "qid")
    want = {(r.qid, r.chunk_id) for r in retrieval.dense(v, q, 5).collect()}
    got = {(r.qid, r.chunk_id) for r in retrieval.approximate(v, q, 5, probes=32).collect()}
    assert len(want & got) / len(want) >= 0.95  # vectors without any structure are the hardest
    assert {(r.qid, r.chunk_id) for r in retrieval.approximate(v, q, 5, centres=8, probes=8).collect()} == want
    assert retrieval.approximate(v.limit(0), q, 5).count() == 0


def test_experiment_measures_and_goes_on(spark, tmp_path):
    sections = spark.createDataFrame([("d", "item_1", "the firm sells rain gauges to farms"), ("e", "item_1a", "suppliers of steel may fail in winter")], "doc_key string, section_id string, text string")
    s = service.Settings(dim=64, model="gemini-2.5-pro")
    qa = spark.createDataFrame([(i, "suppliers of steel", "lookup", "e_item_1a::0000", "may fail", "e") for i in range(5)], "qid long, question string, qa_type string, source_id string, span string, filing string")
    asked = []

    def judge(rows):
        asked.append(rows.count())
        return rows.select("qid", F.lit(0.5).alias("context_recall"), F.lit(float("nan")).alias("faithfulness"), F.lit(None).cast("double").alias("answer_relevancy"))

    bundle = service.bundle_of(sections, s)
    rows, total = service.run_experiment(bundle, qa.filter("qid < 3"), s, "x", judge, f"file://{tmp_path}/out", block=2)
    got = total.first()
    assert (got.n_questions, got.context_recall, got.faithfulness, got.answer_relevancy, asked) == (3, 0.5, None, None, [2, 1])
    assert got.total_cost_usd > 0 and got.mean_latency_ms > 0
    one = rows.first()
    assert one.cost_usd == pytest.approx(service.price("gemini-2.5-pro", one.input_tokens, one.output_tokens))
    _, total = service.run_experiment(bundle, qa, s, "x", judge, f"file://{tmp_path}/out", block=2)
    assert total.first().n_questions == 5 and asked == [2, 1, 2]
    _, total = service.run_experiment(bundle, qa, s, "y")
    assert total.first().context_recall is None and total.first().hit_at_5 == 1.0
    records.append_ledger(total, f"{tmp_path}/base")
    assert service.nightly(bundle, qa, s, f"{tmp_path}/base", "y", f"{tmp_path}/smoke", 3) == (0, [])
    assert service.nightly(bundle, qa, s, f"{tmp_path}/base", "nobody", f"{tmp_path}/smoke", 3)[0] == 2


def test_ingest_and_index_for_a_question_set(spark, tmp_path, caplog):
    index = {"filings": {"recent": {"accessionNumber": ["0001-24-1", "0001-20-2", "0001-24-3"], "filingDate": ["2024-02-01", "2015-02-01", "2024-05-01"], "reportDate": ["", "", ""], "form": ["10-K", "10-K", "10-Q"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}}}

    def index_of(ticker, cik):
        if ticker == "MSFT":
            raise OSError("down")
        return json.dumps(index)

    def fetch(url, path):
        if "KO_" in path:
            raise OSError("lost")
        filings.write_sample(path)
        return os.path.getsize(path)

    man = filings.ingest(spark, ["AAPL", "MSFT", "KO", "??"], index_of, fetch, str(tmp_path), f"{tmp_path}/manifest", 3, 2025)
    assert [(r.ticker, r.filing_date, r.fiscal_year) for r in man.collect()] == [("AAPL", "2024-02-01", 2024)]
    qa = spark.createDataFrame([("AAPL", "2024-02-01"), ("PG", "2024-01-01")], "source_ticker string, source_filing_date string")
    bundle = service.bundle_for(qa, filings.read_manifest(spark, f"{tmp_path}/manifest"), service.Settings())
    assert {r.doc_key for r in bundle.chunks.collect()} == {"AAPL_2024-02-01"} and "PG_2024-01-01" in caplog.text
    with pytest.raises(RuntimeError):
        service.bundle_for(qa.filter("source_ticker = 'PG'"), man, service.Settings())


def test_filings_of_one_name_in_other_folders(spark, tmp_path):
    rows, man = [], "ticker string, cik string, filing_date string, fiscal_year int, accession_number string, form_type string, url string, local_path string"
    for ticker, date, word in (("A", "2024-01-01", "alpha"), ("B", "2024-01-02", "beta"), ("C", "2024 x", "gamma")):
        folder = tmp_path / "raw" / ticker / date
        folder.mkdir(parents=True)
        (folder / "10k.html").write_text(f"<h1>Item 1. Business</h1><p>{' '.join([word] * 300)}</p>")
        rows.append((ticker, None, date, 2024, None, "10-K", None, f"{folder}/10k.html"))
    manifest = spark.createDataFrame(rows, man)
    qa = spark.createDataFrame([("A", "2024-01-01"), ("B", "2024-01-02"), ("C", "2024 x")], "source_ticker string, source_filing_date string")
    chunks = service.bundle_for(qa, manifest, service.Settings()).chunks.collect()
    assert {(r.doc_key, *set(r.text.split())) for r in chunks} == {("A_2024-01-01", "alpha"), ("B_2024-01-02", "beta"), ("C_2024 x", "gamma")}
    shared = spark.createDataFrame([(*rows[0][:-1], rows[1][-1]), rows[1]], man)
    with pytest.raises(ValueError):
        service.bundle_for(qa, shared, service.Settings())


def test_store_survives_a_crash_and_is_vacuumed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = vectors.VectorStore(spark, path, buckets=4)
    assert store.upsert_lists(["a", "b", "a"], [[1.0], [2.0], [3.0]]) == 2
    assert {r.id: list(r.v) for r in store.table.collect()} == {"a": [3.0], "b": [2.0]}
    assert store.upsert(spark.createDataFrame([("a", [7.0], 2), ("a", [8.0], 1)], "id string, v array<double>, at int"), "at") == 1
    crashed = vectors.VectorStore(spark, path)
    crashed._point = lambda: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        crashed.upsert_lists(["c"], [[9.0]])
    again = vectors.VectorStore(spark, path)
    assert again.version == 2 and {r.id: list(r.v) for r in again.table.collect()} == {"a": [7.0], "b": [2.0]}
    late = vectors.VectorStore(spark, path)
    assert again.upsert_lists(["d"], [[4.0]]) == 1
    with pytest.raises(RuntimeError):  # another writer was first
        late.upsert_lists(["e"], [[5.0]])
    assert again.vacuum() > 2 and again.vacuum() == 0
    assert {r.id for r in vectors.VectorStore(spark, path).table.collect()} == {"a", "b", "d"}
    fresh = vectors.VectorStore(spark, path, recreate=True)
    assert len(fresh) == 0 and fresh.upsert_lists(["z"], [[1.0]]) == 1
    assert [r.id for r in vectors.VectorStore(spark, path).table.collect()] == ["z"]
