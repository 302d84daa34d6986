"""The sink of whole blocks: jobs that die within a block, after it, and two writers of one."""

import pytest
from pyspark.sql import functions as F

from marlstone.plans import service
from marlstone.sources import records
from marlstone.sources.blocks import BlockSink
from marlstone.streaming import answers


@pytest.fixture
def stream(spark, tmp_path):
    """Forty questions in four files, a block each."""
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").alias("qid")).coalesce(2).write.parquet(f"{tmp_path}/in/{i}")
    return lambda: spark.readStream.schema("qid long").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")


def ids(sink):
    return sorted(r.qid for r in sink.read().collect())


def run(stream, answer, sink, tmp_path):
    q = answers.answering(stream(), answer, sink, f"{tmp_path}/checkpoint")
    try:
        q.awaitTermination()
    finally:
        q.stop()


def test_a_block_killed_half_way_is_neither_lost_nor_doubled(spark, stream, tmp_path):
    sink, state = BlockSink(spark, f"{tmp_path}/out"), {"down": True, "n": 0}

    def answer(rows):
        state["n"] += 1
        if state["n"] == 2 and state["down"]:  # one task's file is written, the other task fails
            fail = F.raise_error(F.lit("killed")).cast("long")
            top = rows.agg(F.max("qid")).first()[0]
            return rows.withColumn("qid", F.when(F.col("qid") == top, fail).otherwise(F.col("qid")))
        return rows

    with pytest.raises(Exception, match="killed"):
        run(stream, answer, sink, tmp_path)
    assert sink.blocks() == [0] and len(ids(sink)) == 10
    state["down"] = False
    run(stream, answer, sink, tmp_path)
    assert ids(sink) == list(range(40)) and sink.blocks() == [0, 1, 2, 3]
    sink.vacuum()
    assert ids(sink) == list(range(40)) and sink.vacuum() == 0


def test_a_batch_that_dies_after_its_block_is_passed_by(spark, stream, tmp_path):
    class Dies(BlockSink):
        def write(self, rows, number):
            made = super().write(rows, number)
            if number == 1:
                raise RuntimeError("after the rename")
            return made

    asked = []

    def answer(rows):
        asked.append(1)
        return rows

    with pytest.raises(Exception, match="after the rename"):
        run(stream, answer, Dies(spark, f"{tmp_path}/out"), tmp_path)
    sink = BlockSink(spark, f"{tmp_path}/out")
    assert sink.blocks() == [0, 1]
    run(stream, answer, sink, tmp_path)
    assert ids(sink) == list(range(40)) and len(asked) == 4


def test_the_first_whole_block_stays(spark, tmp_path):
    sink = BlockSink(spark, f"{tmp_path}/out", "parquet")
    assert sink.read() is None and sink.blocks() == [] and sink.next() == 0 and sink.vacuum() == 0
    assert sink.write(spark.range(3).toDF("qid"), 0) and not sink.write(spark.range(9).toDF("qid"), 0)

    class Late(BlockSink):  # sees no block before it writes
        seen = 0

        def blocks(self):
            self.seen += 1
            return [] if self.seen == 1 else super().blocks()

    assert not Late(spark, f"{tmp_path}/out", "parquet").write(spark.range(9).toDF("qid"), 0)
    assert ids(sink) == [0, 1, 2] and sink.vacuum() == 0 and sink.next() == 1
    assert sink.write(spark.range(0).toDF("qid"), 1) and ids(sink) == [0, 1, 2]
    assert sorted(r.qid for r in sink.missing(spark.range(5).toDF("qid"), "qid").collect()) == [3, 4]
    with pytest.raises(ValueError):
        sink.write(spark.range(1).toDF("qid"), -1)


def test_an_experiment_goes_on_after_a_judge_died(spark, tmp_path):
    sections = spark.createDataFrame([(f"k{i}", "item_1", f"word{i} alpha beta gamma delta " * 20) for i in range(4)], "doc_key string, section_id string, text string")
    settings = service.Settings(strategy="bm25")
    bundle = service.bundle_of(sections, settings)
    qa = spark.createDataFrame([(i, f"what of word{i % 4}", "lookup", None, f"word{i % 4} alpha", f"k{i % 4}") for i in range(6)], "qid long, question string, qa_type string, source_id string, span string, filing string")
    state = {"n": 0}

    def judge(rows):
        state["n"] += 1
        if state["n"] == 2:
            raise RuntimeError("judge is down")
        return service.no_judge(rows)

    with pytest.raises(RuntimeError, match="down"):
        service.run_experiment(bundle, qa, settings, "e", judge, f"{tmp_path}/sink", block=2)
    assert records.per_question_sink(spark, f"{tmp_path}/sink", "e").blocks() == [0]
    done, total = service.run_experiment(bundle, qa, settings, "e", judge, f"{tmp_path}/sink", block=2)
    assert sorted(r.qid for r in done.collect()) == list(range(6)) and total.first().exp_name == "e"
    with pytest.raises(ValueError):
        records.read_per_question(spark, f"{tmp_path}/sink", "other")


def test_costs_on_any_file_system(spark, tmp_path):
    calls = [("a", "gemini-2.5-pro", 1_000_000, 1_000_000, 2.0), ("b", None, None, 5, None), ("c", "unknown", 9, 9, 1.0)]
    rows = spark.createDataFrame(calls, "operation string, model string, input_tokens long, output_tokens long, latency_ms double")
    path = f"file://{tmp_path}/costs"
    assert [records.append_costs(rows, path), records.append_costs(rows, path)] == [0, 1]
    got = records.read_costs(spark, path).collect()
    assert len(got) == 6 and sum(r.cost_usd for r in got) == 12.5 and all(r.ts for r in got)
    assert records.append_costs(rows.limit(0), path) == 2 and records.read_costs(spark, path).count() == 6
