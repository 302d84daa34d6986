"""Question sets, ledgers, cost logs, leaderboards, chats: files in, files out."""

from __future__ import annotations

import datetime
import json
import logging
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.numbers import PRICES, cost
from marlstone.operators.ledger import COLUMNS, coerced
from marlstone.sources import files
from marlstone.sources.blocks import BlockSink

QA_SCHEMA = (
    "id string, question string, ground_truth_answer string, source_ticker string, source_filing_date string, source_fiscal_year int, "
    "source_section_id string, source_chunk_id string, source_span string, qa_type string, difficulty string, verified boolean, "
    "verification_reason string, generation_model string, verification_model string"
)
COST_SCHEMA = "ts string, operation string, model string, input_tokens long, output_tokens long, cost_usd double, latency_ms double, extra map<string,string>"
log = logging.getLogger(__name__)


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank ones are skipped. A limit takes the lowest ids."""
    rows = spark.read.schema(QA_SCHEMA).json(path).filter(F.col("id").isNotNull())
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A CSV ledger, coerced, with `ord`, the order in which its lines were appended; columns that an older one lacks are null.

    A folder that append_ledger wrote has the number of each append; files of other folders go by the time of their last
    change. Ledgers are small by nature, so one task numbers their lines."""
    raw = spark.read.option("header", "true").csv(path)
    place = [F.col(c) for c in ("append",) if c in raw.columns] + [F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    raw = raw.select("*", F.struct(*place, F.monotonically_increasing_id()).alias("__place"))
    raw = raw.withColumn("ord", F.row_number().over(Window.orderBy("__place")).cast("long") - 1).drop("__place")
    for c in COLUMNS:
        if c not in raw.columns:
            raw = raw.withColumn(c, F.lit(None).cast("string"))
    return coerced(raw.select(*COLUMNS, "ord"))


def append_ledger(rows: DataFrame, path: str) -> None:
    """Appends experiment rows in the locked order of columns; others are passed by. Each append has a folder with its number,
    and its rows keep their order (`ord`, where they have it). One writer at a time."""
    numbers = [int(n[7:]) for n in (x.getPath().getName() for x in files.listed(rows.sparkSession, path)) if n.startswith("append=")]
    order = ["ord"] if "ord" in rows.columns else []
    locked = rows.coalesce(1).sortWithinPartitions(*order) if order else rows.coalesce(1)
    locked = locked.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])
    locked.write.mode("errorifexists").option("header", "true").csv(f"{path}/append={max(numbers, default=0) + 1}")


def write_per_question(rows: DataFrame, path: str, experiment: str) -> None:
    """One folder for each experiment; a rerun replaces its own."""
    rows.write.mode("overwrite").json(f"{path}/exp_name={experiment}")


def per_question_sink(spark: SparkSession, path: str, experiment: str) -> BlockSink:
    """An experiment's folder as a sink of blocks: what was written stays whatever happens, and a block is whole or not there."""
    return BlockSink(spark, f"{path}/exp_name={experiment}")


def append_per_question(rows: DataFrame, path: str, experiment: str) -> None:
    """Adds a block of scored questions to an experiment's folder. One writer at a time."""
    sink = per_question_sink(rows.sparkSession, path, experiment)
    number = sink.next()
    if not sink.write(rows, number):
        raise RuntimeError(f"block {number} of {experiment} was made by another writer")


def read_per_question(spark: SparkSession, path: str, experiment: str, columns: list[str] = ()) -> DataFrame:
    """An experiment's scored questions; `columns` that no line has are null."""
    rows = per_question_sink(spark, path, experiment).read()
    if rows is None:
        raise ValueError(f"nothing was written for {experiment}")
    return rows.withColumns({c: F.lit(None).cast("string") for c in columns if c not in rows.columns})


def unanswered(questions: DataFrame, path: str, experiment: str) -> DataFrame:
    """Questions (qid) that the experiment's folder does not have yet."""
    return per_question_sink(questions.sparkSession, path, experiment).missing(questions, "qid")


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def log_cost(path: str, operation: str, model: str, tokens_in: int, tokens_out: int, cost: float, latency_ms: float, **extra) -> None:
    """Appends a line; what can't be written is only warned of, since a log must not stop the work."""
    row = {"ts": datetime.datetime.now(datetime.timezone.utc).isoformat(), "operation": operation, "model": model, "input_tokens": tokens_in, "output_tokens": tokens_out, "cost_usd": cost, "latency_ms": latency_ms, "extra": extra}
    try:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")
    except OSError as e:
        log.warning("cost log: %s", e)


def append_costs(calls: DataFrame, path: str) -> int:
    """Adds a block of calls (operation, model, input_tokens, output_tokens, latency_ms, and ts if known) to a cost log on any file
    system, priced by model, and returns its number. Unknown models and missing tokens cost nothing; without a time, calls are
    of now. Whole blocks only: a job that dies leaves none of its lines, and one that is repeated adds a block of its own. One
    writer at a time."""
    per = F.create_map(*[F.lit(x) for m, a, b in PRICES for x in (m, F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    rate = F.try_element_at(per, F.coalesce("model", F.lit("")))
    when = F.date_format(F.coalesce(F.col("ts").cast("timestamp") if "ts" in calls.columns else F.lit(None).cast("timestamp"), F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    rows = calls.select(when.alias("ts"), "operation", "model", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")], cost(F.col("input_tokens"), F.col("output_tokens"), rate["a"], rate["b"]).alias("cost_usd"), F.col("latency_ms").cast("double").alias("latency_ms"))
    sink = BlockSink(calls.sparkSession, path)
    number = sink.next()
    if not sink.write(rows, number):
        raise RuntimeError(f"block {number} of the cost log was made by another writer")
    return number


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    """A cost log: a file of lines, or a folder of blocks."""
    return spark.read.schema(COST_SCHEMA).option("recursiveFileLookup", "true").json(path)


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def write_leaderboard(board: dict, folder: str) -> str:
    """Overwrites leaderboard.json and adds a snapshot that is never overwritten, on any file system that Spark reaches; returns
    the snapshot's path. The snapshot is written first, so the leaderboard never shows what no snapshot has."""
    spark, top = _session(), folder.rstrip("/")
    text = json.dumps(board, indent=2, sort_keys=True)
    stamp = re.sub(r"[^0-9]", "", str(board.get("last_updated") or datetime.datetime.now(datetime.timezone.utc).isoformat()))[:14]
    for n in range(10_000):
        path = f"{top}/snapshots/leaderboard_{stamp}{f'_{n}' if n else ''}.json"
        if not files.exists(spark, path) and files.write(spark, path, text):
            files.write(spark, f"{top}/leaderboard.json", text, replace=True)
            return path
    raise RuntimeError("too many snapshots of one moment")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """snapshot (file name), category, winner, winner_value, runner_up of every snapshot; broken ones are passed by."""
    board = "categories map<string, struct<metric: string, winner: string, winner_value: double, runner_up: string>>"
    rows = spark.read.text(f"{folder.rstrip('/')}/snapshots/*.json", wholetext=True)
    rows = rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("snapshot"), F.from_json("value", board).alias("board"))
    return rows.select("snapshot", F.explode("board.categories").alias("category", "w")).select("snapshot", "category", "w.winner", "w.winner_value", "w.runner_up")


def newest_run(folder: str, name: str = "per_question.jsonl") -> str | None:
    """The run folder whose result file changed last, on any file system; of equal times the name that sorts last."""
    spark = _session()
    runs = [f"{folder.rstrip('/')}/{x.getPath().getName()}" for x in files.listed(spark, folder) if x.isDirectory()]
    changed = [(r, next((x.getModificationTime() for x in files.listed(spark, r) if x.getPath().getName() == name), None)) for r in runs]
    return max(((at, r) for r, at in changed if at is not None), default=(0, None))[1]


def between_markers(text: str, name: str, body: str) -> str:
    """Replaces what stands between <!-- name:start --> and <!-- name:end -->; raises where they are missing."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    a, b = text.find(start), text.find(end)
    if a < 0 or b < a:
        raise ValueError(f"no section {name}")
    return f"{text[: a + len(start)]}\n{body.strip()}\n{text[b:]}"


class ChatStore:
    """Chats as JSON files on any file system that Spark reaches, for one user's few; `ChatLog` keeps many. Loading a broken one
    raises; listing passes it by."""

    IDS = re.compile(r"[A-Za-z0-9_-]{1,64}")

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.spark, self.folder = spark or _session(), folder.rstrip("/")

    def _path(self, chat_id: str) -> str:
        if not self.IDS.fullmatch(chat_id):
            raise ValueError(f"bad chat id {chat_id!r}")
        return f"{self.folder}/{chat_id}.json"

    def save(self, chat: dict) -> None:
        chat = {**chat, "updated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}
        files.write(self.spark, self._path(chat["id"]), json.dumps(chat), replace=True)

    def load(self, chat_id: str) -> dict | None:
        path = self._path(chat_id)
        return json.loads(files.read(self.spark, path)) if files.exists(self.spark, path) else None

    def delete(self, chat_id: str) -> bool:
        return files.remove(self.spark, self._path(chat_id))

    def _parsed(self, schema: str) -> DataFrame | None:
        """What parses, one row a file; None where there is no file."""
        if not any(x.getPath().getName().endswith(".json") for x in files.listed(self.spark, self.folder)):
            return None
        rows = self.spark.read.text(f"{self.folder}/*.json", wholetext=True)
        return rows.select(F.from_json("value", schema).alias("c")).filter("c.id is not null").select("c.*")

    def list(self) -> list[dict]:
        """Newest first; only heads come to the driver."""
        rows = self._parsed("id string, title string, updated_at string, messages array<string>")
        if rows is None:
            return []
        rows = rows.select("id", "title", "updated_at", F.greatest(F.size(F.coalesce("messages", F.array().cast("array<string>"))), F.lit(0)).alias("n_messages"))
        return [r.asDict() for r in rows.orderBy(F.col("updated_at").desc_nulls_last(), "id").collect()]

    def turns(self, spark: SparkSession | None = None) -> DataFrame:
        """All chats as rows (conv_id, turn, role, text); broken files are dropped."""
        rows = self._parsed("id string, title string, messages array<struct<role:string,content:string>>")
        if rows is None:
            return self.spark.createDataFrame([], "conv_id string, turn long, role string, text string")
        return rows.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))
