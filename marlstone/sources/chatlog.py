"""Chats kept as a log of whole blocks, for many chats at once, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import chats
from marlstone.sources.blocks import BlockSink

#: Turns of one chat that are kept and matched together.
PART = 1024
_SCHEMA = "id string, kind string, part long, turn long, role string, text string, title string, n_messages long, updated_at timestamp, gone boolean"


def checked_id(c: Column) -> Column:
    """Ids are 1 to 64 letters, digits, hyphens or underscores; others raise, null too."""
    c = c.cast("string")
    return F.when(c.rlike(r"^[A-Za-z0-9_-]{1,64}\z"), c).otherwise(F.raise_error(F.concat(F.lit("bad chat id: "), F.coalesce(c, F.lit("null")))))


class ChatLog:
    """save, delete, turns, summaries, search, compact over blocks of Parquet.

    A save puts whole chats into one block: a head for each, a row for each part of 1024 turns, and the turns. What an id
    has in the highest block that names it counts, so saving again replaces a chat, and deleting writes a head that says so.
    A block comes to be by one rename: a job that dies leaves the chats as they were. Reading finds each id's highest block from
    the heads, and matches turns with them by part, so a long chat never comes together in a task (positions within a chat are
    distinct; where a table repeats them, its rows are kept and a part may be larger). Null roles, texts and turns are kept as
    they are; null ids raise. `compact` writes what counts into one block and removes those before, oldest first, so that a
    deleted chat can't come back if it is interrupted. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.sink = spark, BlockSink(spark, path, "parquet")

    def _rows(self) -> DataFrame:
        rows = self.sink.read(_SCHEMA)
        if rows is None:
            return self.spark.createDataFrame([], f"{_SCHEMA}, seq long")
        return rows.select("*", F.regexp_extract("_metadata.file_path", r"/block-(\d+)/", 1).cast("long").alias("seq"))

    def _put(self, rows: list[DataFrame]) -> int:
        whole = [r.select(*[F.col(c) if c in r.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _SCHEMA.split(", "))]) for r in rows]
        out = whole[0]
        for r in whole[1:]:
            out = out.unionByName(r)
        number = self.sink.next()
        if not self.sink.write(out.sortWithinPartitions("kind", "id"), number):
            raise RuntimeError(f"block {number} of the chats was made by another writer")
        return number

    def save(self, turns: DataFrame, titles: DataFrame | None = None) -> int:
        """Whole chats (conv_id, turn, role, text), each in place of what was kept of it: the block's number. Titles come from
        the first question, or from `titles` (conv_id, title), which may name chats without a turn."""
        rows = turns.select(checked_id(F.col("conv_id")).alias("id"), F.col("turn").cast("long").alias("turn"), "role", "text")
        rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART).cast("long"), F.lit(-1)))
        heads = chats.summaries(rows.withColumnRenamed("id", "conv_id")).select(F.col("conv_id").alias("id"), "title", "n_messages")
        if titles is not None:
            named = titles.select(checked_id(F.col("conv_id")).alias("id"), F.col("title").alias("given")).groupBy("id").agg(F.max("given").alias("given"))
            heads = heads.join(named, "id", "full").select("id", F.coalesce("given", "title").alias("title"), F.coalesce("n_messages", F.lit(0)).cast("long").alias("n_messages"))
        heads = heads.select("*", F.lit("head").alias("kind"), F.current_timestamp().alias("updated_at"), F.lit(False).alias("gone"))
        parts = rows.groupBy("id", "part").agg(F.lit("part").alias("kind"))
        return self._put([heads, parts, rows.withColumn("kind", F.lit("turn"))])

    def delete(self, ids: DataFrame) -> int:
        """How many of these chats (conv_id) were there; they are gone then."""
        wanted = ids.select(checked_id(F.col("conv_id")).alias("id")).distinct()
        there = self.live().join(wanted, "id", "left_semi").select("id").persist()
        try:
            if n := there.count():
                self._put([there.select("id", F.lit("head").alias("kind"), F.current_timestamp().alias("updated_at"), F.lit(True).alias("gone"))])
            return n
        finally:
            there.unpersist()

    def live(self) -> DataFrame:
        """id, title, n_messages, updated_at, seq of each chat that is there."""
        heads = self._rows().filter("kind = 'head'")
        last = heads.groupBy("id").agg(F.max_by(F.struct("title", "n_messages", "updated_at", "gone", "seq"), "seq").alias("h"))
        return last.filter("not h.gone").select("id", "h.title", "h.n_messages", "h.updated_at", "h.seq")

    def _parts(self) -> DataFrame:
        parts = self._rows().filter("kind = 'part'").select("id", "seq", "part")
        return parts.join(self.live().select("id", "seq"), ["id", "seq"], "left_semi")

    def turns(self, chat_id: str | None = None) -> DataFrame:
        """conv_id, turn, role, text of all chats that are there, or of one, whose id reaches the scan."""
        rows, parts = self._rows().filter("kind = 'turn'").select("id", "seq", "part", "turn", "role", "text"), self._parts()
        if chat_id is not None:
            rows, parts = rows.filter(F.col("id") == chat_id), parts.filter(F.col("id") == chat_id)
        return rows.join(parts, ["id", "seq", "part"], "left_semi").select(F.col("id").alias("conv_id"), "turn", "role", "text")

    def summaries(self) -> DataFrame:
        """conv_id, title, n_messages, updated_at: newest first."""
        return self.live().select(F.col("id").alias("conv_id"), "title", "n_messages", "updated_at").orderBy(F.col("updated_at").desc(), F.col("conv_id").desc())

    def search(self, text: str) -> DataFrame:
        """Summaries of chats with the text in title or turns, case aside; blank text finds all."""
        wanted = text.strip().casefold()
        if not wanted:
            return self.summaries()
        inside = self.turns().filter(F.contains(F.lower("text"), F.lit(wanted))).select("conv_id").distinct().withColumn("inside", F.lit(True))
        found = self.summaries().join(inside, "conv_id", "left").filter(F.coalesce("inside", F.lit(False)) | F.contains(F.lower("title"), F.lit(wanted)))
        return found.drop("inside").orderBy(F.col("updated_at").desc(), F.col("conv_id").desc())

    def compact(self) -> int:
        """How many blocks went."""
        before = self.sink.blocks()
        if len(before) < 2:
            return 0
        heads = self.live().select("*", F.lit("head").alias("kind"), F.lit(False).alias("gone"))
        parts = self._parts().select("id", "part", F.lit("part").alias("kind"))
        turns = self._rows().filter("kind = 'turn'").join(self._parts(), ["id", "seq", "part"], "left_semi")
        self._put([heads, parts, turns])
        for number in before:  # oldest first
            self.sink.remove(number)
        return len(before)
