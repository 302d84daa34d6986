"""Chats as rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import strip, title

ROLES = ("user", "assistant")


def first_questions(turns: DataFrame) -> DataFrame:
    """conv_id, question: the first user turn."""
    return turns.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))


def summaries(turns: DataFrame) -> DataFrame:
    """conv_id, title, n_messages, last_turn: newest (highest id) first."""
    per = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("any"), F.count_if(F.col("role") == "user").alias("asked"))
    return per.select("conv_id", title(F.when(F.col("asked") > 0, F.col("any"))).alias("title"), "n_messages", "last_turn").orderBy(F.col("conv_id").desc())


def search(turns: DataFrame, text: str) -> DataFrame:
    """Summaries of chats with the text in title or messages, case aside; blank text finds all."""
    found = summaries(turns)
    wanted = text.strip().casefold()
    if not wanted:
        return found
    inside = turns.filter(F.contains(F.lower("text"), F.lit(wanted))).select("conv_id").distinct().withColumn("inside", F.lit(True))
    return found.join(inside, "conv_id", "left").filter(F.coalesce("inside", F.lit(False)) | F.contains(F.lower("title"), F.lit(wanted))).drop("inside").orderBy(F.col("conv_id").desc())


def appended(turns: DataFrame, conv_id: int, role: str, text: str) -> DataFrame:
    if role not in ROLES:
        raise ValueError(f"role must be one of {ROLES}, not {role!r}")
    last = turns.filter(F.col("conv_id") == conv_id).agg(F.coalesce(F.max("turn") + 1, F.lit(0)).alias("turn"))
    new = last.select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(text).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(new)


def renamed(name: str, width: int = 80) -> str:
    """A title given by hand: white space collapsed, cut at a word; a blank one is refused."""
    s = " ".join(name.split())
    if not s:
        raise ValueError("a title can't be blank")
    if len(s) <= width:
        return s
    cut = s[:width]
    return cut.rsplit(" ", 1)[0] if " " in cut else cut


__all__ = ["first_questions", "summaries", "search", "appended", "renamed", "strip"]
