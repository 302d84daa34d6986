"""Licence scan by canonical digests.

A text is brought to canonical form: lower case, copyright lines dropped, punctuation and white space to one
space, equivalent spellings to one. The SHA-256 of the whole canonical text is hash-joined to the digests of
the known licence texts. The same is done with each line of a document as a text of its own, which finds
one-line licence notices inside other text.

Known as whole texts: MIT, MIT-0, ISC, 0BSD, BSD-2-Clause, BSD-3-Clause, Zlib, Unlicense; by the digest of the whole text:
Apache-2.0, Artistic-1.0-Perl, the University's BSD-3-Clause, CC0-1.0, GFDL-1.2 and 1.3, GPL-1.0, 2.0 and 3.0, LGPL-2.0,
2.1 and 3.0, MPL-1.1 and 2.0. Of AGPL and the other CC licences only notices are known; a caller may give a larger table.

Native: DataFrame functions only. The known side is the fixed table of `licence_texts` (or a caller's, checked
for its size), the documents' side is digests; texts are never shuffled.

Defined results: a null or empty text has the digest of the empty string and no licence; rows are told apart by
id and text, and repeated rows get the same values each; where one digest has several identifiers, the first in
sorted order counts; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import row_keys, table, written
from marlstone.llm.licence_texts import DIGESTS, END, SPELLINGS, TEXTS

BROADCAST_ROWS = 100_000

#: Lines that state a copyright: text that is wrapped before "copyright holder", or a clause (c), is not among them.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9]|by |\[|<|:)|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$"
_PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text with canonical lines, each between spaces, line ends kept."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "")
    lines = F.concat(F.lit(" "), F.replace(F.regexp_replace(lines, _PUNCTUATION, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for said, stands in SPELLINGS:
        lines = F.replace(lines, F.lit(f" {said} "), F.lit(f" {stands} "))
    return lines


def canonical(lines: Column) -> Column:
    """Canonical lines as one canonical text: spellings of several words may go over a line end."""
    text = F.regexp_replace(lines, r"[ \n]+", " ")
    for said, stands in SPELLINGS:
        if " " in said:
            text = F.replace(text, F.lit(f" {said} "), F.lit(f" {stands} "))
    return F.trim(text)


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def known(spark: SparkSession, texts: list[tuple[str, str]] = TEXTS, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """digest, licence: one row for each digest, of texts and of those known by digest alone."""
    rows = json.dumps([{"licence": k, "text": t} for k, t in texts])
    x = spark.range(1).select(F.explode(F.from_json(F.lit(rows), "array<struct<licence:string,text:string>>")).alias("x"))
    rows = x.select(digest(canonical(canonical_lines(F.col("x.text")))).alias("digest"), F.col("x.licence").alias("licence"))
    if digests:
        more = F.from_json(F.lit(json.dumps([{"digest": d, "licence": k} for k, d in digests])), "array<struct<digest:string,licence:string>>")
        rows = rows.unionByName(spark.range(1).select(F.explode(more).alias("y")).select("y.digest", "y.licence"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def digests_of(spark: SparkSession, texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(licence, digest) of (licence, text): of the whole text, and of what stands before the line that ends its terms, with
    that line and without. This is how DIGESTS was made, from the texts that Linux distributions install."""
    cut = [(k, t.partition(END)[0] + tail) for k, t in texts if END in t for tail in ("", END)]
    rows = spark.createDataFrame(texts + cut, "licence string, text string")
    made = rows.select("licence", digest(canonical(canonical_lines(F.col("text")))).alias("digest")).distinct()
    return sorted((r.licence, r.digest) for r in made.collect())


def scan(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, licence (of the whole text), n_notices, notices (licences of its lines, sorted)."""
    licences = known(docs.sparkSession) if licences is None else licences.groupBy("digest").agg(F.min("licence").alias("licence"))
    licences = written(licences, "licences")
    small = F.broadcast(licences) if licences.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else licences
    base = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), canonical_lines(F.col(text_col)).alias("lines"))
    # the whole text has number -1, its lines follow
    parts = F.concat(F.array(canonical(F.col("lines"))), F.transform(F.split("lines", "\n"), canonical))
    at = base.select("doc_id", "k1", "k2", F.posexplode(F.transform(parts, digest)).alias("no", "digest"))
    met = at.join(small, "digest", "left").filter("licence is not null or no = 0")
    met = written(met.select("doc_id", "k1", "k2", "no", "digest", "licence"), "licence-lines")
    lines = met.filter("no > 0").dropDuplicates(["k1", "k2", "no"]).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("licence")).alias("found"))
    return met.filter("no = 0").join(lines, ["k1", "k2"], "left").select(
        "doc_id",
        "digest",
        "licence",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_notices"),
        F.coalesce("found", F.array().cast("array<string>")).alias("notices"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: licences of every document."""
    return scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


def _sql(text: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    lines = f"regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT.replace('(?m)', '(?m)')}', '', 'g')"
    lines = f"concat(' ', replace(regexp_replace({lines}, '{_PUNCTUATION}', ' ', 'g'), chr(10), concat(' ', chr(10), ' ')), ' ')"
    for said, stands in SPELLINGS:
        lines = f"replace({lines}, {quoted(f' {said} ')}, {quoted(f' {stands} ')})"
    return lines


def _whole(lines: str) -> str:
    text = f"regexp_replace({lines}, '[ \\n]+', ' ', 'g')"
    for said, stands in SPELLINGS:
        if " " in said:
            text = f"replace({text}, ' {said} ', ' {stands} ')"
    return f"sha256(trim({text}))"


def _values() -> str:
    return ", ".join("('" + k.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for k, t in TEXTS)


ORACLE = f"""
WITH known AS (
  SELECT {_whole("lines")} AS digest, min(licence) AS licence
  FROM (SELECT licence, {_sql("t")} AS lines FROM (VALUES {_values()}) AS v(licence, t)) GROUP BY 1
  UNION ALL SELECT digest, licence FROM (VALUES {", ".join(f"('{k}', '{d}')" for k, d in DIGESTS)}) AS v(licence, digest)
), d AS (
  SELECT doc_id, {_sql("text")} AS lines FROM documents
), l AS (
  SELECT doc_id, no, {_whole("line")} AS digest
  FROM (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line, generate_subscripts(string_split(lines, chr(10)), 1) AS no FROM d)
), n AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS found FROM l JOIN known USING (digest) GROUP BY doc_id
), w AS (
  SELECT doc_id, {_whole("lines")} AS digest FROM d
)
SELECT w.doc_id, w.digest, licence, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(found, '') AS notices
FROM w LEFT JOIN known USING (digest) LEFT JOIN n USING (doc_id)
"""
