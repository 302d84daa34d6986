"""Query key -> function, and query key -> DuckDB oracle, for the retrieval and evaluation operators."""

from __future__ import annotations

import functools
import threading

from pyspark.sql import functions as F

from marlstone.functions import numbers, tables, text
from marlstone.functions.bpe import Vocabulary
from marlstone.operators import chats, chunking, draws, embedding, generation, ledger, lexical, metrics, parsing, quantiles, remote, rerank, retrieval, routing, sampling
from marlstone.plans import fixtures as fx
from marlstone.plans.fixtures import (
    DIM,
    OVERLAP,
    SIZE,
    SQL_CHILDREN,
    SQL_CHUNKS,
    SQL_FORMS,
    SQL_LEDGER,
    SQL_NORM,
    SQL_OUTCOMES,
    SQL_QA,
    SQL_QUESTIONS,
    sql_bm25,
    sql_dense,
    sql_fuse,
    sql_fuse_of,
    sql_match,
    sql_parents,
    sql_recursive,
    sql_run,
    sql_sparse,
    table,
)
from marlstone.sources import filings, records, vectors
from marlstone.sources.blocks import BlockSink
from marlstone.sources.cells import CellIndex
from marlstone.sources.chatlog import ChatLog
from marlstone.sources.postings import PostingIndex
from marlstone.sources.shared import shared_folder
from marlstone.streaming import answers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ranked(df):
    return df.select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"))


# ---- sources ------------------------------------------------------------------------------------------------------

_TICKERS = ["AAPL", "MSFT", "NVDA", "ZZZZ", "JPM"]


@query(
    "WITH t AS (SELECT s_suppkey, list_extract(['AAPL', 'MSFT', 'NVDA', 'ZZZZ', 'JPM'], CAST(s_suppkey % 5 AS INTEGER) + 1) AS ticker FROM supplier) "
    "SELECT s_suppkey, ticker, coalesce(lpad(k, 10, '0'), '') AS cik FROM t LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in filings.CIKS.items()) + ") AS v(name, k) ON ticker = name"
)
def cik_lookup(s, d):
    t = table(s, d, "supplier").select("s_suppkey", F.get(F.array(*map(F.lit, _TICKERS)), (F.col("s_suppkey") % 5).cast("int")).alias("ticker"))
    return t.select("s_suppkey", "ticker", filings.cik(F.col("ticker")).alias("cik"))


@query(
    "SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, printf('%010d-24-%06d', o_custkey, o_orderkey) AS accession_number, "
    "'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(printf('%010d-24-%06d', o_custkey, o_orderkey), '-', '') || '/' || o_orderkey || '.htm' AS url FROM orders WHERE o_orderstatus = 'F'"
)
def columnar_json_unzip(s, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = table(s, d, "orders").select("o_custkey", F.format_string("%010d-24-%06d", "o_custkey", "o_orderkey").alias("a"), day.alias("f"), F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("").alias("r"), "o_orderstatus", F.concat(F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("p"))
    row = F.struct("a", "f", "r", "o_orderstatus", "p")
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("x"))  # one customer's filings, as the service sends them
    recent = F.struct(F.col("x.a").alias("accessionNumber"), F.col("x.f").alias("filingDate"), F.col("x.r").alias("reportDate"), F.col("x.o_orderstatus").alias("form"), F.col("x.p").alias("primaryDocument"))
    sent = per.select(F.lit("T").alias("ticker"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return filings.unzipped(sent, "F").select("cik", "filing_date", "fiscal_year", "accession_number", "url")


@query("SELECT doc_id, source || '/' || doc_id AS path FROM documents WHERE NOT (doc_id % 3 = 0 AND n_chars > 1024)")
def missing_files_antijoin(s, d):
    docs = table(s, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.col("n_chars").alias("length"))
    return filings.missing(docs.select("doc_id", "path"), docs.filter("doc_id % 3 = 0").select("path", "length")).select("doc_id", "path")


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders WHERE year(o_orderdate) >= 1998 - 2")
def filings_recent_years(s, d):
    return filings.recent_years(table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("fiscal_year")), 2, 1998)


@query()
def qa_scan(s, d):
    return fx.qa(s, d).select("qid", "question", "qa_type", "source_id")


@query("SELECT item_id AS qid, text AS span FROM benchmark ORDER BY item_id LIMIT 10")
def qa_limit(s, d):
    return fx.questions(s, d).select("qid", "span").orderBy("qid").limit(10)


_RAW = ["''", "'None'", "'n/a'", "' 0.25 '", "'1e3'"]


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 6 IN (0, 1, 2) THEN NULL WHEN s_suppkey % 6 = 3 THEN 0.25 WHEN s_suppkey % 6 = 4 THEN 1000.0 ELSE CAST(CAST(s_acctbal AS VARCHAR) AS DOUBLE) END AS value FROM supplier"
)
def ledger_coerce(s, d):
    raw = F.get(F.array(*[F.expr(x) for x in _RAW], F.col("s_acctbal").cast("string")), (F.col("s_suppkey") % 6).cast("int"))
    return ledger.coerced(table(s, d, "supplier").select("s_suppkey", raw.alias("value")), text=("s_suppkey",))


@query(
    "SELECT vec_id AS id, CAST(CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CAST(CASE WHEN vec_id % 4 = 0 THEN label + 100 ELSE label END AS INTEGER) AS label FROM embeddings UNION ALL "
    "SELECT vec_id + 1000000, 2, CAST(label + 100 AS INTEGER) FROM embeddings WHERE vec_id % 4 = 0"
)
def upsert_last_write_wins(s, d):
    base = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("version"), "label")
    new = base.filter("id % 4 = 0").select("id", F.lit(2).cast("long").alias("version"), (F.col("label") + 100).alias("label"))
    return vectors.upserted(base, new.unionByName(new.withColumn("id", F.col("id") + 1_000_000)))


@query("SELECT doc_id, CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 16)) AS UBIGINT) AS VARCHAR) AS point FROM documents")
def point_id_hash(s, d):
    return table(s, d, "documents").select("doc_id", text.point_id(F.col("doc_id").cast("string")).cast("string").alias("point"))


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


_COSINE = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"


@query(
    f"WITH p AS (SELECT a.vec_id AS qid, b.vec_id AS chunk_id, {_COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0) "
    "SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p) WHERE rank <= 5"
)
def dense_topk(s, d):
    v = _vectors(s, d)
    return ranked(retrieval.dense(v, v.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 5))


@query()
def ann_topk(s, d):
    v = _vectors(s, d).select("id", numbers.unit(F.col("v")).alias("v"))
    return ranked(retrieval.approximate(v, v.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 5))


# ---- projections and filters ---------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) > 0")
def drop_blank_docs(s, d):
    return chunking.not_blank(table(s, d, "documents")).select("doc_id")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents WHERE length(text) >= 500")
def min_length_filter(s, d):
    return table(s, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n >= 500")


@query(f"WITH {SQL_CHUNKS},\n{SQL_QUESTIONS},\n{SQL_QA},\n{sql_bm25('bm', 'questions', 'chunks', 5)} SELECT qid, count(*) AS n FROM qa JOIN bm USING (qid) WHERE qa_type <> 'out_of_scope' GROUP BY 1")
def judge_rows(s, d):
    rows = fx.qa(s, d).join(fx.bm25(s, d, 5).groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
    return rows.filter((F.col("qa_type") != "out_of_scope") & (F.col("n") > 0)).select("qid", "n")


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 OR toxic = 1")
def verified_filter(s, d):
    return table(s, d, "labels").filter((F.col("quality") == 1) | (F.col("toxic") == 1)).select("doc_id", "quality", "toxic")


@query("SELECT event_type AS model, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05' GROUP BY 1 UNION ALL SELECT NULL, count(*), round(sum(value), 6) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def daily_cost(s, d):
    rows = table(s, d, "events").filter(F.to_date("ts") == F.lit("2024-01-05").cast("date"))
    return rows.rollup(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT item_id AS qid, trim(text, e' \\t\\n\\r') AS question, trim(substr(text, 1, 30), e' \\t\\n\\r') AS source_span, CASE WHEN item_id % 2 = 0 THEN 'hard' ELSE 'medium' END AS difficulty, false AS verified, '' AS verification_reason FROM benchmark")
def qa_build(s, d):
    b = table(s, d, "benchmark")
    made = sampling.record(F.col("text"), F.substring("text", 1, 30), F.when(F.col("item_id") % 2 == 0, " hard "))
    return b.select(F.col("item_id").alias("qid"), *[c.alias(n) for n, c in made.items()])


@query()
def ann_stored_topk(s, d):
    v = _vectors(s, d)
    index = CellIndex.build(v, shared_folder(s, "cells"), cells=32)
    return ranked(index.search(v.filter("id % 50 = 0").withColumnRenamed("id", "qid"), 5, probes=24, shortlist=1000))


# ---- parsing and chunking ------------------------------------------------------------------------------------------

_HTML = "coalesce(html, '')"
for _e in (r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>", "(?s)<!--.*?-->", "<[a-zA-Z/!][^>]*>"):
    _HTML = f"regexp_replace({_HTML}, '{_e}', chr(1), 'g')"
_HTML = f"regexp_replace({_HTML}, '\\x01+', chr(10), 'g')"
for _a, _b in (("&nbsp;", " "), ("&#160;", " "), ("&#xA0;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"), ("&amp", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"


@query(f"SELECT page_id, md5({_HTML}) AS text_md5, CAST(length({_HTML}) AS BIGINT) AS n FROM pages")
def html_to_text(s, d):
    rows = table(s, d, "pages").select("page_id", parsing.html_text(F.col("html")).alias("text"))
    return rows.select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n"))


_ANCHORS = [("the", r"\bthe of\b"), ("and", r"\band the\b"), ("in", r"\bin the\b")]


def _filings(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("doc_key"), "text")


_MARKS = " UNION ALL ".join(
    f"SELECT doc_key, '{sid}' AS sid, CAST({k} AS BIGINT) AS rank, length(array_to_string(parts[1:i], '')) + length(array_to_string(heads[1:i - 1], '')) + 1 AS pos, heads[i] AS header "
    f"FROM (SELECT doc_key, parts, heads, unnest(range(1, len(heads) + 1)) AS i FROM (SELECT doc_id AS doc_key, string_split_regex(text, '(?i){p}') AS parts, regexp_extract_all(text, '(?i){p}') AS heads FROM documents))"
    for k, (sid, p) in enumerate(_ANCHORS)
)


@query(f"SELECT doc_key, sid, CAST(pos AS BIGINT) AS pos, header FROM ({_MARKS})")
def section_markers(s, d):
    return parsing.markers(_filings(s, d), _ANCHORS).select("doc_key", "sid", F.col("pos").cast("long").alias("pos"), "header")


_PARSED = f"""m AS ({_MARKS}), e AS (SELECT *, lead(pos) OVER (PARTITION BY doc_key ORDER BY pos, sid, header) AS stop FROM m),
b AS (SELECT e.doc_key, sid, rank, pos, header, regexp_replace(substr(regexp_replace(substr(text, pos, coalesce(stop, length(text) + 1) - pos), '^\\s+|\\s+$', '', 'g'), length(header) + 1), '^\\s+|\\s+$', '', 'g') AS body FROM e JOIN documents ON doc_id = e.doc_key),
parsed AS (SELECT doc_key, sid AS section_id, rank, header AS title, body AS text, CAST(length(body) AS BIGINT) AS char_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_key, sid ORDER BY length(body) DESC, pos) AS r FROM b WHERE length(body) >= 100) WHERE r = 1)"""


@query(f"WITH {_PARSED} SELECT doc_key, section_id, rank, title, md5(text) AS text_md5, char_count FROM parsed")
def parse_sections_longest(s, d):
    return parsing.parse(_filings(s, d), _ANCHORS, 100).select("doc_key", "section_id", "rank", "title", F.md5(F.col("text").cast("binary")).alias("text_md5"), "char_count")


@query(
    f"WITH {_PARSED} SELECT doc_id AS doc_key, count(section_id) AS found, coalesce(array_to_string(list_sort(list_filter(['the', 'and', 'in'], lambda x: NOT list_contains(list(coalesce(section_id, '')), x))), ','), '') AS missing, count(section_id) / 3.0 AS parse_rate "
    "FROM documents LEFT JOIN parsed ON doc_id = doc_key GROUP BY 1"
)
def parse_rate(s, d):
    docs = _filings(s, d)
    return parsing.parse_rate(docs, parsing.parse(docs, _ANCHORS, 100), _ANCHORS)


@query(f"WITH {SQL_CHUNKS} SELECT doc_key, chunk_index, md5(text) AS text_md5 FROM chunks")
def chunk_naive(s, d):
    return fx.chunks(s, d).select("doc_key", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query()
def chunk_ids_of_vocabulary(s, d):
    made = chunking.naive(fx.sections(s, d), 512, 50, vocabulary=Vocabulary.public())
    return made.select("chunk_id", "start_byte", "end_byte", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, doc_key, section_id, chunk_index, 'naive' AS chunker FROM chunks")
def chunk_ids(s, d):
    return fx.chunks(s, d).select("chunk_id", "doc_key", "section_id", "chunk_index", "chunker")


_ID = "lpad(CAST(doc_id AS VARCHAR), 8, '0') || '_' || lang"
_RECURSIVE = f"WITH {sql_recursive('rec', f'SELECT {_ID} AS id, 600 AS size, text FROM documents', 60)}"
_BUDGET = "CASE lang WHEN 'fr' THEN 900 WHEN 'de' THEN 700 ELSE 1200 END"
_STRUCTURAL = f"WITH {sql_recursive('rec', f'SELECT {_ID} AS id, {_BUDGET} AS size, text FROM documents', 100)}"


@query(f"{_RECURSIVE} SELECT printf('%s::%04d', id, i) AS chunk_id, i AS chunk_index, text FROM rec")
def chunk_recursive(s, d):
    return chunking.recursive(fx.sections(s, d), 600, 60).select("chunk_id", "chunk_index", "text")


@query()
def chunk_semantic(s, d):
    return chunking.semantic(fx.sections(s, d), None, SIZE, OVERLAP).select("chunk_id", "chunk_index", "text")


@query(f"{_STRUCTURAL} SELECT printf('%s::%04d', id, i) AS chunk_id, i AS chunk_index, size AS section_budget, text FROM rec")
def chunk_structural(s, d):
    return chunking.structural(fx.sections(s, d), {"fr": 900, "de": 700}, 1200, 100).select("chunk_id", "chunk_index", "section_budget", "text")


def _lateral(s, d, statement: str):
    """A statement over {sections} that uses the chunkers as table functions."""
    tables.register(s)
    return s.sql(statement, sections=fx.sections(s, d))


@query(f"WITH {SQL_CHUNKS} SELECT doc_key, chunk_index, text FROM chunks")
def sql_chunk_naive(s, d):
    return _lateral(s, d, f"SELECT s.doc_key, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.text FROM {{sections}} s, LATERAL chunk_naive(s.text, {SIZE}, {OVERLAP}) c")


@query(f"WITH {SQL_CHILDREN} SELECT split_part(chunk_id, '_', 1) AS doc_key, CAST(regexp_extract(chunk_id, '::([0-9]+):', 1) AS BIGINT) AS parent_index, CAST(regexp_extract(chunk_id, ':c([0-9]+)$', 1) AS BIGINT) AS child_index, text FROM children")
def sql_chunk_parent_child(s, d):
    return _lateral(
        s,
        d,
        f"SELECT s.doc_key, CAST(p.chunk_index AS BIGINT) AS parent_index, CAST(c.chunk_index AS BIGINT) AS child_index, c.text FROM {{sections}} s, LATERAL chunk_naive(s.text, {SIZE}, {OVERLAP}) p, LATERAL chunk_naive(p.text, 48, 8) c",
    )


@query(f"{_RECURSIVE} SELECT split_part(id, '_', 1) AS doc_key, i AS chunk_index, text FROM rec")
def sql_chunk_recursive(s, d):
    return _lateral(s, d, "SELECT s.doc_key, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.text FROM {sections} s, LATERAL chunk_recursive(s.text, 600, 60) c")


@query(f"{_STRUCTURAL} SELECT split_part(id, '_', 1) AS doc_key, i AS chunk_index, text FROM rec")
def sql_chunk_structural(s, d):
    return _lateral(
        s,
        d,
        "SELECT s.doc_key, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.text FROM {sections} s, LATERAL chunk_recursive(s.text, CASE section_id WHEN 'fr' THEN 900 WHEN 'de' THEN 700 ELSE 1200 END, 100) c",
    )


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc_key, CAST(k AS BIGINT) AS chunk_index, substr(text, k * 540 + 1, 600) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST((length(text) - 1) // 540 AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)")
def sql_chunk_slices(s, d):
    return _lateral(s, d, "SELECT s.doc_key, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.text FROM {sections} s, LATERAL chunk_slices(s.text, 600, 60) c")


@query()
def sql_chunk_semantic(s, d):
    return _lateral(s, d, f"SELECT s.doc_key, c.chunk_index, c.text FROM {{sections}} s, LATERAL chunk_semantic(s.text, {SIZE}, {OVERLAP}, 95) c")


@query(
    "WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), "
    "r AS (SELECT doc_id, p, 1 AS i, length(p[1]) AS held, 0 AS chunk FROM s UNION ALL SELECT doc_id, p, i + 1, CASE WHEN held + 1 + length(p[i + 1]) <= 600 THEN held + 1 + length(p[i + 1]) ELSE length(p[i + 1]) END, CASE WHEN held + 1 + length(p[i + 1]) <= 600 THEN chunk ELSE chunk + 1 END FROM r WHERE i < len(p)) "
    "SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(held) AS BIGINT) AS n_chars FROM r GROUP BY 1, 2"
)
def pack_greedy(s, d):
    return chunking.line_packs(table(s, d, "documents"))


@query("SELECT doc_id, CAST(k AS BIGINT) AS i, md5(substr(text, k * 540 + 1, 600)) AS text_md5 FROM (SELECT doc_id, text, unnest(range(0, CAST((length(text) - 1) // 540 AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)")
def chunk_hard_slice(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(chunking.hard_slices(F.col("text"), 600, 60)).alias("i", "t"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


_SENT = "list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n{2,}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_SENTENCES = f"sent AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT} AS s FROM documents)))"


@query(f"WITH {_SENTENCES} SELECT doc_id, i, sentence FROM sent")
def split_sentences(s, d):
    rows = table(s, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", F.col("i").cast("long").alias("i"), "sentence")


_DIST = (
    f"WITH {_SENTENCES},\n"
    + sql_sparse("v", "SELECT doc_id * 100000 + i AS id, sentence AS text FROM sent", 64)
    + """, dot AS (SELECT a.id, sum(a.w * b.w) AS c FROM v a JOIN v b ON b.id = a.id + 1 AND a.idx = b.idx GROUP BY 1),
dist AS (SELECT s.doc_id, s.i, least(2.0, greatest(0.0, 1.0 - coalesce(c, 0))) AS d FROM sent s JOIN sent n ON n.doc_id = s.doc_id AND n.i = s.i + 1 LEFT JOIN dot ON id = s.doc_id * 100000 + s.i)"""
)


def _distances(s, d):
    return chunking.sentence_distances(table(s, d, "documents"), embed=functools.partial(embedding.hashed_rows, dim=64))


@query(_DIST + " SELECT doc_id, i, round(d, 6) AS distance FROM dist")
def sentence_distance(s, d):
    return _distances(s, d).select("doc_id", "i", F.round("distance", 6).alias("distance"))


@query(_DIST + ", thr AS (SELECT doc_id, quantile_cont(round(d, 9), 0.95) AS t FROM dist GROUP BY 1) SELECT doc_id, count(*) AS n_breaks, min(i) AS first_break FROM dist JOIN thr USING (doc_id) WHERE round(d, 9) >= t - 1e-12 GROUP BY 1")
def semantic_breakpoints(s, d):
    return _distances(s, d).filter("jump").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_breaks"), F.min("i").alias("first_break"))


@query("SELECT doc_id, lang AS section_id, CAST(CASE lang WHEN 'fr' THEN 900 WHEN 'de' THEN 700 ELSE 1200 END AS INTEGER) AS section_budget FROM documents")
def structural_budget_lookup(s, d):
    return chunking.budgets(fx.sections(s, d), {"fr": 900, "de": 700}, 1200).select("doc_id", "section_id", "section_budget")


@query(f"WITH {SQL_CHILDREN} SELECT chunk_id, parent_id, chunk_index AS child_index, md5(text) AS text_md5 FROM (SELECT *, regexp_replace(chunk_id, ':c[0-9]+$', '') AS parent_id FROM (SELECT chunk_id, k.chunk_index, text FROM (SELECT chunk_id, text, CAST(regexp_extract(chunk_id, ':c([0-9]+)$', 1) AS BIGINT) AS chunk_index FROM children) k))")
def chunk_parent_child(s, d):
    _, children = fx.family(s, d)
    return children.select("chunk_id", "parent_id", "child_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# ---- vectors and terms ---------------------------------------------------------------------------------------------


@query("WITH " + sql_sparse("v", "SELECT doc_id AS id, text FROM documents") + " SELECT id AS doc_id, idx, round(w, 6) AS w FROM v")
def mock_embed_sparse(s, d):
    v = embedding.sparse(table(s, d, "documents"), "doc_id", "text", DIM)
    return v.select(F.col("id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.round("w", 6).alias("w"))


@query("SELECT vec_id, CAST(i AS BIGINT) AS i, round(CAST(embedding[i + 1] AS DOUBLE) / n, 6) AS x FROM (SELECT vec_id, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n, unnest(range(0, len(embedding))) AS i FROM embeddings)")
def l2_normalize(s, d):
    rows = table(s, d, "embeddings").select("vec_id", F.posexplode(numbers.unit(F.col("embedding"))).alias("i", "x"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(s, d):
    v = table(s, d, "embeddings").select("vec_id", numbers.unit(F.col("embedding")).alias("v"))
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(numbers.dot(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM documents")
def bm25_tokenize(s, d):
    t = text.lexical_tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query("SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2")
def bm25_postings(s, d):
    return lexical.build(table(s, d, "documents").withColumnRenamed("doc_id", "chunk_id")).postings.select("term", F.col("chunk_id").alias("doc_id"), "tf")


@query("WITH " + SQL_CHUNKS + ",\n" + SQL_QUESTIONS + ",\n" + sql_bm25("bm", "questions", "chunks", 5) + " SELECT term, df, round(idf, 6) AS idf FROM bm_i")
def bm25_idf(s, d):
    return lexical.build(fx.chunks(s, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("WITH " + SQL_CHUNKS + ",\n" + SQL_QUESTIONS + ",\n" + sql_bm25("bm", "questions", "chunks", 5) + " SELECT qid, chunk_id, round(score, 6) AS score FROM bm_s")
def bm25_scores(s, d):
    return lexical.scores(lexical.build(fx.chunks(s, d)), fx.questions(s, d)).select("qid", "chunk_id", F.round("score", 6).alias("score"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentile_latency(s, d):
    p = quantiles.percentiles(table(s, d, "events"), "value", [0.5, 0.95], ["event_type"])
    return p.select("event_type", *[F.round(F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)), 6).alias(n) for i, n in enumerate(("p50", "p95"))])


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_MODELS = [m for m, _, _ in numbers.PRICES] + ["unknown"]


@query(
    "WITH e AS (SELECT event_id, list_extract([" + ", ".join(f"'{m}'" for m in _MODELS) + f"], CAST(event_id % {len(_MODELS)} AS INTEGER) + 1) AS model, event_id * 37 % 5000 AS i, event_id * 11 % 900 AS o FROM events) "
    "SELECT event_id, model, round(i / 1e6 * coalesce(a, 0) + o / 1e6 * coalesce(b, 0), 9) AS cost_usd FROM e LEFT JOIN (VALUES " + ", ".join(f"('{m}', {a}, {b})" for m, a, b in numbers.PRICES) + ") AS p(name, a, b) ON model = name"
)
def cost_usd(s, d):
    e = table(s, d, "events").select("event_id", F.get(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % len(_MODELS)).cast("int")).alias("model"), (F.col("event_id") * 37 % 5000).alias("i"), (F.col("event_id") * 11 % 900).alias("o"))
    prices = s.createDataFrame(numbers.PRICES, "model string, a double, b double")
    return e.join(F.broadcast(prices), "model", "left").select("event_id", "model", F.round(numbers.cost(F.col("i"), F.col("o"), F.col("a"), F.col("b")), 9).alias("cost_usd"))


# ---- retrieval -----------------------------------------------------------------------------------------------------

_BASE = "WITH " + SQL_CHUNKS + ",\n" + SQL_QUESTIONS + ",\n"
_FAMILY = "WITH " + SQL_CHILDREN + ",\n" + SQL_QUESTIONS + ",\n"
_SELECT = " SELECT qid, chunk_id, rank, round(score, 6) AS score FROM "
_BOTH = sql_dense("de", "questions", "chunks", 20) + ",\n" + sql_bm25("bm", "questions", "chunks", 20)
_BOTH_CHILD = sql_dense("de", "questions", "children", 20) + ",\n" + sql_bm25("bm", "questions", "children", 20)


@query(_BASE + sql_dense("de", "questions", "chunks", 5) + _SELECT + "de")
def dense_text_topk(s, d):
    return ranked(retrieval.retrieve(fx.bundle(s, d), fx.questions(s, d), "dense", 5))


@query(_BASE + sql_bm25("bm", "questions", "chunks", 5) + _SELECT + "bm")
def bm25_topk(s, d):
    return ranked(fx.bm25(s, d, 5))


@query(_BASE + sql_bm25("bm", "questions", "chunks", 5) + _SELECT + "bm")
def bm25_stored_topk(s, d):
    return ranked(PostingIndex.build(fx.chunks(s, d), shared_folder(s, "postings")).topk(fx.questions(s, d), 5))


@query(_BASE + _BOTH + ",\n" + sql_fuse("rr", ["de", "bm"], "first", 40) + _SELECT + "rr")
def rrf_fuse(s, d):
    b, q = fx.bundle(s, d), fx.questions(s, d)
    return ranked(retrieval.hybrid(retrieval.retrieve(b, q, "dense", 20), retrieval.retrieve(b, q, "bm25", 20), 40))


@query(_BASE + _BOTH + ",\n" + sql_fuse("hy", ["de", "bm"], "first", 5) + _SELECT + "hy")
def hybrid_topk(s, d):
    return ranked(retrieval.retrieve(fx.bundle(s, d), fx.questions(s, d), "hybrid", 5))


@query(_FAMILY + sql_dense("de", "questions", "children", 20) + ",\n" + sql_parents("pa", "de", 5) + _SELECT + "pa")
def parent_doc_topk(s, d):
    return ranked(retrieval.retrieve(fx.family_bundle(s, d), fx.questions(s, d), "parent_doc", 5))


@query(_FAMILY + _BOTH_CHILD + ",\n" + sql_fuse("hy", ["de", "bm"], "first", 40) + ",\n" + sql_parents("pa", "hy", 5) + _SELECT + "pa")
def hybrid_parent_topk(s, d):
    return ranked(retrieval.retrieve(fx.family_bundle(s, d), fx.questions(s, d), "hybrid_parent", 5))


@query(_BASE + sql_bm25("bm", "questions", "chunks", 5) + " SELECT qid, string_agg(printf('%d:%s:%.4f:%s', rank, chunk_id, score, section_id), ';' ORDER BY rank) AS citations FROM bm JOIN chunks USING (chunk_id) GROUP BY 1")
def citations_struct(s, d):
    rows = retrieval.citations(fx.bm25(s, d, 5), fx.chunks(s, d))
    return rows.select("qid", F.array_join(F.transform("citations", lambda c: F.format_string("%d:%s:%.4f:%s", c["rank"], c["chunk_id"], c["score"], c["section_id"])), ";").alias("citations"))


_KEYED = SQL_FORMS + ",\nkeyed AS (SELECT qid || '|' || list_no AS key, qid, list_no, question FROM forms)"


@query(
    _BASE + _KEYED + ",\n" + sql_bm25("bm", "keyed", "chunks", 5, "key") + ",\n" + sql_fuse_of("mq", "SELECT qid, list_no, chunk_id, rank FROM bm JOIN keyed USING (key)", "last, chunk_id", 5) + _SELECT + "mq"
)
def multi_query_fuse(s, d):
    return ranked(retrieval.retrieve_many(fx.bundle(s, d), fx.formulations(s, d), "bm25", 5))


_TRIM = f"regexp_replace({{0}}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"WITH {SQL_QUESTIONS} SELECT qid, CAST(0 AS INTEGER) AS list_no, question FROM questions UNION ALL SELECT qid, 1, {_TRIM.format("question || ' explained'")} FROM questions "
    f"UNION ALL SELECT qid, 2, {_TRIM.format("'details about ' || question")} FROM questions UNION ALL SELECT qid, 3, {_TRIM.format("'what is said on ' || question")} FROM questions"
)
def query_expand(s, d):
    return rerank.expand(fx.questions(s, d))


@query(f"WITH {SQL_QUESTIONS} SELECT qid, 'The filing states that ' || lower(rtrim({_TRIM.format('question')}, '?')) || ' as described in this section.' AS question FROM questions")
def hyde_write(s, d):
    return rerank.hypothetical(fx.questions(s, d))


@query(
    _BASE
    + SQL_FORMS
    + ",\nhyp AS (SELECT qid, question FROM forms WHERE list_no = 2 AND qid % 4 <> 0),\n"
    + sql_bm25("bm", "questions", "chunks", 5)
    + ",\n"
    + sql_bm25("hb", "hyp", "chunks", 5)
    + ",\n"
    + sql_fuse_of("hf", "SELECT qid, 0 AS list_no, chunk_id, rank FROM bm WHERE qid % 4 <> 0 UNION ALL SELECT qid, 1, chunk_id, rank FROM hb", "last, chunk_id", 5)
    + " SELECT qid, chunk_id, rank, round(score, 6) AS score FROM hf UNION ALL SELECT qid, chunk_id, rank, round(score, 6) FROM bm WHERE qid % 4 = 0"
)
def hyde_fuse(s, d):
    b = fx.bundle(s, d)
    hyp = fx.formulations(s, d).filter("list_no = 2 and qid % 4 <> 0").select("qid", "question")
    return ranked(retrieval.with_hypothetical(retrieval.retrieve(b, fx.questions(s, d), "bm25", 5), retrieval.retrieve(b, hyp, "bm25", 5), 5))


@query(
    "WITH c AS (SELECT conv_id, turn, text AS question FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(lower(question), '\\bitem\\s+\\d+[a-z]?\\b') OR contains(lower(question), 'section') OR len(regexp_extract_all(lower(question), '\\S+')) <= 5 THEN 'bm25' ELSE 'hybrid' END AS strategy FROM c"
)
def route_question(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.route(F.col("text")).alias("strategy"))


@query(
    _BASE + sql_bm25("bm", "questions", "chunks", 10)
    + ", j AS (SELECT bm.*, CAST(quality AS DOUBLE) AS m FROM bm LEFT JOIN labels ON doc_id = CAST(substr(chunk_id, 1, 8) AS BIGINT)) SELECT qid, chunk_id, new AS rank, round(score, 6) AS score, m AS model_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m IS NULL, m DESC, round(score, 9) DESC, rank) AS new FROM j) WHERE new <= 5"
)
def rerank_order(s, d):
    top = fx.bm25(s, d, 10).withColumn("doc_id", F.substring("chunk_id", 1, 8).cast("long")).join(table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("model_score")), "doc_id", "left")
    out = rerank.ordered(top.withColumn("score", F.round("score", 9)), 5)
    return out.select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"), "model_score")


@query(
    _BASE + sql_bm25("bm", "questions", "chunks", 10)
    + ", o AS (SELECT bm.*, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM bm JOIN questions USING (qid) JOIN chunks USING (chunk_id)), m AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE) END AS m FROM o) "
    "SELECT qid, chunk_id, new AS rank, round(score, 6) AS score, round(m, 6) AS model_score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m IS NULL, m DESC, round(score, 9) DESC, rank) AS new FROM m) WHERE new <= 5"
)
def rerank_overlap(s, d):
    top = fx.bm25(s, d, 10).withColumn("score", F.round("score", 9))
    out = rerank.rerank(top, fx.questions(s, d), fx.chunks(s, d), 5)
    return out.select("qid", "chunk_id", "rank", F.round("score", 6).alias("score"), F.round("model_score", 6).alias("model_score"))


@query(
    _BASE + sql_dense("de", "questions", "chunks", 5) + ",\n" + sql_bm25("bm", "questions", "chunks", 5)
    + ", x AS (SELECT qid, list(chunk_id) AS a, arg_min(chunk_id, rank) AS a1 FROM de GROUP BY 1), y AS (SELECT qid, list(chunk_id) AS b, arg_min(chunk_id, rank) AS b1 FROM bm GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN a1 = b1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(len(list_intersect(a, b)) / CAST(greatest(1, len(a)) AS DOUBLE)), 6) AS overlap FROM x JOIN y USING (qid)"
)
def parity_overlap(s, d):
    b, q = fx.bundle(s, d), fx.questions(s, d)
    return retrieval.parity(retrieval.retrieve(b, q, "dense", 5), fx.bm25(s, d, 5)).select("n", F.round("top1", 6).alias("top1"), F.round("overlap", 6).alias("overlap"))


# ---- joins ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi_referenced(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_anti_missing(s, d):
    return table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT d.doc_id, CAST(coalesce(quality, -1) AS INTEGER) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_default(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


_NORMED = f"WITH a AS (SELECT item_id AS qid, {SQL_NORM.format('text')} AS s FROM benchmark), b AS (SELECT doc_id, {SQL_NORM.format('text')} AS t FROM documents)"


@query(f"{_NORMED} SELECT qid, doc_id FROM a JOIN b ON {sql_match('s', 't')}")
def join_span_contains(s, d):
    spans = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("span"))
    return metrics.span_matches(spans, table(s, d, "documents").select(F.col("doc_id").alias("text_id"), "text")).select("qid", F.col("text_id").alias("doc_id"))


@query(f"WITH {SQL_OUTCOMES}, a AS (SELECT qid, hit FROM outcomes WHERE strategy = 'first'), b AS (SELECT qid, hit FROM outcomes WHERE strategy = 'bm25') SELECT count(*) AS n, count(*) FILTER (NOT a.hit AND b.hit) AS gained, count(*) FILTER (a.hit AND NOT b.hit) AS lost, count(*) FILTER (NOT a.hit AND b.hit) - count(*) FILTER (a.hit AND NOT b.hit) AS net FROM a JOIN b USING (qid)")
def paired_gain_loss(s, d):
    o = fx.outcomes(s, d)
    return metrics.gain_loss(o.filter("strategy = 'first'"), o.filter("strategy = 'bm25'"))


# ---- metrics -------------------------------------------------------------------------------------------------------

_RUN = f"WITH {SQL_CHUNKS},\n{SQL_QUESTIONS},\n{SQL_QA},\n{sql_bm25('bm', 'questions', 'chunks', 5)},\n{sql_run('run', 'SELECT * FROM bm')}"


@query("SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN trim(text, e' \\t\\n\\r') ELSE '<no relevant span>x' END AS span FROM benchmark")
def normalize_span(s, d):
    k = F.col("item_id") % 4
    raw = F.when(k == 1, "  <no relevant span> ").when(k == 2, F.concat(F.lit(" \t"), F.col("text"), F.lit("\n"))).when(k == 3, "<no relevant span>x")
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), text.normal_span(raw).alias("span"))


@query(f"{_NORMED} SELECT qid, count(*) AS n_docs, min(doc_id) AS first_doc FROM a JOIN b ON {sql_match('s', 't')} GROUP BY 1")
def span_match(s, d):
    return join_span_contains(s, d).groupBy("qid").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query(_RUN + " SELECT qid, qa_type, hit FROM run")
def hit_at_k(s, d):
    return fx.per_question(s, d).select("qid", "qa_type", "hit")


@query(_RUN + " SELECT qid, hit_content FROM run")
def hit_at_k_content(s, d):
    return fx.per_question(s, d).select("qid", "hit_content")


@query(_RUN + " SELECT qid, cite FROM run")
def citation_accuracy(s, d):
    return fx.per_question(s, d).select("qid", "cite")


@query(_RUN + " SELECT qid, cite_content FROM run")
def citation_accuracy_content(s, d):
    return fx.per_question(s, d).select("qid", "cite_content")


_RATE = "round(avg(CASE WHEN {0} THEN 1.0 ELSE 0.0 END), 6) AS {1}"
_RATES = ", ".join(_RATE.format(a, b) for a, b in (("hit", "hit_at_5"), ("cite", "citation_accuracy"), ("hit_content", "hit_at_5_content"), ("cite_content", "citation_accuracy_content")))
_RATE_NAMES = ("hit_at_5", "citation_accuracy", "hit_at_5_content", "citation_accuracy_content")


@query(_RUN + f" SELECT count(*) AS n_questions, {_RATES}, round(avg(latency_ms), 6) AS mean_latency_ms, count(DISTINCT filing) AS n_filings FROM run")
def experiment_summary(s, d):
    out = metrics.summary(fx.per_question(s, d))
    return out.select("n_questions", *[F.round(c, 6).alias(c) for c in _RATE_NAMES], F.round("mean_latency_ms", 6).alias("mean_latency_ms"), "n_filings")


@query("SELECT event_type, round(avg(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE value END), 6) AS mean FROM events GROUP BY 1")
def mean_skip_nan(s, d):
    e = table(s, d, "events").withColumn("x", F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return e.groupBy("event_type").agg(F.round(metrics.mean_of_numbers("x"), 6).alias("mean"))


_STRATEGIES = ("bm25", "first", "rest")


@query(
    f"WITH {SQL_OUTCOMES} SELECT qa_type, count(DISTINCT qid) AS n, "
    + ", ".join(f"round(avg(CASE WHEN strategy = '{x}' THEN CAST(hit AS INTEGER) END), 6) AS {x}_rate, count(CASE WHEN strategy = '{x}' THEN hit END) AS {x}_n" for x in _STRATEGIES)
    + " FROM outcomes JOIN qa USING (qid) GROUP BY 1"
)
def route_table_pivot(s, d):
    q = fx.qa(s, d)
    out = routing.by_type(fx.outcomes(s, d, q), q, list(_STRATEGIES))
    return out.select("qa_type", "n", *[F.round(f"{x}_rate", 6).alias(f"{x}_rate") for x in _STRATEGIES], *[f"{x}_n" for x in _STRATEGIES])


@query(
    f"WITH {SQL_OUTCOMES}, best AS (SELECT qid, max(CAST(hit AS INTEGER)) AS h, max(CAST(cite AS INTEGER)) AS c FROM outcomes GROUP BY 1) "
    "SELECT count(*) AS n, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate, round(avg(CAST(cite AS INTEGER)), 6) AS cite_rate, round(avg(h), 6) AS oracle_hit_rate, round(avg(c), 6) AS oracle_cite_rate FROM outcomes JOIN best USING (qid) WHERE strategy = CASE WHEN qid % 2 = 0 THEN 'first' ELSE 'rest' END"
)
def score_routing(s, d):
    decisions = fx.questions(s, d).select("qid", F.when(F.col("qid") % 2 == 0, "first").otherwise("rest").alias("strategy"))
    out = routing.score(fx.outcomes(s, d), decisions)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "cite_rate", "oracle_hit_rate", "oracle_cite_rate")])


@query(f"WITH {SQL_OUTCOMES} SELECT strategy, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate FROM outcomes GROUP BY 1 ORDER BY round(avg(CAST(hit AS INTEGER)), 9) DESC, strategy LIMIT 1")
def best_single(s, d):
    return routing.best_single(fx.outcomes(s, d)).select("strategy", F.round("hit_rate", 6).alias("hit_rate"))


_CATS = ", ".join(f"('{c}', '{m}', {-1 if not least else 1})" for c, m, least in ledger.CATEGORIES)
_METRICS = ("context_recall", "faithfulness", "answer_relevancy", "hit_at_5", "citation_accuracy", "hit_at_5_content", "citation_accuracy_content")
_LONG = " UNION ALL ".join(f"SELECT exp_name, ord, '{m}' AS metric, {m} AS value FROM ledger" for m in _METRICS)
_WINNERS = (
    f"WITH {SQL_LEDGER}, cat AS (SELECT * FROM (VALUES {_CATS}) AS v(category, metric, sign)), l AS ({_LONG}), r AS (SELECT category, exp_name, value, row_number() OVER (PARTITION BY category ORDER BY sign * value, ord) AS r FROM cat JOIN l USING (metric) WHERE value IS NOT NULL), "
    "w AS (SELECT cat.category, cat.metric, max(CASE WHEN r = 1 THEN exp_name END) AS winner, max(CASE WHEN r = 1 THEN value END) AS winner_value, max(CASE WHEN r = 2 THEN exp_name END) AS runner_up FROM cat LEFT JOIN r USING (category) GROUP BY 1, 2)"
)


@query(_WINNERS + " SELECT category, metric, winner, winner_value, runner_up FROM w")
def leaderboard_winners(s, d):
    return ledger.winners(fx.ledger(s, d))


@query(_WINNERS + " SELECT category, 'winner' AS field, winner AS value FROM w UNION ALL SELECT category, 'runner_up', runner_up FROM w")
def leaderboard_flatten(s, d):
    w = ledger.winners(fx.ledger(s, d))
    return w.select("category", F.explode(F.array(F.struct(F.lit("winner").alias("field"), F.col("winner").alias("value")), F.struct(F.lit("runner_up").alias("field"), F.col("runner_up").alias("value")))).alias("x")).select("category", "x.field", "x.value")


@query(f"WITH {SQL_LEDGER} SELECT exp_name, timestamp, max(timestamp) OVER () AS last_updated FROM ledger")
def leaderboard_history(s, d):
    return ledger.history(fx.ledger(s, d).select("exp_name", "timestamp")).select("exp_name", "timestamp", "last_updated")


_CELL = "CASE WHEN {0} IS NULL THEN '—' WHEN {0} = (SELECT max({0}) FROM ledger) AND (SELECT count(*) FROM ledger l WHERE l.{0} = (SELECT max({0}) FROM ledger)) = 1 THEN '**' || printf('%.4f', {0}) || '**' ELSE printf('%.4f', {0}) END AS {0}"


@query(f"WITH {SQL_LEDGER}, c AS (SELECT exp_name, {', '.join(_CELL.format(m) for m in _METRICS[:3])} FROM ledger) SELECT *, " + " AND ".join(f"starts_with({m}, '**')" for m in _METRICS[:3]) + " AS leads FROM c")
def unique_maxima(s, d):
    return ledger.unique_maxima(fx.ledger(s, d).select("exp_name", *_METRICS[:3]), list(_METRICS[:3]))


_DRIFT = (
    f"WITH {SQL_LEDGER}, two AS (SELECT metric, b.value AS baseline, c.value AS candidate FROM (SELECT * FROM ({_LONG}) WHERE ord = 1) b JOIN (SELECT * FROM ({_LONG}) WHERE ord = 2) c USING (metric)), "
    "t AS (SELECT *, candidate - baseline AS delta, greatest(0.05, 1.96 * sqrt(greatest(0, least(1, baseline)) * (1 - greatest(0, least(1, baseline))) / 40)) AS threshold FROM two), "
    "v AS (SELECT metric, baseline, candidate, round(delta, 4) AS delta, CASE WHEN baseline IS NULL OR candidate IS NULL THEN NULL ELSE round(threshold, 4) END AS threshold, CASE WHEN baseline IS NULL OR candidate IS NULL THEN 'skipped' WHEN delta < -threshold THEN 'BREACH' WHEN delta > threshold THEN 'improved' ELSE 'ok' END AS status FROM t UNION ALL "
    "SELECT 'mean_latency_ms', b.mean_latency_ms, c.mean_latency_ms, NULL, NULL, CASE WHEN b.mean_latency_ms <= 0 THEN 'skipped' WHEN c.mean_latency_ms > 2 * b.mean_latency_ms THEN 'BREACH' ELSE 'ok' END FROM ledger b, ledger c WHERE b.ord = 1 AND c.ord = 2)"
)


@query(_DRIFT + " SELECT * FROM v")
def drift_check(s, d):
    rows = fx.ledger(s, d)
    return ledger.drift(rows.filter("ord = 1"), rows.filter("ord = 2"))


@query(_DRIFT + " SELECT count(*) FILTER (status = 'BREACH') = 0 AS ok, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (status = 'BREACH'), '') AS breaches, coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (status = 'improved'), '') AS improvements FROM v")
def drift_verdict(s, d):
    out = ledger.verdict(drift_check(s, d))
    return out.select("ok", F.array_join("breaches", ",").alias("breaches"), F.array_join("improvements", ",").alias("improvements"))


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS verified FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2")
def qa_counts(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    return rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("verified"))


@query("SELECT user_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(s, d):
    p = quantiles.percentiles(table(s, d, "events"), "value", [0.5, 0.95], ["user_id"])
    return p.select("user_id", F.round(F.get("p", F.lit(0)), 6).alias("p50"), F.round(F.get("p", F.lit(1)), 6).alias("p95"))


@query(_RUN + f" SELECT qa_type, count(*) AS n_questions, {_RATES} FROM run GROUP BY 1")
def by_type_breakdown(s, d):
    return metrics.summary(fx.per_question(s, d), "qa_type").select("qa_type", "n_questions", *[F.round(c, 6).alias(c) for c in _RATE_NAMES])


@query("SELECT source, count(*) AS n, round(avg(quality), 6) AS hit_rate FROM documents JOIN labels USING (doc_id) GROUP BY 1 ORDER BY round(avg(quality), 9), source LIMIT 5")
def worst_sources(s, d):
    rows = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("r"))
    return rows.orderBy(F.round("r", 9), "source").limit(5).select("source", "n", F.round("r", 6).alias("hit_rate"))


@query(_RUN + " SELECT qid, coalesce(bool_or(substr(chunk_id, 1, 8) = substr(source_id, 1, 8)), false) AS same_filing, coalesce(bool_or(split_part(split_part(chunk_id, '::', 1), '_', 2) = split_part(split_part(source_id, '::', 1), '_', 2)), false) AS same_section, coalesce(bool_or(split_part(chunk_id, '::', 1) = split_part(source_id, '::', 1)), false) AS same_both FROM run LEFT JOIN bm USING (qid) GROUP BY 1")
def same_location_hit(s, d):
    rows = fx.per_question(s, d)
    place = lambda c: F.split_part(c, F.lit("::"), F.lit(1))
    any_ = lambda f: F.coalesce(F.exists("retrieved", lambda x: f(x) == f(F.col("source_id"))), F.lit(False))
    return rows.select("qid", any_(lambda x: F.substring(x, 1, 8)).alias("same_filing"), any_(lambda x: F.split_part(place(x), F.lit("_"), F.lit(2))).alias("same_section"), any_(place).alias("same_both"))


@query(f"WITH {SQL_OUTCOMES}, a AS (SELECT qid, hit FROM outcomes WHERE strategy = 'first'), b AS (SELECT qid, hit FROM outcomes WHERE strategy = 'rest') SELECT count(*) FILTER (a.hit AND b.hit) AS shared, count(*) FILTER (a.hit AND NOT b.hit) AS only_a, count(*) FILTER (NOT a.hit AND b.hit) AS only_b, round(avg(CASE WHEN a.hit OR b.hit THEN 1.0 ELSE 0.0 END), 6) AS union_rate FROM a JOIN b USING (qid)")
def run_overlap(s, d):
    o = fx.outcomes(s, d)
    return metrics.run_overlap(o.filter("strategy = 'first'"), o.filter("strategy = 'rest'")).withColumn("union_rate", F.round("union_rate", 6))


@query(f"WITH {SQL_LEDGER} SELECT l.exp_name, round((l.hit_at_5 - b.hit_at_5) * 100, 4) AS hit_at_5, round((l.faithfulness - b.faithfulness) * 100, 4) AS faithfulness FROM ledger l, ledger b WHERE b.ord = 3")
def ledger_delta(s, d):
    rows = fx.ledger(s, d)
    name = "Supplier#000000003" if rows.filter("exp_name = 'Supplier#000000003'").count() else rows.filter("ord = 3").first().exp_name
    return ledger.deltas(rows, name, ["hit_at_5", "faithfulness"])


# ---- picks, chats, answers -----------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(s, d):
    return sampling.latest(table(s, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", tie="o_orderkey")


_CALL_MODELS = {"click": "gemini-2.5-flash", "error": "gemini-2.5-pro", "purchase": "text-embedding-005"}
_CALL_MODEL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CALL_MODELS.items()) + " END"
_RATED = f"(VALUES {', '.join(f"('{m}', {a}, {b})" for m, a, b in numbers.PRICES)}) AS p(model, a, b)"


@query(
    f"WITH calls AS (SELECT strftime(ts, '%Y-%m-%d') AS day, coalesce({_CALL_MODEL}, 'other') AS model, event_id % 997 AS i, event_id % 101 AS o FROM events) "
    f"SELECT day, model, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, round(sum(i / 1e6 * coalesce(a, 0) + o / 1e6 * coalesce(b, 0)), 6) AS cost_usd FROM calls LEFT JOIN {_RATED} USING (model) GROUP BY 1, 2"
)
def cost_log(s, d):
    """Events as calls, priced, appended to a cost log as a block, read back and summed by day and model."""
    kind = F.create_map(*[F.lit(x) for kv in _CALL_MODELS.items() for x in kv])
    calls = table(s, d, "events").select("ts", F.lit("generate").alias("operation"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("other")).alias("model"), (F.col("event_id") % 997).alias("input_tokens"), (F.col("event_id") % 101).alias("output_tokens"), F.lit(0.0).alias("latency_ms"))
    folder = shared_folder(s, "costs")
    records.append_costs(calls, folder)
    rows = records.read_costs(s, folder)
    return rows.groupBy(F.substring("ts", 1, 10).alias("day"), "model").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("SELECT item_id AS qid, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS n_words, CASE WHEN regexp_matches(lower(coalesce(text, '')), '\\bitem\\s+\\d+[a-z]?\\b') OR contains(lower(coalesce(text, '')), 'section') OR len(regexp_extract_all(coalesce(text, ''), '\\S+')) <= 5 THEN 'bm25' ELSE 'hybrid' END AS strategy FROM benchmark")
def answers_in_blocks(s, d):
    """The items as a stream, routed block by block into a sink of whole blocks."""
    items = table(s, d, "benchmark")
    stream = s.readStream.schema(items.schema).parquet(f"{d}/benchmark.parque[t]")
    sink = BlockSink(s, shared_folder(s, "answers"), "parquet")
    route = lambda rows: rows.select(F.col("item_id").alias("qid"), F.size(text.white_tokens(F.col("text"))).cast("long").alias("n_words"), text.route(F.col("text")).alias("strategy"))
    answers.answering(stream, route, sink, shared_folder(s, "answers-checkpoint")).awaitTermination()
    out = sink.read()
    return route(items.limit(0)) if out is None else out


class _FlakyService:
    """A stand-in for a remote scorer: refuses each prompt once for quota, knows no answer for every thirteenth length, and else
    answers with the number of words, ten at most. A thread holds the prompt that it refused last, and no other is kept."""

    def __call__(self, x: tuple) -> str:
        own = self.__dict__.setdefault("own", threading.local())
        prompt = x[0] or ""
        if getattr(own, "refused", None) is not x:
            own.refused = x
            raise remote.QuotaExceeded("Quota exceeded")
        if len(prompt) % 13 == 0:
            raise ValueError("no answer")
        return str(min(10, len(prompt.split())))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) % 13 <> 0 THEN CAST(least(10, len(regexp_extract_all(coalesce(text, ''), '\\S+'))) AS VARCHAR) END AS said, CASE WHEN length(coalesce(text, '')) % 13 = 0 THEN 'ValueError: no answer' END AS said_error FROM documents")
def remote_calls(s, d):
    """Every document asked about through the pool of a service with a quota; no row is lost."""
    rows = table(s, d, "documents").select("doc_id", "text")
    return remote.called(rows, ["text"], "said", _FlakyService(), remote.Limits(concurrent=8, base=0.001)).select("doc_id", "said", "said_error")


_FLAGS = ["A", "N", "R"]


@query(
    "WITH x AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_returnflag) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem) "
    "SELECT l_returnflag, l_orderkey, l_linenumber FROM x WHERE i >= CASE WHEN n > least(10, n) + 1 THEN 1 ELSE 0 END AND i < CASE WHEN n > least(10, n) + 1 THEN 1 ELSE 0 END + least(10, n)"
)
def stratified_slice(s, d):
    rows = table(s, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    return sampling.stratified(rows, "l_returnflag", ["l_orderkey", "l_linenumber"], 30, _FLAGS)


@query(
    "SELECT p_size, CAST(round_even(p_size * 0.4, 0) AS BIGINT) AS lookup, CAST(round_even(p_size * 0.3, 0) AS BIGINT) AS section, CAST(CASE WHEN p_size >= 5 THEN greatest(1, round_even(p_size * 0.2, 0)) ELSE 0 END AS BIGINT) AS synthesis, CAST(CASE WHEN p_size >= 5 THEN greatest(1, round_even(p_size * 0.1, 0)) ELSE 0 END AS BIGINT) AS out_of_scope FROM (SELECT DISTINCT p_size FROM part)"
)
def quota_alloc(s, d):
    rows = table(s, d, "part").select("p_size").distinct()
    return rows.select("p_size", *[c.alias(k) for k, c in sampling.quotas(F.col("p_size")).items()])


@query()
def seeded_shuffle(s, d):
    return sampling.shuffled(table(s, d, "supplier").select("s_suppkey"), 7, "s_suppkey")


@query(f"SELECT doc_id, {sql_match(SQL_NORM.format('substr(text, 11, 80)'), SQL_NORM.format('text'))} AND doc_id % 3 <> 1 OR doc_id % 3 = 2 AS verified FROM documents")
def verify_spans(s, d):
    k = F.col("doc_id") % 3
    span = F.when(k == 0, F.substring("text", 11, 80)).when(k == 1, F.concat(F.lit("zz#"), F.substring("text", 11, 80))).otherwise(F.lit(text.NO_SPAN))
    return table(s, d, "documents").select("doc_id", sampling.verified(F.replace(span, F.lit("|"), F.lit(" ")), F.array(F.replace("text", F.lit("|"), F.lit(" "))), F.lit("lookup")).alias("verified"))


def _sql_u(seed: int, *columns: str) -> str:
    return f"((CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 13)) AS BIGINT) + 0.5) / {2.0**52})"


@query(
    f"SELECT source, doc_id, draw FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY -ln({_sql_u(11, 'source', 'doc_id')}) / n_chars, doc_id) AS draw FROM documents WHERE n_chars > 0) WHERE draw <= 20"
)
def weighted_draw(s, d):
    """Twenty documents of each source, the longer the likelier."""
    return draws.weighted(table(s, d, "documents").select("source", "doc_id", "n_chars"), "n_chars", 20, ["source"], ["source", "doc_id"], 11).select("source", "doc_id", "draw")


@query(f"SELECT o_orderkey, draw FROM (SELECT o_orderkey, row_number() OVER (ORDER BY -ln({_sql_u(5, 'o_orderkey')}) / o_totalprice, o_orderkey) AS draw FROM orders WHERE o_totalprice > 0) WHERE draw <= 1200")
def weighted_draw_large(s, d):
    """Orders by price over the whole table, more of them than Spark limits a window to."""
    return draws.weighted(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1200, [], ["o_orderkey"], 5).select("o_orderkey", "draw")


_DRAW_BUCKETS = ["en", "fr", "de", "es", "it"]
_SPLIT = "regexp_extract_all(coalesce(text, ''), '\\S+')"
_QUOTA_PICKS = f"""few AS (SELECT source, lang, doc_id, {_SPLIT} AS w, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM documents WHERE lang IN ('en', 'fr', 'de', 'es', 'it')),
picks AS (SELECT source, lang, doc_id, w, row_number() OVER (PARTITION BY source ORDER BY {_sql_u(3, 'source', 'doc_id')}, CAST(doc_id AS VARCHAR)) AS pick, {_sql_u(4, 'source', 'doc_id')} AS u, {_sql_u(3, 'source', 'lang')} AS v,
  array_to_string(w[1:20], ' ') AS span FROM few WHERE i > CASE WHEN n > 3 THEN 1 ELSE 0 END AND i <= CASE WHEN n > 3 THEN 1 ELSE 0 END + 2)"""
# what is left of lookup, section and out of scope (4, 3 and 1 at first), pick by pick; kind 0 to 2
_KIND = "CASE WHEN a > 0 THEN CASE WHEN u * (a + b + c) < a THEN 0 WHEN u * (a + b + c) < a + b THEN 1 ELSE 2 END WHEN b > 0 THEN 1 WHEN c > 0 THEN 2 END"
_DRAWN = f"""WITH RECURSIVE {_QUOTA_PICKS},
step AS (SELECT source, CAST(0 AS BIGINT) AS pick, 4 AS a, 3 AS b, 1 AS c, CAST(NULL AS INTEGER) AS kept FROM (SELECT DISTINCT source FROM picks)
  UNION ALL SELECT source, pick, a - CASE WHEN kept = 0 THEN 1 ELSE 0 END, b - CASE WHEN kept = 1 THEN 1 ELSE 0 END, c - CASE WHEN kept = 2 THEN 1 ELSE 0 END, kept
  FROM (SELECT *, CASE WHEN len(w) >= 6 AND (kind = 2 OR length(span) % 3 <> 0) THEN kind END AS kept
    FROM (SELECT s.source, p.pick, a, b, c, w, span, {_KIND} AS kind FROM step s JOIN picks p ON p.source = s.source AND p.pick = s.pick + 1))),
single AS (SELECT source, pick AS ord, lang, doc_id, ['lookup', 'section', 'out_of_scope'][kept + 1] AS qa_type, 'What is said about ' || lower(trim(w[1], '.,')) || ' (' || ['lookup', 'section', 'out_of_scope'][kept + 1] || ')?' AS question,
  CASE WHEN kept = 2 THEN '<no relevant span>' ELSE span END AS source_span FROM step JOIN picks USING (source, pick) WHERE kept IS NOT NULL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY v, lang) AS r FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY pick) AS own FROM picks) WHERE own = 1),
joined AS (SELECT source, count(*) AS n, min(len(w)) AS least, string_agg(lang, ',' ORDER BY r) FILTER (r <= 2) AS lang, arg_min(doc_id, r) AS doc_id, string_agg(lower(trim(w[1], '.,')), ' and ' ORDER BY r) AS names, string_agg(array_to_string(w[1:8], ' '), ' | ' ORDER BY r) AS span, list(lower(array_to_string(w, ' ')) ORDER BY r) AS texts FROM firsts WHERE r <= 3 GROUP BY 1),
asked AS (SELECT * FROM single UNION ALL SELECT source, 1000000, lang, doc_id, 'synthesis', 'How do ' || names || ' relate?', span FROM joined WHERE n >= 2 AND least >= 4
  AND len([x FOR x IN list_zip(string_split(lower(span), '|')[1:len(texts)], texts) IF trim(x[1]) = '' OR NOT contains(x[2], trim(x[1]))]) = 0)
SELECT printf('q_%04d', row_number() OVER (ORDER BY source, ord)) AS id, source, lang, CAST(doc_id AS VARCHAR) AS chunk_id, qa_type, question, source_span FROM asked"""


@query(_DRAWN)
def qa_by_quota(s, d):
    """Questions on each source's documents, languages as its sections; the verifier turns some down."""
    rows = table(s, d, "documents").select("source", "lang", "text", F.col("doc_id").alias("n"), F.col("doc_id").cast("string").alias("chunk_id"))
    return draws.question_set_by_quota(rows, 10, verify=lambda q, span: len(span) % 3 != 0, seed=3, key="source", section="lang", order=("n",), buckets=_DRAW_BUCKETS).drop("verification_reason")


@query()
def qa_generate(s, d):
    return sampling.question_set(fx.chunks(s, d), 10)


_CUT = "CASE WHEN {0} = '' THEN 'New chat' WHEN length({0}) <= 42 THEN {0} ELSE CASE WHEN regexp_extract(substr({0}, 1, 42), '^(.*) ', 1) = '' THEN substr({0}, 1, 42) ELSE regexp_extract(substr({0}, 1, 42), '^(.*) ', 1) END || '…' END"
_CHAT = f"per AS (SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn, arg_min(text, turn) FILTER (role = 'user') AS q FROM conversations GROUP BY 1), chat AS (SELECT conv_id, {_CUT.format('q2')} AS title, n_messages, last_turn FROM (SELECT *, trim(regexp_replace(coalesce(q, ''), '\\s+', ' ', 'g')) AS q2 FROM per))"


@query(f"WITH {_CHAT} SELECT * FROM chat WHERE contains(lower(title), 'the') OR conv_id IN (SELECT conv_id FROM conversations WHERE contains(lower(text), 'the'))")
def chat_search(s, d):
    return chats.search(table(s, d, "conversations"), " THE ")


@query(f"WITH {_CHAT} SELECT * FROM chat")
def chat_summaries(s, d):
    return chats.summaries(table(s, d, "conversations"))


@query(f"SELECT conv_id, turn, {_CUT.format('t')} AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def chat_title(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", text.title(F.col("text")).alias("title"))


@query("SELECT conv_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1")
def chat_first_question(s, d):
    return chats.first_questions(table(s, d, "conversations"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, text FROM conversations WHERE conv_id % 5 <> 1 AND (conv_id % 3 <> 0 OR turn < 2)")
def chat_log(s, d):
    turns, kept = table(s, d, "conversations"), ChatLog(s, shared_folder(s, "chat-log"))
    kept.save(turns)
    kept.save(turns.filter("conv_id % 3 = 0 AND turn < 2"))  # these chats begin anew
    kept.delete(turns.filter("conv_id % 5 = 1").select("conv_id"))
    kept.compact()
    return kept.turns()


_CTX = _BASE + sql_bm25("bm", "questions", "chunks", 3) + ", ctx AS (SELECT qid, list(text ORDER BY rank) AS t, list(chunk_id ORDER BY rank) AS i, list(score ORDER BY rank) AS s FROM bm JOIN chunks USING (chunk_id) GROUP BY 1)"


@query(
    _CTX + " SELECT qid, 'Based on the retrieved filings: ' || substr(replace(t[1], chr(10), ' '), 1, 240) || CASE WHEN length(t[1]) > 240 THEN '...' ELSE '' END || chr(10) || chr(10) || 'Sources:' || chr(10) || array_to_string(list_transform(list_zip(i, s), lambda z: '- [' || z[1] || '] (score=' || printf('%.3f', z[2]) || ')'), chr(10)) AS answer FROM ctx"
)
def mock_answer(s, d):
    return generation.generate(fx.questions(s, d), fx.bm25(s, d, 3), fx.chunks(s, d)).select("qid", "answer")


@query(_CTX + " SELECT qid, md5(array_to_string(list_transform(list_zip(i, t), lambda z: '[' || z[1] || ']' || chr(10) || z[2]), chr(10) || chr(10) || '---' || chr(10) || chr(10))) AS prompt_md5 FROM ctx")
def prompt_assemble(s, d):
    return generation.contexts(fx.bm25(s, d, 3), fx.chunks(s, d)).select("qid", F.md5(generation.prompt(F.col("ctx")).cast("binary")).alias("prompt_md5"))


@query("SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS question_key, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1")
def cache_key_dedupe(s, d):
    return table(s, d, "conversations").filter("role = 'user'").groupBy(text.question_key(F.col("text")).alias("question_key")).agg(F.count(F.lit(1)).alias("n"))

