"""Stand-ins made from the tables at hand, and the same as SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import white_tokens
from marlstone.operators import chunking, generation, lexical, metrics, retrieval
from marlstone.operators.streams import few

SIZE, OVERLAP, DIM = 128, 16, 256


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("doc_key"), F.col("lang").alias("section_id"), "text", "doc_id")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.naive(sections(spark, d), SIZE, OVERLAP)


def family(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return chunking.parent_child(sections(spark, d), SIZE, OVERLAP, 48, 8)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Every item as a question, its whole text."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(white_tokens(F.col("text")), " ").alias("question"), F.col("text").alias("span"))


def formulations(spark: SparkSession, d: str) -> DataFrame:
    """The question, the first half of its words, and the second, as three formulations."""
    q = questions(spark, d)
    w = white_tokens(F.col("question"))
    half = F.floor((F.size(w) + 1) / 2).cast("int")
    texts = F.array(F.col("question"), F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))
    return q.select("qid", F.posexplode(texts).alias("list_no", "question"))


def bundle(spark: SparkSession, d: str) -> retrieval.Bundle:
    return retrieval.Bundle(chunks(spark, d), None, DIM)


def family_bundle(spark: SparkSession, d: str) -> retrieval.Bundle:
    return retrieval.Bundle(*family(spark, d), DIM)


def bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    # k rows a question, used many times over by what is measured on it
    return lexical.topk(lexical.build(chunks(spark, d)), questions(spark, d), k).persist()


def qa(spark: SparkSession, d: str) -> DataFrame:
    """qid, question, span, qa_type, source_id (first chunk of the lowest document that holds the span), filing."""
    q = questions(spark, d)
    docs = sections(spark, d).select(F.struct("doc_key", "section_id").alias("text_id"), "text")
    source = metrics.span_matches(q.select("qid", "span"), docs).groupBy("qid").agg(F.min("text_id").alias("s"))
    kind = F.when(F.col("s").isNull(), "out_of_scope").otherwise(F.get(F.array(*map(F.lit, ("lookup", "section", "synthesis"))), (F.col("qid") % 3).cast("int")))
    return q.join(source, "qid", "left").select("qid", "question", "span", kind.alias("qa_type"), chunking.chunk_id(F.col("s.doc_key"), F.col("s.section_id"), F.lit(0)).alias("id0"), "s").select(
        "qid", "question", "span", "qa_type", F.when(F.col("s").isNotNull(), F.col("id0")).alias("source_id"), F.col("s.doc_key").alias("filing")
    ).persist()


def picked(ranking: DataFrame, own: DataFrame) -> DataFrame:
    """The chunks that a ranking names, k a question, kept: one pass over the others, which stay where they are."""
    return own.join(few(ranking.select("chunk_id").distinct()), "chunk_id", "left_semi").persist()


def per_question(spark: SparkSession, d: str, ranking: DataFrame | None = None, q: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """Scored questions of a run: by BM25 unless another ranking is given; questions and ranked chunks are made unless given."""
    top = bm25(spark, d, 5) if ranking is None else ranking
    q = qa(spark, d) if q is None else q
    own = picked(top, chunks(spark, d)) if own is None else own
    made = generation.generate(q, top, own)
    texts = generation.contexts(top, own).select("qid", F.transform("ctx", lambda c: c["chunk_id"]).alias("retrieved"), F.transform("ctx", lambda c: c["text"]).alias("retrieved_texts"))
    rows = q.join(made, "qid").join(texts, "qid", "left").withColumn("cited_texts", F.col("retrieved_texts"))
    rows = metrics.hits(rows).withColumn("latency_ms", (F.col("qid") * 7 % 101).cast("double"))
    return rows.withColumn("cost_usd", F.col("input_tokens") / 1e6 * 0.075 + F.col("output_tokens") / 1e6 * 0.30)


def outcomes(spark: SparkSession, d: str, q: DataFrame | None = None) -> DataFrame:
    """qid, strategy, hit, cite of three runs: BM25, and BM25 at its first result or at the others. They share one ranking, one
    table of questions and the chunks that are ranked."""
    top = bm25(spark, d, 5)
    q = qa(spark, d) if q is None else q
    own = picked(top, chunks(spark, d))
    five = per_question(spark, d, top, q, own)
    one = per_question(spark, d, top.filter("rank = 1"), q, own)
    two = per_question(spark, d, top.filter("rank >= 2"), q, own)
    out = None
    for name, run in (("bm25", five), ("first", one), ("rest", two)):
        own = run.select("qid", F.lit(name).alias("strategy"), F.col("hit_content").alias("hit"), F.col("cite_content").alias("cite"))
        out = own if out is None else out.unionByName(own)
    return out


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as experiments: made-up metrics in thousandths, some of them null."""
    n = F.col("s_suppkey")
    metric = lambda k: F.when(n % (k + 5) != 0, (n * k * 37 % 1000) / 1000)
    return table(spark, d, "supplier").select(
        F.col("s_name").alias("exp_name"),
        n.alias("ord"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 97).cast("int")), "yyyy-MM-dd").alias("timestamp"),
        F.lit(40).alias("n_questions"),
        *[metric(k).alias(m) for k, m in enumerate(("context_recall", "faithfulness", "answer_relevancy", "hit_at_5", "citation_accuracy", "hit_at_5_content", "citation_accuracy_content"), 2)],
        F.abs("s_acctbal").alias("mean_latency_ms"),
    )


SQL_TOK = """tok AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc_key, lang AS section_id, regexp_extract_all(text, '\\S+') AS w FROM documents)"""


def sql_windows(source: str, key: str, size: int, overlap: int, out: str, ids: str) -> str:
    s = size - overlap
    return f"""{out} AS (SELECT {ids} AS chunk_id, doc_key, section_id, {key}k AS chunk_index, array_to_string(w[k * {s} + 1 : k * {s} + {size}], ' ') AS text
  FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((len(w) - {size}) / {float(s)})) AS BIGINT) + 1)) AS k FROM {source} WHERE len(w) > 0))"""


SQL_CHUNKS = SQL_TOK + ",\n" + sql_windows("tok", "", SIZE, OVERLAP, "chunks", "printf('%s_%s::%04d', doc_key, section_id, k)")
SQL_CHILDREN = (
    SQL_CHUNKS
    + ",\nptok AS (SELECT chunk_id AS parent_id, doc_key, section_id, regexp_extract_all(text, '\\S+') AS w FROM chunks),\n"
    + sql_windows("ptok", "parent_id, ", 48, 8, "children", "printf('%s:c%02d', parent_id, k)")
)
SQL_QUESTIONS = """questions AS (SELECT item_id AS qid, array_to_string(regexp_extract_all(coalesce(text, ''), '\\S+'), ' ') AS question, text AS span FROM benchmark)"""
SQL_FORMS = """forms AS (SELECT qid, 0 AS list_no, question FROM questions UNION ALL
  SELECT qid, 1, array_to_string((regexp_extract_all(question, '\\S+'))[1:(len(regexp_extract_all(question, '\\S+')) + 1) // 2], ' ') FROM questions UNION ALL
  SELECT qid, 2, array_to_string((regexp_extract_all(question, '\\S+'))[(len(regexp_extract_all(question, '\\S+')) + 1) // 2 + 1:], ' ') FROM questions)"""


def sql_sparse(name: str, rows: str, dim: int = DIM) -> str:
    """CTEs that end in `name`(id, idx, w); rows is a query of (id, text)."""
    m = 2 * dim
    half = lambda a: f"(CAST(('0x' || substr(md5(tok), {a}, 16)) AS UBIGINT) % {m})"
    return f"""{name}_t AS (SELECT id, unnest(regexp_extract_all(lower(text), '\\S+')) AS tok FROM ({rows})),
{name}_p AS (SELECT id, CAST(({half(1)} * {2**64 % m} + {half(17)}) % {m} AS BIGINT) AS place FROM {name}_t),
{name}_c AS (SELECT id, place % {dim} AS idx, sum(CASE WHEN place < {dim} THEN 1 ELSE -1 END) AS c FROM {name}_p GROUP BY 1, 2 HAVING c <> 0),
{name}_w AS (SELECT id, idx, sign(c) * ln(1 + abs(c)) AS w FROM {name}_c),
{name} AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}_w)"""


def sql_dense(name: str, asked: str, of: str, k: int, key: str = "qid") -> str:
    """CTEs that end in `name`({key}, chunk_id, rank, score): all chunks are scored."""
    return (
        sql_sparse(f"{name}_q", f"SELECT {key} AS id, question AS text FROM {asked}")
        + ",\n"
        + sql_sparse(f"{name}_d", f"SELECT chunk_id AS id, text FROM {of}")
        + f""",
{name}_s AS (SELECT q.id AS {key}, d.id AS chunk_id, sum(q.w * d.w) AS score FROM {name}_q q JOIN {name}_d d USING (idx) GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT {key}, chunk_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY {key} ORDER BY round(coalesce(score, 0), 9) DESC, chunk_id) AS rank
  FROM (SELECT q.{key}, c.chunk_id FROM {asked} q, {of} c) LEFT JOIN {name}_s USING ({key}, chunk_id)) WHERE rank <= {k})"""
    )


def sql_bm25(name: str, asked: str, of: str, k: int, key: str = "qid") -> str:
    return f"""{name}_t AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {of}),
{name}_d AS (SELECT chunk_id, len(w) AS dl FROM {name}_t),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_d),
{name}_p AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM {name}_t) GROUP BY 1, 2),
{name}_r AS (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {name}_p, {name}_n GROUP BY 1),
{name}_i AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {name}_r) ELSE raw END AS idf FROM {name}_r),
{name}_q AS (SELECT {key}, term, count(*) AS times FROM (SELECT {key}, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM {asked}) GROUP BY 1, 2),
{name}_s AS (SELECT {key}, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_q JOIN {name}_i USING (term) JOIN {name}_p USING (term) JOIN {name}_d USING (chunk_id), {name}_n GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT {key}, chunk_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY {key} ORDER BY round(coalesce(score, 0), 9) DESC, chunk_id) AS rank
  FROM (SELECT q.{key}, c.chunk_id FROM {asked} q, {of} c) LEFT JOIN {name}_s USING ({key}, chunk_id)) WHERE rank <= {k})"""


def sql_fuse(name: str, lists: list[str], order: str, k: int) -> str:
    union = " UNION ALL ".join(f"SELECT qid, {i} AS list_no, chunk_id, rank FROM {x}" for i, x in enumerate(lists))
    return sql_fuse_of(name, union, order, k)


def sql_fuse_of(name: str, union: str, order: str, k: int) -> str:
    return f"""{name}_f AS (SELECT qid, chunk_id, sum(1.0 / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first, max(list_no) AS last FROM ({union}) GROUP BY 1, 2),
{name} AS (SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, {order}) AS rank FROM {name}_f) WHERE rank <= {k})"""


def sql_parents(name: str, ranking: str, k: int) -> str:
    return f"""{name} AS (SELECT qid, parent_id AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best) AS rank
  FROM (SELECT qid, parent_id, min(rank) AS best, arg_min(score, rank) AS score FROM {ranking} JOIN children USING (chunk_id) GROUP BY 1, 2)) WHERE rank <= {k})"""


SQL_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def sql_match(span: str, text: str) -> str:
    return f"({span} <> '' AND {text} <> '' AND (contains({text}, {span}) OR (length({span}) > 100 AND (contains({text}, substr({span}, 1, 100)) OR contains({text}, right({span}, 100))))))"


SQL_QA = f"""nspan AS (SELECT qid, {SQL_NORM.format('span')} AS s FROM questions),
ndoc AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc_key, lang, {SQL_NORM.format('text')} AS t FROM documents),
src AS (SELECT qid, min(doc_key || '_' || lang) AS s FROM nspan JOIN ndoc ON {sql_match('s', 't')} GROUP BY 1),
qa AS (SELECT qid, question, span, CASE WHEN s IS NULL THEN 'out_of_scope' ELSE ['lookup', 'section', 'synthesis'][CAST(qid % 3 AS INTEGER) + 1] END AS qa_type, s || '::0000' AS source_id, substr(s, 1, 8) AS filing
  FROM questions LEFT JOIN src USING (qid))"""


def sql_run(name: str, ranking: str) -> str:
    """CTEs that end in `name`: the scored questions of a ranking."""
    span = SQL_NORM.format("span")
    return f"""{name}_c AS (SELECT qid, list(chunk_id ORDER BY rank) AS ids, list(text ORDER BY rank) AS texts, list(r.score ORDER BY rank) AS scores FROM ({ranking}) r JOIN chunks USING (chunk_id) GROUP BY 1),
{name}_m AS (SELECT DISTINCT qid FROM ({ranking}) r JOIN chunks USING (chunk_id) JOIN questions USING (qid) WHERE {sql_match(span, SQL_NORM.format('chunks.text'))}),
{name} AS (SELECT qa.*, ids, texts,
  CASE WHEN qa_type = 'out_of_scope' THEN NOT coalesce(list_contains(ids, source_id), false) ELSE coalesce(list_contains(ids, source_id), false) END AS hit,
  CASE WHEN qa_type = 'out_of_scope' THEN true ELSE m.qid IS NOT NULL END AS hit_content,
  CASE WHEN qa_type = 'out_of_scope' THEN false ELSE coalesce(list_contains(ids, source_id), false) END AS cite,
  CASE WHEN qa_type = 'out_of_scope' THEN false ELSE m.qid IS NOT NULL END AS cite_content,
  CAST(qa.qid * 7 % 101 AS DOUBLE) AS latency_ms
  FROM qa LEFT JOIN {name}_c USING (qid) LEFT JOIN {name}_m m ON qa.qid = m.qid)"""


SQL_OUTCOMES = ",\n".join(
    [SQL_CHUNKS, SQL_QUESTIONS, SQL_QA, sql_bm25("bm", "questions", "chunks", 5)]
    + [sql_run(n, f"SELECT * FROM bm WHERE {w}") for n, w in (("r5", "true"), ("r1", "rank = 1"), ("r2", "rank >= 2"))]
    + ["outcomes AS (" + " UNION ALL ".join(f"SELECT qid, '{s}' AS strategy, hit_content AS hit, cite_content AS cite FROM {n}" for n, s in (("r5", "bm25"), ("r1", "first"), ("r2", "rest"))) + ")"]
)
SQL_LEDGER = """ledger AS (SELECT s_name AS exp_name, s_suppkey AS ord, strftime(DATE '2024-01-01' + CAST(s_suppkey % 97 AS INTEGER), '%Y-%m-%d') AS timestamp, """ + ", ".join(
    f"CASE WHEN s_suppkey % {k + 5} <> 0 THEN (s_suppkey * {k} * 37 % 1000) / 1000.0 END AS {m}"
    for k, m in enumerate(("context_recall", "faithfulness", "answer_relevancy", "hit_at_5", "citation_accuracy", "hit_at_5_content", "citation_accuracy_content"), 2)
) + ", abs(s_acctbal) AS mean_latency_ms FROM supplier)"


def sql_recursive(name: str, rows: str, overlap: int, separators: tuple[str, ...] = chunking.SEPARATORS) -> str:
    """CTEs that end in `name`(id, size, i, text); rows is a query of (id, size, text). One level of separators after the other:
    too long pieces are split there and packed again by a fold."""
    out = f"{name}_0 AS (SELECT id, size, CASE WHEN regexp_matches(text, '\\S') THEN [text] ELSE [] END AS c FROM ({rows}))"
    for k, sep in enumerate(separators, 1):
        cut = f"e'{sep}'".replace("\n", "\\n")
        fold = (
            f"list_reduce(list_transform(string_split(x, {cut}), lambda p: [p]), lambda acc, p: CASE WHEN len(acc) > 0 AND length(acc[-1]) + {len(sep)} + length(p[1]) <= size THEN acc[1:len(acc) - 1] || [acc[-1] || {cut} || p[1]] "
            "WHEN p[1] = '' THEN acc ELSE acc || p END, CAST([] AS VARCHAR[]))"
        )
        out += f",\n{name}_{k} AS (SELECT id, size, flatten(list_transform(c, lambda x: CASE WHEN length(x) > size AND contains(x, {cut}) THEN {fold} ELSE [x] END)) AS c FROM {name}_{k - 1})"
    slices = f"[x[low + 1 : low + size] FOR low IN range(0, length(x), size - {overlap})]"
    out += f",\n{name}_s AS (SELECT id, size, list_filter(flatten(list_transform(c, lambda x: CASE WHEN length(x) > size THEN {slices} ELSE [x] END)), lambda x: regexp_matches(x, '\\S')) AS c FROM {name}_{len(separators)})"
    return out + f",\n{name} AS (SELECT id, size, i - 1 AS i, c[i] AS text FROM (SELECT id, size, c, unnest(range(1, len(c) + 1)) AS i FROM {name}_s))"
