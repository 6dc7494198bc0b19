"""Every query of the library by name, and SQL for DuckDB that gives the same rows.

The driver's tables have no regulations, so both sides derive them: regulation_type is lang, chemical_type is source,
and the priority goes by doc_id. Sessions, audit records, warehouse and ticket rows come from conversations, events,
part and orders in the same way.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow import schema
from tarnflow.functions import prompts, rules, text, tokens, tools
from tarnflow.operators import audit, compliance, dialog, index, rerank, retrieve
from tarnflow.operators.knowledge import KnowledgeBase
from tarnflow.operators.numbering import numbered
from tarnflow.sources import corpus
from tarnflow.streaming import logs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERY, ENGLISH = "the station of there", ("the", "station", "worthless", "license")
NOW = "2024-06-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal out a table of fewer files than cores, which may have a row group each, so that its scan isn't one task; others stay."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if len(df.inputFiles()) < wanted else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    level = F.element_at(F.array(F.lit("高"), F.lit("中"), F.lit("低")), (F.col("doc_id") % 3 + 1).cast("int"))
    df = df.select("doc_id", F.col("text").alias("content"), F.col("lang").alias("regulation_type"), level.alias("priority"), F.col("source").alias("chemical_type"))
    return spread(df, "doc_id")


DOCS = """docs AS (
    SELECT doc_id, text AS content, lang AS regulation_type, source AS chemical_type,
        CASE doc_id % 3 WHEN 0 THEN '高' WHEN 1 THEN '中' ELSE '低' END AS priority FROM documents)"""
#: The delimiters, as DuckDB's regular expressions have them.
CLASS = r"""[\s,.\-_()\[\]，。：:；"、！？!?]+"""
#: A word of a query as its tokens, one a row.
_GRAMS_OF = "unnest(list_concat([p], list_transform(range(1, length(p)), lambda i: substr(p, i, 2)), list_transform(range(1, length(p) + 1), lambda i: substr(p, i, 1))))"
TOKENS = f"""parts AS (
    SELECT doc_id, p FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(content), '{CLASS}')) AS p FROM docs) WHERE p <> ''),
tokens AS (
    SELECT doc_id, unnest(list_concat([p], list_transform(range(1, length(p)), lambda i: substr(p, i, 2)), list_transform(range(1, length(p) + 1), lambda i: substr(p, i, 1)))) AS term FROM parts)"""
BM25 = f"""{DOCS}, {TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
len AS (SELECT d.doc_id, coalesce(c.n, 0) AS n FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) c USING (doc_id)),
stats AS (SELECT count(*) AS n, avg(n) AS mean FROM len),
q AS (
    SELECT term, count(*) AS times FROM (
        SELECT unnest(list_concat([p], list_transform(range(1, length(p)), lambda i: substr(p, i, 2)), list_transform(range(1, length(p) + 1), lambda i: substr(p, i, 1)))) AS term
        FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS p)) GROUP BY term),
df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term),
scores AS (
    SELECT tf.doc_id, sum(q.times * ln((s.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * len.n / s.mean))) AS score
    FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id CROSS JOIN stats s GROUP BY tf.doc_id)"""


def _top(k: int) -> str:
    return f"top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT {k})"


# --- tokens and index


@query(f"""WITH {DOCS}, p AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(content), '{CLASS}'), lambda x: x <> '') AS ps FROM docs),
    t AS (SELECT doc_id, flatten(list_transform(ps, lambda p: list_concat([p], list_transform(range(1, length(p)), lambda i: substr(p, i, 2)), list_transform(range(1, length(p) + 1), lambda i: substr(p, i, 1))))) AS ts FROM p)
    SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS token_md5 FROM t""")
def tokenize_ngrams(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tokens.length(F.col("content")).alias("n_tokens"), F.md5(tokens.joined(F.col("content")).cast("binary")).alias("token_md5"))


@query(f"WITH {DOCS}, {TOKENS} SELECT doc_id, term, count(*)::BIGINT AS tf FROM tokens GROUP BY doc_id, term")
def term_freq(spark, sf_dir):
    return index.postings(documents(spark, sf_dir)).select("doc_id", "term", "tf")


@query(f"WITH {DOCS}, {TOKENS} SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM tokens GROUP BY term")
def doc_freq(spark, sf_dir):
    return index.doc_freq(index.postings(documents(spark, sf_dir)))


@query(f"WITH {BM25} SELECT n AS n_docs, round(mean, 6) AS avg_doc_len FROM stats")
def corpus_stats(spark, sf_dir):
    return index.corpus_stats(documents(spark, sf_dir)).select("n_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


# --- retrieval


def _scored(spark, sf_dir):
    return retrieve.bm25_scores(documents(spark, sf_dir), QUERY)


@query(f"WITH {BM25}, {_top(10)} SELECT doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM top")
def bm25_topk(spark, sf_dir):
    return retrieve.top(_scored(spark, sf_dir), 10).select("doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scores WHERE score > 0")
def bm25_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scores WHERE score > 0")
def bm25_indexed(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return retrieve.bm25_indexed(index.postings(docs), index.doc_stats(docs), QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM scores WHERE score > 0")
def bm25_saved(spark, sf_dir):
    """From an index that was saved as bucketed tables."""
    base = shared_folder(spark)
    name = "index_" + uuid.uuid4().hex
    index.save(documents(spark, sf_dir), name, base)
    return retrieve.bm25_saved(spark, name, QUERY).select("doc_id", F.round("score", 6).alias("score"))


_PASS = "(chemical_type IS NULL OR chemical_type = '通用' OR lower(chemical_type) = 'src3') AND (regulation_type IS NULL OR lower(regulation_type) = 'en')"


@query(f"WITH {BM25}, {_top(100)} SELECT doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM top JOIN docs USING (doc_id) WHERE {_PASS}")
def bm25_filtered(spark, sf_dir):
    hits = retrieve.top(_scored(spark, sf_dir), 100).where(rerank.passes("SRC3", "EN"))
    return hits.select("doc_id", "rank", F.round("score", 6).alias("score"))


def _rerank_sql(priority: str, fetch: int, terms: bool, where: str = "TRUE") -> str:
    bonus = " + ".join(f"CASE WHEN contains(lower(content), '{t}') THEN 50 ELSE 0 END" for t in ENGLISH) if terms else "0"
    return f"""WITH {BM25}, {_top(fetch)}
    SELECT doc_id, rank::INTEGER AS rank, round(score, 6) AS score, (row_number() OVER (ORDER BY b DESC, rank) - 1)::INTEGER AS position FROM (
        SELECT doc_id, rank, score, round(score + {priority} + {bonus}, 9) AS b FROM top JOIN docs USING (doc_id) WHERE {where} ORDER BY b DESC, rank LIMIT 10)"""


def _reranked(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "rank", F.round("score", 6).alias("score"), "position")


_LEVEL = "CASE priority WHEN '高' THEN 3000 WHEN '中' THEN 2000 WHEN '低' THEN 1000 ELSE 0 END"


@query(_rerank_sql(_LEVEL, 20, True))
def rerank_by_level(spark, sf_dir):
    return _reranked(rerank.regulations(_scored(spark, sf_dir), 10, terms=ENGLISH))


@query(_rerank_sql("0", 20, True))
def rerank_by_type(spark, sf_dir):
    return _reranked(rerank.regulations(_scored(spark, sf_dir), 10, priorities=rerank.PRIORITY_BY_TYPE, terms=ENGLISH))


@query(_rerank_sql(_LEVEL, 20, True, "regulation_type IS NULL OR lower(regulation_type) = 'en'"))
def rerank_filtered(spark, sf_dir):
    return _reranked(rerank.regulations(_scored(spark, sf_dir), 10, regulation="en", terms=ENGLISH))


@query(_rerank_sql("0", 30, False))
def rerank_simple(spark, sf_dir):
    return _reranked(rerank.simple(_scored(spark, sf_dir), 10))


CHUNKS = """paras AS (
    SELECT doc_id, trim(p) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (
        SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]')) AS p, generate_subscripts(regexp_split_to_array(text, '[\\r\\n]'), 1) AS i FROM documents)
    WHERE trim(p) <> ''),
walk AS (
    SELECT doc_id, i, p, length(p) AS size, 0 AS chunk FROM paras WHERE i = 1
    UNION ALL
    SELECT n.doc_id, n.i, n.p, CASE WHEN w.size + length(n.p) > 500 AND w.size > 0 THEN length(n.p) ELSE w.size + length(n.p) END,
        CASE WHEN w.size + length(n.p) > 500 AND w.size > 0 THEN w.chunk + 1 ELSE w.chunk END
    FROM walk w JOIN paras n ON n.doc_id = w.doc_id AND n.i = w.i + 1),
chunked AS (SELECT doc_id, chunk, string_agg(p, chr(10) ORDER BY i) AS content FROM walk GROUP BY doc_id, chunk)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk::INTEGER AS chunk, length(content)::BIGINT AS n_chars, md5(content) AS content_md5 FROM chunked")
def chunk_split(spark, sf_dir):
    c = corpus.chunked(documents(spark, sf_dir))
    return c.select("doc_id", "chunk", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"WITH RECURSIVE {CHUNKS}, {BM25.replace(DOCS, 'docs AS (SELECT doc_id * 100000 + chunk AS doc_id, content FROM chunked)')}, {_top(10)} SELECT doc_id, rank::INTEGER AS rank, round(score, 6) AS score FROM top")
def chunk_bm25(spark, sf_dir):
    c = corpus.chunked(documents(spark, sf_dir)).withColumn("doc_id", F.col("doc_id") * 100000 + F.col("chunk"))
    return retrieve.top(retrieve.bm25_scores(c, QUERY), 10).select("doc_id", "rank", F.round("score", 6).alias("score"))


VECTOR = tuple(round(0.5 - (i * 37 % 64) / 64, 6) for i in range(64))
_COSINE = "list_cosine_similarity(embedding::DOUBLE[], [" + ", ".join(map(str, VECTOR)) + "]::DOUBLE[])"


@query(f"SELECT vec_id AS doc_id, (row_number() OVER (ORDER BY 1 - s, vec_id) - 1)::INTEGER AS rank, round(s, 5) AS score FROM (SELECT vec_id, {_COSINE} AS s FROM embeddings WHERE embedding IS NOT NULL ORDER BY 1 - s, vec_id LIMIT 10)")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieve.vector(v, VECTOR, 10).select("doc_id", "rank", F.round("score", 5).alias("score"))


_NEAR = f"near AS (SELECT *, row_number() OVER (ORDER BY 1 - score, doc_id) - 1 AS rank FROM (SELECT d.doc_id, d.content, {_COSINE} AS score FROM docs d JOIN embeddings e ON e.vec_id = d.doc_id WHERE embedding IS NOT NULL) ORDER BY 1 - score, doc_id LIMIT 20)"


def _hybrid_sql(near: str) -> str:
    return f"""WITH {BM25}, {_top(20)}, {near},
    b AS (SELECT * FROM (SELECT substr(content, 1, 100) AS key, doc_id, score, rank, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY rank DESC) AS n FROM top JOIN docs USING (doc_id)) WHERE n = 1),
    v AS (SELECT * FROM (SELECT substr(content, 1, 100) AS key, doc_id, score, rank, row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY rank DESC) AS n FROM near) WHERE n = 1),
    m AS (SELECT coalesce(b.doc_id, v.doc_id) AS doc_id, 0.5 * coalesce(b.score, 0) + 0.5 * coalesce(v.score, 0) AS score, b.rank AS br, v.rank AS vr FROM b FULL OUTER JOIN v USING (key))
    SELECT doc_id, (row_number() OVER (ORDER BY score DESC, br NULLS LAST, vr NULLS LAST) - 1)::INTEGER AS rank, round(score, 5) AS score, 'Hybrid' AS method
    FROM m ORDER BY score DESC, br NULLS LAST, vr NULLS LAST LIMIT 10"""


def _mode(spark, sf_dir, mode, vector=VECTOR):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = retrieve.search(documents(spark, sf_dir), QUERY, vector, 10, mode, vectors=vectors)
    return found.select("doc_id", "rank", F.round("score", 5).alias("score"), "method")


@query(_hybrid_sql(_NEAR))
def hybrid_topk(spark, sf_dir):
    return _mode(spark, sf_dir, "Hybrid")


@query(_hybrid_sql("near AS (SELECT top.doc_id, content, score, rank FROM top JOIN docs USING (doc_id))"))
def hybrid_fallback(spark, sf_dir):
    return _mode(spark, sf_dir, "hybrid", None)


@query(f"WITH {BM25}, {_top(10)} SELECT doc_id, rank::INTEGER AS rank, round(score, 5) AS score, 'BM25' AS method FROM top")
def search_mode_bm25(spark, sf_dir):
    return _mode(spark, sf_dir, "BM25")


@query(f"WITH {DOCS}, {_NEAR} SELECT doc_id, rank::INTEGER AS rank, round(score, 5) AS score, 'Vector' AS method FROM near WHERE rank < 10")
def search_mode_vector(spark, sf_dir):
    return _mode(spark, sf_dir, "vector")


_WORDS = ("worthless", "idiot", "license", "token")


def _keyword_sql(words: tuple[str, ...]) -> str:
    hits = " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in words)
    return f"""WITH h AS (SELECT doc_id, {hits} AS hits FROM documents),
    b AS (SELECT * FROM h WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 3)
    SELECT * FROM b UNION ALL (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM b) ORDER BY doc_id LIMIT 3)"""


@query(_keyword_sql(_WORDS[:3]))
def keyword_topk(spark, sf_dir):
    return retrieve.keyword_top(documents(spark, sf_dir), "worthless idiot under a license", _WORDS, ("token",)).select("doc_id", "hits")


@query(_keyword_sql(("主轴", "温度")))
def keyword_fallback(spark, sf_dir):
    return retrieve.keyword_top(documents(spark, sf_dir), "nothing known", ("故障",), ("主轴", "温度")).select("doc_id", "hits")


# --- texts and rules


def _said(df: DataFrame) -> DataFrame:
    said = F.element_at(F.array(F.lit("检查温度 205.5 ℃"), F.lit("我叫张三，你叫王工。"), F.lit("阈值≤ 180℃"), F.lit("hello")), (F.col("turn") % 4 + 1).cast("int"))
    return df.select(F.col("conv_id").cast("string").alias("session_id"), "turn", "role", F.concat(said, F.lit("\n1. "), "text", F.lit("\nA) x【注】 y")).alias("content"))


def conversations(spark, sf_dir):
    return _said(table(spark, sf_dir, "conversations"))


TURNS = """turns AS (
    SELECT conv_id::VARCHAR AS session_id, turn, role,
        CASE turn % 4 WHEN 0 THEN '检查温度 205.5 ℃' WHEN 1 THEN '我叫张三，你叫王工。' WHEN 2 THEN '阈值≤ 180℃' ELSE 'hello' END
            || chr(10) || '1. ' || text || chr(10) || 'A) x【注】 y' AS content FROM conversations)"""


def _clean(x: str, letter: bool) -> str:
    line = f"regexp_replace(regexp_replace(l, '^\\s*\\d+\\.\\s*', '', 'g'), '【.*?】\\s*', '', 'g')"
    line = f"regexp_replace({line}, '^\\s*[A-Z]\\)\\s*', '', 'g')" if letter else line
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace({x}, '</?think>', '', 'g'), '[\\r\\n]+'), lambda l: trim({line}, ' ' || chr(9))), lambda y: y <> ''), chr(10))"


@query(f"WITH {TURNS} SELECT session_id, turn, CASE WHEN regexp_matches(lower(content), '{'|'.join(rules.INDUSTRIAL)}') THEN 'IndustrialDiagnostic' ELSE 'SimpleChat' END AS intent FROM turns")
def intent_route(spark, sf_dir):
    return conversations(spark, sf_dir).select("session_id", "turn", rules.intent(F.col("content")).alias("intent"))


@query(f"WITH {TURNS} SELECT session_id, turn, md5({_clean('content', True)}) AS once, md5({_clean(_clean('content', True), True)}) AS twice FROM turns")
def clean_content(spark, sf_dir):
    c = text.clean_content(F.col("content"))
    return conversations(spark, sf_dir).select("session_id", "turn", F.md5(c.cast("binary")).alias("once"), F.md5(text.clean_content(c).cast("binary")).alias("twice"))


@query(f"WITH {TURNS} SELECT session_id, turn, {_clean('content', False)} AS content FROM turns")
def clean_line(spark, sf_dir):
    return conversations(spark, sf_dir).select("session_id", "turn", text.clean_line(F.col("content")).alias("content"))


@query("""WITH p AS (SELECT page_id, 'x<think>' || html || '</think>b<think>' || url AS x FROM pages)
    SELECT page_id, regexp_replace(regexp_replace(x, '(?s)<think>.*?(</think>|$)', '', 'g'), '</think>', '', 'g') AS content FROM p""")
def strip_think(spark, sf_dir):
    x = F.concat(F.lit("x<think>"), "html", F.lit("</think>b<think>"), "url")
    return table(spark, sf_dir, "pages").select("page_id", text.strip_think(x).alias("content"))


def _spoken(spark, sf_dir, *said: str) -> DataFrame:
    """conversations with x: what a turn says in the form that turn % len(said) has; forms are SQL over the turn's columns."""
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.expr(_case("turn", *said)).alias("x"))


def _case(number: str, *values: str) -> str:
    """The value by a number's remainder; the same text is SQL for Spark and for DuckDB."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_TOOL = "'Tool' || conv_id"
_CALLS = (f"text || '【工具调用】: GetSpindleTemperature,' || {_TOOL}", "'【工具调用】:无'", f"text || '【工具调用】:Calculate(1+2), -,' || {_TOOL}", "text || ' GetCurrentTime'", "text || ' 不需要 WebSearch'")
_NONE = "[]::VARCHAR[]"


def _expected(**columns: tuple[str, ...]) -> str:
    return "SELECT conv_id, turn, " + ", ".join(f"{_case('turn', *v)} AS {k}" for k, v in columns.items()) + " FROM conversations"


@query(_expected(
    strict=(f"[': GetSpindleTemperature', {_TOOL}]", "[':无']", f"[':Calculate(1+2)', {_TOOL}]", _NONE, _NONE),
    clean=(f"['GetSpindleTemperature', {_TOOL}]", _NONE, f"['Calculate(1+2)', {_TOOL}]", _NONE, _NONE)))
def parse_tools_a(spark, sf_dir):
    x = F.col("x")
    return _spoken(spark, sf_dir, *_CALLS).select("conv_id", "turn", rules.tools_marked(x, strict=True).alias("strict"), rules.tools_marked(x).alias("clean"))


@query(_expected(tools=(f"['GetSpindleTemperature', {_TOOL}]", "['无']", f"['Calculate1+2', {_TOOL}]", _NONE, _NONE)))
def parse_tools_b(spark, sf_dir):
    return _spoken(spark, sf_dir, *_CALLS).select("conv_id", "turn", rules.tools_stripped(F.col("x")).alias("tools"))


@query(_expected(tools=(f"['GetSpindleTemperature', {_TOOL}]", _NONE, f"['Calculate1+2', {_TOOL}]", _NONE, _NONE)))
def parse_tools_c(spark, sf_dir):
    return _spoken(spark, sf_dir, *_CALLS).select("conv_id", "turn", rules.tools_squeezed(F.col("x")).alias("tools"))


@query(_expected(tools=("['GetSpindleTemperature']", _NONE, "['Calculate']", "['GetCurrentTime']", _NONE)))
def parse_tools_d(spark, sf_dir):
    return _spoken(spark, sf_dir, *_CALLS).select("conv_id", "turn", rules.tools_named(F.col("x")).alias("tools"))


@query(_expected(needs_tools=("true", "true", "true", "false"), tool_names=(f"['GetCurrentTime', {_TOOL}]", _NONE, f"[{_TOOL}]", _NONE)))
def parse_tools_e(spark, sf_dir):
    listed = f"concat('需要工具: 是', chr(10), '工具列表: GetCurrentTime, ', {_TOOL}, ',无,GetCurrentTime')"
    v = _spoken(spark, sf_dir, listed, "'需要工具:否'", f"'需要工具: ' || {_TOOL}", "text")
    return v.select("conv_id", "turn", F.inline(F.array(rules.tools_planned(F.col("x")))))


@query(f"""WITH {TURNS} SELECT session_id, turn, contains(content, '温度') OR contains(content, '阈值') AS needs_tools,
    CASE WHEN contains(content, '温度') OR contains(content, '阈值') THEN 'GetSpindleTemperature,GetTemperatureThreshold' ELSE '' END AS tools FROM turns""")
def tool_plan(spark, sf_dir):
    p = conversations(spark, sf_dir).withColumn("p", rules.tool_plan(F.col("content")))
    return p.select("session_id", "turn", F.col("p.needs_tools").alias("needs_tools"), F.array_join("p.tool_names", ",").alias("tools"))


@query(f"""WITH {TURNS} SELECT session_id, turn, tool, CASE tool WHEN 'GetTemperatureThreshold' THEN '{tools.THRESHOLD}' ELSE '未知工具: ' || tool END AS result
    FROM (SELECT session_id, turn, unnest(['GetTemperatureThreshold', 'Unknown']) AS tool FROM turns)""")
def tool_call(spark, sf_dir):
    calls = conversations(spark, sf_dir).select("session_id", "turn", F.explode(F.array(F.lit("GetTemperatureThreshold"), F.lit("Unknown"))).alias("tool"))
    return tools.call(calls, spark.createDataFrame([("GetTemperatureThreshold", tools.THRESHOLD)], "tool string, result string")).select("session_id", "turn", "tool", "result")


_NAMES = "'李' || conv_id", "'王' || conv_id"
_BOTH = f"'你叫 ' || {_NAMES[0]} || '，我叫 ' || {_NAMES[1]} || '！'", f"'我叫 ' || {_NAMES[1]} || '，你叫 ' || {_NAMES[0]} || '！'"


@query(_expected(answer=(_BOTH[0], _BOTH[0], _BOTH[1], "'你好！之前检查的温度是 ' || turn || ' ℃。还有什么需要我帮你的吗？'", "'安全阈值是 ≤ ' || turn || '℃。'", f"'你叫 ' || {_NAMES[0]} || '！'", "NULL")))
def memory_answer(spark, sf_dir):
    asked = [f"text || '{q}'" for q in ("我是谁？", "我的名字", "你是谁", "刚才温度多少", "安全吗", "我是谁", "你叫什么")]
    known = "turn % 7 < 5"
    q = _spoken(spark, sf_dir, *asked).selectExpr("conv_id", "turn", "x", f"CASE WHEN turn % 7 < 6 THEN {_NAMES[0]} END AS u", f"CASE WHEN {known} THEN {_NAMES[1]} END AS a", f"CASE WHEN {known} THEN turn || ' ℃' END AS s", f"CASE WHEN {known} THEN '≤ ' || turn || '℃' END AS l")
    return q.select("conv_id", "turn", rules.memory_answer(*map(F.col, "xuasl")).alias("answer"))


@query(_expected(user_name=(_NAMES[0], "'谁？'", f"{_NAMES[0]} || '工程师'", "NULL"), assistant_name=(_NAMES[1], "NULL", "NULL", "NULL")))
def name_extract(spark, sf_dir):
    v = _spoken(spark, sf_dir, f"concat(text, '你好，我叫', {_NAMES[0]}, '，你叫', {_NAMES[1]})", "text || '我是谁？'", f"concat('我叫', {_NAMES[0]}, '工程师')", "text")
    return v.select("conv_id", "turn", rules.user_name(F.col("x")).alias("user_name"), rules.assistant_name(F.col("x")).alias("assistant_name"))


@query(f"""WITH {TURNS} SELECT session_id, turn, CASE WHEN turn % 4 = 0 THEN nullif(regexp_extract(content, '(\\d+(\\.\\d+)?)\\s*℃', 0), '') END AS temperature,
    CASE WHEN turn % 4 = 2 THEN nullif(regexp_extract(content, '≤?\\s*(\\d+(\\.\\d+)?)\\s*℃', 0), '') END AS threshold FROM turns""")
def fact_regex(spark, sf_dir):
    c = F.col("content")
    return conversations(spark, sf_dir).select("session_id", "turn", rules.temperature(c).alias("temperature"), rules.threshold(c).alias("threshold"))


@query(f"""WITH {TURNS}, f AS (
    SELECT session_id, turn, 'user_name' AS key, '张三' AS value FROM turns WHERE role = 'user' AND turn % 4 = 1
    UNION ALL SELECT session_id, turn, 'assistant_name', '王工' FROM turns WHERE role = 'user' AND turn % 4 = 1
    UNION ALL SELECT session_id, turn, '主轴温度', '205.5 ℃' FROM turns WHERE role = 'assistant' AND turn % 4 = 0
    UNION ALL SELECT session_id, turn, '安全阈值', '≤ 180℃' FROM turns WHERE role = 'assistant' AND turn % 4 = 2)
    SELECT session_id, key, arg_max(value, turn) AS value FROM f GROUP BY session_id, key""")
def fact_latest(spark, sf_dir):
    return dialog.latest(dialog.facts(conversations(spark, sf_dir)))


_LANGUAGES = ("en", "de", "fr", "es")


@query(f"SELECT doc_id, {_case('doc_id', repr('甲苯'), repr('通用'), repr('硫酸'), repr('甲苯'))} AS chemical_type FROM documents")
def file_classify(spark, sf_dir):
    name = _case("doc_id", "concat('甲苯储存规范', doc_id)", "concat(source, '通则')", "concat(doc_id, '浓硫酸.txt')", "'盐酸与甲苯'")
    return table(spark, sf_dir, "documents").select("doc_id", rules.chemical_type(F.expr(name)).alias("chemical_type"))


_LINE = "regexp_replace(regexp_replace({x}, '\\r?\\n', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
_CASES = f"""SELECT doc_id, 0 AS pos, '案例' || {_LINE.format(x='lang')} AS content FROM documents
    UNION ALL SELECT doc_id, 1, '案例' || {_LINE.format(x="'1 ' || text || chr(10)")} FROM documents
    UNION ALL SELECT doc_id, 2, '案例' || {_LINE.format(x="'2 ' || source")} FROM documents"""


def _case_texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("concat(lang, '案例1 ', text, chr(10), '案例2 ', source)").alias("text"))


@query(_CASES)
def case_split(spark, sf_dir):
    return _case_texts(spark, sf_dir).select("doc_id", F.posexplode(corpus.cases(F.col("text"))).alias("pos", "content"))


_LIMITS = "SELECT p_partkey, '型号X' || p_partkey || '：安全阈值' || p_size || '，异常阈值' || (p_size + 20) AS content FROM part WHERE p_partkey % 3 <> 1"


def _limit_lines(spark, sf_dir) -> DataFrame:
    line = _case("p_partkey", "concat_ws(',', 'X' || p_partkey, p_size, p_size + 20)", "concat('bad,', p_size)", "concat_ws(',', 'X' || p_partkey, p_size, p_size + 20, 7)")
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(line).alias("line"))


@query(_LIMITS)
def csv_threshold(spark, sf_dir):
    return _limit_lines(spark, sf_dir).select("p_partkey", corpus.threshold_sentence(F.col("line")).alias("content")).where("content IS NOT NULL")


@query(f"SELECT content FROM ({_CASES}) UNION ALL SELECT content FROM ({_LIMITS})")
def knowledge_union(spark, sf_dir):
    return corpus.knowledge(_case_texts(spark, sf_dir), _limit_lines(spark, sf_dir))


@query("SELECT doc_id, lang AS regulation_type FROM documents")
def source_union(spark, sf_dir):
    """One source for each language, and one of what has another or none."""
    docs = documents(spark, sf_dir).select("doc_id", "regulation_type")
    known = F.coalesce(F.col("regulation_type").isin(*_LANGUAGES), F.lit(False))
    first, *rest = [docs.where(~known), *(docs.where(F.col("regulation_type") == x) for x in _LANGUAGES)]
    for df in rest:
        first = first.unionByName(df)
    return first


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT page_id, concat('【1】', url, chr(10), '摘要：', chr(10), '来源：u', page_id, chr(10), chr(10), '【2】c', chr(10), '摘要：', html, chr(10), '来源：', url, chr(10), chr(10)) AS content FROM pages")
def web_results(spark, sf_dir):
    hit = lambda name, snippet, url: F.struct(name.alias("name"), snippet.alias("snippet"), url.alias("url"))
    first = hit(F.col("url"), F.lit(None).cast("string"), F.concat(F.lit("u"), F.col("page_id").cast("string")))
    body = F.to_json(F.struct(F.struct(F.array(first, hit(F.lit("c"), F.col("html"), F.col("url"))).alias("value")).alias("webPages")))
    return table(spark, sf_dir, "pages").select("page_id", tools.web_results(body).alias("content"))


@query("SELECT conv_id, turn, 'https://api.search.bing.com/v7.0/search?q=' || url_encode(text || ' *~+' || chr(10)) || '&count=5&mkt=zh-CN' AS url FROM conversations")
def search_url(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tools.search_url(F.concat("text", F.lit(" *~+\n"))).alias("url"))


@query("""SELECT conv_id, turn, concat_ws(chr(10), '【内容大纲】', '一、问题分析', '  1.1 用户问题：' || text, CASE WHEN turn % 2 = 0 THEN '二、工具调用结果' || chr(10) || '  2.1 Calculate' || chr(10) || '  2.2 Tool' || conv_id END,
    '三、诊断结论', '  3.1 问题判断', '  3.2 故障原因', '  3.3 整改建议', '') AS outline FROM conversations""")
def outline(spark, sf_dir):
    called = F.when(F.col("turn") % 2 == 0, F.array(F.lit("Calculate"), F.expr(_TOOL))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.outline(F.col("text"), called).alias("outline"))


@query(f"""WITH {BM25}, {_top(5)}, p AS (
    SELECT concat('你是化工园区危化品合规审核专家，请根据以下参考法规对用户的巡检内容进行合规审核:', chr(10), chr(10), '参考法规:', chr(10),
        string_agg((rank + 1) || '. ' || content, chr(10) ORDER BY rank), chr(10), chr(10), '用户巡检内容:', chr(10), '{QUERY}', chr(10), chr(10),
        array_to_string(['请按以下格式输出审核结论:', '1. 是否合规: [是/否]', '2. 违规点: [如有]', '3. 法规依据: [引用具体条款]', '4. 整改建议: [详细说明]', ''], chr(10))) AS prompt
    FROM top JOIN docs USING (doc_id))
    SELECT md5(prompt) AS prompt_md5, '[' || length(prompt) || '] ' || substr(prompt, 1, 50) AS conclusion, '巡检内容: {QUERY}...' AS details FROM p""")
def compliance_check(spark, sf_dir):
    checked = compliance.check(documents(spark, sf_dir), QUERY)
    log = compliance.recorded(spark.createDataFrame([], schema.AUDIT), checked, F.lit(NOW).cast("timestamp"))
    return checked.crossJoin(F.broadcast(log.select("details"))).select(F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), "conclusion", "details")


@query("""SELECT event_id, '主轴实时温度：' || event_id || '℃' AS reading, '""" + tools.THRESHOLD + """' AS threshold, strftime(ts, '%Y年%m月%d日 %H:%M:%S') AS at FROM events""")
def registered_tools(spark, sf_dir):
    tools.register(spark)
    return table(spark, sf_dir, "events").selectExpr("event_id", "GetSpindleTemperature(CAST(event_id AS INT)) AS reading", "GetTemperatureThreshold() AS threshold", "GetCurrentTime(ts) AS at")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id / 4.0::DOUBLE END AS value, concat('【1】', url, chr(10), '摘要：', html, chr(10), '来源：', chr(10), chr(10)) AS hits FROM pages""")
def registered_answers(spark, sf_dir):
    """The two tools that compute, called from SQL."""
    tools.register(spark)
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("url").alias("name"), F.col("html").alias("snippet"))).alias("value")).alias("webPages")))
    rows = table(spark, sf_dir, "pages").select("page_id", body.alias("body"), F.expr("CASE WHEN page_id % 2 = 0 THEN page_id || ' / 4' ELSE 'import ' || page_id END").alias("x"))
    return rows.selectExpr("page_id", "Calculate(x) AS value", "WebSearch(body) AS hits")


class Flaky:
    """A model that answers a prompt at the third try, or never where its length is divisible by four."""

    def __init__(self) -> None:
        self.tries: dict[str, int] = {}

    def __call__(self, prompt: str) -> str:
        self.tries[prompt] = self.tries.get(prompt, 0) + 1
        if len(prompt) % 4 == 0 or self.tries[prompt] % 3:
            raise TimeoutError("busy")
        return tools.stub(prompt)


@query("SELECT conv_id, turn, CASE WHEN length(text) % 4 = 0 THEN '错误: busy' ELSE '[' || length(text) || '] ' || substr(text, 1, 50) END AS answer FROM conversations")
def generated_retry(spark, sf_dir):
    """A model that fails is asked three times; what failed to the end has the error's text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tools.generate(F.col("text"), Flaky()).alias("answer"))


# --- sessions and audit


@query(f"WITH {TURNS} SELECT session_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM turns) WHERE n <= 3")
def history_last_n(spark, sf_dir):
    return dialog.last_turns(conversations(spark, sf_dir), 3)


@query(f"""WITH {TURNS} SELECT session_id, '【对话上下文】' || chr(10) || string_agg(role || ': ' || {_clean('content', True)}, chr(10) ORDER BY turn) AS summary
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM turns) WHERE n <= 5 GROUP BY session_id""")
def context_summary(spark, sf_dir):
    return dialog.context(conversations(spark, sf_dir))


@query(f"WITH {TURNS} SELECT session_id, count(*)::BIGINT AS n_turns FROM turns GROUP BY session_id")
def history_count(spark, sf_dir):
    return dialog.count(conversations(spark, sf_dir))


@query(f"WITH {TURNS} SELECT session_id, turn, md5({_clean('content', True)}) AS content_md5 FROM turns WHERE session_id IN (SELECT user_id::VARCHAR FROM events)")
def known_sessions(spark, sf_dir):
    """Turns are written for the sessions that events know, and dropped for all others."""
    new = conversations(spark, sf_dir)
    sessions = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"))
    return dialog.append(new.limit(0), new, sessions).select("session_id", "turn", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""SELECT user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '{NOW}' ELSE max(ts) END AS last_updated, CASE WHEN user_id % 2 = 0 THEN 0 ELSE count(*) END::BIGINT AS n_turns
    FROM events GROUP BY user_id""")
def clear_history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), "ts")
    sessions = e.groupBy("session_id").agg(F.max("ts").alias("last_updated"))
    turns, sessions = dialog.clear_history(e, sessions, sessions.where("session_id % 2 = 0"), F.lit(NOW).cast("timestamp"))
    return sessions.join(dialog.count(turns), "session_id", "left").select("session_id", F.col("last_updated").cast(table(spark, sf_dir, "events").schema["ts"].dataType).alias("last_updated"), F.coalesce("n_turns", F.lit(0)).alias("n_turns"))


@query("SELECT user_id AS session_id, max(ts) AS last_updated FROM events GROUP BY user_id HAVING (SELECT max(ts) FROM events) - max(ts) > INTERVAL 30 MINUTE")
def session_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_updated"))
    return dialog.expired(s.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now"), 1800).select("session_id", "last_updated")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def session_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return dialog.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "at").select("user_id", "event_id")


def audit_log(spark, sf_dir):
    return audit_records(table(spark, sf_dir, "events"))


def audit_records(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("operation"), F.col("props").alias("details"), F.col("ts").alias("create_time"))


_SPAN = "(SELECT min(ts) + INTERVAL 1 HOUR AS a, min(ts) + INTERVAL 49 HOUR AS b FROM events)"


def _span(log: DataFrame):
    """First time plus 1 and 49 hours: one row."""
    a = log.agg((F.min("create_time") + F.expr("INTERVAL 1 HOUR")).alias("a"), (F.min("create_time") + F.expr("INTERVAL 49 HOURS")).alias("b")).first()
    return a["a"], a["b"]


@query(f"SELECT event_id AS id, user_id::VARCHAR AS user_id, event_type AS operation FROM events, {_SPAN} WHERE ts BETWEEN a AND b AND user_id <> -1")
def audit_filter(spark, sf_dir):
    log = audit_log(spark, sf_dir)
    return audit.find(log, *_span(log)).select("id", "user_id", "operation")


@query("SELECT event_id AS id FROM events WHERE user_id = 7")
def audit_user(spark, sf_dir):
    return audit.find(audit_log(spark, sf_dir), user="7").select("id")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS k FROM events, {_SPAN} WHERE ts BETWEEN a AND b)
    SELECT strftime(ts, '%Y-%m-%d') AS day, (k // 1000)::BIGINT AS block, count(*)::BIGINT AS n,
    string_agg('[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] 用户:' || user_id || ' 操作:' || event_type || chr(10) || '  详情: ' || props, chr(10) ORDER BY k) AS report
    FROM r GROUP BY 1, 2""")
def audit_report(spark, sf_dir):
    log = audit_log(spark, sf_dir)
    return audit.report(log, *_span(log))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE value > 50)::BIGINT AS passed, round(100.0 * count(*) FILTER (WHERE value > 50) / count(*), 1)::DOUBLE AS rate FROM events")
def pass_rate(spark, sf_dir):
    return audit.pass_rate(table(spark, sf_dir, "events").select((F.col("value") > 50).alias("passed")))


@query("SELECT event_id AS id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def audit_retention(spark, sf_dir):
    log = audit_log(spark, sf_dir)
    rows = log.crossJoin(F.broadcast(log.agg(F.max("create_time").alias("now"))))
    return audit.retained(rows, F.col("now"), 10).select("id")


# --- connectors and tools


@query("SELECT p_partkey, p_type AS chemical_name, p_retailprice AS quantity FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def warehouse_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    records = p.select("p_partkey", F.col("p_type").alias("chemical_name"), F.col("p_retailprice").alias("quantity"))
    return corpus.warehouse(records, p.agg(F.min("p_type")).first()[0])


@query("SELECT o_orderkey AS ticket_id, o_orderpriority AS priority, true AS is_completed FROM orders WHERE o_orderstatus = 'F'")
def ehs_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return corpus.tickets(o.select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderstatus") == "F").alias("is_completed")), True)


@query("""SELECT md5(text) AS content_md5, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '通用' END AS regulation_type, '中' AS priority, coalesce(source, '通用') AS chemical_type, len(embedding)::INTEGER AS width
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def document_sink(spark, sf_dir):
    """Documents are appended with defaults and their vectors, and read back."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    d = table(spark, sf_dir, "documents").join(vectors, F.col("vec_id") == F.col("doc_id"), "left")
    rows = d.select(F.col("text").alias("content"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END").alias("regulation_type"), F.col("source").alias("chemical_type"), "embedding")
    path = shared_folder(spark)
    written = corpus.write_documents(rows, path, F.lit(NOW).cast("timestamp"), embed=lambda _: F.col("embedding"))
    return spark.read.schema(written.schema).parquet(path).select(F.md5(F.col("content").cast("binary")).alias("content_md5"), "regulation_type", "priority", "chemical_type", F.size("embedding").alias("width"))


@query("SELECT event_id, '主轴实时温度：' || floor(value)::BIGINT || '℃' AS reading, value > 180 AS above FROM events WHERE value IS NOT NULL")
def sensor_threshold(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").where(value.isNotNull()).select("event_id", tools.reading(value).alias("reading"), tools.above(value).alias("above"))


@query(_expected(leaves=("true", "true", "false", "false", "false"), clears=("false", "false", "true", "false", "false"), asks=("false", "false", "false", "true", "false")))
def commands(spark, sf_dir):
    x = F.col("x")
    said = _spoken(spark, sf_dir, "' EXIT '", "'退出'", "'Clear'", "'历史'", "text")
    return said.select("conv_id", "turn", *[rules.is_command(x, names).alias(c) for c, names in (("leaves", rules.EXIT), ("clears", rules.CLEAR), ("asks", rules.HISTORY))])


@query(f"""WITH {TURNS} SELECT session_id, turn, tool, CASE tool WHEN 'GetSpindleTemperature' THEN '主轴实时温度：205℃' ELSE '{tools.THRESHOLD}' END AS result
    FROM (SELECT session_id, turn, unnest(['GetSpindleTemperature', 'GetTemperatureThreshold']) AS tool FROM turns WHERE contains(content, '温度') OR contains(content, '阈值'))""")
def plan_execute(spark, sf_dir):
    """Each turn's plan, and the results of the tools that it names."""
    planned = conversations(spark, sf_dir).select("session_id", "turn", F.explode(rules.tool_plan(F.col("content"))["tool_names"]).alias("tool"))
    known = spark.range(1).select(F.explode(F.create_map(F.lit("GetSpindleTemperature"), tools.reading(F.lit(205.5)), F.lit("GetTemperatureThreshold"), F.lit(tools.THRESHOLD))).alias("tool", "result"))
    return tools.call(planned, known).select("session_id", "turn", "tool", "result")


@query("SELECT conv_id, turn, '[' || length(text) || '] ' || substr(text, 1, 50) AS answer FROM conversations")
def generated(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tools.generate(F.col("text")).alias("answer"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS n FROM events")
def dense_ids(spark, sf_dir):
    return numbered(table(spark, sf_dir, "events").select("event_id", "ts"), F.col("ts").desc(), F.col("event_id")).select("event_id", "n")


@query("""SELECT row_number() OVER (ORDER BY text) - 1 AS doc_id, md5(text) AS content_md5, NULL::VARCHAR AS regulation_type FROM documents
    UNION ALL SELECT (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY html) - 1, md5(html), 'page' FROM pages""")
def kb_insert(spark, sf_dir):
    """Two batches: ids of the second go on from the count of the first."""
    kb = KnowledgeBase(spark).add(table(spark, sf_dir, "documents").select(F.col("text").alias("content")))
    kb.add(table(spark, sf_dir, "pages").select(F.col("html").alias("content"), F.lit("page").alias("regulation_type")))
    return kb.docs.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "regulation_type")


@query(f"WITH {DOCS} SELECT doc_id, concat_ws('|', nullif(regulation_type, ''), priority, nullif(chemical_type, '')) AS metadata FROM docs")
def document_metadata(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("source_file", F.lit(""))
    return d.select("doc_id", F.array_join(F.map_values(corpus.metadata(d)), "|").alias("metadata"))


@query(f"SELECT p_partkey, ({_case('p_partkey', 'p_partkey + p_size * 3', '(p_partkey + p_size) * 3', '-p_partkey / 2.0::DOUBLE', 'NULL', 'NULL')})::DOUBLE AS value FROM part")
def calculate(spark, sf_dir):
    x = _case("p_partkey", "concat(p_partkey, '+', p_size, '*3')", "concat('(', p_partkey, ' + ', p_size, ') * 3')", "concat('-', p_partkey, '/2')", "concat(p_partkey, '/0')", "concat('open(', p_partkey, ')')")
    return table(spark, sf_dir, "part").select("p_partkey", tools.calculate(F.expr(x)).alias("value"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS preview FROM documents")
def result_preview(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.preview(F.col("content")).alias("preview"))


#: Files that a task writes where each row is one.
FILES_PER_TASK = 512
#: Tasks move their files themselves, not the driver all of them; and a local folder gets no checksum file beside each, which with
#: its permissions takes more time than the file.
SMALL_FILES = {"mapreduce.fileoutputcommitter.algorithm.version": 2, "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": True}
_FOLDER = _case("page_id", "'国标'", "'园区规则'", "'历史案例'")


@query(f"""SELECT md5(html || chr(10)) AS content_md5, {_FOLDER} AS regulation_type, {_case('page_id', "'高'", "'中'", "'低'")} AS priority, '通用' AS chemical_type FROM pages WHERE html IS NOT NULL""")
def files_loaded(spark, sf_dir):
    """Every page as a text file in a folder of its category, loaded as a whole."""
    base = shared_folder(spark)
    pages = table(spark, sf_dir, "pages").where("html IS NOT NULL").select("html", F.expr(_FOLDER).alias("folder"))
    for folder, n in pages.groupBy("folder").count().collect():
        # A task for some hundreds of files, whatever the table's layout.
        rows = pages.where(F.col("folder") == folder).select("html").repartition(-(-n // FILES_PER_TASK))
        rows.write.options(maxRecordsPerFile=1, **SMALL_FILES).text(f"{base}/{folder}")
    loaded = corpus.whole_files(spark, base)
    return loaded.select(F.md5(F.col("content").cast("binary")).alias("content_md5"), "regulation_type", "priority", "chemical_type")


@query("""SELECT row_number() OVER (ORDER BY text, lang, source) - 1 AS doc_id, md5(text) AS content_md5, coalesce(source, '通用') AS chemical_type FROM documents""")
def typed_insert(spark, sf_dir):
    """Regulations with a chemical type, or the wildcard."""
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("lang").alias("regulation_type"), F.lit("高").alias("priority"), F.col("source").alias("chemical_type"))
    rows = rows.withColumn("at", F.struct("content", "regulation_type", "chemical_type"))
    return KnowledgeBase(spark).add_regulations(rows, "at").docs.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "chemical_type")


@query("""SELECT 'documents' AS origin, md5(text) AS content_md5, '中' AS priority, coalesce(source, '通用') AS chemical_type FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 'pages', md5(html), '低', '通用' FROM pages WHERE html IS NOT NULL
    UNION ALL SELECT 'conversations', md5(text), '中', '通用' FROM conversations WHERE text IS NOT NULL""")
def sources_united(spark, sf_dir):
    """Documents, pages and conversations as one knowledge table."""
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("source").alias("chemical_type"))
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("content"), F.lit("低").alias("priority"))
    said = table(spark, sf_dir, "conversations").select(F.col("text").alias("content"))
    rows = corpus.united(documents=docs, pages=pages, conversations=said)
    return rows.select("origin", F.md5(F.col("content").cast("binary")).alias("content_md5"), "priority", "chemical_type")


# --- streams


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the cluster's checkpoint folder; a temporary one only where none is
    set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base}/shared-{uuid.uuid4().hex}" if base else tempfile.mkdtemp(prefix="shared-")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream of a table that is one file or a folder of part files. Streams take a single file by a pattern only."""
    return logs.read(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


@query("SELECT event_id AS id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] 用户:' || user_id || ' 操作:' || event_type || chr(10) || '  详情: ' || props AS line FROM events")
def audit_stream(spark, sf_dir):
    """Records are worded as they come in, and appended once each."""
    base = shared_folder(spark)
    lines = audit_records(streamed(spark, sf_dir, "events")).select("id", audit.line().alias("line"))
    logs.append(lines, f"{base}/log", f"{base}/state").awaitTermination()
    return spark.read.schema(lines.schema).parquet(f"{base}/log")


@query(ORACLES["fact_latest"])
def facts_stream(spark, sf_dir):
    """Facts of each conversation as a stream keeps them; what it gives out last is the latest value."""
    base = shared_folder(spark)
    changes = logs.latest_facts(dialog.facts(_said(streamed(spark, sf_dir, "conversations"))))
    logs.append(changes, f"{base}/log", f"{base}/state").awaitTermination()
    return dialog.latest(spark.read.schema(changes.schema).parquet(f"{base}/log"))
