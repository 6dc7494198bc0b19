"""Queries over dialogs and logs that carry state on: facts as of a turn, the session store, the audit journal, search logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import prompts, variants
from tarnflow.operators import dialog, retrieve
from tarnflow.operators.searchlog import SearchLog
from tarnflow.plans.catalog import _GRAMS_OF, DOCS, NOW, TOKENS, _case, documents, query, shared_folder, streamed, table
from tarnflow.streaming import journal, logs, store

#: What a user and an assistant say in the form that (conv_id + turn) has; SQL for Spark and for DuckDB.
_ASKS = ("'我叫李' || turn || '，你叫王' || conv_id || '。' || text", "text || '我是谁？'", "text || '你是谁'", "text || '刚才的温度'", "text || '安全吗'")
_TELLS = ("text || '温度 ' || turn || '.5 ℃'", "text || '阈值≤ ' || turn || '℃'", "text")
_FORM = "(conv_id + turn)"


def told(df):
    """conversations with turns that state facts and ask for them; all turns are users' but every second one."""
    said = F.expr(f"CASE WHEN turn % 2 = 0 THEN {_case(_FORM, *_ASKS)} ELSE {_case(_FORM, *_TELLS)} END")
    return df.select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.expr("CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END").alias("role"), said.alias("content"))


_BOTH = "'你叫 ' || u || '，我叫 ' || a || '！'", "'我叫 ' || a || '，你叫 ' || u || '！'"
_NAMED = f"coalesce({_BOTH[0]}, '你叫 ' || u || '！')", f"coalesce({_BOTH[1]}, '我叫 ' || a || '！')"


@query(f"""WITH f AS (
    SELECT conv_id, turn, turn % 2 = 0 AS asks, {_FORM} % 5 AS form,
        CASE WHEN turn % 2 = 0 AND {_FORM} % 5 = 0 THEN '李' || turn WHEN turn % 2 = 0 AND {_FORM} % 5 = 1 THEN '谁？' END AS u,
        CASE WHEN turn % 2 = 0 AND {_FORM} % 5 = 0 THEN '王' || conv_id END AS a,
        CASE WHEN turn % 2 = 1 AND {_FORM} % 3 = 0 THEN turn || '.5 ℃' END AS t,
        CASE WHEN turn % 2 = 1 AND {_FORM} % 3 = 1 THEN '≤ ' || turn || '℃' END AS l FROM conversations),
    k AS (SELECT conv_id, turn, asks, form, {', '.join(f'last_value({c} IGNORE NULLS) OVER w AS {c}' for c in 'uatl')} FROM f
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id::VARCHAR AS session_id, turn, CASE form WHEN 0 THEN coalesce({_NAMED[0]}, {_NAMED[1]}) WHEN 1 THEN {_NAMED[0]} WHEN 2 THEN {_NAMED[1]}
        WHEN 3 THEN '你好！之前检查的温度是 ' || t || '。还有什么需要我帮你的吗？' ELSE '安全阈值是 ' || l || '。' END AS answer FROM k WHERE asks""")
def answers_as_of(spark, sf_dir):
    """Every question of every conversation, answered from what was said before it."""
    return dialog.dialogue(told(table(spark, sf_dir, "conversations"))).select("session_id", "turn", "answer")


@query(f"""WITH f AS (
        SELECT conv_id, turn, turn % 2 = 0 AS asks, {_case(_FORM, *_ASKS)} AS x, lag(text) OVER v AS history,
            CASE WHEN turn % 2 = 0 AND {_FORM} % 5 = 0 THEN '李' || turn WHEN turn % 2 = 0 AND {_FORM} % 5 = 1 THEN '谁？' END AS u, CASE WHEN turn % 2 = 0 AND {_FORM} % 5 = 0 THEN '王' || conv_id END AS a
        FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn)),
    k AS (SELECT conv_id, turn, asks, x, history, last_value(u IGNORE NULLS) OVER w AS u, last_value(a IGNORE NULLS) OVER w AS a FROM f
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id::VARCHAR AS session_id, turn, md5('你是友好的AI助手，名字叫' || coalesce(a, '助手') || '。' || chr(10) || chr(10) || '对话历史：' || chr(10) || coalesce(history, '') || chr(10) || chr(10)
        || '用户说：' || x || chr(10) || chr(10) || '用户的名字可能是' || coalesce(u, '用户') || '。' || chr(10) || chr(10) || '请直接回答用户，不要思考标记。') AS prompt_md5 FROM k WHERE asks""")
def dialog_prompt(spark, sf_dir):
    """The prompt of every question, with the names known before it and the turn before it as history."""
    turns = table(spark, sf_dir, "conversations")
    said = told(turns)
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    history = turns.select(F.col("conv_id").cast("string").alias("session_id"), "turn", before.alias("history"))
    asked = dialog.known(said.where("role = 'user'").join(history, ["session_id", "turn"]), dialog.facts(said))
    return asked.select("session_id", "turn", F.md5(prompts.dialog(F.col("content"), F.col("history"), F.col("user_name"), F.col("assistant_name")).cast("binary")).alias("prompt_md5"))


_GAP, _LATE = 1800, 600  # seconds


@query(f"""WITH e AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= {_GAP}000000, true)::INT AS new FROM events),
    c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS chain FROM e)
    SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL {_GAP} SECONDS AS "end", count(*)::BIGINT AS n FROM c GROUP BY user_id, chain
    HAVING epoch_ms(max(ts) + INTERVAL {_GAP} SECONDS) <= (SELECT epoch_ms(max(ts)) FROM events) - {_LATE}000""")
def session_windows(spark, sf_dir):
    """Sessions of users that end after half an hour without an event, as a stream gives them out once they are over."""
    base = shared_folder(spark)
    events = streamed(spark, sf_dir, "events")
    over = logs.sessions(events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", f"{_GAP} seconds", f"{_LATE} seconds")
    logs.append(over, f"{base}/log", f"{base}/state").awaitTermination()
    at = lambda c: F.col(c).cast(events.schema["ts"].dataType).alias(c)
    return spark.read.schema(over.schema).parquet(f"{base}/log").select("user_id", at("start"), at("end"), "n")


_IDLE = 43_200  # seconds


@query(f"""WITH e AS (
        SELECT user_id, ts, epoch_ms(ts) AS ms, event_id, event_type, props, event_type <> 'error' AS bump,
            max(CASE WHEN event_type <> 'error' THEN epoch_ms(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
    c AS (SELECT *, sum((bump AND (before IS NULL OR ms - before > {_IDLE}000))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain FROM e WHERE bump OR ms - before <= {_IDLE}000),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, chain ORDER BY ts, event_id) AS n FROM c),
    s AS (SELECT *, min(CASE WHEN event_type = 'signup' THEN n END) OVER (PARTITION BY user_id, chain) AS first FROM n),
    a AS (SELECT *, max(CASE WHEN event_type IN ('error', 'purchase') THEN n ELSE 0 END) OVER (PARTITION BY user_id, chain) AS cleared FROM s WHERE n >= first)
    SELECT user_id::VARCHAR AS session_id, min(ts) AS created_at, max(CASE WHEN bump THEN ts END) AS last_updated, 'signup' AS session_type,
        count(*) FILTER (WHERE event_type = 'click' AND n > cleared)::BIGINT AS n_turns, count(DISTINCT CASE WHEN event_type = 'view' THEN props END)::BIGINT AS n_data,
        CASE WHEN max(CASE WHEN bump THEN ms END) + {_IDLE}001 <= (SELECT epoch_ms(max(ts)) FROM events) THEN 'evicted' ELSE 'live' END AS status
    FROM a GROUP BY user_id, chain""")
def session_store(spark, sf_dir):
    """Events as operations on sessions (signup: upsert, click: turn, view: data, purchase and error: the two clears); what was
    evicted after twelve idle hours, and what is live at the end."""
    base = shared_folder(spark)
    op = F.expr(f"CASE event_type WHEN 'signup' THEN '{store.UPSERT}' WHEN 'click' THEN '{store.TURN}' WHEN 'view' THEN '{store.DATA}' WHEN 'purchase' THEN '{store.CLEAR_HISTORY}' ELSE '{store.CLEAR_DIALOG_HISTORY}' END")
    content = F.expr("CASE event_type WHEN 'signup' THEN event_type ELSE props END")
    events = streamed(spark, sf_dir, "events")
    operations = events.select(F.col("user_id").cast("string").alias("session_id"), op.alias("op"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit("user").alias("role"), content.alias("content"), F.col("props").alias("key"))
    store.run(operations, f"{base}/log", f"{base}/state", _IDLE).awaitTermination()
    at = lambda c: F.col(c).cast(events.schema["ts"].dataType).alias(c)
    return store.sessions(spark, f"{base}/log").select("session_id", at("created_at"), at("last_updated"), "session_type", "n_turns", "n_data", "status")


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS id, user_id::VARCHAR AS user_id, event_type AS operation, props AS details FROM events")
def audit_journal(spark, sf_dir):
    """Events as audit records, numbered without a gap as they are appended."""
    base = shared_folder(spark)
    records = streamed(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("operation"), F.col("props").alias("details"), F.col("ts").cast("timestamp").alias("create_time"), F.col("event_id").alias("seq"))
    journal.append(records, f"{base}/log", f"{base}/state", "create_time", "seq").awaitTermination()
    return journal.Journal(spark, f"{base}/log").read("user_id string, operation string, details string").select("id", "user_id", "operation", "details")


_ASKED = ("the station of there", "漢字", "license 10", "")


@query(f"""WITH {DOCS}, {TOKENS}, q AS (SELECT unnest([{', '.join(map(repr, _ASKED))}]) AS query),
    t AS (SELECT query, {_GRAMS_OF} AS term FROM (SELECT query, unnest(string_split(query, ' ')) AS p FROM q) WHERE p <> ''),
    n AS (SELECT query, count(DISTINCT doc_id) AS n FROM t JOIN tokens USING (term) GROUP BY query)
    SELECT query, least(coalesce(n, 0), 7)::INTEGER AS results_count, 'bm25' AS source_priority FROM q LEFT JOIN n USING (query)""")
def search_log(spark, sf_dir):
    """Four searches of up to seven results, as the log has them."""
    base = shared_folder(spark)
    docs, log = documents(spark, sf_dir), SearchLog(spark, f"{base}/log")
    for i, text in enumerate(_ASKED):
        log.run(text, lambda x: retrieve.bm25(docs, x, 7), f"{base}/hits{i}", "bm25", F.lit(NOW))
    return log.read().select("query", "results_count", "source_priority")


#: JSON of an event in the form that its number has: all fields, an ill-typed and a missing one, nested, none at all.
_JSON = ("'{\"k\": ' || event_id || ', \"who\": {\"id\": \"u' || user_id || '\"}, \"tags\": [1, 2]}'", "'{\"k\": \"none\", \"who\": 7}'", "'{\"k\": 1.5, \"who\": {\"id\": null}, \"tags\": [' || user_id || ']}'", "'no json'", "props")


@query(f"""WITH j AS (SELECT event_id, event_id % 5 AS form, {_case('event_id', *_JSON)} AS x FROM events)
    SELECT event_id, CASE form WHEN 0 THEN event_id WHEN 2 THEN 1 WHEN 4 THEN (x::JSON->>'k')::BIGINT END AS k, CASE form WHEN 0 THEN x::JSON->'who'->>'id' END AS who,
        CASE form WHEN 0 THEN 1 WHEN 2 THEN (x::JSON->'tags'->>0)::BIGINT END AS tag, form <> 3 AS is_json,
        CASE form WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'DECIMAL(2,1)' WHEN 4 THEN 'BIGINT' END AS kind FROM j""")
def session_variant(spark, sf_dir):
    """Session data of any shape, typed when it is read."""
    rows = table(spark, sf_dir, "events").select("event_id", variants.data(F.expr(_case("event_id", *_JSON))).alias("v"))
    v = F.col("v")
    return rows.select("event_id", variants.field(v, "$.k", "long").alias("k"), variants.field(v, "$.who.id", "string").alias("who"), variants.field(v, "$.tags[0]", "long").alias("tag"), v.isNotNull().alias("is_json"), variants.kind(v, "$.k").alias("kind"))


@query(f"""WITH j AS (SELECT event_type, event_id % 5 AS form FROM events)
    SELECT event_type, count(*) FILTER (WHERE form <> 3)::BIGINT AS n FROM j GROUP BY event_type""")
def session_shapes(spark, sf_dir):
    """How many rows of each event type have session data of a merged shape that can be told."""
    rows = table(spark, sf_dir, "events").select("event_type", variants.data(F.expr(_case("event_id", *_JSON))).alias("v"))
    shapes = rows.groupBy("event_type").agg(variants.shape(F.col("v")).alias("shape"), F.count("v").alias("n"))
    return shapes.where(F.col("shape").startswith("OBJECT<")).select("event_type", "n")
