"""Dialog sessions: turns, history, expiry, and facts that a session remembers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.functions import rules
from tarnflow.functions.text import clean_content


def append(turns: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    """turns and the new ones of known sessions, cleaned as they are written."""
    known = new.join(sessions.select("session_id"), "session_id", "left_semi")
    return turns.unionByName(known.withColumn("content", clean_content(F.col("content"))))


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each session. The rank limit is pushed before the shuffle, so a long session sends n rows a task."""
    w = W.partitionBy("session_id").orderBy(F.col("turn").desc())
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _joined(turns: DataFrame, n: int, line: Column, title: str, out: str) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return last_turns(turns, n).groupBy("session_id").agg(F.array_join(F.concat(F.array(F.lit(title)), lines), "\n").alias(out))


def history(turns: DataFrame, n: int = 10) -> DataFrame:
    """(session_id, history): the last n turns for display, cleaned again as they are read."""
    label = F.when(F.lower("role") == "user", "👤 用户").otherwise("🤖 助手")
    line = F.concat_ws("\n", F.concat(label, F.lit(" ["), F.date_format("ts", "HH:mm:ss"), F.lit("]")), clean_content(F.col("content")), F.lit("─" * 40))
    return _joined(turns, n, line, "【对话历史记录】", "history")


def context(turns: DataFrame, n: int = 5) -> DataFrame:
    """(session_id, summary): the last n turns for a prompt."""
    return _joined(turns, n, F.concat(F.col("role"), F.lit(": "), clean_content(F.col("content"))), "【对话上下文】", "summary")


def count(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.count("*").alias("n_turns"))


def expired(sessions: DataFrame, now: Column, timeout_seconds: float) -> DataFrame:
    """Sessions idle for longer than the timeout."""
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_updated").cast("timestamp"))
    return sessions.where(idle > int(timeout_seconds * 1_000_000))


def upsert(old: DataFrame, new: DataFrame, key: str = "session_id", at: str = "last_updated") -> DataFrame:
    """The latest row of each key; of two at one time the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[F.col(c) for c in old.columns])
    return both.groupBy(key).agg(F.max_by(row, F.struct(at, "_new")).alias("_row")).select("_row.*")


def clear(turns: DataFrame, gone: DataFrame) -> DataFrame:
    return turns.join(gone.select("session_id"), "session_id", "left_anti")


def clear_history(turns: DataFrame, sessions: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """turns without those of the sessions in `gone`, and sessions, where these count as updated now."""
    marked = sessions.join(gone.select("session_id").distinct().withColumn("_gone", F.lit(True)), "session_id", "left")
    return clear(turns, gone), marked.withColumn("last_updated", F.when(F.col("_gone"), now).otherwise(F.col("last_updated"))).select(*sessions.columns)


def facts(turns: DataFrame) -> DataFrame:
    """(session_id, key, value, turn) of every fact that a turn states."""
    found = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.when(F.col("role") == role, rule(F.col("content"))).alias("value"))
            for k, role, rule in (
                ("user_name", "user", rules.user_name),
                ("assistant_name", "user", rules.assistant_name),
                ("主轴温度", "assistant", rules.temperature),
                ("安全阈值", "assistant", rules.threshold),
            )
        ]
    )
    rows = turns.select("session_id", "turn", F.explode(F.filter(found, lambda x: x["value"].isNotNull())).alias("f"))
    return rows.select("session_id", "f.key", "f.value", "turn")


def latest(found: DataFrame) -> DataFrame:
    """The last value of each fact of each session."""
    return found.groupBy("session_id", "key").agg(F.max_by("value", "turn").alias("value"))


def profile(found: DataFrame) -> DataFrame:
    """A row per session with its facts as columns."""
    return found.groupBy("session_id").agg(*[F.max_by("value", F.when(F.col("key") == k, F.col("turn"))).alias(k) for k in KEYS])


#: Turns that are looked at together where facts are carried on; a longer session is several groups.
SPAN = 4096
KEYS = ("user_name", "assistant_name", "主轴温度", "安全阈值")


def known(questions: DataFrame, found: DataFrame, span: int = SPAN) -> DataFrame:
    """questions (session_id, turn, …) with the four facts as columns, as they stood before that turn.

    An as-of join as a running last value: a fact counts for all later turns until one of its key replaces it, facts of the
    turn itself don't (a question is answered before it is read for facts). Of two values of a key in one turn the larger
    counts; facts or questions without a turn have no place in the order: the former are ignored, the latter know nothing.
    A session is cut into spans of turns: each carries on what the last value before it was, so none is one large group.
    """
    rest = [c for c in questions.columns if c not in ("session_id", "turn")]
    block = F.floor(F.col("turn") / span).alias("block")
    stated = found.where("turn IS NOT NULL").groupBy("session_id", block, F.col("turn").cast("long").alias("turn")).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in KEYS])
    at_end = stated.groupBy("session_id", "block").agg(*[F.max_by(k, F.when(F.col(f"`{k}`").isNotNull(), F.col("turn"))).alias(k) for k in KEYS])
    asked = questions.select("session_id", block, F.col("turn").cast("long").alias("turn"), F.struct(F.lit(True).alias("_asked"), "turn", *[F.col(f"`{c}`") for c in rest]).alias("_q"))
    # Spans with a question and none with a fact need what was carried on, too.
    spans = at_end.unionByName(asked.where("turn IS NOT NULL").select("session_id", "block").distinct(), allowMissingColumns=True)
    before = W.partitionBy("session_id").orderBy("block").rangeBetween(W.unboundedPreceding, -1)
    carried = spans.select("session_id", "block", *[F.last(k, ignorenulls=True).over(before).alias(f"_{k}") for k in KEYS]).distinct()
    events = stated.unionByName(asked, allowMissingColumns=True)
    inside = W.partitionBy("session_id", "block").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    rows = events.select("session_id", "block", "_q", *[F.last(k, ignorenulls=True).over(inside).alias(k) for k in KEYS]).where("_q._asked")
    full = rows.join(carried, ["session_id", "block"], "left")
    facts_of = lambda k: F.when(F.col("_q.turn").isNotNull(), F.coalesce(F.col(f"`{k}`"), F.col(f"`_{k}`"))).alias(k)
    return full.select("session_id", "_q.turn", *[F.col(f"_q.`{c}`").alias(c) for c in rest], *map(facts_of, KEYS))


def answers(questions: DataFrame, found: DataFrame) -> DataFrame:
    """questions (session_id, content, …) with `answer` from the session's facts as they stood before the question's `turn`;
    questions without that column are asked now, after all that was said."""
    q = known(questions, found) if "turn" in questions.columns else questions.join(profile(found), "session_id", "left")
    return q.withColumn("answer", rules.memory_answer(F.col("content"), *[F.col(f"`{k}`") for k in KEYS])).select(*questions.columns, "answer")


def dialogue(turns: DataFrame) -> DataFrame:
    """The turns of users with `answer`: each is answered from memory where that has an answer (else null), and only then read
    for facts itself, as are the turns of assistants. So asking for one's own name replaces it by what follows the words."""
    return answers(turns.where("role = 'user'"), facts(turns))
