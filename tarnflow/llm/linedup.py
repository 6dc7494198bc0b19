"""Line dedup by content-defined chunks of lines (built-in functions only).

1. A text is cut after a line when the rolling hash of that line and the one before it is divisible by `divisor`. The
   places depend on the lines around them only, so an insertion shifts nothing. A chunk with two lines or more that have
   words, from the first to the last of these, that occurs more than once anywhere leaves but for its first occurrence
   (by doc_id, then place).
2. At the ends of a repeated passage chunks also hold foreign lines, and a passage of few lines may hold no whole chunk.
   So all pairs of successive lines with words that aren't inside a chunk removed before are compared in the same way,
   as the smallest chunks of lines. As each run of two repeated lines or more consists of overlapping pairs, what leaves
   is every repeated run as a whole, whatever surrounds it; the chunks spare the pairs of most copies.

Only keys are shuffled for all texts. Equal hashes merely nominate; bodies of nominated chunks are compared byte by byte.

An extension, off unless `long_words` is given: a single line of that many words counts as a chunk too.

Defined cases: a null text stays null and has no line; an empty text is one line that is never removed; lines without a
word go where they stand between removed ones; rows that share doc_id and text count as one document and are treated
alike; null ids sort first and are kept; very long texts cost n log n of their lines; other columns pass through,
whatever their names, but `n_lines` and `n_removed`, which are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import GIVEN, aside, back, given, release, sized, store, words

#: Fixed values of the rolling hash.
BASE, MODULUS = 31, 2147483647
WORDED = "[^\\x20\\x09-\\x0D]"


def _span(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def _body(lines: str, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["a"] + 1, span["b"] - span["a"] + 1), "\n")


def with_lines(df: DataFrame, divisor: int) -> DataFrame:
    """Add `_l`, the lines of `text`, `_i`, the numbers of those with words, and `_s`, the first lines of all chunks."""
    df = df.withColumn("_l", F.split("text", "\n"))
    df = df.withColumn("_i", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: F.get("_l", i).rlike(WORDED)))
    df = df.withColumn("_h", F.transform("_l", lambda x: F.pmod(F.xxhash64(x), F.lit(MODULUS))))

    def starts(i: Column) -> Column:
        rolling = (F.coalesce(F.get("_h", i - 2), F.lit(0)) * BASE + F.get("_h", i - 1)) % MODULUS
        return (i == 0) | (rolling % divisor == 0)

    return df.withColumn("_s", F.filter(F.sequence(F.lit(0), F.size("_l") - 1), starts)).drop("_h")


def with_chunks(df: DataFrame, divisor: int) -> DataFrame:
    """Add `_l` and `_w`: the chunks with two lines with words or more, as (a, b), the first and the last such line."""
    df = with_lines(df, divisor)
    end = lambda k: F.coalesce(F.get("_s", k + 1), F.size("_l")) - 1
    held = F.transform("_s", lambda s, k: F.filter(F.sequence(s, end(k)), lambda i: F.get("_l", i).rlike(WORDED)))
    spans = F.transform(F.filter(held, lambda x: F.size(x) > 1), lambda x: _span(x[0], F.element_at(x, -1)))
    return df.withColumn("_w", spans).drop("_i", "_s")


def with_pairs(df: DataFrame, divisor: int, long_words: int | None) -> DataFrame:
    """Add `_l` and `_w`: the pairs of lines that aren't inside a chunk in `gone`, and lines of `long_words` or more."""
    df = with_lines(df, divisor)
    size = lambda k: F.coalesce(F.get("_s", k + 1), F.size("_l")) - F.get("_s", k)
    df = df.withColumn("_c", F.flatten(F.transform(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: F.array_repeat(k, size(k)))))
    # Chunk numbers with whether they are gone, in order: a lookup by place costs the same in a text of any length.
    gone = F.coalesce(F.array_distinct(F.transform("gone", lambda x: F.get("_c", x["a"]))), F.array().cast("array<int>"))
    flag = lambda ks, is_gone: F.transform(ks, lambda k: F.struct(k.alias("k"), F.lit(is_gone).alias("gone")))
    df = df.withColumn("_g", gone).withColumn("_g", F.array_sort(F.concat(flag(F.array_except(F.sequence(F.lit(0), F.size("_s") - 1), "_g"), False), flag(F.col("_g"), True))))
    inside = lambda a, b: (F.get("_c", a) == F.get("_c", b)) & F.get("_g", F.get("_c", a))["gone"]
    spans = F.filter(F.transform("_i", lambda i, k: _span(i, F.get("_i", k + 1))), lambda x: x["b"].isNotNull() & ~inside(x["a"], x["b"]))
    if long_words:
        line = lambda i: F.get("_l", i)
        long = lambda i: (F.length(line(i)) >= 2 * long_words - 1) & (F.size(words(line(i))) >= long_words) & ~inside(i, i)
        spans = F.concat(spans, F.transform(F.filter("_i", long), lambda i: _span(i, i)))
    return df.withColumn("_w", spans).drop("_i", "_s", "_c", "_g")


def repeats(docs: DataFrame, chunked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, t, gone): the spans of each text that occur earlier. `chunked` adds `_l` and `_w` to docs (id, t, text, …)."""
    hashed = F.transform("_w", lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), F.xxhash64(_body("_l", w)).alias("key")))
    # The outer form, as the plain one puts a filter on the whole computation of the array below it.
    rows = chunked(docs).select("id", "t", F.explode_outer(hashed).alias("w")).where(F.col("w").isNotNull())
    rows = store(rows.select("id", "t", "w.*"))
    repeated = store(rows.groupBy("key").count().where("count > 1").select("key"))
    # The join is split by adaptive execution where a key is hot.
    named = rows.join(repeated.hint("merge"), "key").groupBy("id", "t").agg(F.collect_set(F.struct("a", "b", "key")).alias("w"))
    named = store(named.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "w"))
    found = docs.select("id", "t", "text").join(sized(named, "w"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    found = found.withColumn("_l", F.split("text", "\n"))
    found = found.select("id", "t", F.explode_outer(F.transform("w", lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), w["key"].alias("key"), _body("_l", w).alias("body")))).alias("w"))
    found = store(found.select("id", "t", "w.*"))
    at = F.struct("id", "t", "a", "b")
    first = store(found.groupBy("key", "body").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = found.join(first.hint("merge"), ["key", "body"]).where(~at.eqNullSafe(F.col("first")))
    gone = store(later.groupBy("id", "t").agg(F.collect_set(_span(F.col("a"), F.col("b"))).alias("gone")))
    release(rows, repeated, named, found, first)
    return gone


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = 4, long_words: int | None = None) -> DataFrame:
    """(id, t, gone): spans of lines (a, b) to remove from the text with hash t of document id."""
    docs = df.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("t"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    chunks = repeats(docs, lambda x: with_chunks(x, divisor))
    known = chunks.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "gone")
    rest = docs.join(sized(known, "gone"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("id", "t", "text", "gone")
    pairs = repeats(rest, lambda x: with_pairs(x, divisor, long_words))
    gone = store(chunks.union(pairs).groupBy("id", "t").agg(F.flatten(F.collect_list("gone")).alias("gone")))
    release(chunks, pairs)
    return gone


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = 4, long_words: int | None = None) -> DataFrame:
    """df with its texts freed of repeated runs of lines, and `n_lines` and `n_removed`."""
    gone = removals(df, doc_id, text, divisor, long_words).select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("gone").alias("_gone"))
    columns = [given(c) for c in df.columns if c not in (text, "n_lines", "n_removed")]
    rows = aside(df).join(sized(gone, "_gone"), given(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(given(text)) == F.col("_t")), "left")
    rows = rows.withColumn("_l", F.split(given(text), "\n")).withColumn("_k", F.array_distinct(F.flatten(F.transform("_gone", lambda x: F.sequence(x["a"], x["b"])))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_k"))
    cleaned = F.when(F.col("_k").isNull(), given(text)).otherwise(F.array_join(F.transform(left, lambda k: F.get("_l", k)), "\n"))
    n_lines = F.when(given(text).isNull(), 0).otherwise(F.size("_l")).cast("long")
    n_removed = F.when(F.col("_k").isNull(), 0).otherwise(F.size("_k")).cast("long")
    # A generator of one row, so that filters on the results aren't rewritten into all of their computation.
    results = F.struct(cleaned.alias(GIVEN + text), n_lines.alias("n_lines"), n_removed.alias("n_removed"))
    return back(rows.select(*columns, F.inline(F.array(results))))


def sql(long_words: int = 50) -> str:
    """The same rows from DuckDB: what leaves are all repeated pairs, and lines of `long_words` or more."""
    return rf"""
    WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM d),
    w AS (
        SELECT * FROM (SELECT doc_id, i, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM l)
        WHERE n > 0),
    p AS (
        SELECT doc_id, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM w
        UNION ALL SELECT doc_id, i, i FROM w WHERE n >= {long_words}),
    o AS (SELECT doc_id, a, b, array_to_string(list_slice(l, a + 1, b + 1), chr(10)) AS body FROM p JOIN d USING (doc_id) WHERE b IS NOT NULL),
    r AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY body ORDER BY doc_id, a, b) > 1 AS gone FROM o),
    g AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM r WHERE gone),
    s AS (
        SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
        FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
    SELECT d.doc_id, coalesce(s.text, CASE WHEN d.text IS NOT NULL THEN '' END) AS text,
        coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(s.n_removed, 0)::BIGINT AS n_removed
    FROM documents d LEFT JOIN s USING (doc_id)"""
