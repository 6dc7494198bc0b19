"""Mixing sources to target weights by capped water-filling.

Sources get shares of all words by weight. A source whose share exceeds `max_epochs` times its own size is clamped
there, and what it leaves is dealt anew to the others by weight until none is above its cap. A document is then taken
floor(rate) whole times; for the fraction that is left, documents are added in the order of a seeded hash until the
source's target is met, and the document at the border gives the words that are still missing.

Sources are ordered and clamped in one task, a row each: thousands of them, not one for each web domain.

The order is never sorted as a whole: per source, hash ranges are summed first, and only the range that holds the
border is ordered row by row, so a source with most of the rows is no hot group.

Defined cases: a null or empty text has size 0 and takes 0; a very long text is one item, whose border words may be a
part of it; a null source is a source of its own, last in order; rows
that share doc_id and source stand at one place of the order and share the border's words by size; an empty table
gives an empty one; other columns pass through `mix`, and columns of the results' names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnflow.llm.common import aside, back, given, store, words

RANGES = 4096
RESULTS = ("size", "source_size", "target", "copies", "part", "taken")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Clamping one source after another ends where sum(min(cap, level * weight)) is the total. With the sources in the
    order of cap / weight, the clamped ones are those before the first whose share of what is left fits under its cap.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k + 1)).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    df = df.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    df = df.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    df = df.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), "level"))).over(W.partitionBy())["level"])
    return df.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), max_epochs: float = 3.0, seed: str = "mix") -> DataFrame:
    """df with size, source_size, target, copies (whole), part (words of one more, partial copy) and taken."""
    place = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(i.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    key = df.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("size"), place(F.col(doc_id)).alias("place"))
    key = store(key.withColumn("range", F.shiftright("place", 60 - 12)))
    ranges = store(key.groupBy("source", "range").agg(F.sum("size").alias("size")))
    goal = targets(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = store(goal.withColumn("need", F.round("target").cast("long") - F.col("copies") * F.col("source_size")))
    below = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    spans = ranges.withColumn("start", F.coalesce(F.sum("size").over(below), F.lit(0))).alias("r").join(goal.alias("g"), same)
    spans = spans.select(F.col("r.source").alias("s"), F.col("range").alias("b"), F.col("start"), "source_size", "target", "copies", "need", (F.col("start") + F.col("r.size")).alias("end"))
    spans = store(spans)
    # The one range of each source that holds the border, in order; ids that stand at one place are summed as one.
    edge = spans.where("start < need and need < end")
    rows = key.join(edge.hint("merge"), key["source"].eqNullSafe(edge["s"]) & (key["range"] == edge["b"])).groupBy("source", "place", "id", "need", "start").agg(F.sum("size").alias("size"))
    upto = F.col("start") + F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("place", F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select(F.col("source").alias("es"), F.col("id").alias("eid"), F.col("size").alias("held"), F.greatest(F.lit(0), F.least("size", F.col("need") - upto)).alias("give"))
    kept = [c for c in df.columns if c not in RESULTS]
    out = aside(df).withColumn("size", F.size(words(given(text))).cast("long")).withColumn("range", F.shiftright(place(given(doc_id)), 60 - 12))
    out = out.join(spans.hint("merge"), given(source).eqNullSafe(F.col("s")) & (F.col("range") == F.col("b")))
    out = out.join(rows.hint("merge"), given(source).eqNullSafe(F.col("es")) & given(doc_id).eqNullSafe(F.col("eid")) & (F.col("end") > F.col("need")), "left")
    part = F.when(F.col("end") <= F.col("need"), F.col("size")).when(F.col("start") >= F.col("need"), 0)
    part = part.otherwise(F.coalesce(F.when(F.col("give") >= F.col("held"), F.col("size")).otherwise(F.floor(F.col("give") * F.col("size") / F.col("held"))), F.lit(0))).cast("long")
    out = out.select(*map(given, kept), "size", "source_size", "target", "copies", part.alias("part"))
    return back(out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part")))


def sql() -> str:
    """The same rows from DuckDB, for the weights 5, 2, 1 and the cap 3."""
    return r"""
    WITH k AS (
        SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
            ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
    w AS (
        SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
            3.0::DOUBLE * source_size AS cap FROM s),
    l AS (
        SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    v AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1),
    t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v) * w, cap)) AS target FROM l),
    g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
    o AS (
        SELECT k.doc_id, k.size, g.source_size, g.target, g.copies, round(g.target)::BIGINT - g.copies * g.source_size AS need,
            coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY place, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
        FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, need - upto)))::BIGINT AS taken FROM o"""
