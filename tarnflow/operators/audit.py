"""Audit records: append, filters, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.numbering import numbered


def append(log: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """log and the new records, numbered on from its count in the order of `seq`."""
    start = log.agg(F.count("*").alias("_n"))
    rows = numbered(new, "seq", column="_k").crossJoin(F.broadcast(start)).withColumn("id", F.col("_n") + F.col("_k") + 1).withColumn("create_time", now)
    return log.unionByName(rows.select(*log.columns))


def find(log: DataFrame, start=None, end=None, user: str | None = None) -> DataFrame:
    """Records from start to end, both included, of a user; newest first, then as written. Each part is optional."""
    for given, test in ((start, lambda: F.col("create_time") >= F.lit(start)), (end, lambda: F.col("create_time") <= F.lit(end)), (user, lambda: F.col("user_id") == user)):
        if given is not None:
            log = log.where(test())
    return log.orderBy(F.col("create_time").desc(), "id")


def line() -> Column:
    """A record as the report shows it."""
    when = F.date_format("create_time", "yyyy-MM-dd HH:mm:ss")
    return F.concat(F.lit("["), when, F.lit("] 用户:"), F.col("user_id"), F.lit(" 操作:"), F.col("operation"), F.lit("\n  详情: "), F.col("details"))


def report_lines(log: DataFrame, start, end) -> DataFrame:
    """(id, create_time, line) of the report's records. A report of any length is written from this with `write.text`."""
    return find(log, start, end).select("id", "create_time", line().alias("line"))


def header(log: DataFrame, start, end) -> DataFrame:
    """(line): title, range and number of records."""
    shown = lambda x: F.date_format(F.lit(x), "yyyy-MM-dd HH:mm:ss")
    title = F.lit("化工园区危化品合规审核 - 审计日志报告\n报告时间范围: ")
    return log.where(F.col("create_time").between(F.lit(start), F.lit(end))).agg(F.concat(title, shown(start), F.lit(" 至 "), shown(end), F.lit("\n记录总数: "), F.count("*").cast("string")).alias("line"))


def report(log: DataFrame, start, end, per_row: int = 1000) -> DataFrame:
    """(day, block, n, report): the lines of a day, newest first, in blocks; `per_row` bounds a row on the busiest day."""
    rows = numbered(report_lines(log, start, end), F.col("create_time").desc(), F.col("id"), column="_k")
    rows = rows.withColumn("day", F.date_format("create_time", "yyyy-MM-dd")).withColumn("block", F.floor(F.col("_k") / per_row))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_k", "line"))), lambda x: x["line"])
    return rows.groupBy("day", "block").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("report"))


def pass_rate(results: DataFrame, passed: str = "passed") -> DataFrame:
    """(total, passed, rate): how many tests passed, and their share in per cent to one digit; no rate without a test."""
    ok = F.count_if(F.coalesce(F.col(passed), F.lit(False)))
    return results.agg(F.count("*").alias("total"), ok.alias("passed"), F.round(F.try_divide(ok * 100.0, F.count("*")), 1).alias("rate"))


def retained(log: DataFrame, now: Column, days: int = 180) -> DataFrame:
    return log.where(F.col("create_time") >= now - F.expr(f"INTERVAL {days} DAYS"))
