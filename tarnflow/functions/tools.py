"""Tools that a dialog may call, by name, and the functions behind them."""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}
#: The answer about the limit.
THRESHOLD = "主轴安全温度阈值：≤ 180℃，超过即为异常故障"


def evaluate(expression: str | None) -> float | None:
    """Value of + - * / and brackets over numbers; null for anything else."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Expression):
            return value(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return float(node.value)
        if isinstance(node, ast.BinOp):
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp):
            return _OPERATORS[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    try:
        return value(ast.parse((expression or "").strip(), mode="eval"))
    except (ValueError, KeyError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.DoubleType())
def calculate(x: pd.Series) -> pd.Series:
    return x.map(evaluate).astype(float)


#: The limit of the spindle temperature.
LIMIT = 180


def reading(value: Column) -> Column:
    """A reading of the spindle temperature in words, in whole degrees."""
    return F.concat(F.lit("主轴实时温度："), F.floor(value).cast("string"), F.lit("℃"))


def above(value: Column, limit: float = LIMIT) -> Column:
    """Whether a reading is above the limit; at the limit it isn't."""
    return value > limit


def current_time(now: Column) -> Column:
    return F.date_format(now, "yyyy年MM月dd日 HH:mm:ss")


RESULTS = "struct<webPages:struct<value:array<struct<name:string,snippet:string,url:string>>>>"


def web_results(body: Column, n: int = 3) -> Column:
    """The first n hits of a JSON answer as text: numbered title, summary and origin; a missing field is empty."""
    hits = F.slice(F.from_json(body, RESULTS)["webPages"]["value"], 1, n)
    shown = lambda h, i: F.format_string("【%d】%s\n摘要：%s\n来源：%s\n\n", i + 1, *[F.coalesce(h[k], F.lit("")) for k in ("name", "snippet", "url")])
    return F.array_join(F.transform(hits, shown), "")


#: The address that a search is sent to.
SEARCH = "https://api.search.bing.com/v7.0/search?q=%s&count=5&mkt=zh-CN"


def search_url(query: Column) -> Column:
    """The address of a search, with the query percent-encoded (a space as %20)."""
    encoded = F.url_encode(query)
    for plain, coded in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(plain), F.lit(coded))
    return F.format_string(SEARCH.replace("%s", "%1$s"), encoded)


#: Name: description. All are functions in SQL under these names once registered.
REGISTRY = {
    "GetSpindleTemperature": "current spindle temperature, from a reading",
    "GetTemperatureThreshold": "safe limit of the spindle temperature",
    "GetCurrentTime": "current time",
    "Calculate": "value of an arithmetic expression",
    "WebSearch": "first hits of a web search, from its answer",
}


def register(spark: SparkSession) -> None:
    """Make the five tools callable from SQL by their names."""
    spark.udf.register("Calculate", calculate)
    bodies = {
        "GetSpindleTemperature(reading INT)": "concat('主轴实时温度：', reading, '℃')",
        "GetTemperatureThreshold()": f"'{THRESHOLD}'",
        "GetCurrentTime(now TIMESTAMP)": "date_format(now, 'yyyy年MM月dd日 HH:mm:ss')",
        "WebSearch(body STRING)": f"""array_join(transform(slice(from_json(body, '{RESULTS}').webPages.value, 1, 3), (h, i) -> format_string(
            '【%d】%s\\n摘要：%s\\n来源：%s\\n\\n', i + 1, coalesce(h.name, ''), coalesce(h.snippet, ''), coalesce(h.url, ''))), '')""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def call(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (…, tool) with the result of each tool, from (tool, result); an unknown tool says so."""
    return calls.join(results, "tool", "left").withColumn("result", F.coalesce("result", F.concat(F.lit("未知工具: "), F.col("tool"))))


Generator = Callable[[str], str]


def stub(prompt: str) -> str:
    """A deterministic stand-in for a language model."""
    return f"[{len(prompt)}] {prompt[:50]}"


def generate(prompt: Column, model: Generator = stub, tries: int = 3) -> Column:
    """A model's answers; after `tries` failures the error's text."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        for k in range(tries):
            try:
                return model(x)
            except Exception as e:  # noqa: BLE001 the model is the caller's, and a failure is an answer
                error = e
        return f"错误: {error}"

    @F.pandas_udf(T.StringType())
    def run(p: pd.Series) -> pd.Series:
        return p.map(one)

    return run(prompt)
