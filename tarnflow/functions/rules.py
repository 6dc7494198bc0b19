"""Decision rules on texts: classification, tool plans and calls, facts, answers from memory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.text import contains_any, not_blank, trim

#: Keyword lists.
INDUSTRIAL = ("温度", "机床", "主轴", "异常", "故障", "阈值", "诊断", "检查", "传感器", "数据", "参数")
CHEMICALS = ("甲苯", "甲醇", "乙醇", "丙酮", "硫酸", "盐酸")
TOOLS = ("GetSpindleTemperature", "GetTemperatureThreshold", "GetCurrentTime", "Calculate", "WebSearch")
MARKER = "【工具调用】:"
EMPTY_CALLS = ("无", "空", "-")
EXIT, CLEAR, HISTORY = ("exit", "退出"), ("clear", "清空"), ("history", "历史")


def intent(x: Column) -> Column:
    return F.when(contains_any(F.coalesce(x, F.lit("")), INDUSTRIAL), "IndustrialDiagnostic").otherwise("SimpleChat")


def is_command(x: Column, names: tuple[str, ...]) -> Column:
    return F.lower(trim(x)).isin(*names)


def chemical_type(file_name: Column) -> Column:
    out = F.lit("通用")
    for c in reversed(CHEMICALS):
        out = F.when(F.contains(file_name, F.lit(c)), c).otherwise(out)
    return out


def tool_plan(x: Column) -> Column:
    """struct(needs_tools, tool_names)."""
    plan = lambda names: F.struct(F.lit(bool(names)).alias("needs_tools"), F.array(*map(F.lit, names)).cast("array<string>").alias("tool_names"))
    return F.when(contains_any(x, ("温度", "阈值")), plan(TOOLS[:2])).when(F.contains(x, F.lit("时间")), plan(TOOLS[2:3])).otherwise(plan(()))


def _after_marker(x: Column, skip: int) -> Column:
    at = F.instr(x, MARKER)
    return F.when(at > 0, F.substring(x, at + skip, F.length(x)))


def _listed(x: Column) -> Column:
    names = F.filter(F.transform(F.split(x, ","), trim), lambda y: not_blank(y) & ~y.isin(*EMPTY_CALLS))
    return F.coalesce(names, F.array().cast("array<string>"))


def tools_marked(x: Column, strict: bool = False) -> Column:
    """Names after the marker. strict skips one character less than the marker has, as callers of old expect."""
    return _listed(_after_marker(x, len(MARKER) - strict))


def tools_stripped(x: Column) -> Column:
    """As the strict form, with brackets and colons taken from each name."""
    return F.filter(F.transform(_listed(_after_marker(x, len(MARKER) - 1)), lambda y: trim(F.translate(y, "()：:", ""))), not_blank)


def tools_squeezed(x: Column) -> Column:
    """Brackets, colons, spaces and newlines leave the text before it is split."""
    return _listed(F.translate(_after_marker(x, len(MARKER) - 1), "()：: \r\n", ""))


def tools_named(x: Column) -> Column:
    """Known names anywhere in the text, in fixed order; none where the text refuses."""
    found = F.filter(F.array(*map(F.lit, TOOLS)), lambda n: F.contains(F.lower(x), F.lower(n)))
    return F.when(contains_any(x, ("无", "不需要", "不调用")), F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def tools_planned(x: Column) -> Column:
    """struct(needs_tools, tool_names) from lines that begin with 需要工具: (a yes, a no or names) or 工具列表: (names)."""
    needs, names = "需要工具:", "工具列表:"
    lines = F.transform(F.split(x, "\n"), trim)
    value = lambda y, head: trim(F.substring(y, len(head) + 1, 1 << 30))
    listed = lambda v: F.filter(F.transform(F.split(v, ","), trim), lambda t: not_blank(t) & ~F.contains(t, F.lit("无")))
    none = F.array().cast("array<string>")

    def of(y: Column) -> Column:
        plain = ~contains_any(value(y, needs), ("是", "否"))
        return F.when(F.startswith(y, F.lit(needs)) & plain, listed(value(y, needs))).when(F.startswith(y, F.lit(names)), listed(value(y, names))).otherwise(none)

    found = F.array_distinct(F.flatten(F.transform(lines, of)))
    said = F.filter(lines, lambda y: F.startswith(y, F.lit(needs)))
    asked = F.coalesce(not_blank(value(F.element_at(said, -1), needs)), F.lit(False))
    return F.struct(((F.size(found) > 0) | F.when(F.size(said) > 0, asked).otherwise(False)).alias("needs_tools"), found.alias("tool_names"))


def _until_stop(x: Column, mark: str) -> Column:
    at = F.instr(x, mark)
    rest = F.substring(x, at + len(mark), F.length(x))
    stop = F.when(F.instr(rest, "，") > 0, F.instr(rest, "，")).when(F.instr(rest, "。") > 0, F.instr(rest, "。"))
    return F.when(at > 0, trim(F.when(stop.isNotNull(), F.substring(rest, F.lit(1), stop - 1)).otherwise(rest)))


def user_name(x: Column) -> Column:
    """After 我叫, else after 我是, to the first comma, else the first full stop."""
    return F.coalesce(_until_stop(x, "我叫"), _until_stop(x, "我是"))


def assistant_name(x: Column) -> Column:
    return _until_stop(x, "你叫")


def temperature(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("温度")), F.nullif(F.regexp_extract(x, r"(?U)(\d+(\.\d+)?)\s*℃", 0), F.lit("")))


def threshold(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("阈值")), F.nullif(F.regexp_extract(x, r"(?U)≤?\s*(\d+(\.\d+)?)\s*℃", 0), F.lit("")))


def memory_answer(question: Column, user: Column, assistant: Column, spindle: Column, limit: Column) -> Column:
    """Answer from stored facts, or null; a rule without its fact falls through to the next."""
    they, we = F.concat(F.lit("你叫 "), user), F.concat(F.lit("我叫 "), assistant)
    end = F.lit("！")
    return F.coalesce(
        F.when(contains_any(question, ("我叫", "名字", "我是谁")), F.coalesce(F.concat(they, F.lit("，"), we, end), F.concat(they, end))),
        F.when(contains_any(question, ("你叫", "你是谁")), F.coalesce(F.concat(we, F.lit("，"), they, end), F.concat(we, end))),
        F.when(contains_any(question, ("刚才", "刚刚", "之前")) & F.contains(question, F.lit("温度")), F.concat(F.lit("你好！之前检查的温度是 "), spindle, F.lit("。还有什么需要我帮你的吗？"))),
        F.when(contains_any(question, ("阈值", "安全")), F.concat(F.lit("安全阈值是 "), limit, F.lit("。"))),
    )
