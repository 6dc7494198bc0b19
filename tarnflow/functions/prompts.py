"""Texts for a language model: outlines and prompts, Column in, Column out. Their wording is fixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.text import not_blank


def _lines(*parts: Column | str) -> Column:
    """Lines that each end with a line break; an array gives a line for each element."""
    wrapped = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.concat(F.array_join(F.concat(*wrapped), "\n"), F.lit("\n"))


def _line(*parts: Column | str) -> Column:
    return F.array(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _listed(items: Column, head: str, tail: str = " ") -> Column:
    """The items, numbered from 1 between head and tail."""
    return F.transform(items, lambda x, i: F.concat(F.lit(head), (i + 1).cast("string"), F.lit(tail), x))


def outline(question: Column, tools: Column) -> Column:
    """Outline of an answer; the section of tool results only where a tool was called."""
    none = F.array().cast("array<string>")
    results = F.when(F.size(tools) > 0, F.concat(F.array(F.lit("二、工具调用结果")), _listed(tools, "  2."))).otherwise(none)
    ends = ("三、诊断结论", "  3.1 问题判断", "  3.2 故障原因", "  3.3 整改建议")
    return _lines("【内容大纲】", "一、问题分析", _line("  1.1 用户问题：", question), results, *ends)


def compliance(text: Column, references: Column) -> Column:
    """Prompt of a compliance check from the inspected text and an array of regulations."""
    form = ("请按以下格式输出审核结论:", "1. 是否合规: [是/否]", "2. 违规点: [如有]", "3. 法规依据: [引用具体条款]", "4. 整改建议: [详细说明]")
    head = ("你是化工园区危化品合规审核专家，请根据以下参考法规对用户的巡检内容进行合规审核:", "", "参考法规:")
    return _lines(*head, _listed(references, "", ". "), "", "用户巡检内容:", F.array(text), "", *form)


def dialog(question: Column, history: Column, user: Column, assistant: Column) -> Column:
    """Prompt of a plain dialog; unknown names (null or blank) get their fixed words."""
    named = lambda name, other: F.when(F.coalesce(not_blank(name), F.lit(False)), name).otherwise(F.lit(other))
    head = _line("你是友好的AI助手，名字叫", named(assistant, "助手"), "。")
    parts = (head, "", "对话历史：", F.array(F.coalesce(history, F.lit(""))), "", _line("用户说：", question), "", _line("用户的名字可能是", named(user, "用户"), "。"), "")
    return F.concat(_lines(*parts), F.lit("请直接回答用户，不要思考标记。"))
