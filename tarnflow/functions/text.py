"""Text functions: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters besides white space that part words.
DELIMITERS = ',.-_()[]，。：:；"、！？!?'
_CLASS = r"\s" + re.escape(DELIMITERS)
PARTS = rf"(?U)[{_CLASS}]+"
#: What white space is in Unicode.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(x: Column) -> Column:
    """Without white space (of all Unicode) at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def not_blank(x: Column) -> Column:
    return x.rlike(r"(?U)\S")


def parts(text: Column) -> Column:
    """Lower-case words between delimiters; null gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PARTS), "")


def grams(part: Column) -> Column:
    """A word, its character pairs and its characters, repeats kept."""
    n = F.length(part)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(part, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(part), pairs, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(part, i, F.lit(1))))


def tokenize(text: Column) -> Column:
    return F.flatten(F.transform(parts(text), grams))


def doc_len(text: Column) -> Column:
    """Number of tokens without making them: a word of n characters has 1 + (n - 1) + n."""
    return (2 * F.length(F.translate(F.lower(F.coalesce(text, F.lit(""))), BLANKS + DELIMITERS, ""))).cast("long")


def query_terms(query: str) -> dict[str, int]:
    """Tokens of a query and how often each occurs."""
    found: dict[str, int] = {}
    for p in re.split(rf"[{_CLASS}]+", query.lower()):
        if p:
            for t in [p, *(p[i : i + 2] for i in range(len(p) - 1)), *p]:
                found[t] = found.get(t, 0) + 1
    return found


def spaced(text: Column) -> Column:
    """The parts of a text, each between two spaces of its own: no regular expression, and one pass for all that is counted."""
    marks = BLANKS + DELIMITERS
    one = F.translate(F.lower(F.coalesce(text, F.lit(""))), marks, " " * len(marks))
    return F.concat(F.lit(" "), F.replace(one, F.lit(" "), F.lit("  ")), F.lit(" "))


def _occurrences(x: Column, y: str) -> Column:
    """How often y stands in x, where it can't overlap itself."""
    return ((F.octet_length(x) - F.octet_length(F.replace(x, F.lit(y), F.lit("")))) / len(y.encode())).cast("long")


def spaced_count(x: Column, term: str) -> Column:
    """How often a term is among the tokens of a `spaced` text: as a whole word, and as a character or a pair anywhere."""
    whole = _occurrences(x, f" {term} ")
    if len(term) > 2:
        return whole
    # Two of one character may overlap, so they are looked for at each place.
    inside = F.regexp_count(x, F.lit(f"(?={re.escape(term)})")) if len(term) == 2 and term[0] == term[1] else _occurrences(x, term)
    return whole + inside


def spaced_len(x: Column) -> Column:
    """Number of tokens of a `spaced` text: a word of n characters has 1 + (n - 1) + n."""
    return (2 * F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def chunks(text: Column, limit: int = 500) -> Column:
    """Paragraphs packed in order while their characters stay within the limit; a longer paragraph stays whole."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[\\r\\n]"), trim), lambda x: x != "")
    start = F.struct(F.array().cast("array<int>").alias("breaks"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def add(a: Column, n: Column) -> Column:
        flush = (a["size"] > 0) & (a["size"] + n > limit)
        return F.struct(
            F.when(flush, F.concat(a["breaks"], F.array(a["at"]))).otherwise(a["breaks"]).alias("breaks"),
            F.when(flush, n).otherwise(a["size"] + n).alias("size"),
            (a["at"] + 1).alias("at"),
        )

    def cut(x: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.aggregate(F.transform(x, F.length), start, add, lambda a: a["breaks"]))
        joined = lambda s: F.transform(s, lambda at, k: F.array_join(F.slice(x, at + 1, F.coalesce(F.get(s, k + 1), F.size(x)) - at), "\n"))
        return F.when(F.size(x) > 0, let(starts, joined)).otherwise(F.array().cast("array<string>"))

    return let(lines, cut)


def _lines(x: Column, rules: tuple[str, ...]) -> Column:
    def one(line: Column) -> Column:
        for r in rules:
            line = F.regexp_replace(line, r, "")
        return trim(line)

    return F.array_join(F.filter(F.transform(F.split(F.regexp_replace(x, "</?think>", ""), "[\\r\\n]+"), one), lambda y: y != ""), "\n")


NUMBER, NOTE, LETTER = r"(?U)^\s*\d+\.\s*", r"(?U)【.*?】\s*", r"(?U)^\s*[A-Z]\)\s*"


def clean_content(x: Column) -> Column:
    """Lines without numbering, notes in 【】 and option letters; not idempotent, and applied at write and at read."""
    return _lines(x, (NUMBER, NOTE, LETTER))


def clean_line(x: Column) -> Column:
    return _lines(x, (NUMBER, NOTE))


def strip_think(x: Column) -> Column:
    """Without think blocks, an open one reaching to the end."""
    return F.regexp_replace(F.regexp_replace(x, r"(?s)<think>.*?(</think>|$)", ""), "</think>", "")


def contains_any(x: Column, keywords: tuple[str, ...]) -> Column:
    low, out = F.lower(x), F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k.lower()))
    return out


def count_hits(x: Column, keywords: tuple[str, ...]) -> Column:
    low, out = F.lower(x), F.lit(0)
    for k in keywords:
        out = out + F.contains(low, F.lit(k.lower())).cast("int")
    return out


def preview(x: Column, n: int = 50) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def vector_literal(v: Column) -> Column:
    return F.to_json(v)
