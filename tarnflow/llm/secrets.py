"""Secret scans through a trigram inverted index.

Documents are indexed in blocks of 64 inside a task: for each trigram (hashed to 16 bits) a posting list, kept as a row
of flags, one for each of the block's documents (4 MB a block). From each rule's regex a Boolean query of trigrams is derived that every match
must satisfy; posting lists are intersected and united as it says, and only the candidates are matched. A rule without
mandatory trigrams scans its whole block. Hashing can only add candidates, so results are those of a full scan.

Defined cases: a null text is empty and has no span; rows are scanned one by one, so repeated rows, null ids and
ties need no rule; texts are indexed and matched whole; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Query = bool | str | tuple  # True: no condition; a trigram; ("and", ...) or ("or", ...)


@dataclass(frozen=True)
class Rule:
    """A regex of a kind of secret, and what a match must satisfy besides."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True


#: The base rules, in the order that breaks ties, then the added ones.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)
ADDED = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"ghp_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BLOCK, BUCKETS = 64, 1 << 16


def _tokens(pattern: str) -> list:
    """A regex as nested lists: characters, None for anything else, and ("or", [sequences]) for groups."""
    i = 0

    def sequence() -> list:
        nonlocal i
        branches: list[list] = [[]]
        while i < len(pattern) and pattern[i] != ")":
            c = pattern[i]
            i += 1
            if c == "|":
                branches.append([])
                continue
            if c == "(":
                if pattern[i] == "?":  # flags or a group that isn't kept
                    i = pattern.index(":", i) + 1
                item: object = sequence()
                i += 1
            elif c == "[":
                end = i + (pattern[i] in "^]")
                while pattern[end] != "]":
                    end += 1 + (pattern[end] == "\\")
                item, i = None, end + 1
            elif c == "\\":
                word, i = pattern[i], i + (3 if pattern[i] == "x" else 1)
                item = None if word.isalnum() else word
            else:
                item = None if c in ".^$" else c
            if i < len(pattern) and pattern[i] in "?*+{":
                least = {"?": 0, "*": 0, "+": 1}.get(pattern[i])
                if least is None:
                    least, i = int(re.match(r"\{(\d+)", pattern[i:])[1]), pattern.index("}", i) + 1
                else:
                    i += 1
                # An optional letter stands in some matches and not in others; what repeats ends a run of letters.
                item = ("or", [[item], []]) if least == 0 and isinstance(item, str) else [item, None] if least else None
            branches[-1].append(item)
        return branches[0] if len(branches) == 1 else [("or", branches)]

    return sequence()


def trigrams(pattern: str) -> Query:
    """The Boolean query of lower-case trigrams that every match of a regex satisfies."""

    def spell(items: list) -> list[list[str]]:
        """For each way through the alternatives the runs of letters that stand together."""
        ways: list[list[str]] = [[""]]
        for x in items:
            if isinstance(x, str):
                ways = [w[:-1] + [w[-1] + x.lower()] for w in ways]
            elif x is None:
                ways = [w + [""] for w in ways]
            else:
                inner = [s for branch in (x[1] if isinstance(x, tuple) else [x]) for s in spell(branch)]
                ways = [w[:-1] + [w[-1] + s[0]] + s[1:] for w in ways for s in inner]
            if len(ways) > 64:
                return [[""]]
        return ways

    found = []
    for way in spell(_tokens(pattern)):
        grams = sorted({run[i : i + 3] for run in way for i in range(len(run) - 2)})
        if not grams:
            return True
        found.append(("and", *grams))
    return ("or", *dict.fromkeys(found))


def _bucket(a, b, c):
    return (a * 31153 + b * 7919 + c * 257) & (BUCKETS - 1)


def index(texts: list[bytes]) -> np.ndarray:
    """Posting sets of a block: for each trigram bucket the documents that hold it, one bit each."""
    post = np.zeros((BUCKETS, len(texts)), bool)
    for k, t in enumerate(texts):
        x = np.frombuffer(t.lower(), np.uint8).astype(np.uint32)
        if len(x) > 2:
            post[_bucket(x[:-2], x[1:-1], x[2:]), k] = True
    return post


def candidates(post: np.ndarray, query: Query) -> np.ndarray:
    """Which documents of a block satisfy a query."""
    if query is True:
        return np.ones(post.shape[1], bool)
    if isinstance(query, str):
        return post[_bucket(*map(int, query.encode()))]
    parts = [candidates(post, q) for q in query[1:]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(doc_id, spans): spans is an array of (kind, start, end), in code points, by start and then in the rules' order."""
    compiled = [(r, re.compile(r.pattern, re.ASCII), trigrams(r.pattern)) for r in rules]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.iloc[at : at + BLOCK]
                texts = [t or "" for t in part["text"]]
                post = index([t.encode("utf-8", "surrogatepass") for t in texts])
                spans: list[list] = [[] for _ in texts]
                for order, (rule, regex, query) in enumerate(compiled):
                    for k in np.flatnonzero(candidates(post, query)).tolist():
                        spans[k] += [(m.start(), order, m.end()) for m in regex.finditer(texts[k]) if rule.accept(m)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "spans": [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(x)] for x in spans]})

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' hash and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: What a match of a base rule must satisfy besides, as SQL.
_ACCEPTED = {"assign": "length(regexp_extract(m, '{pattern}', 2)) >= 6", "access": "length(m) >= 20", "hex": "length(m) >= 24"}


def sql(rules: tuple[Rule, ...] = BASE + ADDED) -> str:
    """The same rows as `digest` from DuckDB: places are sums over the matches and what stands between them."""
    found = []
    for order, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        accepted = _ACCEPTED.get(r.kind, "TRUE").replace("{pattern}", pattern)
        found.append(f"""
        SELECT doc_id, '{r.kind}' AS kind, {order} AS o, start, start + length(m) AS stop FROM (
            SELECT doc_id, m, k, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS start FROM (
                SELECT doc_id, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, generate_subscripts(ms, 1) AS k FROM (
                    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs FROM d)))
        WHERE {accepted}""")
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o)"
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({' UNION ALL '.join(found)}),
    s AS (SELECT doc_id, {counts}, {listed} FILTER (WHERE kind IN ({base})) AS base, {listed} AS spans FROM f GROUP BY doc_id)
    SELECT d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN s USING (doc_id)"""
