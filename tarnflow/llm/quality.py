"""Line-first quality rules (built-in functions only).

Lines are judged one by one: a line fails when it is decoration instead of prose (symbol-laden), a navigation
strip (short items between separators), boilerplate (a known phrase in a line of few words), or without any sentence
mark, whatever its length. Failing lines are removed, and a document is rejected when what is left is too small a share
of its text.

Defined cases: a null or blank text has zero counts, loses nothing and is not kept (it fails n_words); repeated rows
are judged alike, row by row, so there are no ties; a very long text or line is judged as any other (n log n of its
words); null ids stay null; extra columns are ignored by `measure` and kept by `clean`, but for columns named
`clean_text`, `lost` and `line_kept`, which it replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import aside, back, given, words

SYMBOLS = "#*$%&|<>"
BARS = "|>»·•"
#: Sentence marks of several scripts; a line that has none is a label, a list item or debris.
MARKS = ".!?…:;。！？：；؟।"
#: Phrases that mark a line of at most `BOILERPLATE_WORDS` words as boilerplate, by language.
BOILERPLATE = {
    "en": (
        "cookie policy", "privacy policy", "terms of service", "terms of use", "all rights reserved", "click here",
        "sign up", "log in", "enable javascript", "subscribe to our newsletter", "share this article", "back to top",
        "skip to content", "read more",
    ),
    "de": (
        "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken",
        "jetzt registrieren", "javascript aktivieren", "newsletter abonnieren", "artikel teilen", "nach oben",
        "zum inhalt springen", "weiterlesen", "impressum",
    ),
    "fr": (
        "politique de cookies", "politique de confidentialité", "conditions d'utilisation", "tous droits réservés",
        "cliquez ici", "s'inscrire", "se connecter", "activer javascript", "abonnez-vous à notre newsletter",
        "partager cet article", "haut de page", "aller au contenu", "lire la suite", "mentions légales",
    ),
    "es": (
        "política de cookies", "política de privacidad", "términos de uso", "términos y condiciones",
        "todos los derechos reservados", "haga clic aquí", "haz clic aquí", "iniciar sesión", "activar javascript",
        "suscríbete a nuestro boletín", "compartir este artículo", "volver arriba", "saltar al contenido", "leer más",
        "aviso legal",
    ),
}
BOILERPLATE_WORDS = 25
WINDOW = 8


def with_repeated_words(df: DataFrame, array: str, out: str) -> DataFrame:
    """Number of words that lie in a window of 8 words found twice or more in the text.

    Windows with an equal hash are brought together by sorting (hash, start) inside the row, so that a long text
    costs n log n; rows without an equal pair skip the sort.
    """
    df = df.withColumn("_h", F.transform(array, lambda x: F.xxhash64(x)))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words, each from two of half its length
        df = df.withColumn("_h", F.zip_with("_h", F.slice("_h", 1 + step, F.size("_h")), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_h", F.slice("_h", 1, F.greatest(F.size(array) - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(F.get("_s", y)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda a, b: F.least(F.lit(WINDOW), b - a))
    return df.withColumn(out, F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_h", "_s", "_p")


def _only(text: Column, characters: str) -> Column:
    """Number of the characters of a text that stand in a regex class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def line_fails(line: Column, separators: int = 3, symbol_share: float = 0.1) -> Column:
    """True for a line that a rule removes; blank lines pass. Cheap tests stand first, as lines rarely reach the others."""
    n_words = F.size(words(line))
    bars = _only(line, BARS)
    decorated = _only(line, SYMBOLS) > symbol_share * F.length(line)
    navigation = (bars >= separators) & (bars * 4 >= n_words)
    phrase = (n_words <= BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(x for phrases in BOILERPLATE.values() for x in phrases))
    unmarked = ~line.rlike(f"[{MARKS}]") & line.rlike("[^\\x20\\x09-\\x0D]")
    return unmarked | (line.rlike(f"[{SYMBOLS}{BARS}]") & (decorated | navigation)) | phrase


def clean(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Add `clean_text` (without the failing lines), `lost` (share of characters removed) and `line_kept`."""
    value = F.coalesce(given(text), F.lit(""))
    rows = aside(df).withColumn("_lines", F.split(value, "\n"))
    rows = rows.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    rows = rows.withColumn("clean_text", F.when(F.size("_good") == F.size("_lines"), value).otherwise(F.array_join("_good", "\n"))).drop("_lines", "_good")
    full = F.length(value)
    rows = rows.withColumn("lost", F.when(full > 0, 1 - F.length("clean_text") / full).otherwise(0.0)).withColumn("line_kept", F.col("lost") <= max_lost)
    kept = [given(c) for c in df.columns if c not in ("clean_text", "lost", "line_kept")]
    return back(rows.select(*kept, "clean_text", "lost", "line_kept"))


def measure(df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Counts, base verdict and the line-first verdict, one row for each row of df."""
    df = clean(df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t")), "t", max_lost)
    df = df.withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select(
        "doc_id",
        "w",
        "lost",
        "line_kept",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _only(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("l"),
    )
    df = df.withColumn("n_dup_lines", (F.size("l") - F.size(F.array_distinct("l"))).cast("long")).drop("l")
    df = with_repeated_words(df, "w", "n_repeat_words").drop("w")
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & F.col("line_kept"))
    # A generator of one row: filters on the verdicts stay above it, instead of being rewritten into the whole chain.
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")
    return df.select("doc_id", F.inline(F.array(F.struct(*results))))


def sql(separators: int = 3, symbol_share: float = 0.1, max_lost: float = 0.5) -> str:
    """The same rows from DuckDB."""
    quoted = "|".join(x.replace("'", "''") for phrases in BOILERPLATE.values() for x in phrases)
    count = lambda x, characters: f"length(regexp_replace({x}, '[^{characters}]+', '', 'g'))"
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, {split('t')} AS w FROM d),
    wins AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM wins) WHERE c > 1),
    inside AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM twice) GROUP BY doc_id),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
    judged AS (
        SELECT *, worded AND NOT regexp_matches(line, '[{MARKS}]')
            OR {count('line', SYMBOLS)} > {symbol_share}::DOUBLE * length(line) OR bars >= {separators} AND bars * 4 >= n
            OR n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{quoted}') AS fails
        FROM (SELECT *, len({split('line')}) AS n, {count('line', BARS)} AS bars, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded FROM l)),
    lines AS (
        SELECT doc_id, (count(*) FILTER (WHERE worded) - count(DISTINCT line) FILTER (WHERE worded))::BIGINT AS n_dup_lines, bool_or(fails) AS cleaned,
            greatest(coalesce(sum(length(line) + 1) FILTER (WHERE NOT fails), 0) - 1, 0) AS left_over
        FROM judged GROUP BY doc_id),
    m AS (
        SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {count('t', SYMBOLS)}::BIGINT AS n_symbols,
            n_dup_lines, coalesce(inside.n, 0)::BIGINT AS n_repeat_words,
            CASE WHEN length(t) > 0 AND cleaned THEN 1 - left_over / length(t)::DOUBLE ELSE 0.0::DOUBLE END AS lost
        FROM w JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {max_lost} AS kept, lost
    FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)"""
