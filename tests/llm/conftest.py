import random

import pytest

#: Documents with columns whose names clash with those that operators use inside or return.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, size string, start long, key string, _l string, _id long, _chunks string, _lines string, score string, n_removed long, kept string, shard string, fp string, part string, h long"


def _rows(texts, first=1):
    return [(first + i, t, None, f"src{i % 3}", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark):
    """documents(texts) or documents(rows): a table like the driver's, in three partitions."""

    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        rows = list(rows)
        if rows and not isinstance(rows[0], tuple):
            rows = _rows(rows)
        return spark.createDataFrame(rows, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Null and blank texts, a null id and source, repeated rows, ties, a long text, and clashing column names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long = "\n".join(prose(30) + "." for _ in range(700))
    texts = [None, "", " \n\t ", "one", prose(40), prose(60) + "\n" + prose(60), long, "é ü ß 漢字 \U0001f600 " + prose(30), "12 34 !!"]
    rows = [(i, t, "en" if i % 2 else None, None if i == 4 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows += [(3, "one", None, "s1", None), (None, texts[4], None, None, None), (None, prose(30), None, "s0", None), (20, texts[4], "de", "s0", 3), (20, texts[4], "de", "s0", 3), (21, texts[5], None, "s1", None)]
    return spark.createDataFrame([(*r, *([None] * 16)) for r in rows], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)
