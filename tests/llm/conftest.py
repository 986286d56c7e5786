import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, n long, rid long, tag string, row long, block string, size int, copies int, kept boolean"


def make_docs(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, "x", 1, 2, "y", 3, "z", 4, 5, True) for i, t, lang, src in rows], SCHEMA)


def messy(seed=1, n=60):
    """Copies, near copies, shared passages, nulls, empty and white texts, repeated ids and rows, a very long text."""
    rng = random.Random(seed)
    vocabulary = [rng.choice("bcdfgl") + rng.choice("aeiouéß") + rng.choice(["", "n", "st", "漢", "🙂"]) for _ in range(120)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = []
    for i in range(n):
        t = text(rng.randint(0, 80))
        if i % 4 == 1:
            t = f"{t}\n{passage} {text(5)}"
        if i % 5 == 2 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 7 == 3 and rows:
            w = (rows[-1][1] or "").split(" ")
            w[len(w) // 2 : len(w) // 2 + 1] = ["Changed,"]
            t = " ".join(w)
        if i % 9 == 4:
            t = t.replace(" ", "\t\n") + " \r\x0b"
        rows.append((i * 3 - 20, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "\U0001f600", None])))
    rows += [(500, None, None, None), (501, "", "en", "a"), (502, " \t", "fr", "a"), (None, rows[1][1], "en", "b"), (None, "alone  here", None, "b"), (503, "one", "en", "c"), (503, "One", "en", "c"), rows[1], rows[1], (504, text(3000), "en", "a"), (505, "x" * 5000, "en", "b")]
    return rows


@pytest.fixture
def docs(spark):
    return make_docs(spark, messy())


@pytest.fixture
def none(spark):
    return make_docs(spark, [])
