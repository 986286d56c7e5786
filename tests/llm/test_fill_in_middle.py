"""Fill-in-middle against a plain version."""

import hashlib
import re

import pytest

from fsweave.llm import op12_fill_in_middle as fim

from .conftest import make_docs, messy


def plain(doc_id, text, rate=100, spm=50):
    """The same in few words, from the hexadecimal digits and joined lines."""
    text, key = text or "", "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"7:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, len(p), len(m), output)


def rows():
    lines = ["", "\n", "\n\n\n", "a\nb\nc", "a\r\nb c\x85d\n", "🙂\n漢\n" * 50, "x <P> y", "<M>", "< P>\n<S", "long " * 30_000 + "\n" + "z" * 100_000, "\x00\n\x00"]
    return messy() + [(1000 + k, t, None, None) for k, t in enumerate(lines)] + [(1003, "a\nb\nc", None, None)] + [(2000 + k, "one\ntwo\nthree\nfour", "en", "a") for k in range(40)]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (0, 50), (100, 100)])
def test_equals_a_plain_version_and_comes_back(spark, rate, spm):
    docs = make_docs(spark, rows())
    made = fim.fill_in_middle(docs, rate=rate, suffix_first=spm)
    got = made.withColumn("back", fim.restore("output", "form")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((plain(i, t, rate, spm) for i, t, *_ in rows()), key=str)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t, *_ in rows())


def test_no_rows_and_other_units(spark, none):
    assert fim.fill_in_middle(none).count() == 0
    made = fim.fill_in_middle(make_docs(spark, [(1, "abcdef", None, None)]), unit=".").first()
    assert made.n == 6 and fim.restored(made.output, made.form) == "abcdef"
    with pytest.raises(ValueError):
        fim.fill_in_middle(none, unit="a*")
