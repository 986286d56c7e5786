"""Fill-in-middle: texts cut at unit borders and written with their middle last."""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Lines with their line feed; what stands before prefix, suffix and middle.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
#: Seed of the draws; of 100 documents, how many are transformed, and of these, how many have the suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
SHAPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def ends_of(text: str, unit: regex.Pattern) -> array:
    """0 and the end offset of every unit, in code points."""
    ends = array("q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(seed: int, doc_id: str) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers, the first digits of a SHA-256 over seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(text: str, doc_id: str, unit: regex.Pattern, seed: int, rate: int, suffix_first: int) -> tuple:
    """n, form, prefix and middle length, output of one text."""
    ends = ends_of(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, last = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = MARKS[0] + text[:first], MARKS[2] + text[first:last], MARKS[1] + text[last:]
    if h4 % 100 < suffix_first:
        return n, "spm", first, last - first, suffix + prefix + middle
    return n, "psm", first, last - first, prefix + suffix + middle


def restored(output: str, form: str) -> str:
    """The text that an output was made of; no part holds a mark, so the marks part it."""
    if form == "plain":
        return output
    p, s, m = (output.index(mark) for mark in MARKS)
    suffix = output[s + len(MARKS[1]) : m if form == "psm" else p]
    prefix = output[p + len(MARKS[0]) : s if form == "psm" else m]
    return prefix + output[m + len(MARKS[2]) :] + suffix


def restore(output, form):
    """The column of texts rebuilt from the columns ``output`` and ``form``."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return run(output, form)


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output of every whole text.

    Texts are cut at ends of units (``unit`` must match all of a text, left to right).
    Null and empty texts and texts that hold a mark stay plain, as do those that
    ``rate`` spares; the lengths of plain ones are null.  Draws depend on seed and doc_id
    alone, so repeated rows with one text have one output; a null doc_id is drawn for as
    the empty word.  No documents give no rows; other columns are ignored.  Each text is
    cut by itself, whatever its length, and nothing is shuffled.
    """
    if regex.compile(unit).fullmatch(""):
        raise ValueError("a unit has at least one character")

    @F.pandas_udf(SHAPE)
    def run(texts: pd.Series, ids: pd.Series) -> pd.DataFrame:
        cut = regex.compile(unit)
        rows = [transformed(t, i, cut, seed, rate, suffix_first) for t, i in zip(texts, ids)]
        n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
        lengths = lambda values: pd.array(values, "Int64")
        return pd.DataFrame({"n": np.array(n, np.int64), "form": list(form), "prefix_chars": lengths(list(prefix)), "middle_chars": lengths(list(middle)), "output": list(output)})

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), run(F.coalesce("text", F.lit("")), F.coalesce(doc_id.cast("string"), F.lit(""))).alias("made")).select("doc_id", "made.*")


def digests(output, form):
    """Digests of outputs and of the texts rebuilt from them, as a struct column."""
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"output_sha256": [hexed(o) for o in outputs], "restored_sha256": [hexed(restored(o, f)) for o, f in zip(outputs, forms)]})

    return run(output, form)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests("output", "form").alias("d")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "d.*")


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
e AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
g AS (
  SELECT doc_id, n, t, plain, h4, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM f),
o AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         CASE WHEN plain THEN t WHEN h4 % 100 < 50 THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS output FROM g)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
