"""N-gram counts of words that carry how often they occur."""

from pyspark.sql import functions as F

from fsweave.operators import ngram


def test_weighted_counts_equal_counts_of_all_occurrences(spark):
    words = spark.createDataFrame([("aba", 3), ("b", 2), ("", 4)], "x string, n long")
    each = words.select("x", F.explode(F.expr("sequence(1, n)")).alias("k"))
    got = ngram.ngram_counts(ngram.symbols(words, "x", F.col("x"), "n"), 3, weight="n")
    want = ngram.ngram_counts(ngram.symbols(each, "x", F.col("x")), 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("ord = 0 AND sym = 'a'").first().cnt == 6
