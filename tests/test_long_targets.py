"""Scores of targets that need long sources."""

import math

import pytest

from fsweave.operators import ngram, scoring
from fsweave.sources import catalog


def test_targets_longer_than_twelve_are_scored(spark):
    m, model = catalog.letters(zip("ab", "xy")), ngram.FiniteModel({"a" * 20: 0.5, "a" * 15 + "b": 0.5})
    df = spark.createDataFrame([("x" * 15,)], "target string")
    got = {r.sym: math.exp(r.logp) for r in scoring.score_targets(df, m, model).collect()}
    assert set(got) == {"x", "y"} and all(abs(p - 0.5) < 1e-9 for p in got.values())


def test_too_many_sources_are_an_error():
    m, model = catalog.delete_b(), ngram.NgramModel.train(["ab" * 9, "b" * 40], 2, 0.5)
    with pytest.raises(RuntimeError, match="go on"):
        scoring._followed([(0, "a", 0), (0, "b", 0)], [0], (), (0,), model, most=100)
    got = scoring.exact(m, ngram.FiniteModel({"a": 0.5, "b" * 30 + "a": 0.5}), (), None)
    assert abs(math.exp(got["A"]) - 1) < 1e-9
