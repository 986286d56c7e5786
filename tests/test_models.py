"""Sequence models, induced distributions, beams and sampling."""

import math

import numpy as np
import pytest

from fsweave.functions.logmath import log1mexp, log_softmax, logsumexp, logsumexp_list
from fsweave.operators import ngram, scoring
from fsweave.operators.algebra import transduce
from fsweave.sources import catalog

FINITE = {"": 0.2, "a": 0.3, "b": 0.2, "ab": 0.15, "ba": 0.15}


def pushed(m, p):
    out = {}
    for x, w in p.items():
        for y in transduce(m, x):
            out[y] = out.get(y, 0.0) + w
    return out


def test_byte_ngram_counts():
    data = b"the cat sat on the mat. the dog sat on the log. " * 10
    m = ngram.NgramModel.bytes(data, 4, 0.01)
    assert abs(sum(math.exp(v) for v in m.logp_next(tuple(b"the")).values()) - 1) < 1e-9
    assert m.logprefix(b"the ") > m.logprefix(b"zzz ")
    c = ngram.NgramModel.train(["abcabc"], 2, 0.5)
    nexts = c.logp_next(("a",))
    assert nexts["b"] > nexts["c"] and abs(sum(map(math.exp, nexts.values())) - 1) < 1e-9


@pytest.mark.parametrize("name", ["delete_b", "parity", "count_mod3", "small"])
def test_exact_scores_equal_brute_force(name):
    m, model = catalog.CATALOG[name](), ngram.FiniteModel(FINITE)
    out = pushed(m, FINITE)
    for target in {y[:k] for y in out for k in range(len(y) + 1)}:
        total = sum(p for y, p in out.items() if y[: len(target)] == target)
        want = {y: sum(p for z, p in out.items() if z[: len(target) + 1] == (*target, y)) / total for y in m.writes}
        want[model.eos] = out.get(target, 0.0) / total
        exact = scoring.exact(m, model, target, 4)
        search = scoring.OutputModel(m, model).logp_next(target)
        for y, p in want.items():
            assert abs(math.exp(exact.get(y, float("-inf"))) - p) < 1e-9
            assert abs(math.exp(search.get(y, float("-inf"))) - p) < 1e-9


def test_hub_beam_equals_exact():
    m, model = catalog.letters(zip("ab", "xy")), ngram.FiniteModel(FINITE)
    beam = scoring.HubBeam(m, model)
    state = beam.start()
    for target in ((), ("x",)):
        got, want = beam.logp_next(state), scoring.exact(m, model, target, 4)
        assert all(abs(math.exp(got.get(y, float("-inf"))) - math.exp(v)) < 1e-9 for y, v in want.items())
        state = beam.advance(state, "x")


def test_character_beam_equals_enumeration():
    model = ngram.FiniteModel({"": 0.1, ("t1",): 0.3, ("t2",): 0.2, ("t2", "t3"): 0.25, ("t1", "t2"): 0.15})
    spelling = {"t1": "ab", "t2": "a", "t3": "b"}
    p = {}
    for x, w in model.p.items():
        y = "".join(spelling[t] for t in x)
        p[y] = p.get(y, 0.0) + w
    beam = scoring.CharacterBeam(model, spelling, k=50)
    state = beam.start()
    for prefix in ("", "a", "ab"):
        total = sum(w for y, w in p.items() if y.startswith(prefix))
        got = beam.logp_next(state)
        for c in "ab":
            want = sum(w for y, w in p.items() if y.startswith(prefix + c)) / total
            assert abs(math.exp(got.get(c, float("-inf"))) - want) < 1e-9
        assert abs(math.exp(got.get(model.eos, float("-inf"))) - p.get(prefix, 0.0) / total) < 1e-9
        state = beam.advance(state, "ab"[len(prefix) % 2])


def test_enumeration_and_importance_sampling():
    m, model = catalog.letters(zip("ab", "xy")), ngram.FiniteModel(FINITE)
    found = scoring.enumerate_sources(m, model, "x", 100)
    assert [(x, part) for x, part, _ in found][0] == (("a",), "Q") and abs(math.exp(found[0][2]) - 0.45) < 1e-9
    for absorb in (True, False):
        w = [scoring.importance_weight(m, model, "x", np.random.default_rng([3, k]), absorb=absorb) for k in range(3000)]
        assert abs(np.mean(np.exp(w)) - 0.45) < 0.03
    assert ngram.greedy(model, 5) == ("a",)
    rng = np.random.default_rng(5)
    draws = ["".join(ngram.sample(model, 5, rng)) for _ in range(2000)]
    assert abs(draws.count("a") / 2000 - 0.3) < 0.05


def test_log_arithmetic(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", -2.0), ("b", float("-inf")), ("c", -700.0), ("c", -700.0)], "k string, v double")
    got = {r.k: r.s for r in logsumexp(df, ["k"], "v", "s").collect()}
    assert abs(got["a"] - logsumexp_list([-1.0, -2.0])) < 1e-12 and got["b"] == float("-inf") and abs(got["c"] + 700 - math.log(2)) < 1e-9
    xs = spark.createDataFrame([(-1e-12,), (-0.5,), (-5.0,), (0.0,)], "x double")
    got = [r[0] for r in xs.select(log1mexp(xs.x)).collect()]
    assert all(abs(g - math.log(-math.expm1(x))) < 1e-9 for g, x in zip(got, (-1e-12, -0.5, -5.0))) and got[3] == float("-inf")
    arr = spark.createDataFrame([([1.0, 2.0, 1000.0],)], "v array<double>")
    assert abs(sum(math.exp(x) for x in arr.select(log_softmax(arr.v)).first()[0]) - 1) < 1e-9


def test_table_model_equals_local_model(spark):
    from pyspark.sql import functions as F

    words = ["abab", "abc", "", "ccab"]
    seqs = ngram.symbols(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "k int, w string"), "k", F.col("w"))
    counts = ngram.ngram_counts(seqs, 3)
    local = ngram.NgramModel.train(words, 3, 0.5)
    got = {r.k: r.logp for r in ngram.score(seqs, "k", counts, 3, 0.5, local.v).collect()}
    assert all(abs(got[i] - local.logprob(w)) < 1e-9 for i, w in enumerate(words))
    smooth = {(r.ctx, r.sym): r.logp for r in ngram.smoothed(counts, 0.5).where("ord = 2").collect()}
    assert abs(smooth["ab", "c"] - local.logp(("a", "b"), "c")) < 1e-9
    drawn = ngram.sampled(counts.where("ord = 0"), ["ctx"], "cnt", F.lit(0.0)).collect()
    assert len(drawn) == 1


def test_score_targets(spark):
    m, model = catalog.delete_b(), ngram.FiniteModel(FINITE)
    df = spark.createDataFrame([("",), ("A",), ("?",)], "target string")
    got = {(r.target, r.sym): r.logp for r in scoring.score_targets(df, m, model).collect()}
    assert abs(math.exp(got["", "A"]) - 0.6) < 1e-9 and ("?", "A") not in got
