"""Machines as tables of arcs: composition with silent moves, functionality, components."""

import random
from collections import defaultdict

import pytest

from fsweave.operators import algebra, graphs
from fsweave.plans.machine import ARC_SCHEMA, EPS, STATE_SCHEMA, Machine
from fsweave.plans.precover import strings_below
from fsweave.sources import catalog


def random_machine(seed, reads, writes, n=4, arcs=9):
    rng = random.Random(seed)
    rows = {(rng.randrange(n), rng.choice([*reads, EPS]), rng.choice([*writes, EPS]), rng.randrange(n)) for _ in range(arcs)}
    rows = [(i, a, b, j) for i, a, b, j in rows if a != EPS or b == EPS or i < j]  # no endless writing
    return Machine.of(rows, [0], [n - 1, rng.randrange(n)])


def counted_paths(arcs, starts, finals, longest):
    """How many paths spell each (input, output) pair, up to some number of arcs."""
    out, level = defaultdict(int), [("", "", s) for s in starts]
    for _ in range(longest + 1):
        for x, y, s in level:
            if s in finals:
                out[x, y] += 1
        level = [(x + a, y + b, j) for x, y, s in level for i, a, b, j in arcs if i == s]
    return out


@pytest.mark.parametrize("seed", [1, 2, 5])
def test_silent_composition(spark, seed):
    f, g = random_machine(seed, "ab", "cd", 3, 6), random_machine(seed + 50, "cd", "xy", 3, 6)
    arcs, states = graphs.compose_silent(*f.to_df(spark), *g.to_df(spark))
    got_arcs = [(tuple(r.src), r.ilabel, r.olabel, tuple(r.dst)) for r in arcs.collect()]
    ends = states.collect()
    m = Machine.of(got_arcs, [tuple(r.state) for r in ends if r.is_start], [tuple(r.state) for r in ends if r.is_final])
    want = algebra.compose(f, g)
    for x in strings_below(f, 3):
        assert {"".join(y) for y in algebra.transduce(m, x, 6)} == {"".join(y) for y in algebra.transduce(want, x, 6)}
    assert {s for i, _, _, j in got_arcs for s in (i, j)} <= {tuple(r.state) for r in ends}


def test_pairs_of_paths_are_met_once(spark):
    """Two silent moves on either side meet in one order only."""
    f = Machine.of([(0, "a", EPS, 1), (1, "b", EPS, 2), (2, "c", "m", 3)], [0], [3])
    g = Machine.of([(0, EPS, "x", 1), (1, EPS, "y", 2), (2, "m", "z", 3)], [0], [3])
    arcs, states = graphs.compose_silent(*f.to_df(spark), *g.to_df(spark))
    ends = states.collect()
    paths = counted_paths([tuple(r) for r in arcs.collect()], [r.state for r in ends if r.is_start], [r.state for r in ends if r.is_final], 8)
    assert paths == {("abc", "xyz"): 1}


@pytest.mark.parametrize("name", ["newspeak", "parity", "anbn", "backticks", "small", "split_copy", "triplets", "lookahead"])
def test_functionality_agrees_with_the_driver(spark, name):
    m = catalog.CATALOG[name]() if name != "newspeak" else catalog.newspeak("abdu")
    wrong = graphs.conflicts(*m.to_df(spark)).collect()
    assert bool(wrong) == (not algebra.is_functional(m)[0] if isinstance(algebra.is_functional(m), tuple) else not algebra.is_functional(m))


def test_conflicts_of_several_kinds(spark):
    for arcs, finals, bad in (
        ([(0, "a", "x", 1), (0, "a", "y", 2)], [1, 2], True),  # outputs part
        ([(0, "a", "x", 1), (0, "a", "y", 2)], [1], False),  # one of them ends nowhere
        ([(0, "a", "x", 1), (0, "a", EPS, 2)], [1, 2], True),  # a lead is left at the end
        ([(0, "a", "x", 1), (0, "a", EPS, 2), (1, "b", EPS, 3), (2, "b", "x", 3)], [3], False),  # a lead is made up for
        ([(0, "a", "x", 0), (0, "a", EPS, 1), (1, "a", EPS, 1), (1, "b", EPS, 2), (0, "b", EPS, 2)], [2], True),  # leads grow
    ):
        m = Machine.of(arcs, [0], finals)
        got = graphs.conflicts(spark.createDataFrame(arcs, ARC_SCHEMA), spark.createDataFrame([(q, q == 0, q in finals) for q in m.states], STATE_SCHEMA))
        assert bool(got.collect()) == bad
    none = graphs.conflicts(spark.createDataFrame([], ARC_SCHEMA), spark.createDataFrame([], STATE_SCHEMA))
    assert none.count() == 0


@pytest.mark.parametrize("seed, n, arcs", [(1, 30, 40), (2, 30, 60), (3, 1, 0), (4, 12, 60)])
def test_components(spark, seed, n, arcs):
    rng = random.Random(seed)
    hops = {(rng.randrange(n), rng.randrange(n)) for _ in range(arcs)}
    df = spark.createDataFrame([(i, "a", "a", j) for i, j in hops], ARC_SCHEMA)
    states = spark.createDataFrame([(q, q == 0, False) for q in range(n)], STATE_SCHEMA)
    far = {q: {q} for q in range(n)}
    for _ in range(n):
        far = {q: far[q] | {k for i, k in hops if i in far[q]} for q in far}
    loops = {q for q in range(n) if any(i == q and q in far[j] for i, j in hops)}
    want = {(q, min(k for k in far[q] if q in far[k]), q in loops, not far[q] & loops) for q in range(n)}
    assert {tuple(r) for r in graphs.endless(df, states).collect()} == want
