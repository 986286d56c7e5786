"""Outputs of long inputs, and of inputs with endlessly many outputs."""

import string

import pytest

from fsweave.operators import algebra
from fsweave.operators.apply import apply_batches, relation_rows, sequential_form
from fsweave.plans.machine import EPS, Machine
from fsweave.sources import catalog

BOTH = algebra.union(catalog.letters((c, c) for c in string.ascii_lowercase), catalog.letters((c, c.upper()) for c in string.ascii_lowercase))


def test_relation_rows_of_a_long_run(spark):
    run = "ab" * 6000
    rows = relation_rows(spark.createDataFrame([(run,), ("c",)], "word string"), BOTH, "word", "y").collect()
    assert sorted(r.y for r in rows) == sorted([run, run.upper(), "c", "C"])


def test_a_long_text_through_a_machine_without_sequential_form(spark):
    # the last letter decides what all letters before it become
    arcs = [(s, "a", b, s) for s, b in ((1, "x"), (2, "y"))] + [(1, "p", "p", 3), (2, "q", "q", 3)]
    m = Machine.of(arcs, [1, 2], [3])
    assert sequential_form(m) is None
    rows = apply_batches(spark.createDataFrame([("a" * 15_000 + "q",), ("a",)], "t string"), m, "t", "y").collect()
    assert [r.y for r in rows] == ["y" * 15_000 + "q", None]


def test_endless_outputs_are_an_error():
    m = Machine.of([(0, "a", "b", 1), (1, EPS, "c", 1), (0, "z", "z", 2)], [0], [1, 2])
    with pytest.raises(ValueError, match="endlessly"):
        list(algebra.transduce(m, "a"))
    assert list(algebra.transduce(m, "z")) == [("z",)]
    assert len(list(algebra.transduce(m, "a", 5))) == 6  # longer ones are not followed
    dead = Machine.of([(0, "a", "b", 1), (0, EPS, "c", 0), (3, "a", "b", 3)], [3], [3])
    assert list(algebra.transduce(dead, "a")) == [("b",)]
    silent = Machine.of([(0, EPS, EPS, 0), (0, "a", "b", 0)], [0], [0])
    assert list(algebra.transduce(silent, "aa")) == [("b", "b")]
