"""Vector codes against a plain Lloyd iteration."""

import math
import random

import numpy as np
import pytest

from fsweave.llm import op11_vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, id long, vector string, ids int, n long, part int"


def plain(rows, parts, entries, rounds):
    """Codes and codebooks with integers of Python, every part against every entry."""
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for _, v, _ in good] for p in range(parts)]
    seeds = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][1]))[:entries]
    books = [[cut[p][k] for k in seeds] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        near = [[min(range(len(b)), key=lambda e: (far(x, b[e]), e)) for x in xs] for b, xs in zip(books, cut)]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x for x, n in zip(cut[p], near[p]) if n == e]
                    if mine:
                        books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    out = []
    for k, (i, _, y) in enumerate(good):
        out.append((i, y, "".join(f"{near[p][k]:02x}" for p in range(parts)), sum(far(cut[p][k], books[p][near[p][k]]) for p in range(parts))))
    return sorted(out, key=str), books


def vectors(n, size, seed, grid=False):
    rng = random.Random(seed)
    one = lambda: rng.randint(-3, 3) / 256 if grid else rng.gauss(0, 0.2)  # noqa: E731  a grid has many ties
    rows = [(i, [float(np.float32(one())) for _ in range(size)], rng.choice([None, 0, 1, 2])) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (7, rows[9][1], 1), (-4, None, 1), (-3, [None] + rows[0][1][1:], 1), (-2, [float("nan")] + rows[0][1][1:], 0), (-1, rows[0][1][:-1] + [float("-inf")], 0)]
    rows += [(n + k, rows[1][1], None) for k in range(n // 2)]  # a third is one vector
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2, "y", 3, 4, 5) for i, v, y in rows], SCHEMA)


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("n, size, parts, entries, rounds", [(300, 8, 4, 16, 2), (40, 6, 2, 64, 3), (300, 12, 3, 256, 1)])
def test_equals_a_plain_iteration(spark, monkeypatch, n, size, parts, entries, rounds, grid):
    monkeypatch.setattr(op, "BLOCK", 64)
    monkeypatch.setattr(op, "LEAF", 4)
    rows = vectors(n, size, n + size, grid)
    want, want_books = plain(rows, parts, entries, rounds)
    got, books = op.compress(frame(spark, rows), parts, entries, rounds)
    assert books.tolist() == [[list(e) for e in b] for b in want_books]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_no_rows_few_rows_and_bad_ones(spark):
    got, books = op.compress(frame(spark, []))
    assert got.count() == 0 and books.shape == (16, 0, 1)
    got, _ = op.compress(frame(spark, [(5, [0.5] * 32, 1), (2, None, 1)]))
    assert [tuple(r) for r in got.collect()] == [(5, 1, "00" * 16, 0)]
    for bad in ([(1, [0.5] * 31, 1)], [(1, [0.5] * 32, 1), (2, [0.5] * 48, 1)], [(1, [1e9] * 32, 1)]):
        with pytest.raises(Exception, match="components|length|beyond"):
            op.compress(frame(spark, bad))[0].collect()


def test_nearest_of_clusters():
    """Where parts lie in clusters, nodes are settled far above the leaves."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-10_000, 10_000, (8, 4))
    points = middle[rng.integers(0, 8, 8000)] + rng.integers(-20, 20, (8000, 4))
    tree = op.Tree.build(points)
    codes, total, count = tree.nearest(middle)
    brute = ((points[tree.order][:, None] - middle) ** 2).sum(2).argmin(1)
    assert (codes == brute).all() and (count == np.bincount(brute, minlength=8)).all()
    assert all((total[e] == tree.points[brute == e].sum(0)).all() for e in range(8))
    assert tree.depth > 7 and tree.sums[0].tolist() == points.sum(0).tolist()
