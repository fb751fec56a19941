import math

import numpy as np
import pytest

from gridlark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, n string"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, most=16):
    """Exact integers in plain Python; the covariance in numpy over centred rows."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    share = values / np.trace(centred.T @ centred / n)
    out = []
    for i, x in usable:
        c = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), c @ vectors / np.sqrt(values)))
    return out, share


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1, "a", "b") for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whitened(df)
    assert got.columns == COLUMNS
    return got.collect()


def compare(got, rows, k=16):
    want, share = brute(rows, k)
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(want) * k and {r.n for r in got} == {want[0][1]}
    signs = [0.0] * k
    for i, _, deviation, w in want:
        for c in range(k):
            near = min((abs(abs(r.whitened) - abs(w[c])), r.whitened) for r in found[i, deviation][c + 1])
            assert near[0] < 1e-7 * max(1, abs(w[c]))
            if abs(w[c]) > 1e-6:
                sign = math.copysign(1, near[1] * w[c])
                assert signs[c] in (0.0, sign)  # the same for all rows
                signs[c] = sign
    assert all(abs(r.explained - share[r.component - 1]) <= 1e-9 * share[r.component - 1] for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    spread = np.linspace(0.3, 4, d)
    return [[float(np.float32(c)) for c in v] for v in rng.normal(size=(n, d)) * spread + rng.normal(size=d) * 50]


def test_against_plain_python(spark):
    v = vectors(3, 300, 20)
    rows = [*enumerate(v), (None, v[0]), (7, v[1]), (7, v[7]), (400, None), (401, [*v[0][:-1], None]), (402, [*v[0][:-1], math.inf]), (403, [*v[0][:-1], math.nan]), (1 << 60, v[5]), ((1 << 60) + 1, v[6])]
    compare(run(spark, rows), rows)


def test_one_hot_vector(spark):
    v = vectors(4, 120, 6)
    rows = list(enumerate(v + [v[3]] * 300))
    compare(run(spark, rows), rows, 6)


def test_a_common_offset_costs_no_digit(spark):
    v = [[100_000 + c for c in x] for x in vectors(5, 200, 5)]
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    compare(run(spark, rows), rows, 5)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_without_variance_there_are_no_components(spark, rows):
    assert run(spark, rows) == []


def test_fewer_components_than_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(50)]
    got = run(spark, rows)
    assert {r.component for r in got} == {1} and len(got) == 50 and abs(got[0].explained - 1) < 1e-12 and got[0].identity_error < 1e-9
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(abs(i - 24.5) / np.std(np.arange(50)) for i in range(50)))


def test_large_entries_and_other_lengths(spark):
    rows = [(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0]), (4, [1.0]), (5, [0.0, 0.0])]
    got = run(spark, rows)
    assert {r.vec_id for r in got} == {1, 2, 3, 5} and all(math.isfinite(r.whitened) for r in got)
    assert {r.vec_id for r in got if r.deviation is None} == {1, 2}


def test_deviations_are_exact_integers():
    rng = np.random.default_rng(1)
    for big in (100, 1 << 20, 1 << 40):
        x = rng.integers(-big, big, (50, 4))
        model = whitening.Whitening(50, x.sum(axis=0).tolist(), np.eye(4))
        want = [sum((50 * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
        assert model.deviations(x) == [w if w < 1 << 63 else None for w in want]
