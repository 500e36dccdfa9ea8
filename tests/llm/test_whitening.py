"""Whitening against exact sums in Python and a dense covariance in numpy."""

import math
import random

import numpy as np
import pytest

from pagemill.llm import whitening


def _grid(vector):
    return tuple(math.floor(256 * float(np.float32(c))) for c in vector)


def _brute(rows, weights="one", components=4):
    grids = [(i, _grid(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = list(dict.fromkeys(g for _, g in grids)) if weights == "one" else [g for _, g in grids]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    matrix = np.array(fit, dtype=float)
    centred = matrix - matrix.mean(axis=0)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, g in grids:
        deviation = sum((n * c - s) ** 2 for c, s in zip(g, sums))
        away = np.array([c - s / n for c, s in zip(g, sums)])
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, deviation, away @ vectors[:, k] / math.sqrt(values[k]), values[k] / np.trace(covariance)))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def _same(spark, rows, weights="one"):
    made = {}
    for r in whitening.whitened(_frame(spark, rows), weights=weights).collect():
        made.setdefault((r["vec_id"], r["component"]), []).append(r)
    expected = _brute(rows, weights)
    assert made.keys() == expected.keys()
    signs = {}
    for key, own in expected.items():
        assert len(made[key]) == len(own)
        for row, (n, deviation, y, share) in zip(made[key], own):
            assert (row["n"], row["deviation"]) == (n, deviation)
            assert row["explained"] == pytest.approx(share, rel=1e-9)
            assert row["identity_error"] < 1e-9
            if abs(y) > 1e-3:
                assert signs.setdefault(key[1], np.sign(row["whitened"] * y)) == np.sign(row["whitened"] * y)
            assert abs(row["whitened"]) == pytest.approx(abs(y), abs=1e-8)


def _rows(seed, count, dim=6):
    rng = random.Random(seed)
    own = [(i, [rng.gauss(0, 1 + d) / 4 for d in range(dim)]) for i in range(count)]
    return own + [(count + i, own[0][1]) for i in range(count // 2)]


@pytest.mark.parametrize("weights", ["one", "count"])
def test_like_a_dense_covariance(spark, weights):
    _same(spark, _rows(3, 300), weights)


def test_copies_count_once(spark):
    """A third of all rows the same, and nearly the same, which the grid makes the same."""
    rows = _rows(5, 100)
    _same(spark, rows + [(1000 + i, [c + 1e-9 for c in rows[1][1]]) for i in range(200)])


def test_rows_that_are_left_out(spark):
    rows = _rows(7, 60)
    bad = [(900, None), (901, [None] * 6), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    assert {r["vec_id"] for r in whitening.whitened(_frame(spark, rows + bad)).select("vec_id").distinct().collect()} == {i for i, _ in rows}


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None if i % 3 == 0 else i // 4, v) for i, (_, v) in enumerate(_rows(8, 40))]
    assert whitening.whitened(_frame(spark, rows)).count() == 4 * len(rows)


def test_few_vectors_and_few_dimensions(spark):
    one = whitening.whitened(_frame(spark, [(1, [0.5, 0.25])] * 3)).collect()
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    line = whitening.whitened(_frame(spark, [(i, [i / 4, i / 4]) for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    assert max(r["identity_error"] for r in line) < 1e-9


def test_lengths_are_fitted_apart(spark):
    rows = _rows(9, 50, 6)
    others = [(500 + i, v) for i, v in _rows(10, 50, 3)]
    made = whitening.whitened(_frame(spark, [*rows, *others, (999, [])])).filter("vec_id < 500")
    alone = whitening.whitened(_frame(spark, rows))
    assert sorted(made.select("vec_id", "component", "n", "deviation").collect()) == sorted(alone.select("vec_id", "component", "n", "deviation").collect())


def test_empty_table_and_other_columns(spark):
    assert whitening.whitened(_frame(spark, [])).count() == 0
    assert whitening.whitened(_frame(spark, [(1, None)])).count() == 0
    plain = _frame(spark, _rows(11, 30))
    extra = plain.selectExpr("*", "1 AS id", "2 AS x", "3 AS key", "4 AS dim", "5 AS n", "6 AS at")
    columns = ["vec_id", "component", "n", "deviation"]
    assert sorted(whitening.whitened(extra).select(columns).collect()) == sorted(whitening.whitened(plain).select(columns).collect())


def test_sums_beyond_a_long_are_exact(spark):
    rows = [(i, [float(2**40 + 2**20 * i), float(i % 7)]) for i in range(50)]
    made = {r["vec_id"]: r["deviation"] for r in whitening.whitened(_frame(spark, [(i, [v[0] / 2**20, v[1]]) for i, v in rows])).collect()}
    expected = _brute([(i, [v[0] / 2**20, v[1]]) for i, v in rows])
    assert made == {i: own[0][1] for (i, k), own in expected.items() if k == 1}
    total = whitening._sums(whitening.distinct_vectors(whitening.grid_rows(_frame(spark, [(i, [2.0**54 + 2.0**31 * i]) for i in range(99)]), "vec_id", "embedding", 256), "one"))
    assert total[1] == (99, (sum(256 * (2**54 + 2**31 * i) for i in range(99)),))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    _same(spark, rows)
