"""Whitening against NumPy on all rows at once."""

import numpy as np
import pytest

from trackloom.llm.queries import op11_whitening
from trackloom.llm.whitening import fit_whitening, merged, moments, squared_lengths, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(rng, n, d=6):
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base.astype(np.float32))]
    return rows + [(n + i, rows[3][1], 1) for i in range(40)]


def good(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(x is not None and np.isfinite(x) for x in r[1])]


def check(got, rows, d):
    fine = good(rows, d)
    x = np.floor(256.0 * np.array([r[1] for r in fine], dtype=np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    w = (x - sums / n) @ vectors / np.sqrt(values)
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == [1, 2, 3, 4]
    for c, found in by.items():
        assert sum(map(len, found.values())) == len(fine)
        mine = np.array([found[r[0]][0].whitened for r in fine])
        sign = np.sign(mine @ w[:, c - 1])
        assert np.allclose(mine, sign * w[:, c - 1], atol=1e-9)
        for k, r in enumerate(fine):
            one = found[r[0]][0]
            assert (one.n, one.deviation) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], sums)))
            assert one.explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9) and 0 <= one.identity_error < 1e-9


def test_query_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = rows_of(rng, 300)
    rows += [(900, None, 1), (901, [None, 1.0, 2.0, 3.0, 4.0, 5.0], 1), (902, [float("nan")] * 6, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [-0.0] * 6, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(op11_whitening(spark, str(tmp_path)).collect(), rows, 6)


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 3])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op11_whitening(spark, str(tmp_path)).collect() == []


def test_null_ids_and_other_columns(spark):
    rows = [(None, [0.0, 1.0], 1, "p"), (1, [1.0, 0.0], 2, "q"), (1, [1.0, 0.5], 3, "r")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec int, row string")
    model = fit_whitening(df)
    got = whiten(df, model).collect()
    assert model.n == 3 and len(model.eigenvalues) == 2 and sorted(str(r.vec_id) for r in got) == ["1", "1", "None"]


def test_exact_sums_and_moments():
    rng = np.random.default_rng(0)
    for bits, n in ((8, 7), (20, 10**6), (40, 2**20), (50, 2**40)):
        x = rng.integers(-(2**bits), 2**bits, (5, 3))
        sums = tuple(int(s) for s in rng.integers(-(2**55), 2**55, 3))
        assert squared_lengths(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    w = rng.normal(size=(30, 3)) + 100
    one, both = moments(w), merged(merged(None, moments(w[:11])), moments(w[11:]))
    assert one[0] == both[0] and np.allclose(one[1], both[1]) and np.allclose(one[2], both[2])
