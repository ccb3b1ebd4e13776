"""Fits of hidden states against the definition, row by row."""

import numpy as np

from trackloom.operators import state_fits as f
from trackloom.operators.states import transition_matrix


def plain_density(params, row):
    pr, ms, ma, vs, va, vr, cov = params
    x = np.array([row[1] - ms, row[2] - ma, row[3]])
    e = np.array([[vs, cov, 0], [cov, va, 0], [0, 0, vr]])
    return (pr if row[0] else 1 - pr) * 4 / (np.pi**2 * np.sqrt(np.linalg.det(e))) / (1 + x @ np.linalg.inv(e) @ x) ** 3


def plain_chances(p, moves):
    n, m = p.shape
    ahead, back, v = [], [], np.full(m, 1 / m)
    for row in p:
        v = np.diag(row) @ moves @ v
        v = v / v.sum()
        ahead.append(v)
    v = np.ones(m)
    for row in p[::-1]:
        v = moves @ np.diag(row) @ v
        v = v / v.sum()
        back.append(v)
    both = np.array(ahead) * np.array(back[::-1])
    return both / both.sum(axis=1, keepdims=True)


def plain_estimates(rel, seen):
    out = []
    for w in (rel / rel.sum(axis=0)).T:
        c = 1 / (1 - (w**2).sum())
        r, s, a, ar = seen.T
        ms, ma = (w * s).sum(), (w * a).sum()
        out.append([(w * r).sum(), ms, ma, c * ((w * s * s).sum() - ms**2), c * ((w * a * a).sum() - ma**2), (w * ar * ar).sum(), c * ((w * a * s).sum() - ma * ms)])
    return np.array(out)


def plain_fit(seen, start, moves):
    params, n = start, 0
    while True:
        p = np.array([[plain_density(s, row) for s in params] for row in seen])
        rel = plain_chances(p, moves)
        fresh = plain_estimates(rel, seen)
        n += 1
        even = fresh.copy()
        even[:, 3:] = np.average(fresh[:, 3:], axis=0, weights=rel.sum(axis=0))
        if (n > 1 and np.abs(even - params).sum() <= 0.1) or n == f.MOST_ROUNDS:
            p = np.array([[plain_density(s, row) for s in fresh] for row in seen])
            pairs = sum(np.outer(a, b) for a, b in zip(p, p[1:]))
            new = moves * pairs
            return fresh, new / new.sum(axis=1, keepdims=True), rel, n
        params = even


def series(rng, n):
    state = np.repeat(rng.integers(0, 2, n // 10 + 1), 10)[:n]
    return np.stack([rng.random(n) < 0.1 + 0.5 * state, rng.normal(1 + 4 * state, 0.5), rng.normal(0.5 + state, 0.4), rng.normal(0, 1, n)], axis=1).astype(float)


def test_fits_by_chunk_and_whole_agree_with_the_definition(spark):
    rng = np.random.default_rng(6)
    data = {k: series(rng, n) for k, n in enumerate((60, 45, 130))}
    rows = [(k, i, bool(r[0]), *map(float, r[1:])) for k, s in data.items() for i, r in enumerate(s)] + [(7, i, True, 1.0, 1.0, 1.0) for i in range(5)] + [(8, 0, True, 1.0, 2.0, 3.0), (9, 0, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "bid int, frame long, r boolean, s double, a double, ar double")
    for chunk in (1000, 25):
        found = {}
        for x in f.fitted_states(df, ("r", "s", "a", "ar"), tau=10.0, step=1.0, chunk=chunk).collect():
            found.setdefault((x.bid, x.states), {})[x.state] = x
        assert {k for k, _ in found} == {0, 1, 2}
        for k, seen in data.items():
            params = plain_estimates(np.ones((len(seen), 1)), seen)
            for states in (1, 2, 3):
                mine = found[k, states]
                if states > 1:
                    start = np.vstack([params, params[-1:]])
                    start[-1, 1] += 1
                    params, moves, rel, rounds = plain_fit(seen, start, np.array(transition_matrix(10.0, 1.0, states)))
                else:
                    moves, rel, rounds = np.ones((1, 1)), np.ones((len(seen), 1)), 0
                assert np.allclose([[mine[i][n] for n in f.NAMES] for i in range(states)], params, rtol=1e-6, atol=1e-8)
                assert np.allclose([mine[i].moves for i in range(states)], moves) and mine[0].rounds == rounds
                share = rel.mean(axis=0)
                assert np.allclose([mine[i].weight for i in range(states)], share)
                safe = np.where(rel > 0, rel, 1)
                assert np.isclose(mine[0].entropy, (rel * np.log2(safe)).sum() / len(seen) - (share * np.log2(share)).sum())


def test_a_known_estimate_of_transitions():
    p = np.array([[0.3, 0.8]] * 5 + [[0.7, 0.2]] * 2 + [[0.3, 0.8]] * 3)
    found = f.new_moves(np.array([[0.5, 0.5], [0.3, 0.7]]), f.pair_sums(p))
    assert np.allclose(found, [[0.39726027, 0.60273973], [0.18333333, 0.81666667]])
