"""Hard negatives against all pairs."""

import numpy as np
import pytest

from trackloom.llm import hard_negatives as h
from trackloom.llm.queries import op12_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def all_pairs(rows, every, relabel=False):
    """The definition, row by row."""
    good = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or len(v) != 6 or not all(c is not None and np.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if relabel and i % 7 == 0 else label
        x = np.floor(256 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64)
        key = (label, [b - 256 if b > 127 else b for b in x.astype("<i8").tobytes()])
        if i not in good or (key[0], bytes(b % 256 for b in key[1])) < (good[i][0], good[i][1].tobytes()):
            good[i] = (label, x)
    out = []
    for a, (label, x) in good.items():
        if a % every:
            continue
        scored = sorted((-int(x @ y), i, m) for i, (m, y) in good.items() if i != a)
        for ps, p, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(i, -s) for s, i, m in scored if m != label and 50 * -ps <= 100 * -s <= 95 * -ps]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(fits[:3])]
    return sorted(out)


def table(seed, n, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6))
    rows = [(int(i), [float(c) for c in (centres[i % 5] + spread * rng.normal(size=6)).astype(np.float32)], int(rng.integers(0, 4))) for i in range(n)]
    hot = [(n + i, rows[8][1], int(i % 3)) for i in range(n // 3)]
    zero = [(2 * n + i, [0.0] * 6, i % 2) for i in range(12)]
    odd = [(3 * n, None, 1), (3 * n + 1, [None] + [1.0] * 5, 1), (3 * n + 2, [float("nan")] * 6, 1), (3 * n + 3, [float("inf")] * 6, 1), (3 * n + 4, [], 1), (3 * n + 5, [1.0] * 5, 1), (3 * n + 6, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    return rows + hot + zero + odd + rows[:30] + [(5, [float(c) for c in centres[0].astype(np.float32)], rows[5][2])] + [(4 * n, [-1.0, 0.5, 0.0, 0.0, 0.0, 0.0], 77)]


def test_query_against_all_pairs(spark, tmp_path):
    rows = table(1, 900)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op12_hard_negatives(spark, str(tmp_path)).collect())
    assert got == all_pairs(rows, 50, True) and len(got) > 200


def test_small_chunks_and_deep_trees(spark, monkeypatch):
    for name, value in (("CANDIDATE_CHUNK", 40), ("CANDIDATE_LEAF", 7), ("ANCHOR_CHUNK", 20), ("ANCHOR_LEAF", 4), ("LABEL_BUCKETS", 2), ("SAMPLE", 100)):
        monkeypatch.setattr(h, name, value)
    rows = table(2, 500, 0.2)
    got = h.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i % 9 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == all_pairs(rows, 9)


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0] * 6, 1)], [(0, [1.0] * 6, 1), (1, [1.0] * 6, 2)]])
def test_nothing_to_mine(spark, rows):
    assert h.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0).collect() == []


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(3)
    x, y = rng.integers(-(2**29), 2**29, (20, 4)), rng.integers(-(2**29), 2**29, (30, 4))
    assert (h.products(x, y) == np.array([[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x])).all()
    with pytest.raises(OverflowError):
        h.products(x * 2**10, y)
    low, high = h.windows(np.array([[100, 7, -3, 0, -h.FAR]]), (50, 95))
    assert low.tolist() == [[50, 4, h.FAR, 0, h.FAR]] and high.tolist() == [[95, 6, -h.FAR, 0, -h.FAR]]
    assert sorted(np.concatenate(list(h.split_leaves(np.zeros((50, 2)), 8))).tolist()) == list(range(50))
