"""Paths against a cell by cell version, and long pairs in pieces."""

import numpy as np
import pytest

from beatlake.operators import harmony


def plain_path(a, b, gully):
    """Cell by cell; the run of the way that reached a cell decides which ways go on from it."""
    cost = np.clip(1 - a @ b.T, 0, 2)
    n, m = cost.shape
    penalty, total, kind = np.median(cost), np.full((n, m), np.inf), np.zeros((n, m), int)
    total[0] = cost[0]
    for i in range(1, n):
        for j in range(m):
            ways = [(total[i - 1, j - 1] if j else np.inf), total[i - 1, j] + penalty if kind[i - 1, j] != 1 else np.inf, total[i, j - 1] + penalty if j and kind[i, j - 1] != 2 else np.inf]
            kind[i, j] = int(np.argmin(ways))
            total[i, j] = ways[kind[i, j]] + cost[i, j]
    start = int(gully * (m - 1))
    i, j = n - 1, start + int(np.argmin(total[-1, start:]))
    if not np.isfinite(total[i, j]):
        return []
    path = [(i, j)]
    while i:
        i, j = ((i - 1, j - 1), (i - 1, j), (i, j - 1))[kind[i, j]]
        path.append((i, j))
    return path[::-1]


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, m", [(1, 5), (5, 1), (40, 40), (30, 55), (60, 33), (80, 20)])
def test_paths_equal_the_plain_ones(n, m):
    rng = np.random.default_rng(n * 100 + m)
    a, b = unit(np.abs(rng.normal(size=(n, 12)))), unit(np.abs(rng.normal(size=(m, 12))))
    assert harmony.warping_path(a, b, int(0.9 * (m - 1))) == plain_path(a, b, 0.9)


def song(rng, n):
    """Chroma that drifts, a frame each 50 ms."""
    steps = np.cumsum(rng.normal(size=(n, 12)) * 0.25, axis=0)
    return unit(np.exp(np.sin(steps)))


def frames(spark, rows):
    return spark.createDataFrame([(int(k), float(t), [float(x) for x in c], "x") for k, t, c in rows], "pair long, time_s double, chroma array<double>, piece string").drop("piece")


def test_pairs_equal_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    left, right = [], []
    for pair, (n, m) in enumerate([(50, 60), (61, 45), (4, 4)]):
        a, b = song(rng, n), song(rng, m)
        left += [(pair, k * 0.05, x) for k, x in enumerate(a)]
        right += [(pair, k * 0.05, x) for k, x in enumerate(b)]
    left.append((9, 0.0, np.ones(12)))
    got = {}
    for r in harmony.dtw_pairs(frames(spark, left), frames(spark, right), "pair").orderBy("pair", "time_s").collect():
        got.setdefault(r["pair"], []).append((r["time_s"], r["to_s"]))
    for pair in range(3):
        a, b = (np.array([x for k, _, x in side if k == pair]) for side in (left, right))
        want, last = [], -1.0
        for i, j in plain_path(a, b, 0.96):
            if i * 0.05 - last >= 0.25:
                want.append((i * 0.05, j * 0.05))
                last = i * 0.05
        assert np.allclose(np.array(got.get(pair, [])), np.array(want))
    assert 9 not in got


def test_a_long_pair_is_cut_into_pieces(spark):
    """A reference that runs slower and faster than the take: every anchor is found within a few frames, from small groups."""
    rng = np.random.default_rng(8)
    n = 12_000
    a = song(rng, n)
    t = np.arange(n) * 0.05
    u = t + 2.5 * np.sin(t / 90) + 3.0  # the reference's times of the take's frames
    grid = np.arange(0, u[-1] + 4, 0.05)
    b = unit(np.stack([np.interp(grid, u, a[:, k]) for k in range(12)], axis=1) + rng.normal(size=(len(grid), 12)) * 0.01)
    got = harmony.dtw_pairs(frames(spark, [(1, x, c) for x, c in zip(t, a)]), frames(spark, [(1, x, c) for x, c in zip(grid, b)]), "pair", frames=1024).orderBy("time_s").collect()
    at, to = (np.array([r[c] for r in got]) for c in ("time_s", "to_s"))
    off = np.abs(to - np.interp(at, t, u))
    assert len(got) > 0.8 * t[-1] / 0.25 and (np.diff(to) > 0).all()
    assert np.quantile(off, 0.98) <= 0.15 and off.max() < 1.0
