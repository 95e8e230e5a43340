"""Kernels against brute force and published values; no Spark needed."""

import inspect
import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.config import EngineConfig
from tessera.functions import counter, mathx, pairs
from tessera.operators import changes, correlate, overlap, profile, stats, tiles
from tessera.plans import stages

RNG = np.random.default_rng(1)


def brute_profile(x, m):
    n = len(x) - m + 1
    z = [(x[i : i + m] - x[i : i + m].mean()) / x[i : i + m].std() for i in range(n)]
    best, near = np.full(n, np.inf), np.full(n, -1)
    for i, j in itertools.product(range(n), range(n)):
        if abs(i - j) > math.ceil(m / 4):
            d = np.sqrt(((z[i] - z[j]) ** 2).sum())
            if d < best[i] - 1e-12:
                best[i], near[i] = d, j
    return best, near


@pytest.mark.parametrize("m", [4, 7, 12])
def test_profile_matches_brute_force(m):
    x = RNG.normal(size=60).cumsum()
    got, want = profile.profile_array(x, m), brute_profile(x, m)
    assert np.allclose(got[0], want[0], atol=1e-6)
    assert (got[1] == want[1]).all()


def test_profile_of_gaps_and_constants():
    x = np.concatenate([np.ones(20), RNG.normal(size=30)])
    x[40] = np.nan
    mp, nn = profile.profile_array(x, 5)
    assert mp[0] == 0.0
    assert np.isinf(mp[36:41]).all() and (nn[36:41] == -1).all()
    assert len(profile.profile_array(np.ones(3), 5)[0]) == 0


@settings(max_examples=20, deadline=None)
@given(st.floats(0.1, 50), st.floats(-100, 100))
def test_profile_is_affine_invariant(scale, shift):
    x = np.sin(np.arange(50.0)) + 0.1 * np.arange(50) % 3
    assert np.allclose(profile.profile_array(x, 8)[0], profile.profile_array(scale * x + shift, 8)[0], atol=1e-4)


def test_greedy_windows():
    assert profile.greedy_windows(np.array([3.0, 1, 1, 5, 2, np.inf]), 3, 1) == [1, 4]
    assert profile.greedy_windows(np.array([3.0, 1, 1, 5, 2, np.inf]), 2, 1, largest=True) == [3, 0]
    assert profile.greedy_windows(np.array([np.nan, np.inf]), 2, 1) == []


def test_motif_groups_start_with_the_best_pair():
    x = RNG.normal(size=120)
    x[10:22] = x[70:82] = np.sin(np.arange(12.0)) * 3
    got = profile.motif_groups(x, 12)
    assert got and {got[0][1], got[0][2]} == {10, 70} and got[0][3] == 0.0


def test_array_forms_equal_the_scalar_ones():
    z = np.concatenate([np.linspace(-9, 9, 400), [0.0, 3.0, -3.0, 37.0]])
    assert np.allclose(mathx.normal_sf_array(z), [mathx.normal_sf(v) for v in z], rtol=1e-10, atol=0)
    assert mathx.normal_sf_array(np.array([np.inf, -np.inf])).tolist() == [pytest.approx(0, abs=1e-300), 1] and np.isnan(mathx.normal_sf_array(np.array([np.nan])))[0]
    r, n = RNG.uniform(-1, 1, 500), RNG.integers(1, 90, 500)
    r[:4] = [1.0, -1.0, 0.0, np.nan]
    want = np.array([mathx.pearson_p(a, int(b)) for a, b in zip(r, n)])
    assert np.allclose(mathx.pearson_p_array(r, n), want, rtol=1e-9, atol=1e-14, equal_nan=True)
    n1, n2 = RNG.integers(0, 7, 300), RNG.integers(0, 7, 300)
    u = RNG.integers(0, 50, 300) % (n1 * n2 + 1) / 1.0
    want = np.array([mathx.mwu_exact(a, int(b), int(c)) for a, b, c in zip(u, n1, n2)])
    assert np.allclose(mathx.mwu_exact_array(u, n1, n2), want, equal_nan=True)
    ties = RNG.integers(0, 3, 300) * 6.0
    want = np.array([mathx.mwu_greater(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties)])
    ok = (n1 > 0) & (n2 > 0)
    assert np.allclose(mathx.mwu_greater_array(u, n1, n2, ties)[ok], want[ok], rtol=1e-10)


def test_mann_whitney_values():
    assert mathx.mwu_greater(96, 10, 16, 24**3 - 24 + 2**3 - 2) == pytest.approx(0.0384730260, abs=1e-9)
    for k, want in {0: 1.0, 1: 0.1178399567, 3: 0.0126570889, 10: 3.36929406e-07}.items():
        assert mathx.mwu_greater(k * 16 + (10 - k) * 8, 10, 16, (26 - k) ** 3 - (26 - k) + k**3 - k) == pytest.approx(want, rel=1e-6)


def test_exact_mann_whitney_counts_all_orders():
    for n1, n2 in ((2, 3), (4, 3), (5, 5)):
        counts = [0] * (n1 * n2 + 1)
        for chosen in itertools.combinations(range(n1 + n2), n1):
            counts[sum(1 for c in chosen for o in range(n1 + n2) if o not in chosen and c > o)] += 1
        assert list(mathx.mwu_counts(n1, n2)) == counts
    assert math.isnan(mathx.mwu_exact(1, 0, 3))


def test_student_and_normal_tails():
    assert mathx.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert mathx.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert mathx.normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert mathx.pearson_p(1.0, 10) == 0.0 and math.isnan(mathx.pearson_p(0.5, 2))


@pytest.mark.parametrize(("n", "k", "most"), [(8, 2, 1), (7, 3, 0), (9, 3, 2), (6, 2, 9), (5, 1, 1), (10, 2, 2)])
def test_overlap_chances_against_all_choices(n, k, most):
    counts, total = [0] * (k + 1), 0
    for a in itertools.combinations(range(n), k):
        for b in itertools.combinations(range(n), k):
            counts[sum(any(abs(x - y) <= most for y in b) for x in a)] += 1
            total += 1
    assert stats.overlap_chances(n + 4, 5, k, most) == pytest.approx([c / total for c in counts])


def test_overlap_chances_of_long_and_short_series():
    chances = stats.overlap_chances(312, 24, 3, 24)
    assert chances.sum() == pytest.approx(1) and chances == pytest.approx([0.2135, 0.4111, 0.2989, 0.0765], abs=0.015)
    assert stats.overlap_chances(20, 24, 3, 24).tolist() == [1, 0, 0, 0]


def test_hamed_rao_and_bootstrap():
    trend = np.arange(60) + RNG.normal(size=60)
    assert stats.hamed_rao(trend)[1] < 1e-6
    assert stats.block_bootstrap(trend, 12, 100, 3) == 0.01
    assert stats.tau_b(np.arange(10.0)) == 1.0 and stats.tau_b(np.ones(5)) == 0.0


def test_block_bootstrap_draws_as_many_as_the_reference():
    assert inspect.signature(stats.corrected_trends).parameters["draws"].default == 5_000
    assert stats.block_bootstrap(np.arange(60.0), 12, 5_000, 3) == 1 / 5_000
    x = RNG.integers(0, 6, (30, 41)).astype(float)
    i, j = np.triu_indices(41, 1)
    sign = np.sign(x[:, j] - x[:, i])
    score, untied = stats._scores(x)
    assert (score == sign.sum(1)).all() and (untied == (sign != 0).sum(1)).all()
    assert [stats.tau_b(r) for r in x] == pytest.approx(list(sign.sum(1) / np.sqrt(len(i) * (sign != 0).sum(1))))


def test_window_sweep_has_all_lengths():
    assert inspect.signature(stages.sweep).parameters["lengths"].default == EngineConfig().window_lengths


def test_bootstrap_of_the_median():
    assert all(math.isnan(v) for v in overlap.bootstrap_median(np.array([]), 1))
    assert overlap.bootstrap_median(np.array([4.0]), 1) == (4.0, 4.0)
    lo, hi = overlap.bootstrap_median(np.arange(20.0), 7)
    assert lo < 9.5 < hi and (lo, hi) == overlap.bootstrap_median(np.arange(20.0), 7)


def test_change_points():
    x = np.concatenate([np.zeros(20), np.full(20, 5.0), np.full(20, -3.0)]) + RNG.normal(scale=0.01, size=60)
    assert changes.binary_segmentation(x, 2) == [19, 39]
    assert changes.kernel_segmentation(x, 2.0) == [19, 39]
    assert changes.binary_segmentation(np.zeros(4), 3) == []


def full_segmentation(x, penalty, least):
    """Every start of every prefix, on the whole kernel matrix."""
    n, square = len(x), (x[:, None] - x[None, :]) ** 2
    middle = np.median(square[np.triu_indices(n, 1)]) if n > 1 else 0.0
    gram = np.exp(-np.clip(square / middle if middle > 0 else square, 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    best = [-penalty] + [np.inf] * n
    for b in range(least, n + 1):
        best[b] = min(best[a] + (b - a) - gram[a:b, a:b].sum() / (b - a) + penalty for a in range(b - least + 1) if a == 0 or a >= least)
    return np.array(best)


@pytest.mark.parametrize("penalty", [10.0, 2.0, 0.3, 0.0])
def test_pruned_segmentation_is_the_best_one(penalty):
    for n, least in ((2, 3), (30, 1), (64, 3), (75, 5)):
        x = RNG.normal(size=n) + np.repeat(RNG.normal(size=n // 15 + 1) * 3, 15)[:n]
        for v in (x, np.round(x)):
            assert np.allclose(changes.segmentation_table(v, penalty, least)[0][least:], full_segmentation(v, penalty, least)[least:])


def test_segmentation_drops_starts():
    x = np.concatenate([RNG.normal(4 * (i % 5), 1, 200) for i in range(15)])
    assert changes.segmentation_table(x, 10.0)[2] < len(x) ** 2 / 20
    assert changes.kernel_segmentation(x, 10.0) == list(range(199, 2999, 200))


@pytest.mark.parametrize("listed", [0, 8])
@pytest.mark.parametrize("n", [2, 3, 4, 9, 60, 151])
def test_pair_statistics_equal_all_pairs(n, listed, monkeypatch):
    monkeypatch.setattr(pairs, "LISTED", listed)
    i, j = np.triu_indices(n, 1)
    for x in (RNG.normal(size=n), RNG.integers(0, 4, n) * 1.0, np.zeros(n), np.arange(n) * 0.1, -RNG.normal(size=n).cumsum(), np.repeat(RNG.normal(size=n), 2)[:n]):
        assert pairs.kendall_score(x) == np.sign(x[j] - x[i]).sum()
        assert pairs.median_slope(x) == pytest.approx(np.median((x[j] - x[i]) / (j - i)), rel=1e-12, abs=1e-12)
        assert pairs.median_square(x) == pytest.approx(np.median((x[i] - x[j]) ** 2), rel=1e-12, abs=1e-12)
        falls = x[i] > x[j]
        assert sorted(zip(*pairs.listed_inversions(pairs.ranks_of(x), 10**9))) == sorted(zip(i[falls], j[falls]))


def test_pair_statistics_of_long_series():
    x = RNG.integers(0, 5, 200_000) * 1.0
    assert pairs.median_slope(x) == 0.0 and abs(pairs.kendall_score(x)) < 2e8
    line = np.arange(50_000) * 3.0
    assert pairs.median_slope(line) == 3.0 and pairs.kendall_score(line) == 50_000 * 49_999 // 2


def test_draws_look_uniform_and_independent():
    got = counter.drawn_array(77, np.arange(2_000), np.arange(50), 10)
    counts = np.bincount(got.ravel(), minlength=10)
    assert ((counts - 10_000) ** 2 / 10_000).sum() < 30 and got.min() == 0 and got.max() == 9
    assert abs(np.corrcoef(got[:, :-1].ravel(), got[:, 1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(got[:-1].ravel(), got[1:].ravel())[0, 1]) < 0.01
    assert (got != counter.drawn_array(78, np.arange(2_000), np.arange(50), 10)).mean() > 0.85


def split_profile(x, m):
    """(nearest to the left, nearest to the right) by all pairs of windows."""
    n, zone = len(x) - m + 1, math.ceil(m / 4)
    z = np.array([(x[i : i + m] - x[i : i + m].mean()) / x[i : i + m].std() for i in range(n)])
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    left = [int(d[i, : i - zone].argmin()) if i > zone else -1 for i in range(n)]
    return left, [int(d[i, i + zone + 1 :].argmin()) + i + zone + 1 if i + zone + 1 < n else -1 for i in range(n)]


def test_tiles_make_up_the_profile():
    x, m, size = RNG.normal(size=200).cumsum(), 9, 37
    n = len(x) - m + 1
    best, near = {s: np.full(n, np.inf) for s in tiles.SIDES}, {s: np.full(n, -1) for s in tiles.SIDES}
    for r in range(0, n, size):
        for c in range(r, n, size):
            a, b = x[r : r + size + m - 1], x[c : c + size + m - 1]
            for side, base, other, (d, u) in (("right", r, c, tiles.tile_minima(a, b, m, c - r)[:2]), ("left", c, r, tiles.tile_minima(a, b, m, c - r)[2:])):
                at = np.flatnonzero((u >= 0) & (d < best[side][base : base + len(d)]))
                best[side][base + at], near[side][base + at] = d[at], u[at] + other
    assert (near["left"].tolist(), near["right"].tolist()) == split_profile(x, m)
    assert np.allclose(np.minimum(best["left"], best["right"]), profile.profile_array(x, m)[0], atol=1e-6)


def test_wavelet_coherence_of_equal_series():
    x = np.sin(np.arange(128) * 2 * np.pi / 12) + 0.01 * RNG.normal(size=128)
    period, coh = correlate.wavelet_coherence(x, x)
    assert coh.min() > 0.99 and period[0] == pytest.approx(2 * 1.033, rel=1e-2)
