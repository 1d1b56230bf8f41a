import numpy as np
import pytest

from sitelens.llm import pitman_yor


def _one_by_one(count, parent, d, sweeps, burn_in, rng):
    """Mean tables of the dishes of one room, each customer leaving and sitting again in each sweep."""
    seated = [[c] for c in count]
    total, mean = len(count), np.zeros(len(count))
    for sweep in range(sweeps):
        for k, tables in enumerate(seated):
            for _ in range(count[k] if count[k] > 1 else 0):
                at = rng.choices(range(len(tables)), tables)[0]
                tables[at] -= 1
                if not tables[at]:
                    tables.pop(at)
                    total -= 1
                new = (pitman_yor.STRENGTH + d * total) * parent[k]
                to = rng.choices(range(len(tables) + 1), [*(n - d for n in tables), new])[0]
                if to == len(tables):
                    tables.append(1)
                    total += 1
                else:
                    tables[to] += 1
        if sweep >= burn_in:
            mean += [len(t) / (sweeps - burn_in) for t in seated]
    return mean


def test_tables_by_brute_force():
    import random

    count = np.array([2] * 40 + [1] * 240 + [5, 20, 64, 64, 90, 200])
    parent = np.array([1e-4] * 280 + [0.02, 0.05, 0.01, 0.1, 0.1, 0.2])
    drawn = [pitman_yor.seat(np.zeros(len(count), int), count, parent, np.random.default_rng(k)) for k in range(60)]
    got, d = np.mean([t for t, _ in drawn], axis=0), drawn[0][1]
    want = _one_by_one(count.tolist(), parent.tolist(), d, 500, 100, random.Random(4))
    assert got[280:] == pytest.approx(want[280:], rel=0.06)
    assert (got[40:280] == 1).all() and got[:40].mean() == pytest.approx(want[:40].mean(), rel=0.02)


def test_stirling_weights():
    for d in (0.3, 0.75, 0.95):
        exact = {1: [1.0]}
        for c in range(1, 100):
            row = exact[c]
            exact[c + 1] = [(row[t - 2] if t > 1 else 0) + ((c - d * t) * row[t - 1] if t <= c else 0) for t in range(1, c + 2)]
        sizes = np.array([2, 3, 40, 100])
        for c, got in zip(sizes.tolist(), pitman_yor._stirling(sizes, np.array([2, 2, 40, 30]), d), strict=True):
            assert got == pytest.approx(np.log(np.array(exact[c][: len(got)]) / exact[c][0]), abs=1e-9)


def test_likely_numbers_of_tables_match_the_recursion():
    for d in (0.3, 0.75, 0.95):
        row = pitman_yor._stirling(np.array([3000]), np.array([3000]), d)[0]
        for fresh in (1e-6, 1.0, 40.0, 700.0, 1e5, 1e12):
            log = row + np.log(d * fresh) * np.arange(3000)
            want = np.exp(log - log.max())
            low, weights = pitman_yor._likely(3000, fresh, d)
            got = np.zeros(3000)
            got[low - 1 : low - 1 + len(weights)] = weights
            assert np.abs(got / got.sum() - want / want.sum()).sum() < 1e-6


def test_work_of_a_dish_does_not_follow_its_customers_squared(monkeypatch):
    rows = []
    recursion = pitman_yor._stirling
    monkeypatch.setattr(pitman_yor, "_stirling", lambda c, w, d: rows.append(int(c[-1]) * int(w.max())) or recursion(c, w, d))
    count = np.array([1, 1, 2, 1000, 300_000, 2_000_000])
    parent = np.array([1e-6, 1e-6, 1e-6, 0.1, 0.4, 0.5])
    tables, d = pitman_yor.seat(np.zeros(6, int), count, parent, np.random.default_rng(1))
    assert rows and max(rows) <= pitman_yor.RECURSED**2
    assert (tables[:2] == 1).all() and (tables <= count).all() and tables[5] > tables[4] > tables[3] > 1


def test_few_numbers_of_tables_are_computed_for_a_dish(monkeypatch):
    computed = []
    contour = pitman_yor._log_sibuya
    monkeypatch.setattr(pitman_yor, "_log_sibuya", lambda c, t, d: computed.append(len(t)) or contour(c, t, d))
    count = np.concatenate([[1, 1, 2], np.arange(1100, 60_000, 700)])
    parent = count / count.sum()
    tables, _ = pitman_yor.seat(np.zeros(len(count), int), count, parent, np.random.default_rng(1))
    sweeps = pitman_yor.BURN_IN + pitman_yor.SAMPLES
    assert (tables[3:] > 1).all() and (tables <= count).all()
    assert 0 < sum(computed) < 30 * sweeps * (len(count) - 3)
    assert len(computed) < 3 * sweeps  # dishes are computed together


def test_weights_of_dishes_taken_together_match_the_recursion():
    for d in (0.3, 0.75, 0.95):
        sizes = np.array([1025, 1400, 6000])
        exact = pitman_yor._stirling(sizes, sizes, d)
        for fresh in (1e-300, 1e-2, 1.0, 5.0, 100.0, 700.0, 3e3, 1e7):
            got = pitman_yor._all_likely(sizes.astype(float), np.full(3, fresh), d)
            for c, row, (low, weights) in zip(sizes.tolist(), exact, got, strict=True):
                log = row + np.log(d * fresh) * np.arange(c)
                want = np.exp(log - log.max())
                have = np.zeros(c)
                have[low - 1 : low - 1 + len(weights)] = weights
                assert np.abs(have / have.sum() - want / want.sum()).sum() < 1e-6
