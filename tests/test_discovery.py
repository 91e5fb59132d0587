"""Lagged moments and causal discovery against plain arrays."""

import math

import numpy as np
import pytest

from causeway.operators import discovery, graphs, moments

SCHEMA = "unit string, t long, var int, x double"


def series_rows(units=("a", "b"), steps=300, d=4, seed=1):
    """Series with links 0 -> 1 (lag 1), 1 -> 2 (lag 2), gaps, and times that begin before 0."""
    rng = np.random.default_rng(seed)
    out, arrays = [], {}
    for u in units:
        x = rng.normal(size=(steps, d))
        for t in range(2, steps):
            x[t, 1] += 0.8 * x[t - 1, 0]
            x[t, 2] += 0.7 * x[t - 2, 1]
        x = 1e6 + x
        x[rng.random(x.shape) < 0.03] = np.nan
        arrays[u] = x
        out += [(u, t - 37, v, float(x[t, v]) if not np.isnan(x[t, v]) else None) for t in range(steps) for v in range(d) if not (np.isnan(x[t, v]) and t % 2)]
    return out, arrays


def plain_correlation(x, i, j, lag):
    a, b = x[: len(x) - lag, i], x[lag:, j]
    both = ~np.isnan(a) & ~np.isnan(b)
    return np.corrcoef(a[both], b[both])[0, 1], int(both.sum())


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_lagged_correlations(spark, block):
    rows, arrays = series_rows()
    got = {(r.unit, r.i, r.j, r.lag): (r.r, r.n) for r in moments.lagged_correlations(spark.createDataFrame(rows, SCHEMA), 4, block).collect()}
    assert len(got) == 2 * 16 * 5
    for (u, i, j, lag), (r, n) in got.items():
        want, count = plain_correlation(arrays[u], i, j, lag)
        assert n == count and r == pytest.approx(want, abs=1e-9)


def test_lagged_sums_do_not_grow_with_the_steps(spark):
    rows, _ = series_rows(units=("a",), steps=2000)
    plan = moments.lagged_sums(spark.createDataFrame(rows, SCHEMA), 2, 50)
    assert plan.count() == 16 * 3


def test_constant_and_missing_series(spark):
    rows = [("a", t, 0, 5.0) for t in range(50)] + [("a", t, 1, float(t % 7)) for t in range(50)] + [("a", 3, 2, None)]
    got = {(r.i, r.j, r.lag): r.r for r in moments.lagged_correlations(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got[0, 1, 1] is None and got[1, 1, 0] == pytest.approx(1) and not any(2 in k[:2] for k in got)
    assert moments.lagged_correlations(spark.createDataFrame([], SCHEMA), 1).collect() == []
    assert discovery.pcmci(spark.createDataFrame([], SCHEMA)).collect() == []
    assert graphs.lagged_correlation_graph(spark.createDataFrame(rows, SCHEMA), 0.1, 1).collect() == []


def student_tail(t, df):
    """Two-sided tail by Simpson's rule over the density."""
    x = np.linspace(0, abs(t), 200_001)
    log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    y = np.exp(log - (df + 1) / 2 * np.log1p(x * x / df))
    h = x[1] - x[0]
    return 1 - 2 * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())


def test_levels_are_those_of_students_t():
    for n, given, r in ((12, 0, 0.5), (12, 5, 0.9), (50, 3, 0.2), (400, 10, 0.05), (5000, 2, 0.03), (8, 4, 0.3)):
        df = n - 2 - given
        t = r * math.sqrt(df / (1 - r * r))
        assert discovery.p_value(r, n, given) == pytest.approx(student_tail(t, df), abs=1e-9)
        assert discovery.p_value(-r, n, given) == discovery.p_value(r, n, given)
    assert discovery.p_value(0.0, 50, 3) == pytest.approx(1) and discovery.p_value(1.0, 50, 3) == 0 and discovery.p_value(0.9, 4, 3) == 1


def plain_search(x, max_lag, alpha, final):
    """The same definitions on one array: partial correlations from regressions' residuals in the correlation matrix."""
    d = x.shape[1]
    known = {(i, j, lag): plain_correlation(x, i, j, lag) for i in range(d) for j in range(d) for lag in range(2 * max_lag + 1)}

    def entry(a, b):
        if a == b:
            return 1.0
        return known[a[1], b[1], a[0] - b[0]][0] if a[0] >= b[0] else known[b[1], a[1], b[0] - a[0]][0]

    def test(source, j, given):
        y = [source, (0, j)]
        syy, syz, szz = (np.array([[entry(a, b) for b in q] for a in p]).reshape(len(p), len(q)) for p, q in ((y, y), (y, given), (given, given)))
        s = syy - syz @ np.linalg.solve(szz, syz.T) if given else syy
        r = s[0, 1] / math.sqrt(s[0, 0] * s[1, 1])
        df = known[source[1], j, source[0]][1] - 2 - len(given)
        return abs(r), student_tail(r * math.sqrt(df / (1 - r * r)), df)

    parents = {}
    for j in range(d):
        least = {(lag, i): 9.0 for lag in range(1, max_lag + 1) for i in range(d)}
        order, size = sorted(least), 0
        while size < len(order):
            results = {p: test(p, j, [q for q in order if q != p][:size]) for p in order}
            least.update({p: min(least[p], r) for p, (r, _) in results.items()})
            order = sorted((p for p in order if results[p][1] <= alpha), key=lambda p: (-least[p], p))
            size += 1
        parents[j] = order
    links = []
    for j in range(d):
        for lag in range(1, max_lag + 1):
            for i in range(d):
                given = []
                for p in [*parents[j], *[(q + lag, v) for q, v in parents[i]]]:
                    if p not in given and p not in ((lag, i), (0, j)):
                        given.append(p)
                links.append((test((lag, i), j, given), i, j, lag))
    links.sort(key=lambda x: x[0][1])
    most = max((k + 1 for k, x in enumerate(links) if x[0][1] <= final * (k + 1) / len(links)), default=0)
    best = {}
    for (r, _), i, j, lag in links[:most]:
        if i != j and r > best.get((i, j), (0, 0))[0]:
            best[i, j] = (r, lag)
    return best


def test_discovery_against_a_plain_search(spark):
    rows, arrays = series_rows(steps=400, d=5, seed=3)
    rows += [("const", t, v, 1.0) for t in range(20) for v in range(2)]
    got = {}
    for r in discovery.pcmci(spark.createDataFrame(rows, SCHEMA), max_lag=2, shares=3).collect():
        got.setdefault(r.unit, {})[r.src, r.dst] = (r.w, r.lag)
    assert set(got) == {"a", "b"}
    for u in ("a", "b"):
        want = plain_search(arrays[u], 2, 0.05, 0.01)
        assert {k: lag for k, (_, lag) in got[u].items()} == {k: lag for k, (_, lag) in want.items()}
        assert {(0, 1), (1, 2)} <= set(want)
        for k, (w, _) in want.items():
            assert got[u][k][0] == pytest.approx(w, abs=1e-9)
