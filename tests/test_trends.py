import datetime

import numpy as np
import pytest

from trendloom.operators import trends


def expected_trend(values):
    """Centred 2×12 average with straight-line ends, clipped at 0."""
    n = len(values)
    kernel = np.array([0.5] + [1.0] * 11 + [0.5]) / 12
    middle = np.convolve(values, kernel, "valid")
    line = np.full(n, np.nan)
    line[6 : n - 6] = middle
    back = n - 7
    for fit, gaps in ((range(6, min(18, back)), range(6)), (range(max(6, back - 12), back), range(back + 1, n))):
        slope, start = np.polyfit(list(fit), line[list(fit)], 1)
        for i in gaps:
            line[i] = slope * i + start
    return np.maximum(line, 0)


def series(spark, rows):
    return spark.createDataFrame(
        [(i, f"L{i}", datetime.date(m // 12, m % 12 + 1, 1), c, c / 100) for i, m, c in rows],
        "id long, label string, publication date, paper_count long, total_percent double",
    )


@pytest.fixture(scope="module")
def computed(spark):
    rng = np.random.default_rng(1)
    start = 2014 * 12 + 4
    rows = [(1, start + i, int(v)) for i, v in enumerate(rng.integers(1, 90, 40)) if i not in (5, 17, 18)]
    rows += [(2, start + i, 5) for i in range(23)] + [(3, start + i, 40 - i) for i in range(24)]
    rows += [(4, start + i, max(0, 60 - 4 * i)) for i in range(30)]
    frame = trends.calculate_trends(series(spark, rows)).cache()
    return rows, frame


def test_trends_and_slopes(computed):
    rows, frame = computed
    found = {}
    for r in frame.orderBy("id", "publication").collect():
        found.setdefault(r.id, []).append(r)
    for key in (1, 3, 4):
        months = {m: c for i, m, c in rows if i == key}
        first, last = min(months), max(months)
        values = np.array([months.get(m, 0) for m in range(first, last + 1)], dtype=float)
        share, count = expected_trend(values / 100), np.round(np.round(expected_trend(values), 9))
        assert len(found[key]) == len(months)  # months added in between are gone
        for r in found[key]:
            i = r.publication.year * 12 + r.publication.month - 1 - first
            assert r.trend_percent == pytest.approx(share[i], abs=1e-9)
            assert r.trend_count == count[i]
            if i < 5:
                assert r.slope_percent is None
            else:
                assert r.slope_percent == pytest.approx(share[i] - share[i - 5], abs=1e-9)
    assert all(r.trend_count is None and r.slope_percent is None for r in found[2])  # under two seasons


def test_rankings(computed):
    _, frame = computed
    best = {}
    for r in frame.collect():
        best.setdefault(r.id, []).append((r.publication, r.slope_percent))
    last = {i: [s for _, s in sorted(v)[-3:]] for i, v in best.items() if i != 2}
    up = sorted(last, key=lambda i: (-max(last[i]), i))[:2]
    down = sorted(last, key=lambda i: (min(last[i]), i))[:2]
    assert [r.id for r in trends.rising(frame, n=2).collect()] == up
    assert [r.id for r in trends.falling(frame, n=2).collect()] == down
    view = trends.current_view(frame, trends.rising(frame, n=1))
    assert {r.id for r in view.collect()} == {up[0]}
