"""Peaks of long series, split over many blocks, against plain loops."""

import numpy as np
import pytest

from pagegrain.operators import series as Z

#: Samples with known peaks.
SCIPY_LIKE = (0.8, 8, 1.0)


def plain_maxima(v):
    told, i = [], 1
    while i < len(v) - 1:
        j = i
        while j < len(v) - 1 and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
            told.append((i + j) // 2)
        i = j + 1
    return told


def plain_far(peaks, v, distance):
    kept = []
    for i in sorted(peaks, key=lambda i: (-v[i], -i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def plain_prominence(i, v):
    sides = []
    for step in (-1, 1):
        least, k = v[i], i
        while 0 <= k < len(v) and v[k] <= v[i]:
            least = min(least, v[k])
            k += step
        sides.append(least)
    return v[i] - max(sides)


def frame(spark, **series):
    rows = [(name, i, float(x)) for name, v in series.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, i long, v double").repartition(4)


def walks():
    rng = np.random.default_rng(3)
    saw = [k // 2 + (k % 2) * 3 for k in range(400)]  # every peak is higher than the one before it
    return {"noise": rng.integers(0, 9, 900), "walk": np.cumsum(rng.integers(-1, 2, 900)), "saw": saw, "fall": saw[::-1], "flat": [1] * 50, "two": [0, 1]}


@pytest.mark.parametrize("block", [1 << 16, 16, 3])
def test_peaks_split_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(Z, "BLOCK", block)
    given = {k: list(map(float, v)) for k, v in walks().items()}
    df = frame(spark, **given)
    maxima = Z.local_maxima(df)
    want = {(s, i) for s, v in given.items() for i in plain_maxima(v)}
    assert {(r.series_id, r.i) for r in maxima.collect()} == want
    for distance in (1, 2, 8, 25):
        got = {(r.series_id, r.i, r.v) for r in Z.far_apart(maxima, distance).collect()}
        assert got == {(s, i, v[i]) for s, v in given.items() for i in plain_far(plain_maxima(v), v, distance)}
    got = {(r.series_id, r.i): r.prominence for r in Z.prominences(maxima, df).collect()}
    assert got == {(s, i): plain_prominence(i, given[s]) for s, i in want}


def test_a_long_series_is_many_groups(spark, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK", 50)
    df = frame(spark, long=np.random.default_rng(4).integers(0, 99, 5000))
    sides = Z.prominences(Z.local_maxima(df), df)
    assert sides.count() > 1000
    assert df.selectExpr("i div 50 AS block").distinct().count() == 100  # what one step sees is 50 samples


def test_find_peaks_in_order(spark):
    height, distance, prominence = SCIPY_LIKE
    v = [0, 1, 0, 2, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0.9, 0.5, 2, 0]
    got = {r.i: r.prominence for r in Z.find_peaks(frame(spark, s=v), height, distance, prominence).collect()}
    assert got == {5: 3.0, 15: 2.0}
    with pytest.raises(ValueError, match="at least 1"):
        Z.far_apart(frame(spark, s=v), 0)
