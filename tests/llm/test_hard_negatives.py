"""Hard negatives against plain loops and SQL, and bounds against exact scores."""

import math
import random

import numpy as np
from oracle import compare
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagegrain.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, row int"


def brute(rows, positives=5, negatives=10):
    """Rows of (vec_id, vector, label) in any order to the sorted result."""
    sound = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        sound.append((i, vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    last = lambda x: (x is None, x or 0)
    out = []
    for i, anchor_id, a, label in sound:
        if anchor_id is None or anchor_id % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a, b)), other, lab) for j, other, b, lab in sound if j != i), key=lambda t: (-t[0], last(t[1])))
        for p, pid, _ in [t for t in scored if t[2] == label][:positives]:
            found = [t for t in scored if t[2] != label and 30 * p <= 100 * t[0] <= 90 * p][:negatives]
            out += [(anchor_id, pid, rank, nid, p, n) for rank, (n, nid, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def got(df):
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)


def made(n, dim, labels, seed, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.5, (centres, dim))
    return [(int(i), (middle[rng.integers(centres)] + rng.normal(0, 0.15, dim)).astype(np.float32).tolist(), int(rng.integers(labels))) for i in range(n)]


def mined(spark, rows, **more):
    return got(H.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0, **more))


def test_against_loops(spark):
    rows = made(900, 20, 4, 1)
    rows += [(None, rows[5][1], 2), (None, rows[9][1], 1), (2000, None, 1), (2001, [0.5, None], 1), (2002, [float("nan")] * 20, 1), (2003, [float("inf")] * 20, 0)]
    rows += [(2100, rows[7][1], None), (2200, [], 1), (2300, rows[0][1][:7], rows[0][2]), (2301, rows[0][1] + [0.25] * 30, 3)]
    assert mined(spark, rows) == brute(rows)


def test_ties_copies_and_repeated_ids(spark):
    rows = made(120, 8, 3, 2)
    rows += [(300 + i, rows[3][1], i % 3) for i in range(60)] + [(100, rows[100][1], rows[100][2]), (100, rows[100][1], 1), (7, rows[3][1], 0)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)


def test_one_hot_label_and_no_rows(spark):
    rows = [(i, v, 0 if i % 10 else lab) for i, v, lab in made(700, 8, 3, 3)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1), (100, None, None)]) == []


def test_large_components(spark):
    rows = [(i * 50, [x * s for x in v], lab) for (i, v, lab), s in zip(made(60, 6, 2, 4), [1.0, 1e7] * 30)]
    assert mined(spark, rows) == brute(rows)


def block_of(vectors, labels, ids=None):
    n = len(vectors)
    levels = [H.summaries(vectors, length) for length in H.LEVELS]
    both = [np.concatenate([lv[k] for lv in levels], 1).tobytes() for k in range(2)]
    return H.Block(list(range(n)), ids or list(range(n)), labels, [[]] * n, vectors.astype("<i8").tobytes(), *both)


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-250, 250, (40, 4)).repeat(16, 1)
    vectors = (centres[rng.integers(40, size=3000)] + rng.integers(-9, 9, (3000, 64))).astype(np.int64)
    a, b = block_of(vectors[:300], [0] * 300), block_of(vectors[300:], [1] * 2700)
    true = vectors[:300] @ vectors[300:].T
    for (am, ad), (bm, bd) in zip(a.levels, b.levels):
        middle, reach = H.products(am, bm), H.products(ad, bd)
        slack = H.SLACK * np.sqrt((am**2).sum(1) + (ad**2).sum(1))[:, None] * np.sqrt((bm**2).sum(1) + (bd**2).sum(1))[None, :]
        assert (middle + reach + slack >= true).all() and (middle - reach - slack <= true).all()
    finder = H.Finder(a, np.full((300, 1), H.LEAST), np.full((300, 1), H.MOST), 10, False)
    for at in range(0, 2700, 300):
        finder.see(block_of(vectors[300 + at : 600 + at], [1] * 300, list(range(at, at + 300))))
    for i in range(300):
        want = sorted(range(2700), key=lambda j: (-true[i, j], j))[:10]
        assert finder.id[i, 0].tolist() == want
    assert finder.scored < 0.25 * finder.looked  # on vectors with flat segments most pairs are never scored


def test_tasks_and_tiles(spark, monkeypatch):
    for name, value in (("ROWS", 64), ("ANCHORS", 3), ("TILE", 2), ("PAIRS", 200), ("MOST_TASKS", 5)):
        monkeypatch.setattr(H, name, value)
    pick = random.Random(6)
    rows = [(i * pick.choice((1, 5, 10)), v, lab) for i, v, lab in made(400, 12, 3, 7)]
    assert mined(spark, rows) == brute(rows)


def test_op13(spark):
    for sf in ("0.001", "0.01"):
        folder = f"/root/testdata/sf{sf}"
        assert compare(entry.queries()["op13_hard_negatives"](spark, folder), entry.oracle_sql()["op13_hard_negatives"], folder) == ""
