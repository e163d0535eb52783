import random
from collections import defaultdict

import numpy as np

from pagegrain.llm import _text, suffix_dedup
from pagegrain.llm.suffix_dedup import remove_repeats


def brute(rows, length, keep_first):
    """Removed byte places of each row, from all windows of all rows."""
    seen = defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    raws = [(t or "").encode() for _, t in rows]
    for i in order:
        for s in range(len(raws[i]) - length + 1):
            seen[raws[i][s : s + length]].append((i, s))
    gone = [set() for _ in rows]
    for places in seen.values():
        for i, s in places[1:] if keep_first else places if len(places) > 1 else []:
            gone[i].update(range(s, s + length))
    return raws, gone


def check(spark, rows, keep_first, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = remove_repeats(df, length=24, k=6, keep_first=keep_first, **options).collect()
    raws, gone = brute(rows, 24, keep_first)
    want = [(str(d), len(raw), len(g), bytes(b for j, b in enumerate(raw) if j not in g)) for (d, _), raw, g in zip(rows, raws, gone)]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 5)))
    passage = [" ".join(word() for _ in range(n)) for n in (4, 9, 14, 30)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(3)]
        rows.append((i, rng.choice(passage).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, ""), (104, "a" * 80), (105, "ab" * 40), (106, rows[7][1] + "!" + rows[7][1])]
    return rows


def test_equals_brute_force(spark):
    for seed, keep_first in ((1, False), (2, True)):
        check(spark, corpus(seed) + [(None, "null id " * 8)], keep_first)


def test_hot_anchors_are_split_by_longer_texts(spark):
    for keep_first, hot in ((False, 2), (True, 2), (True, 1)):
        check(spark, corpus(3), keep_first, hot=hot)


def test_one_anchor_in_most_rows(spark):
    rng = random.Random(8)
    letter = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    near = [letter(9) for _ in range(3)]
    rows = [(i, letter(12) + rng.choice(near) + "aaaaaa" + rng.choice(near) + letter(12)) for i in range(24)]
    for keep_first in (False, True):
        check(spark, rows + [(200, "aaaaaa"), (None, rows[0][1])], keep_first, hot=3)


def test_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(_text, "HOT_LEAST", 2)
    check(spark, corpus(4), False)
    check(spark, corpus(4), True, hot=2)


def test_rows_equal_in_id_and_text_are_one_document(spark):
    rows = corpus(6)
    rows += [(None, rows[4][1])] + [(300, "b" + rows[8][1] + " aé"), (301, rows[9][1])]
    df = spark.createDataFrame([*rows, *rows[:20], (None, rows[4][1]), *rows[-2:]], "doc_id long, text string")
    raws, gone = brute(rows, 24, True)
    want = {str(d) + str(t): (len(g), bytes(b for j, b in enumerate(raw) if j not in g)) for (d, t), raw, g in zip(rows, raws, gone)}
    for hot in (4096, 2):
        got = remove_repeats(df, length=24, k=6, keep_first=True, hot=hot).collect()
        assert len(got) == df.count()
        assert {(str(r.doc_id), r.n_removed, bytes(r.kept)) for r in got} == {(str(d), *want[str(d) + str(t)]) for d, t in rows}


def test_most_rows_have_one_id_and_text(spark, monkeypatch):
    monkeypatch.setattr(_text, "HOT_LEAST", 2)
    rows = corpus(6)[:12]
    for text in (rows[3][1], None):  # a text with repeats, and one that meets nothing
        df = spark.createDataFrame([*rows, *[(None, text)] * 150], "doc_id long, text string")
        for keep_first in (True, False):
            raws, gone = brute([*rows, *[(None, text)] * (1 if keep_first else 150)], 24, keep_first)
            want = [len(g) for g in gone] + ([len(gone[-1])] * 149 if keep_first else [])
            got = remove_repeats(df, length=24, k=6, keep_first=keep_first)
            assert sorted(r.n_removed for r in got.select("n_removed").collect()) == sorted(want)
            cut = suffix_dedup.cut_rows(df, length=24, k=6) if keep_first else None
            assert cut is None or cut.count() == 162


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0


def test_long_texts_go_in_steps(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 200)
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    for keep_first in (False, True):
        check(spark, [(1, long[:1200] + long[700:]), (2, "x" + long[2500:2620]), (3, long), (4, "short")], keep_first)


def test_shorter_repeats_are_noted(spark):
    rows = corpus(7) + [(None, "null id " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep_first in (False, True):
        got = remove_repeats(df, length=24, k=6, keep_first=keep_first, noted=13, noted_k=4).collect()
        raws, gone = brute(rows, 24, keep_first)
        _, noted = brute(rows, 13, False)
        want = [(str(d), bytes(b for j, b in enumerate(raw) if j not in g), len(n)) for (d, _), raw, g, n in zip(rows, raws, gone, noted)]
        assert sorted((str(r.doc_id), bytes(r.kept), r.n_noted) for r in got) == sorted(want)


def test_longest_factors_equal_brute_force():
    rng = np.random.default_rng(9)
    for length, letters in ((3, 2), (24, 2), (24, 4), (40, 1)):
        data = rng.integers(97, 97 + letters, 150).astype(np.uint8)
        data[60:110] = data[5:55]
        raw = data.tobytes()
        starts = np.sort(rng.choice(len(raw) - length + 1, 60, replace=False))

        def shared(a, b):
            return next((i for i in range(length) if raw[a + i] != raw[b + i]), length)

        for earlier_only in (True, False):
            want = [max((shared(a, b) for b in starts if b < a or not earlier_only and a != b), default=0) for a in starts]
            assert suffix_dedup.longest_factors(data, starts, length, earlier_only).tolist() == want
