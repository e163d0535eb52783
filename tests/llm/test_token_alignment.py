"""Alignment and corpus-wide counts against plain loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
from pagegrain.llm import token_alignment as A  # noqa: E402

PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """Rows of (doc_id, text) to the sorted result."""
    lib = tokenizers.Tokenizer.from_file(PATHS[0])
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    told, held = [], Counter()
    for doc, text in rows:
        a = lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [bytes(byte_of[c] for c in lib.id_to_token(i)) for i in a]
        raw_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            told.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, raw_a))).tolist(), np.cumsum(list(map(len, raw_b))).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = []
        for x, i in enumerate(a):
            for y, j in enumerate(b):
                if max(ends_a[x] - len(raw_a[x]), ends_b[y] - len(raw_b[y])) < min(ends_a[x], ends_b[y]):
                    links.append((i, j))
        held.update(set(links))
        told.append((doc, a, b, groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for doc, a, b, groups, links in told:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), sha))
    return sorted(out, key=str), held, most


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def odd_texts(n=60):
    pick = random.Random(5)
    parts = ["foo ", "bar", " ", "\n", "  ", "日", "é", "'s", "9", "12 ", "<|endoftext|>", "</s>", "-", "\t", "\r\n", "the quick ", "　", "<0x41>", "🙂"]
    return ["".join(pick.choice(parts) for _ in range(pick.randrange(0, 60))) for _ in range(n)]


def test_rows(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(1, "again"), (1, "again"), (None, None), (None, "a▁b"), (7, ""), (8, " "), (9, "\x00 x"), (None, "a b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, run int, n_a string").repartition(3)
    want, held, most = brute(rows)
    assert got(A.align(df, *PATHS)) == want
    assert A.align(df.filter("false"), *PATHS).count() == 0


def test_many_runs_long_texts_and_deep_merges(spark, monkeypatch):
    for name, value in (("RUN_BYTES", 300), ("PIECE_BYTES", 90), ("FRAME", 7), ("FAN", 2), ("GROUP_RUNS", 2)):
        monkeypatch.setattr(A, name, value)
    long = " ".join(odd_texts(20)) + " some words that end here" * 30
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(100, long), (101, long + "▁"), (102, "the quick " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, held, most = brute(rows)
    # functions are pickled by value of their module's globals only inside this process, so the parts are called here
    aligner = A.Aligner(*PATHS)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    made = [r for k, s in enumerate(A.slices([batch], limit=300)) for b in A._run_rows(aligner, k, s) for r in b.to_pylist()]
    runs = spark.createDataFrame([tuple(r.values()) for r in made], A._RUN)
    n_runs = sum(r["radix"] == -1 for r in made)
    assert n_runs > 8
    totals = A.merge_runs(runs, n_runs, aligner.n_b)
    counted = {(r.a, r.b): (r.documents, r.best) for r in A.pair_counts(totals, aligner.n_b).collect()}
    assert counted == {p: (n, n == most[p[0]]) for p, n in held.items()}
    assert got(A.contribute(runs, totals, n_runs)) == want


def test_heap_merge_takes_blocks_of_any_length():
    pick = np.random.default_rng(2)
    runs, want = [], Counter()
    for _ in range(9):
        keys = np.unique(pick.integers(0, 300, 120))
        counts = pick.integers(1, 5, len(keys))
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        cuts = np.unique(pick.integers(1, len(keys), 6))
        runs.append(list(zip(np.split(keys, cuts), np.split(counts, cuts))))
    blocks = list(A.heap_merge(runs))
    keys = np.concatenate([k for k, _ in blocks])
    assert (np.diff(keys) > 0).all()
    assert dict(zip(keys.tolist(), np.concatenate([c for _, c in blocks]).tolist())) == dict(want)
    told = list(A._with_best(iter(blocks), 10))
    best = {int(k): bool(b) for ks, _, bs in told for k, b in zip(ks, bs)}
    assert best == {k: n == max(want[j] for j in want if j // 10 == k // 10) for k, n in want.items()}


def test_a_hot_pair_is_one_record_of_a_run(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 10 = 0, 'rare word', 'hot hot') AS text")
    runs = A.make_runs(df.repartition(2), *PATHS)
    n_b = A.Aligner(*PATHS).n_b
    assert runs.filter("radix >= 0").selectExpr("max(size(pairs))").first()[0] == 1
    totals = {(r.a, r.b): r.documents for r in A.pair_counts(A.merge_runs(runs, 2, n_b), n_b).collect()}
    assert max(totals.values()) == 4500 and len(totals) < 12


def test_op12(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 3000]
    texts = spark.read.parquet(f"{SF}/documents.parquet")
    short = texts.filter("text IS NULL OR length(text) < 3000")
    want, held, most = brute(docs)
    assert got(A.align(short, *PATHS)) == want
    rows = entry.queries()["op12_token_alignment"](spark, SF)
    assert set(NAMES) <= set(rows.columns) and rows.count() == texts.count()
