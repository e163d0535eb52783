import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from pagegrain.llm import packing, token_counts, token_store  # noqa: E402
from pagegrain.llm._tokens import ByteLevelIds  # noqa: E402

BYTE, WORD = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
ODD_TEXTS = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\nb", "a\n\n\nb", "a \n", "a\n\n", "  a", "   a",
    "a\tb \t c", "a  b   c", "it's 'the' we'll 's", "<|endoftext|>", "a\n\n<|endoftext|>b", "a \n<|endoftext|> b", "x<|endoftext|> y <|startoftext|>z",
    "naïve Ünïcode été 12345 ²³½ Ⅷ 漢字 العربية 🎉🎉", "é ÄB ̈x", "a\x1c b\x85c", "ΑΣ Σ", "​ x​\n y",
    "word " * 3000, "z" * 5000, "line one\nline two \nline  three",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "Foo", "bar,", "é.", "a_.", "x<|", "7%&&", "dogs'.", "don't!", "漢.", ".", "'s", " ", "  ", "\n", "\n\n", "\t", "12", "é", " ", "!?", "<|endoftext|>", "\r\n", "漢"]
    return ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(n)]


def library(path):
    return tokenizers.Tokenizer.from_file(path)


def ids_of(enc, texts):
    flat, bounds = enc(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_byte_level_ids_equal_the_library():
    texts = ODD_TEXTS + random_texts(400, 1)
    lib, enc = library(BYTE), ByteLevelIds(BYTE)
    for _ in range(2):  # the second time from what is known
        for text, ids in zip(texts, ids_of(enc, texts)):
            assert ids == lib.encode(text, add_special_tokens=False).ids, repr(text)
    for text in texts:  # alone, and in a slice of an array
        assert ids_of(enc, [text]) == [lib.encode(text, add_special_tokens=False).ids], repr(text)
    flat, bounds = enc(pa.array(texts, pa.string()).slice(3, 5))
    assert flat[bounds[1] : bounds[2]].tolist() == lib.encode(texts[4], add_special_tokens=False).ids


def test_piece_counts_equal_the_library():
    texts = ODD_TEXTS + random_texts(400, 2)
    lib, count = library(WORD), token_counts.PieceCounts(WORD)
    for _ in range(2):
        assert count(pa.array(texts, pa.string())).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_known_pieces_stay_bounded(monkeypatch):
    monkeypatch.setattr("pagegrain.llm._tokens.KEEP_BYTES", 4000)
    monkeypatch.setattr("pagegrain.llm.token_counts.KEEP_BYTES", 4000)
    lib, enc, count = library(BYTE), ByteLevelIds(BYTE), token_counts.PieceCounts(WORD)
    for seed in range(5):
        texts = random_texts(20, seed)
        assert ids_of(enc, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert count(pa.array(texts, pa.string())).tolist() == [len(library(WORD).encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_texts_without_spaces_fill_what_is_kept(monkeypatch):
    monkeypatch.setattr("pagegrain.llm._tokens.KEEP_BYTES", 100_000)
    enc = ByteLevelIds(BYTE)
    for c in "abcde":
        ids_of(enc, [c * 60_000, " x"])
    assert len(enc.known) + len(enc.bare) < 8  # few pieces, many bytes


def frame(spark, texts):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(5, None, None, None), (None, "null id", None, 1), (5, "a", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length int")


def test_token_counts_rows(spark):
    df = frame(spark, ODD_TEXTS)
    rows = token_counts.token_counts(df, WORD, limit=10).collect()
    lib = library(WORD)
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 10)
        for r in df.collect()
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.token_counts(df.limit(0), WORD).count() == 0


def test_pack_keeps_every_id_once(spark):
    df = frame(spark, ODD_TEXTS)
    packed = packing.pack(df, BYTE, capacity=64)
    rows = packed.collect()
    lib = library(BYTE)
    want = sorted((str(r.doc_id), tuple(lib.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in df.collect())
    by_sequence, whole = {}, []
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.append(ids.tolist())
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(len(x) for x in whole) == sum(len(x) for _, x in want)
    for doc, ids in want:
        got = [tuple(np.frombuffer(bytes(r.ids), "<u4")) for r in rows if str(r.doc_id) == doc and r.doc_tokens == len(ids)]
        assert sorted(got) == sorted(ids[a : a + 64] for a in range(0, len(ids), 64)) or doc == "5"
    assert packing.pack(df.limit(0), BYTE).count() == 0
    assert packing.padding(packed, 64).count() == len(by_sequence)


def test_fill_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.randrange(1, 40) for _ in range(9)]
        counts = {x: lengths.count(x) for x in lengths}
        got = packing.fill(counts, 50)
        assert all(got.count(x) <= counts[x] for x in got) and max(lengths) in got
        rest = list(lengths)
        rest.remove(max(lengths))
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(got) == max(max(lengths) + s for s in sums if max(lengths) + s <= 50)


def test_codes_give_any_token():
    rng = np.random.default_rng(4)
    for ids in ([], [0], [255, 256, 65536, 2**32 - 1], rng.integers(0, 50257, 5000), rng.integers(0, 300, 3000)):
        ids = np.array(ids, np.uint32)
        codes = token_store.Codes(token_store.encode(ids))
        assert len(codes) == len(ids)
        places = rng.integers(0, max(len(ids), 1), 200 if len(ids) else 0)
        assert codes.take(places).tolist() == ids[places].tolist()
        for _ in range(20):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert codes.span(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        token_store.Codes(b"no codes")


def test_crc32_of_parts():
    rng = random.Random(8)
    raw = rng.randbytes(3000)
    for cuts in ([], [0], [1, 2, 1500], [2999, 3000], sorted(rng.randrange(3000) for _ in range(20))):
        parts = [raw[a:b] for a, b in zip([0, *cuts], [*cuts, 3000])]
        assert token_store.join_crc32((len(p), zlib.crc32(p)) for p in parts) == zlib.crc32(raw)


def test_store_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 700)  # the word text takes several segments
    df = frame(spark, ODD_TEXTS)
    path = token_store.write_store(df, BYTE)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    lib = library(BYTE)
    assert [r.doc_id for r in rows] == [None, *sorted(r.doc_id for r in df.collect() if r.doc_id is not None)]
    at, flat = 0, []
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id != 5:
            ids = np.array(lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
            flat += [(r.start + i, x) for i, x in enumerate(ids.tolist())]
    for place, x in flat[:: len(flat) // 5]:
        assert token_store.token_at(spark, path, place) == x
    assert token_store.token_at(spark, path, at) is None
    assert token_store.read_store(spark, token_store.write_store(df.limit(0), BYTE)).count() == 0
