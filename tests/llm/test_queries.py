"""Every opN_ query as registered, over whole tables, against plain Python; and the pipeline, stage by stage."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import test_minhash_dedup
import test_suffix_dedup

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
zstandard = pytest.importorskip("zstandard")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from pagegrain.llm import quality_rules  # noqa: E402
from pagegrain.llm._text import written  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows_of(spark, name):
    return entry.queries()[name](spark, SF).collect()


def by_id(spark, name):
    rows = rows_of(spark, name)
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def library(name):
    return tokenizers.Tokenizer.from_file(public.path(name))


def test_op1(spark, texts):
    got = by_id(spark, "op1_minhash_dedup")
    want = test_minhash_dedup.brute(list(texts.items()), 3, 85)
    assert {(d, r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {(d, n, c, d == c) for d, n, c in want}
    assert any(not r.kept for r in got.values())


def test_op2(spark, texts):
    lib, got = library("word_bpe_49k.json"), by_id(spark, "op2_token_counts")
    for doc, text in texts.items():
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len(text.encode()), n, n > 2048)


def test_op3(spark):
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    got = {r.page_id: r for r in rows_of(spark, "op3_url_filter")}
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    for page in pages:
        _, found, rest = (page.url or "").partition("://")
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None) if found else None
        r = got[page.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == rules[rule] if rule else r.verdict in ("allow", "block")


def test_op5(spark, texts):
    raws, gone = test_suffix_dedup.brute(list(texts.items()), 400, False)
    got = by_id(spark, "op5_suffix_dedup")
    for doc, raw, out in zip(texts, raws, gone):
        kept = bytes(b for i, b in enumerate(raw) if i not in out)
        spans = sum(i - 1 not in out for i in out)
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(out), spans, hashlib.sha256(kept).hexdigest())


def test_op4(spark, texts):
    got = by_id(spark, "op4_source_mixing")
    assert {d: r.size for d, r in got.items()} == {d: len(WORD.findall(t)) for d, t in texts.items()}
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got.values())


def test_op7(spark, texts):
    lib, parts, sequences = library("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op7_packing"):
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert parts.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array(lib.encode(text, add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(parts[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for spans in sequences.values():
        assert sum(n for _, n in spans) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:]))
    total = sum(n for spans in sequences.values() for _, n in spans)
    assert len(sequences) * 1024 < 1.05 * total


def test_op8(spark, texts):
    got, pack = by_id(spark, "op8_quality_rules"), zstandard.ZstdCompressor(level=3).compress
    for doc, text in texts.items():
        words, lines = WORD.findall(text), text.split("\n")
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        twice = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (twice, len(inside), failed)
        assert r.kept == (not failed and in_bands(text.encode(), pack))
    assert any(r.base_failed for r in got.values()) and any(not r.kept and not r.base_failed for r in got.values())


def in_bands(raw, pack):
    """Whole and chunk ratios against the module's limits, chunks cut here: 4096 bytes, a short last one joined."""
    low, high = [(a, b) for least, a, b in quality_rules.BANDS if len(raw) >= least][-1]
    chunks, rest = [], raw
    while len(rest) >= 4096 + 2048:
        chunks.append(rest[:4096])
        rest = rest[4096:]
    chunks.append(rest)
    least, most = quality_rules.CHUNK_BAND
    outside = [not least <= len(pack(c)) / len(c) <= most for c in chunks]
    return low <= len(pack(raw)) / len(raw) <= high and (len(chunks) == 1 or sum(outside) < 0.5 * len(chunks))


def test_op8_chunks_decide(monkeypatch):
    """A text whose whole ratio is good and whose chunks are not."""
    rng, pack = np.random.default_rng(3), zstandard.ZstdCompressor(level=3).compress
    prose = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(3000))
    monkeypatch.setattr(quality_rules, "BANDS", ((0, 0.0, 1.0),))
    for band, kept in (((0.0, 1.0), True), ((0.9, 1.0), False)):
        monkeypatch.setattr(quality_rules, "CHUNK_BAND", band)
        told = quality_rules.verdict(prose, pack)
        assert told[-1] is kept and kept == in_bands(prose.encode(), pack) and told[-2] == (not kept)


def test_op9(spark, texts):
    lib, got, at = library("byte_bpe_50k.json"), by_id(spark, "op9_token_store"), 0
    for doc in sorted(texts):
        ids = np.array(lib.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4")
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(spark, texts):
    got = by_id(spark, "op10_jpeg_media")
    for doc, text in texts.items():
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small documents with nulls, empty texts, repeated rows and ids, and columns that clash with the operators'."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.filter("doc_id % 9 = 1")
    all_docs = docs.unionByName(more).unionByName(more.withColumn("doc_id", F.lit(None).cast("long")))
    all_docs = all_docs.unionByName(docs.filter("doc_id % 11 = 2").withColumn("doc_id", F.lit(5).cast("long")))
    all_docs = all_docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    all_docs = all_docs.unionByName(docs.limit(2).withColumn("text", F.lit("")).withColumn("source", F.lit(None).cast("string")))
    clash = {c: F.lit("x") for c in ("row", "row_", "kept", "copies", "spans", "digest", "node", "size", "n", "ids")}
    folder = str(tmp_path_factory.mktemp("tables"))
    all_docs.withColumns(clash).withColumn("tags", F.create_map(F.lit("a"), F.lit(1))).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline_against_brute_force(spark, tables):
    stages = [spark.read.parquet(f"{tables}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        stages.append(written(stage(spark, stages[-1], tables)))
    given, passed, single, cut, mixed, packed = stages
    assert all(s.columns == given.columns for s in stages[:5])
    many = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())

    pack = zstandard.ZstdCompressor(level=3).compress

    def good(text):
        words = WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        return len(words) >= 50 and 100 * len(inside) <= 50 * len(words) and in_bands(text.encode(), pack)

    assert many(passed) == Counter({key: n for key, n in many(given).items() if good(key[1])})

    # near duplicates: each group of texts leaves one row, which is one of its own
    rows = [(r.doc_id, r.text) for r in passed.collect()]
    groups = defaultdict(list)
    for (i, _, root), row in zip(test_minhash_dedup.brute([(i, t) for i, (_, t) in enumerate(rows)], 5, 80), rows):
        groups[root].append(row)
    left = Counter((r.doc_id, r.text) for r in single.collect())
    assert sum(left.values()) == len(groups) and all(sum(left[row] for row in set(g)) == 1 for g in groups.values())
    assert len(groups) < len(rows)

    # passages: by id, then place; a character goes if all its bytes do
    before = sorted(((r.doc_id, r.text) for r in single.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({d for d, _ in before}) > 1
    raws, gone = test_suffix_dedup.brute(before, corpus_pipeline.PASSAGE, True)
    ids = Counter(d for d, _ in before)
    after = defaultdict(Counter)
    for r in cut.collect():
        after[r.doc_id][r.text] += 1
        assert r.n_chars == len(r.text)
    for (doc, text), raw, out in zip(before, raws, gone):
        if ids[doc] == 1:  # equal ids are ordered by a hash of the text
            at, want = 0, []
            for c in text:
                n = len(c.encode())
                want += [c] if not all(i in out for i in range(at, at + n)) else []
                at += n
            assert after[doc]["".join(want)] == 1, doc

    old, new = many(cut), many(mixed)
    assert all(0 < n <= 3 * old[key] for key, n in new.items())
    lib = library("byte_bpe_50k.json")
    want = Counter(np.array(lib.encode(r.text, add_special_tokens=False).ids + [0], "<u4").tobytes() for r in mixed.collect())
    length = Counter({raw: n * len(raw) // 4 for raw, n in want.items()})
    got = packed.collect()
    assert sum(r.length for r in got) == sum(length.values())
    pieces = Counter(raw[a : a + 4096] for raw in want.elements() for a in range(0, len(raw), 4096))
    assert Counter(bytes(r.ids) for r in got) == pieces


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
