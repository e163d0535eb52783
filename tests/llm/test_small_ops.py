import hashlib
import re

import numpy as np
import pytest
import zstandard

from pagegrain.llm import chat_format, jpeg_media, quality_rules, source_mixing, url_filter

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = ["", None, "a", "One two three. " * 30, "x y z\nx y z\n\nx y z", "é漢🎉 # $ % " * 9, "w" * 70000, " \n\t", "the cat sat on the mat\n" * 3]


def frame(spark):
    rows = [(i, t, "s" + str(i % 2), "clash") for i, t in enumerate(TEXTS)] + [(None, "null id " * 60, None, "c"), (3, TEXTS[3], "s1", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_quality_equals_brute_force(spark):
    pack = zstandard.ZstdCompressor(level=3).compress
    want = []
    for r in frame(spark).collect():
        text = r.text or ""
        words, lines = WORD.findall(text), text.split("\n")
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        n = len(text.encode())
        kept = not failed and quality_rules.limits(n)[0] <= len(pack(text.encode())) / n <= quality_rules.limits(n)[1]
        want.append((str(r.doc_id), len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed, kept))
    got = quality_rules.quality(frame(spark)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == sorted(want)
    assert quality_rules.quality(frame(spark).limit(0)).count() == 0


def test_quality_bands_reject_junk_and_keep_prose(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = quality_rules.quality(spark.read.parquet(f"{sf}/documents.parquet")).filter("NOT base_failed").join(labels, "doc_id").collect()
    junk, clean = ([r.kept for r in judged if r.quality == q] for q in (0, 1))
    assert 2 * sum(junk) < len(junk) and sum(clean) > 0.97 * len(clean) > 0


def test_quality_limits_follow_their_sample():
    pack = zstandard.ZstdCompressor(level=3).compress
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(10**6, size=n))) for n in (100, 120, 1500)]
    bands, chunks = quality_rules.sampled_limits([*texts, None, "too short"], pack)
    whole = [quality_rules.ratios(t.encode(), pack) for t in texts]
    assert [b[0] for b in bands] == [512, 8192]
    assert bands[0][1:] == (round(min(w for w, _ in whole[:2]) - 0.02, 3), round(max(w for w, _ in whole[:2]) + 0.02, 3))
    assert chunks == (round(min(whole[2][1]) - 0.02, 3), round(max(whole[2][1]) + 0.02, 3))


def test_jpeg_gives_payloads_back(spark):
    stored = jpeg_media.media(frame(spark))
    files = {str(r.doc_id) + str(r.n_bytes): bytes(r.media) for r in stored.collect()}
    rows = {str(r.doc_id) + str(r.n_bytes): r for r in jpeg_media.media_payloads(stored).collect()}
    assert jpeg_media.media_payloads(jpeg_media.media(frame(spark).limit(0))).count() == 0
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        raw += bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[str(i) + str(len((text or "").encode()))]
        assert (r.payload_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        file = files[str(i) + str(len((text or "").encode()))]
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    bad = spark.createDataFrame([(1, b"no jpeg"), (2, None), (3, files["21"])], "id long, media binary")
    told = {r.id: r for r in jpeg_media.media_features(bad).collect()}
    assert told[1].error and told[2].error and told[3].error is None and told[3].width == 512


def test_jpeg_frames_beyond_the_height_limit():
    payload = np.random.default_rng(1).integers(0, 256, 64 * 8200).astype(np.uint8).tobytes()
    (frames,) = jpeg_media.thumbnails(jpeg_media.encode_payloads([payload]))
    assert len(frames) == 2 and b"".join(f[2].tobytes() for f in frames) == payload
    with pytest.raises(ValueError):
        jpeg_media.parse(b"\xff\xd8\xff\xc2\x00\x04ab")


def test_chat_examples_round_trip(spark):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "~1 </s> <s>\n[/INST]"), (1, 2, "user", None), (2, 0, "sys\ntem", "~"),
        (3, 0, "assistant", "<"), (3, 1, "assistant", ""), (None, None, None, None), (4, 0, "user", "q"), (4, 0, "user", "q"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat_format.chat_examples(df)
    told = examples.select("*", chat_format.parse_example(examples.text).alias("turns"),
                           chat_format.loss_text(examples.text, examples.loss_start, examples.loss_length).alias("loss")).collect()
    for key in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] or 0))]
        mine = sorted((t for t in told if t.conv_id == key), key=lambda t: t.example)
        assert [tuple(x) for x in mine[-1].turns] == want
        assert [t.loss for t in mine if t.loss_length or t.turns[-1].role == "assistant"] == [t for r, t in want if r == "assistant"]
    assert chat_format.chat_examples(df.limit(0)).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (i % 37), "abcd"[i % 4 if i % 3 else 0]) for i in range(3000)] + [(None, "x y", None), (7, None, "a")] + [(9, "a b c", "b")] * 40
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size long")
    got = source_mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, source_mixing.mix_sources(df).collect()))
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == size[s] and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 37
    assert source_mixing.mix_sources(df.limit(0)).count() == 0


def test_url_rules_and_templates(spark):
    rules = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"))
    urls = ["https://A.example.COM/en/712?x=/de/", "http://b.com/en/", "x://c.net/de/1#/en/", "no host", None, "https://c.net", "http://xnet/de/x", "a://b://c/d"]
    urls += [f"http://junk.org/spam/{i}.html" for i in range(60)] + [f"http://junk.org/good/{1000 + i}.html" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(60)], "key long, bad long")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels, rules).collect()}
    want = [("a.example.com", "/en/712", "example.com/en/7", "allow"), ("b.com", "/en/", "com/en/", "block"), ("c.net", "/de/1", "net/de/", "allow"),
            ("", "", None, "allow"), ("", "", None, "allow"), ("c.net", "", None, "allow"), ("xnet", "/de/x", None, "allow"), ("b:", "//c/d", None, "allow")]
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(8)] == want
    assert {got[i].verdict for i in range(8, 68)} == {"block"} and {got[i].verdict for i in range(68, 128)} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), labels, rules).count() == 0


def test_url_branches_without_labels_keep_their_names(spark):
    """Purity against a plain recursion over the tree's branches."""
    kinds = {"spam": (30, 1), "ham": (30, 0), "few": (3, 1), "none": (4, None)}
    rows = [("h.org", [kind, "x"], bad) for kind, (n, bad) in kinds.items() for _ in range(n)] + [("i.org", ["a"], None), ("h.org", [""], 0)]
    urls = spark.createDataFrame([(*r, 1) for r in rows], "host string, shape array<string>, bad long, n long")
    got = {(r.host, *r.shape): r for r in url_filter.template_tree(urls).collect()}
    assert all(tuple(r.template) == key[1:] for key, r in got.items())
    bads = [b for *_, b in rows if b is not None]
    overall = 1 - sum(bads) / len(bads)

    def purity(host, template):
        prior = overall
        for depth in range(len(template) + 1):
            mine = [b for h, t, b in rows if b is not None and h == host and (t[:depth] == template[:depth] and len(t) > depth if depth < len(template) else t == template)]
            prior = (len(mine) - sum(mine) + 10 * prior) / (len(mine) + 10)
        return prior

    for (host, *shape), r in got.items():
        assert abs(r.purity - purity(host, shape)) < 1e-9, (host, shape)
    assert got["h.org", "spam", "x"].rejected and not got["h.org", "ham", "x"].rejected and not got["i.org", "a"].rejected


def test_urls_without_numbers_on_one_host(spark):
    """Nine tenths of the shapes have no number; they leave the others' labels as they are, also beside a label without key."""
    urls = [f"http://h.org/{kind}/{i}.html" for kind, least in (("spam", 0), ("good", 1000)) for i in range(least, least + 40)]
    bare = [f"http://h.org/page/w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(650)] + ["http://h.org/page/w"] * 70
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(1000 + i, 0) for i in range(40)] + [(None, 1)], "key long, bad long")
    verdicts = {}
    for some in (urls, urls + bare):
        pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
        verdicts[len(some)] = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, labels, ()).collect()}
    few, all_ = verdicts.values()
    assert [all_[i] for i in range(80)] == [few[i] for i in range(80)] == ["block"] * 40 + ["allow"] * 40
    assert {all_[i] for i in range(80, 800)} == {"allow"} and len(all_) == 800


def test_url_templates_reach_every_level(spark):
    urls = [f"http://h.org/a/b/c/d/{kind}/e/{i}.html" for kind, least in (("spam", 0), ("good", 1000)) for i in range(least, least + 60)]
    urls += ["http://h.org/a/b", "http://h.org/" + "x/" * 11 + "y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1000 + i, 0) for i in range(60)], "key long, bad long")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, labels, ()).collect()}
    assert len(got) == len(urls) and all(got[i].purity is not None for i in got)
    assert {(got[i].verdict, got[i].template.split("/")[4]) for i in range(60)} == {("block", "spam")}
    assert {(got[i].verdict, got[i].template.split("/")[4]) for i in range(60, 120)} == {("allow", "good")}
    assert got[120].template.count("/") == 1 and got[121].template.count("/") == 11


def test_very_long_texts_and_one_id_of_many_sizes(spark):
    long = "word " * 200_000
    rows = [(i, "w " * 20, "a") for i in range(50)] + [(99, long, "a")] + [(7, "x " * i, "b") for i in range(300)] + [(None, "y " * i, "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    mine = [r for r in got if r.source == "b"]
    assert abs(sum(r.taken for r in mine) - mine[0].target) <= 20
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "~" + long)], "conv_id long, turn long, role string, text string")
    told = chat_format.chat_examples(talk)
    row = told.select(chat_format.parse_example(told.text).alias("turns"), chat_format.loss_text(told.text, told.loss_start, told.loss_length).alias("loss")).first()
    assert [t.text for t in row.turns] == [long, "~" + long] and row.loss == "~" + long
    urls = spark.createDataFrame([(1, "http://h.org/" + "s" * 200_000), (2, "http://" + "h" * 100_000 + "/x"), (3, "://"), (4, "")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (1, 0)], "key long, bad long")
    judged = {r.page_id: r for r in url_filter.filter_urls(urls, labels, ()).collect()}
    assert len(judged[1].path) == 200_001 and len(judged[2].host) == 100_000 and (judged[3].host, judged[4].path) == ("", "")


def test_url_labels_of_a_repeated_key_count_once(spark):
    urls = spark.createDataFrame([(i, f"http://h.org/p/{i}") for i in range(30)], "page_id long, url string")
    labels = [(i, int(i < 5)) for i in range(30)]
    once = url_filter.filter_urls(urls, spark.createDataFrame(labels, "key long, bad long"), ()).select("page_id", "purity", "verdict")
    twice = url_filter.filter_urls(urls, spark.createDataFrame(labels * 2, "key long, bad long"), ()).select("page_id", "purity", "verdict")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
