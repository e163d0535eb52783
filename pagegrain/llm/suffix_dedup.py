"""Exact removal of long repeated byte strings, by longest previous factors in suffix order.

Every window of ``length`` bytes holds one anchor: the least hash among the
window's k-grams.  Windows can only be equal if their anchors are, so the runs
of windows that share an anchor (super-windows) are grouped by it, and runs
equal as a whole are one kind.  Of anchors with several kinds one text of each
is sorted by suffixes; previous and next smaller positions in that order give
the longest previous factor of every window start, and a factor of ``length``
bytes is an earlier equal window.  An anchor of very many kinds is split: the
runs' windows are dealt by how far before the anchor they start, and meet by
the longer text that those have in common.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import RangeHash, dropped, id_text, join_salted, mix, slices, view, written

#: Bytes of a k-gram; a window of length L chooses among L - K + 1 of them.
K = 100
#: Window starts that one numpy step handles; longer texts go in steps.
STEP = 1 << 18
#: Kinds of runs that one suffix sort's group may have; the runs of larger groups are split by a longer common text.
HOT = 1024
#: Bytes of run texts that one suffix sort handles, or one group's if that is more.
SORT_BYTES = 1 << 19
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from block-wise minima of prefixes and suffixes."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.uint64(2**64 - 1))]).reshape(-1, width)
    prefix = np.minimum.accumulate(padded, axis=1).ravel()
    suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - width + 1], prefix[width - 1 : n])


def super_windows(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """row, first start, last start (in the row), anchor, content hash, of every run of windows that share an anchor.

    The position breaks ties between equal k-grams: the leftmost is the anchor.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    hashes = RangeHash(data)
    n = len(data) - k + 1
    grams = hashes(np.arange(n), np.arange(k, n + k))
    bits = np.uint64(int(n).bit_length())
    keyed = grams >> bits << bits | np.arange(n, dtype=np.uint64)
    least = sliding_least(keyed, length - k + 1)
    place = (least & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int32)
    long_rows = np.flatnonzero(sizes >= length)
    np.add.at(valid, offsets[long_rows], 1)
    np.add.at(valid, offsets[long_rows + 1] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    if not len(starts):
        return empty, empty, empty, empty, empty
    anchor = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    first, last = starts[heads], starts[np.concatenate([heads[1:], [len(starts)]]) - 1]
    # the last start of a text and the first of the next one may follow each other
    row = np.searchsorted(offsets, first, side="right") - 1
    p = anchor[heads]
    content = hashes(first, last + length) ^ (p - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row, first - offsets[row], last - offsets[row], grams[p].view(np.int64), content.view(np.int64)


def anchors(df: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, digest, first, last, anchor, content: the super-windows of all texts (doc_id, digest, base, text).

    A text is a whole document, base 0, or a piece of one from byte base on;
    first and last count from the document's start.
    """
    names = ["doc_id", "digest", "first", "last", "anchor", "content"]

    def run(batches):
        for batch in slices(batches, limit=STEP):
            data, offsets = view(batch.column(3))
            shift = batch.column(2).to_numpy()
            if len(data) <= 2 * STEP:
                steps = [(0, data, offsets)]
            else:  # one long text: window starts in steps
                steps = [(a, part := data[a : a + STEP + length - 1], np.array([0, len(part)])) for a in range(0, len(data), STEP)]
            for base, part, bounds in steps:
                row, first, last, anchor, content = super_windows(part, bounds, length, k)
                take = pa.array(row)
                base = base + shift[row]
                cols = [batch.column(0).take(take), batch.column(1).take(take)]
                cols += [pa.array(first + base), pa.array(last + base), pa.array(anchor), pa.array(content)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = df.select("doc_id", "digest", "base", "text")
    return rows.mapInArrow(run, "doc_id long, digest long, first long, last long, anchor long, content long")


def suffix_levels(data: np.ndarray, length: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(depth, ranks of all suffixes by their first ``depth`` bytes) for depths 8, 16, ... up to ``length``, by prefix doubling.

    Also the text, padded by zeros that the ranks see beyond its end.
    """
    padded = np.concatenate([data, np.zeros(2 * length + 8, np.uint8)])
    n = len(data) + length
    word = np.zeros(n, np.uint64)
    for i in range(min(8, length)):
        word = word << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    depth, levels = min(8, length), []
    rank = np.unique(word, return_inverse=True)[1].astype(np.int32)
    while True:
        levels.append((depth, rank))
        if 2 * depth > length:
            return levels, padded
        pair = rank[: len(rank) - depth].astype(np.uint64) << np.uint64(32) | rank[depth:].astype(np.uint64)
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int32)
        depth *= 2


def smaller_before(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the nearest one before it with a smaller place (-1: none), and the prefix both share.

    ``common`` tells the prefix each entry shares with the one before it.  All
    entries jump at once: what a skipped entry has skipped is larger still.
    """
    to, low = np.arange(-1, len(place) - 1), common.copy()
    live = np.flatnonzero(place[to[1:]] > place[1:]) + 1
    while len(live):
        over = to[live]
        low[live], to[live] = np.minimum(low[live], low[over]), to[over]
        live = live[to[live] >= 0]
        live = live[place[to[live]] > place[live]]
    low[to < 0] = 0
    return to, low


def longest_factors(data: np.ndarray, starts: np.ndarray, length: int, earlier_only: bool) -> np.ndarray:
    """For each start, how many bytes, ``length`` at most, also start earlier (or at any other of the starts).

    The starts are put in suffix order; the previous and next entries with a
    smaller position hold the longest previous factor, those with a larger one
    the longest next factor.
    """
    levels, padded = suffix_levels(data, length)
    depth, top = levels[-1]
    window = top[starts].astype(np.uint64) << np.uint64(32) | top[starts + length - depth].astype(np.uint64)
    order = np.lexsort((starts, window))
    place = starts[order]
    a, b = place[:-1], place[1:]
    common = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):
        fits = common + depth <= length
        common += np.where(fits & (rank[a + np.minimum(common, length)] == rank[b + np.minimum(common, length)]), depth, 0)
    for _ in range(min(8, length)):  # the last few bytes
        common += (common < length) & (padded[a + common] == padded[b + common])
    common = np.concatenate([[0], common])
    back = np.concatenate([[0], common[1:][::-1]])
    found = np.maximum(smaller_before(place, common)[1], smaller_before(place[::-1], back)[1][::-1])
    if not earlier_only:
        found = np.maximum(found, smaller_before(-place, common)[1])
        found = np.maximum(found, smaller_before(-place[::-1], back)[1][::-1])
    out = np.empty(len(starts), np.int64)
    out[order] = found
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of every run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _sorted_groups(length: int, earlier_only: bool):
    """Partition function: rows (anchor, content, n, doc_id, digest, first, body), by anchor and content, to (anchor, content, runs)."""

    def laid_out(rows):
        bodies = [np.frombuffer(r["body"], np.uint8) for r in rows]
        at = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
        counts = np.diff(at) - length + 1
        body = np.repeat(np.arange(len(rows)), counts)
        starts = at[body] + np.arange(len(body)) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.concatenate(bodies), starts, body, counts

    def solve(rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["anchor"], r["doc_id"], r["digest"], r["first"]))
        data, starts, body, _ = laid_out(rows)
        hashes = RangeHash(data)(starts, starts + length)  # a window without an equal hash has no equal
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        twice = np.zeros(len(rows), bool)
        twice[body[order[1:][same]]] = twice[body[order[:-1][same]]] = True
        rows = [r for r, t in zip(rows, twice) if t]
        out = []
        if rows:
            data, starts, body, counts = laid_out(rows)
            flags = longest_factors(data, starts, length, earlier_only) >= length
            for row, part in zip(rows, np.split(flags, np.cumsum(counts)[:-1])):
                if found := _runs(part):
                    out.append((row["anchor"], row["content"], [{"from": a, "to": b} for a, b in found]))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
        cols = list(zip(*out)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "content", "runs"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["anchor"], row["content"]) == (held[-1]["anchor"], held[-1]["content"]):
                    continue  # rows equal in id and text give the same run: they are one document
                if size >= SORT_BYTES and row["anchor"] != held[-1]["anchor"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["body"])
        if held:
            yield solve(held)

    return run


def _bodies(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds the text of each wanted run: rows (anchor, content, n, hot, doc_id, digest, first, body)."""
    spot = F.struct("anchor", "content", "n", "hot", "first", "last")
    # a text has no more rows than any of its kinds of runs
    listed = written(wanted.groupBy("doc_id", "digest").agg(F.collect_list(spot).alias("spots"), F.min("n").alias("rows")), "spots")
    names = ["anchor", "content", "n", "hot", "doc_id", "digest", "first", "body"]
    kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()]

    def run(batches):
        for batch in slices(batches):
            data, offsets = view(batch.column(batch.schema.get_field_index("text")))
            rows = []
            for i, (doc, digest, base, spots) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))):
                text = data[offsets[i] : offsets[i + 1]]
                for s in spots:
                    a, b = s["first"] - base, s["last"] - base + length
                    if 0 <= a and b <= len(text):
                        rows.append((s["anchor"], s["content"], s["n"], s["hot"], doc, digest, s["first"], text[a:b].tobytes()))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    joined = join_salted(docs, listed, ["doc_id", "digest"], "rows", docs.count(), [F.monotonically_increasing_id()])
    joined = joined.select("doc_id", "digest", "base", "text", "spots")
    schema = "anchor long, content long, n long, hot boolean, doc_id long, digest long, first long, body binary"
    return joined.mapInArrow(run, schema)


def _split(bodies: DataFrame, length: int, k: int) -> DataFrame:
    """Both halves of each run (anchor, content, first, body, at, lo, hi), grouped by a longer common text.

    All windows of a run hold its anchor, ``at`` bytes from the run's start
    (-1: not told yet), so a window is known by how far before the anchor it
    starts, ``lo`` to ``hi`` bytes.  A half takes half of these distances, and
    all its windows hold the bytes between the latest start and the earliest
    end: equal windows have the same distance and meet in one group of halves.
    of and its name the run, shift is the half's start in it, last its last window.
    """
    names = ["of", "its", "shift", "last", "anchor", "content", "doc_id", "digest", "first", "body", "at", "lo", "hi"]
    kinds = [pa.binary() if n == "body" else pa.int64() for n in names]

    def run(batches):
        for batch in slices(batches, "body", STEP // 8):
            column = {n: batch.column(i).to_numpy() for i, n in enumerate(batch.schema.names) if n != "body"}
            data, offsets = view(batch.column(batch.schema.get_field_index("body")))
            hashes = RangeHash(data)
            base, last, at = offsets[:-1], np.diff(offsets) - length, column["at"].copy()
            for i in np.flatnonzero(at < 0).tolist():
                starts = base[i] + np.arange(last[i], length - k + 1)
                at[i] = last[i] + int(np.argmax(hashes(starts, starts + k).view(np.int64) == column["anchor"][i]))
            middle = (column["lo"] + column["hi"]) // 2
            for lo, hi in ((column["lo"], middle), (middle + 1, column["hi"])):
                least, most = np.maximum(lo, at - last), np.minimum(hi, at)
                take = np.flatnonzero((least <= most) & (lo <= hi))
                shift, least, most = (at - most)[take], least[take], most[take]
                begin, p = base[take] + shift, (base + at)[take]
                end = p - least + length
                told = mix((lo * (length + 1) + hi)[take].astype(np.uint64) + np.uint64(1))
                group = mix(hashes(p - lo[take], p - hi[take] + length) ^ told)
                content = hashes(begin, end) ^ most.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                body = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
                cols = [column["anchor"][take], column["content"][take], shift, most - least, group.view(np.int64), content.view(np.int64)]
                cols += [column["doc_id"][take], column["digest"][take], column["first"][take] + shift, body, most, lo[take], hi[take]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    rows = bodies.select("anchor", "content", "doc_id", "digest", "first", "at", "lo", "hi", "body")
    return rows.mapInArrow(run, ", ".join(f"`{n}` {'binary' if n == 'body' else 'long'}" for n in names))


def _group_runs(bodies: DataFrame, length: int, k: int, earlier_only: bool, hot: int) -> DataFrame:
    """(anchor, content, runs) of the runs with repeated windows, from one body of each kind of run.

    Groups of ``hot`` kinds at most are sorted by suffixes in one task.  Larger
    ones are split by a longer common text until they are as small: where all
    windows of a group have one distance, that text is the window, and the
    group has one kind.
    """
    plain = bodies.filter("NOT hot").repartition("anchor").sortWithinPartitions("anchor", "content")
    runs = plain.mapInArrow(_sorted_groups(length, earlier_only), "anchor long, content long, runs array<struct<from:bigint,to:bigint>>")
    large = bodies.filter("hot")
    if large.isEmpty():
        return runs
    parts = written(_split(large.dropDuplicates(["anchor", "content"]), length, k), "parts")
    place = F.struct("doc_id", "digest", "first")
    kinds = parts.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(place).alias("least"), F.first(F.struct("body", "at", "lo", "hi")).alias("one")
    )
    kinds = written(kinds, "kinds")
    mixed = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed")
    wanted = join_salted(kinds, mixed, ["anchor"], "kinds", kinds.count(), ["content"])
    wanted = written(wanted.select("anchor", "content", (F.col("kinds") > hot).alias("hot"), "least.*", "one.*"), "bodies")
    inner = _group_runs(wanted, length, k, earlier_only, hot)
    told = kinds.select("anchor", "content", "n", "least").join(inner.hint("shuffle_hash"), ["anchor", "content"], "left")
    told = written(told.filter("n > 1 OR runs IS NOT NULL"), "told")
    dropped(kinds, mixed, wanted)
    hit = join_salted(parts.drop("body"), told, ["anchor", "content"], "n", parts.count(), ["its"])
    whole = place != F.col("least") if earlier_only else F.col("n") > 1
    everything = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("last").alias("to")))
    spans = F.transform(
        F.when(whole, everything).otherwise(F.col("runs")),
        lambda r: F.struct((r["from"] + F.col("shift")).alias("from"), (r["to"] + F.col("shift")).alias("to")),
    )
    hit = hit.select(F.col("of").alias("anchor"), F.col("its").alias("content"), spans.alias("runs")).filter("runs IS NOT NULL")
    found = written(hit.groupBy("anchor", "content").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    dropped(parts, told)
    return runs.unionByName(found)


def repeated_spans(docs: DataFrame, length: int, k: int, earlier_only: bool, hot: int) -> DataFrame:
    """doc_id, digest, spans (start, stop; they may overlap or be none), rows of all texts with repeated runs or windows; written.

    rows is the number of rows equal in id and text.
    """
    found = written(anchors(docs, length, k), "anchors")
    where = F.struct("doc_id", "digest", "first", "last")
    kinds = written(found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(where).alias("least")), "kinds")
    mixed = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "mixed")
    wanted = join_salted(kinds, mixed, ["anchor"], "kinds", kinds.count(), ["content"])
    wanted = wanted.select("anchor", "content", "n", (F.col("kinds") > hot).alias("hot"), "least.*")
    bodies = written(_bodies(wanted, docs, length), "bodies")
    distances = {"at": F.lit(-1).cast("long"), "lo": F.lit(0).cast("long"), "hi": F.lit(length - k).cast("long")}
    runs = _group_runs(bodies.withColumns(distances), length, k, earlier_only, hot)
    told = kinds.join(runs.hint("shuffle_hash"), ["anchor", "content"], "left").filter("n > 1 OR runs IS NOT NULL")
    told = written(told.select("anchor", "content", "n", "least", "runs"), "told")
    dropped(kinds, mixed, bodies)
    hit = join_salted(found, told, ["anchor", "content"], "n", found.count(), ["doc_id", "first"])
    everything = F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.col("last") - F.col("first")).alias("to")))
    is_least = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("digest") == F.col("least.digest")) & (F.col("first") == F.col("least.first"))
    whole = ~is_least if earlier_only else F.col("n") > 1
    spans = F.transform(
        F.when(whole, everything).otherwise(F.col("runs")),
        lambda r: F.struct((F.col("first") + r["from"]).alias("start"), (F.col("first") + r["to"] + length).alias("stop")),
    )
    hit = hit.select("doc_id", "digest", "first", F.coalesce(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
    rows = F.expr("CAST(count(*) div size(collect_set(first)) AS BIGINT)")
    # sets: the runs of rows equal in id and text are told once, before they are shuffled
    out = written(hit.groupBy("doc_id", "digest").agg(F.flatten(F.collect_set("spans")).alias("spans"), rows.alias("rows")), "spans")
    dropped(found, told)
    return out


def repeated_pieces(docs: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """doc_id, digest, base, text: the merged spans of ``least`` bytes or more, as binary texts."""
    names = ["doc_id", "digest", "base", "text"]

    def run(batches):
        for batch in slices(batches):
            data, offsets = view(batch.column(2))
            rows = []
            for i, (doc, digest, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)))):
                rows += [(doc, digest, a, data[offsets[i] + a : offsets[i] + b].tobytes()) for a, b in merge_spans(found) if b - a >= least]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()])], names=names)

    joined = join_salted(docs, spans, ["doc_id", "digest"], "rows", docs.count(), [F.monotonically_increasing_id()])
    joined = joined.select("doc_id", "digest", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, digest long, base long, text binary")


def merge_spans(spans) -> list[tuple[int, int]]:
    """Overlapping and adjoining (start, stop) joined, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in (() if spans is None else spans)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 400,
    keep_first: bool = True,
    k: int = K,
    hot: int = HOT,
    noted: int | None = None,
    noted_k: int = 64,
) -> DataFrame:
    """A row for each text: doc_id, digest, n_bytes, n_removed, spans (removed, merged), kept (the bytes left), n_noted.

    Removed is each byte covered by a ``length``-byte string that also starts
    earlier (by doc_id, then place; with ``keep_first``) or anywhere else, same
    document included; strings are those of the input.  Matches never cross
    documents.  Two 64-bit hashes (anchor and run) stand for equal runs.

    With ``noted``, a shorter length, n_noted counts the bytes covered by a
    string of so many bytes that also starts anywhere else; else it is null.
    Only texts between such strings' ends can hold longer copies, so
    ``length`` is then sought in those pieces alone.

    Null text is empty; texts shorter than ``length`` lose nothing; null ids
    come first, and an id of -2**63 counts as null; rows equal in id and text
    count as copies of each other, but with ``keep_first`` as one document; an
    empty table gives no rows; other columns are ignored.
    """
    docs = id_text(df, id_col, text_col)
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("digest"), F.lit(0).cast("long").alias("base"))
    if noted is None:
        spans = repeated_spans(docs, length, k, keep_first, hot).withColumn("noted", F.lit(None).cast("long"))
    else:
        found = repeated_spans(docs, noted, noted_k, False, hot)
        pieces = written(repeated_pieces(docs, found, length), "pieces")
        spans = repeated_spans(pieces, length, k, keep_first, hot)
        dropped(pieces)

        @F.pandas_udf("long")
        def covered(spans: pd.Series) -> pd.Series:
            return pd.Series([sum(b - a for a, b in merge_spans(row)) for row in spans], dtype="int64")

        noted_spans = found.select("doc_id", "digest", "rows", covered("spans").alias("noted"))
        spans = written(noted_spans.join(spans.drop("rows"), ["doc_id", "digest"], "left"), "noted")
        docs = docs.withColumn("none", F.lit(0).cast("long"))
    schema = (
        "doc_id long, digest long, n_bytes long, n_removed long, spans array<struct<start:bigint,stop:bigint>>, kept binary, n_noted long"
    )

    def run(batches):
        names = [x.split()[0] for x in schema.replace("<", " ").split(", ")]
        kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
        for batch in slices(batches):
            data, offsets = view(batch.column(1))
            removed, merged, kept = [], [], []
            for i, spans in enumerate(batch.column(3).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                cut = merge_spans(spans)
                edges = [0, *(x for s in cut for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                removed.append(len(text) - len(kept[-1]))
                merged.append([{"start": a, "stop": b} for a, b in cut])
            cols = [pa.array(c, t) for c, t in zip((removed, merged, kept), kinds)]
            sizes = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), sizes, *cols, batch.column(4)], names=names)

    short = F.octet_length("text") < (length if noted is None else min(length, noted))
    joined = join_salted(docs, spans, ["doc_id", "digest"], "rows", docs.count(), [F.monotonically_increasing_id()], "left", short)
    joined = joined.select("doc_id", "text", "digest", "spans", F.coalesce("noted", "none").alias("noted") if noted is not None else "noted")
    return joined.mapInArrow(run, schema).withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID}L)"))


def cut_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", length: int = 400, k: int = K, hot: int = HOT
) -> DataFrame:
    """``docs`` with later copies cut from the texts and ``size_col``, where there is one, set anew.

    A character goes if all its bytes do.  Rows without repeats stay as they
    are, null texts too; other columns pass through.
    """
    keyed = docs.withColumn("__id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))).withColumn(
        "__digest", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    )
    plain = keyed.select(
        F.col("__id").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.col("__digest").alias("digest"),
        F.lit(0).cast("long").alias("base"),
    )
    spans = repeated_spans(plain, length, k, True, hot)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("spans").alias("__spans"), F.col("rows").alias("__rows"))
    short = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)) < length
    joined = join_salted(keyed, spans, ["__id", "__digest"], "__rows", keyed.count(), [F.monotonically_increasing_id()], "left", short)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, s) if s is not None else t for t, s in zip(texts, spans)], dtype=object)

    text = F.when(F.col("__spans").isNull(), F.col(f"`{text_col}`")).otherwise(cut(F.col(f"`{text_col}`"), F.col("__spans")))
    out = joined.withColumn(text_col, text)
    if size_col in docs.columns:
        size = F.length(F.col(f"`{text_col}`")).cast(docs.schema[size_col].dataType)
        out = out.withColumn(size_col, F.when(F.col("__spans").isNull(), F.col(f"`{size_col}`")).otherwise(size))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_text(text: str, spans) -> str:
    """The text without the characters that lie wholly in the byte spans."""
    raw, parts, at = text.encode(), [], 0
    for a, b in merge_spans(spans):
        while a < len(raw) and raw[a] & 0xC0 == 0x80:  # a character that began before the span stays
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:  # as does one that ends after it
            b -= 1
        if b > a:
            parts.append(raw[at:a])
            at = b
    parts.append(raw[at:])
    return b"".join(parts).decode()
