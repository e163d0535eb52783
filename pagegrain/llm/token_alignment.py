"""Alignment of two tokenizers' tokens over a corpus, and how often their ids meet.

A task makes runs: of each some megabytes of text the records (A id, B id,
document), cut by radix of the A id and written as zstd frames in the order of
A, then B.  Runs of a radix are merged over a heap, many to one, in a tree of
shuffles; a merged run is as large as the vocabularies allow, however many
documents there are, and one task's hot pair is one record of it.  The last
merge has all pairs of an A id side by side and so its highest count.  Counts
then go back to the runs, a radix at a time, and give each document's sums.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import id_text, slices, written
from ._tokens import ByteLevelIds, Tails, kept
from .chunked_bpe import Decoder, ragged

#: Text bytes whose records make a run, and bytes of a long text that are aligned at once.
RUN_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
#: Parts that the A ids are dealt to.
RADIX = 32
#: Pairs in a frame, and runs that one merge takes.
FRAME, FAN = 1 << 16, 64
#: Runs whose documents' sums one group of tasks' rows holds at most.
GROUP_RUNS = 512

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_DOCS = ", ".join(["doc_ids array<long>", *[f"{c} array<long>" for c in COUNTS], "shas array<string>"])
_RUN = f"run long, radix int, pairs array<binary>, records binary, {_DOCS}"


class PlainByteLevelIds(ByteLevelIds):
    """Ids with the strings of special tokens as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.model._resize_cache(0)
        self.added, self.tails = (), Tails(())


class PieceIds:
    """Ids of a sentencepiece model, and the bytes of each."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        shown = [self.library.id_to_piece(i) for i in range(n)]
        raw = [bytes([int(p[1:-1], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)]
        self.data, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes
        #: Whether a text may be cut before a space: no piece holds one after another character.
        self.cuts = not any("▁" in p.lstrip("▁") for p in shown)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        told = self.library.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, told), np.int64, len(told))
        return np.fromiter(chain.from_iterable(told), np.int64, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


def cut_text(text: str, limit: int = PIECE_BYTES) -> list[str]:
    """Parts of some ``limit`` bytes, each but the first from a space that stands between visible characters."""
    raw = text.encode()
    if len(raw) <= limit:
        return [text]
    data = np.frombuffer(raw, np.uint8)
    sure = np.flatnonzero((data[1:-1] == 32) & (data[:-2] > 32) & (data[:-2] < 127) & (data[2:] > 32)) + 1
    places, last = [0], 0
    while len(data) - last > limit and (at := int(np.searchsorted(sure, last + limit))) < len(sure):
        last = int(sure[at])
        places.append(last)
    return [raw[a:b].decode() for a, b in zip(places, [*places[1:], len(raw)])]


class Decimals:
    """Decimal digits of ids, joined by separators, as bytes."""

    def __init__(self, n: int):
        raw = [b"%d " % i for i in range(n)]
        self.data, self.sizes = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, n)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Each id and the mark after it; and where each one ends."""
        ends = np.cumsum(self.sizes[ids])
        out = ragged(self.data, self.starts[ids], self.sizes[ids]).copy()
        out[ends - 1] = marks
        return out.tobytes(), ends


class Aligner:
    """Links, groups and their digests of texts."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.decoder = PlainByteLevelIds(path_a), PieceIds(path_b), Decoder(path_a)
        self.n_a, self.n_b = len(self.decoder.sizes), len(self.b.sizes)
        self.decimals = Decimals(max(self.n_a, self.n_b))

    def codes(self, parts: list[str]):
        """Both sides' ids and bounds of the parts, bytes and bounds of the parts, and which parts both sides give back."""
        a, a_bounds = self.a(pa.array(parts, pa.string()))
        a = a.astype(np.int64)
        b, b_bounds = self.b([p[1:] for p in parts])
        raw = [p.encode() for p in parts]
        bounds = np.concatenate([[0], np.cumsum(list(map(len, raw)))]).astype(np.int64)
        data, good = np.frombuffer(b"".join(raw), np.uint8), np.ones(len(parts), bool)
        for ids, at, side in ((a, a_bounds, self.decoder), (b, b_bounds, self.b)):
            ends = np.concatenate([[0], np.cumsum(side.sizes[ids])])[at]
            good &= np.diff(ends) == np.diff(bounds)
            if good.all():
                wrong = np.flatnonzero(ragged(side.data, side.starts[ids], side.sizes[ids]) != data)
                good[np.searchsorted(bounds, wrong, side="right") - 1] = False
        return a, a_bounds, b, b_bounds, bounds, good

    def __call__(self, parts: list[str]):
        """Of parts that both sides give back: counts (part, COUNTS), group texts, and links as (A id, B id, part)."""
        a, a_bounds, b, b_bounds, bounds, good = self.codes(parts)
        if not good.all():
            return None, good
        a_end, b_end = np.cumsum(self.decoder.sizes[a]), np.cumsum(self.b.sizes[b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        n_groups = np.diff(np.searchsorted(shared, bounds, side="right"))
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        # a token's place among both sides': those before it on its side and in earlier (A) or the same (B) groups on the other
        first_a, first_b = np.searchsorted(a_group, np.arange(len(shared) + 1)), np.searchsorted(b_group, np.arange(len(shared) + 1))
        order_a, order_b = np.arange(len(a)) + first_b[a_group], np.arange(len(b)) + first_a[b_group + 1]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[order_a], ids[order_b] = a, b
        marks[order_a[first_a[1:] - 1]], marks[order_b[first_b[1:] - 1]] = ord("|"), ord(";")
        text, ends = self.decimals(ids, marks)
        cut = np.concatenate([[0], ends])[a_bounds + b_bounds].tolist()
        groups = [text[x : y - 1] for x, y in zip(cut, cut[1:])]
        low = np.searchsorted(b_end, a_end - self.decoder.sizes[a], side="right")
        times = np.searchsorted(b_end - self.b.sizes[b], a_end) - low
        link_a = np.repeat(a, times)
        link_b = ragged(b, low, times)
        part = np.repeat(np.repeat(np.arange(len(parts)), np.diff(a_bounds)), times)
        counts = np.stack([np.diff(a_bounds), np.diff(b_bounds), n_groups, np.bincount(part, minlength=len(parts))], 1)
        return (counts, groups, link_a * self.n_b + link_b, part), good


def _added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct key, ascending, and the sum of its values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def frame(*columns: np.ndarray) -> bytes:
    """Equally long columns of whole numbers as one zstd frame; the first as differences."""
    first = np.diff(columns[0].astype(np.int64), prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:])))


def columns_of(raw: bytes, n: int) -> list[np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(n, 8, -1)
    first, *rest = (np.ascontiguousarray(c.T).view("<i8").ravel() for c in flat)
    return [np.cumsum(first), *rest]


def heap_merge(runs):
    """Blocks of (keys ascending, counts) of all runs together: a heap holds how far each run's block reaches,
    and what lies up to the nearest of these ends is complete."""
    runs = [iter(r) for r in runs]
    heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def pull(i: int) -> None:
        block = next(runs[i], None)
        if block is not None:
            heads[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        pull(i)
    while heap:
        bound, taken = heap[0][0], []
        for i, (keys, counts) in heads.items():
            n = int(np.searchsorted(keys, bound, side="right"))
            taken.append((keys[:n], counts[:n]))
            heads[i] = keys[n:], counts[n:]
        yield _added(np.concatenate([k for k, _ in taken]), np.concatenate([c for _, c in taken]))
        while heap and heap[0][0] <= bound:
            _, i = heapq.heappop(heap)
            del heads[i]
            pull(i)


def _blocks(frames):
    return (tuple(columns_of(f, 2)) for f in frames)


def _frames(blocks) -> list[bytes]:
    return [frame(*(c[i : i + FRAME] for c in block)) for block in blocks for i in range(0, len(block[0]), FRAME)]


def _with_best(blocks, n_b: int):
    """Blocks of (keys, counts, best): whether a count is the highest of its A id.  An A id's pairs lie side by side."""
    held = None
    for keys, counts in chain(blocks, [(None, None)]):
        if held is not None and keys is not None:
            keys, counts = np.concatenate([held[0], keys]), np.concatenate([held[1], counts])
        elif keys is None:
            keys, counts = held if held is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            held = "last"
        n = len(keys) if isinstance(held, str) else int(np.searchsorted(keys, keys[-1] // n_b * n_b))
        if n:
            first = np.flatnonzero(np.concatenate([[True], np.diff(keys[:n] // n_b) > 0]))
            most = np.repeat(np.maximum.reduceat(counts[:n], first), np.diff(np.append(first, n)))
            yield keys[:n], counts[:n], (counts[:n] == most).astype(np.int64)
        held = keys[n:], counts[n:]


def make_runs(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of runs, written: for each run and radix its pairs (with the number of its documents) and its records,
    and one row (radix -1) of its documents' own numbers."""

    def run(batches):
        name = f"{path_a}\n{path_b}"
        align = kept(_PairOfPaths, name).aligner
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=RUN_BYTES):
            yield from _run_rows(align, number, batch)
            number += 1

    return written(id_text(df, id_col, text_col).mapInArrow(run, _RUN), "runs")


class _PairOfPaths:
    def __init__(self, paths: str):
        self.aligner = Aligner(*paths.split("\n"))


def _run_rows(align: Aligner, number: int, batch: pa.RecordBatch):
    doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    n = len(texts)
    parts: list[str] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        if text:
            cut = cut_text(" " + text) if align.b.cuts else [" " + text]
            parts += cut
            owner += [i] * len(cut)
    counts, good = np.zeros((n, 4), np.int64), np.ones(n, bool)
    digests: dict[int, object] = {}
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop]) <= PIECE_BYTES):
            size += len(parts[stop])
            stop += 1
        some, mine = parts[at:stop], np.array(owner[at:stop])
        at = stop
        told, fit = align(some)
        if told is None:
            good[mine[~fit]] = False
            some, mine = [p for p, ok in zip(some, fit) if ok], mine[fit]
            if not some:
                continue
            told, _ = align(some)
        told_counts, groups, pairs, part = told
        np.add.at(counts, mine, told_counts)
        for i, group in zip(mine.tolist(), groups):
            if i in digests:
                digests[i].update(b";")
            else:
                digests[i] = hashlib.sha256()
            digests[i].update(group)
        # a pair's documents lie side by side
        new, often = np.unique(pairs * n + mine[part], return_counts=True)
        keys, times = _added(np.concatenate([keys, new]), np.concatenate([times, often]))
    counts[~good] = 0
    doc = keys % n
    keep = good[doc]
    pair, doc, times = keys[keep] // n, doc[keep], times[keep]
    radix = pair // align.n_b % RADIX
    rows = []
    for r in range(RADIX):
        here = radix == r
        if here.any():
            first = np.flatnonzero(np.concatenate([[True], np.diff(pair[here]) > 0]))
            held = np.diff(np.append(first, int(here.sum())))
            rows.append({"run": number, "radix": r, "pairs": _frames([(pair[here][first], held)]), "records": frame(doc[here], times[here])})
    shas = [digests[i].hexdigest() if ok and i in digests else "" for i, ok in enumerate(good.tolist())]
    rows.append({"run": number, "radix": -1, "doc_ids": doc_ids, **{c: counts[:, k].tolist() for k, c in enumerate(COUNTS)}, "shas": shas})
    kinds = {"run": pa.int64(), "radix": pa.int32(), "pairs": pa.list_(pa.binary()), "records": pa.binary(), "doc_ids": pa.list_(pa.int64())}
    kinds |= {c: pa.list_(pa.int64()) for c in COUNTS} | {"shas": pa.list_(pa.string())}
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([row.get(c)], k) for c, k in kinds.items()], names=list(kinds))


def merge_runs(runs: DataFrame, n_runs: int, n_b: int) -> DataFrame:
    """radix, frames (pairs, documents that hold them, whether that is the A id's highest): one row for each radix."""

    def merging(last: bool):
        def run(batches):
            key, held = None, []

            def told():
                blocks = heap_merge([_blocks(f) for f in held])
                frames = _frames(_with_best(blocks, n_b) if last else blocks)
                return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([frames], pa.list_(pa.binary()))], names=["radix", "part", "pairs"])

            for batch in batches:
                for radix, part, frames in zip(*(c.to_pylist() for c in batch.columns)):
                    if key is not None and key != (radix, part):
                        yield told()
                        held = []
                    key = radix, part
                    held.append(frames)
                    if len(held) == FAN:
                        held = [_frames(heap_merge([_blocks(f) for f in held]))]
            if key is not None:
                yield told()

        return run

    level = runs.filter("radix >= 0").select("radix", F.col("run").alias("part"), "pairs")
    parts = n_runs
    while True:
        parts = -(-parts // FAN)
        level = level.select("radix", F.pmod(F.xxhash64("part"), F.lit(parts)).alias("part"), "pairs")
        level = level.repartition("radix", "part").sortWithinPartitions("radix", "part").mapInArrow(merging(parts == 1), "radix int, part long, pairs array<binary>")
        if parts == 1:
            return level.select("radix", "pairs")


def pair_counts(totals: DataFrame, n_b: int) -> DataFrame:
    """a, b, documents, best of all linked pairs, from ``merge_runs``."""

    def run(batches):
        for batch in batches:
            for frames in batch.column(0).to_pylist():
                for keys, counts, best in (columns_of(f, 3) for f in frames):
                    yield pa.RecordBatch.from_arrays([pa.array(keys // n_b), pa.array(keys % n_b), pa.array(counts), pa.array(best == 1)], names=["a", "b", "documents", "best"])

    return totals.select("pairs").mapInArrow(run, "a long, b long, documents long, best boolean")


def contribute(runs: DataFrame, totals: DataFrame, n_runs: int) -> DataFrame:
    """A row for each document: its own numbers, and sums of its links' counts, from its run's records and each radix's totals.

    Runs are dealt to groups; a group reads the totals radix by radix beside its
    own runs' rows of that radix, and keeps its documents' sums meanwhile.
    """
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(-(-n_runs // GROUP_RUNS), min(n_runs, partitions))
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def run(batches):
        group, told, docs = None, None, {}

        def rows():
            for columns, sums in docs.values():
                arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(s) for s in sums] + [pa.array(columns[-1], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for of, _, side, number, pairs, records, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                if of != group:
                    yield from rows()
                    group, docs = of, {}
                if side == 0:  # a run's documents
                    docs[number] = columns, np.zeros((2, len(columns[0])), np.int64)
                elif side == 1:  # a radix's totals
                    told = [np.concatenate(c) for c in zip(*(columns_of(f, 3) for f in pairs))]
                else:
                    held = [np.concatenate(c) for c in zip(*_blocks(pairs))]
                    at = np.repeat(np.searchsorted(told[0], held[0]), held[1])
                    doc, times = columns_of(records, 2)
                    sums = docs[number][1]
                    np.add.at(sums[0], doc, told[2][at] * times)
                    np.add.at(sums[1], doc, told[1][at] * times)
        yield from rows()

    own = F.pmod(F.xxhash64("run"), F.lit(groups))
    docs = [c.split(" ")[0] for c in _DOCS.split(", ")]
    rows = runs.select(own.alias("part"), "radix", F.when(F.col("radix") < 0, 0).otherwise(2).alias("side"), "run", "pairs", "records", *docs)
    every = totals.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "radix", F.lit(1).alias("side"), "pairs")
    dealt = rows.unionByName(every, allowMissingColumns=True).repartition(groups, "part").sortWithinPartitions("part", "radix", "side", "run")
    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "n_best long", "count_sum long", "groups_sha256 string"])
    return dealt.mapInArrow(run, schema)


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``path_a`` is a byte-level tokenizers file, which codes a space and the text,
    ``path_b`` a sentencepiece model, which adds that space itself.  Null and
    empty texts, and texts that one side does not give back byte for byte, have
    zeros and ''.  Ids may be null or repeat (a row each, and each row a document
    of its own in the counts), an empty table gives no rows, other columns are
    ignored.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    runs = make_runs(df, path_a, path_b, id_col, text_col)
    n_runs = max(runs.filter("radix = -1").count(), 1)
    return contribute(runs, merge_runs(runs, n_runs, n_b), n_runs)
