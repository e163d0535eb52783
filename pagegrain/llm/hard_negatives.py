"""Hard negatives by segment summaries.

Every vector is stored with the mean and the deviation of its segments, long
ones and short ones.  Over a segment of n components the inner product of two
vectors is n times the product of their means, give or take n times the product
of their deviations.  So a level's summaries bound a score from both sides; a
pair that can no longer be among the wanted is left, the others are refined by
the next level's shorter segments, and what remains is scored exactly.

Anchors are the stated query set.  They are dealt to blocks, the rows to
packed blocks; a task holds one block of anchors with what they have found and
streams a group of rows' blocks past it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._text import bounded_batches, written

#: Components of a segment, level by level.
LEVELS = (16, 4)
#: Rows and components of a packed block, anchors of a block and of a tile, and pairs that one task looks at.
ROWS, CELLS, ANCHORS, TILE, PAIRS = 2048, 1 << 19, 8192, 1024, 1 << 31
#: Tasks of a sweep at most; beyond it a task takes several blocks of anchors and groups, one after the other.
MOST_TASKS = 100_000
#: Share of a tile's pairs below which they are gathered instead of multiplied whole.
SPARSE = 0.2
#: Relative error of single-precision means, doubled, of a product of two.
SLACK = 2.0**-21
LEAST = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max

_BLOCK = "rows array<long>, ids array<long>, labels array<long>, scores array<array<long>>, vectors binary, means binary, deviations binary"


def summaries(vectors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations (rounded up) of the segments of ``length`` components, in single precision."""
    parts = vectors.reshape(len(vectors), -1, length).astype(np.float64)
    mean = parts.mean(2)
    deviation = np.sqrt(((parts - mean[:, :, None]) ** 2).mean(2))
    return mean.astype(np.float32), np.nextafter((deviation * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def pack(rows: DataFrame, key: str) -> DataFrame:
    """``key`` (long) and blocks of rows (row, id, label, scores, codes); rows of one key must lie side by side in a task."""

    def run(batches):
        at, held = None, []

        def told():
            held.sort(key=lambda r: (r[1] is None, r[1] or 0, r[0]))
            width = max(-(-max(len(r[4]) for r in held) // LEVELS[0]), 1) * LEVELS[0]
            vectors = np.zeros((len(held), width), np.int64)
            for i, r in enumerate(held):
                vectors[i, : len(r[4])] = r[4]
            both = [summaries(vectors, n) for n in LEVELS]
            small = max(int(vectors.max()), -int(vectors.min())) < 1 << 15
            cells = vectors.astype("<i2") if small else vectors
            row = [[at], *[[[r[k] for r in held]] for k in range(4)], [cells.tobytes()]]
            row += [[np.concatenate([b[k] for b in both], 1).tobytes()] for k in range(2)]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.list_(pa.int64())), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=[key, *(c.split()[0] for c in _BLOCK.split(", "))])

        for batch in batches:
            for of, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (of != at or len(held) >= max(64, min(ROWS, CELLS // max(len(held[0][4]), 1)))):
                    yield told()
                    held = []
                at = of
                held.append(row)
        if held:
            yield told()

    return rows.select(F.col(key).cast("long"), "row", "id", "label", "scores", "codes").mapInArrow(run, f"{key} long, {_BLOCK}")


class Block:
    """Packed rows, unpacked."""

    def __init__(self, rows, ids, labels, scores, vectors, means, deviations):
        n = len(rows)
        self.rows, self.labels, self.scores = np.array(rows, np.int64), np.array(labels, np.int64), scores
        self.ids = np.array([MOST if i is None else i for i in ids], np.int64)
        segments = len(means) // (4 * n)
        width = segments * LEVELS[0] // sum(LEVELS[0] // x for x in LEVELS)
        self.vectors = np.frombuffer(vectors, "<i2" if len(vectors) == 2 * n * width else "<i8").reshape(n, width).astype(np.int64)
        mean, deviation = (np.frombuffer(x, np.float32).reshape(n, segments).astype(np.float64) for x in (means, deviations))
        self.levels, at = [], 0
        for length in LEVELS:  # scaled by the root of the length, so products count for all components
            cut = slice(at, at + width // length)
            self.levels.append((mean[:, cut] * length**0.5, deviation[:, cut] * length**0.5))
            at = cut.stop

    @classmethod
    def joined(cls, parts: list[Block]) -> Block:
        out = cls.__new__(cls)
        out.rows, out.labels, out.ids = (np.concatenate([getattr(p, c) for p in parts]) for c in ("rows", "labels", "ids"))
        out.scores = [s for p in parts for s in p.scores]

        def wide(arrays):
            width = max(a.shape[1] for a in arrays)
            return np.concatenate([np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in arrays])

        out.vectors = wide([p.vectors for p in parts])
        out.levels = [tuple(wide([p.levels[k][side] for p in parts]) for side in range(2)) for k in range(len(LEVELS))]
        return out


def products(a: np.ndarray, b: np.ndarray, pairs=None) -> np.ndarray:
    """Inner products of all rows of a with all of b, or of the pairs only; missing components count as 0."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    return a @ b.T if pairs is None else np.einsum("ij,ij->i", a[pairs[0]], b[pairs[1]])


def exact(a: np.ndarray, b: np.ndarray, pairs=None) -> np.ndarray:
    """Whole-number inner products: in double precision where that holds them, else by unbounded integers cut to 64 bits."""
    most = lambda x: int(np.abs(x.astype(np.float64)).max(initial=0)) + 1
    if most(a) * most(b) * min(a.shape[1], b.shape[1]) < 1 << 53:
        return products(a.astype(np.float64), b.astype(np.float64), pairs).astype(np.int64)
    width = min(a.shape[1], b.shape[1])
    i, j = pairs if pairs is not None else (np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)))
    told = [sum(int(x) * int(y) for x, y in zip(a[p, :width].tolist(), b[q, :width].tolist())) for p, q in zip(i, j)]
    out = np.array([min(max(t, LEAST + 1), MOST) for t in told], np.int64)
    return out if pairs is not None else out.reshape(len(a), len(b))


class Finder:
    """The best ``k`` rows of every band (low, high; both included) of a block of anchors, best first by score, then id, then row."""

    def __init__(self, anchors: Block, low: np.ndarray, high: np.ndarray, k: int, same_label: bool):
        self.anchors, self.low, self.high, self.k, self.same = anchors, low, high, k, same_label
        shape = (*low.shape, k)
        self.score, self.id, self.row = (np.full(shape, x, np.int64) for x in (LEAST, MOST, MOST))
        self.looked, self.scored = 0, 0

    def see(self, block: Block) -> None:
        a = self.anchors
        if not self.same:
            for at in range(0, len(a.rows), TILE):
                mine = np.arange(at, min(at + TILE, len(a.rows)))
                self.tile(mine, np.arange(len(block.rows)), block, a.labels[mine][:, None] != block.labels[None, :])
            return
        labels, first = np.unique(block.labels, return_index=True)
        order = np.argsort(block.labels, kind="stable")
        cuts = np.searchsorted(block.labels[order], labels)
        for label, others in zip(labels, np.split(order, cuts[1:])):
            found = np.flatnonzero(a.labels == label)
            for at in range(0, len(found), TILE):
                mine = found[at : at + TILE]
                self.tile(mine, others, block, a.rows[mine][:, None] != block.rows[others][None, :])

    def tile(self, mine: np.ndarray, others: np.ndarray, block: Block, alive: np.ndarray) -> None:
        """Anchors ``mine`` against rows ``others``: bounds, level by level, then exact scores of the pairs still alive."""
        self.looked += int(alive.sum())
        least = np.maximum(self.low[mine], self.score[mine, :, -1])  # beyond this a score can still come in
        most = self.high[mine]
        pairs = None
        for (a_mean, a_dev), (b_mean, b_dev) in zip(self.anchors.levels, block.levels):
            sides = a_mean[mine], b_mean[others], a_dev[mine], b_dev[others]
            norm_a = np.sqrt((sides[0] ** 2).sum(1) + (sides[2] ** 2).sum(1))
            norm_b = np.sqrt((sides[1] ** 2).sum(1) + (sides[3] ** 2).sum(1))
            if pairs is None:
                middle, reach = products(sides[0], sides[1]), products(sides[2], sides[3])
                reach += SLACK * norm_a[:, None] * norm_b[None, :]
                fits = np.zeros(alive.shape, bool)
                for b in range(least.shape[1]):
                    fits |= (middle + reach >= least[:, b : b + 1]) & (middle - reach <= most[:, b : b + 1])
                alive = alive & fits
                if alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
            else:
                middle, reach = products(sides[0], sides[1], pairs), products(sides[2], sides[3], pairs)
                reach += SLACK * norm_a[pairs[0]] * norm_b[pairs[1]]
                fits = np.zeros(len(middle), bool)
                for b in range(least.shape[1]):
                    fits |= (middle + reach >= least[pairs[0], b]) & (middle - reach <= most[pairs[0], b])
                pairs = pairs[0][fits], pairs[1][fits]
        if pairs is None:
            scores = exact(self.anchors.vectors[mine], block.vectors[others])
            self.scored += scores.size
            pairs = np.nonzero(alive)
            scores = scores[pairs]
        else:
            self.scored += len(pairs[0])
            scores = exact(self.anchors.vectors[mine], block.vectors[others], pairs)
        for b in range(least.shape[1]):
            keep = (scores >= least[pairs[0], b]) & (scores <= most[pairs[0], b])
            if keep.any():
                self.take(mine[pairs[0][keep]], b, scores[keep], block.ids[others[pairs[1][keep]]], block.rows[others[pairs[1][keep]]])

    def take(self, anchor: np.ndarray, band: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge found rows into what the anchors hold of a band."""
        which = np.unique(anchor)
        held = [x[which, band].ravel() for x in (self.score, self.id, self.row)]
        slot = np.concatenate([np.repeat(which, self.k), anchor])
        columns = [np.concatenate([old, new]) for old, new in zip(held, (score, ids, rows))]
        order = np.lexsort([columns[2], columns[1], ~columns[0], slot])  # ~x falls as x grows
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = order[place < self.k]
        for x, column in zip((self.score, self.id, self.row), columns):
            x[which, band] = column[best].reshape(-1, self.k)


def bands(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest s with low * score <= 100 * s <= high * score, without overflow."""
    ceiling = -(-scores // 100 * low + -scores % 100 * low // 100)
    return ceiling, scores // 100 * high + scores % 100 * high // 100


def sweep(anchors: DataFrame, blocks: DataFrame, n_blocks: int, groups: int, k: int, of_positives: tuple[int, int] | None) -> DataFrame:
    """row, band, score, id, other (row) of the best ``k`` of each anchor and band, in each group of blocks.

    Little data is much work here, so the number of tasks is set, not left to sizes in bytes.

    ``anchors`` and ``blocks`` are packed; ``of_positives`` None finds rows of
    the anchor's label, else rows of other labels in a band (percent) of each
    of the anchor's scores.
    """
    names = ["row", "band", "score", "id", "other"]

    def run(batches):
        key, parts, finder = None, [], None

        def begun():
            a = Block.joined(parts)
            if of_positives is None:
                return Finder(a, np.full((len(a.rows), 1), LEAST), np.full((len(a.rows), 1), MOST), k, True)
            width = max(map(len, a.scores))
            low, high = np.full((len(a.rows), width), MOST), np.full((len(a.rows), width), LEAST)
            for i, s in enumerate(a.scores):
                low[i, : len(s)], high[i, : len(s)] = bands(np.array(s, np.int64), *of_positives)
            return Finder(a, low, high, k, False)

        def told():
            if finder is None:
                return
            at, band, place = np.nonzero(finder.row < MOST)
            some = finder.id[at, band, place]
            ids = pa.array(some, mask=some == MOST)
            yield pa.RecordBatch.from_arrays([pa.array(finder.anchors.rows[at]), pa.array(band.astype(np.int32)), pa.array(finder.score[at, band, place]), ids, pa.array(finder.row[at, band, place])], names=names)

        for batch in batches:
            for block, group, side, *columns in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, group) != key:
                    yield from told()
                    key, parts, finder = (block, group), [], None
                if side == 0:
                    parts.append(Block(*columns))
                elif parts or finder:
                    if finder is None:
                        finder, parts = begun(), []
                    finder.see(Block(*columns))
        yield from told()

    held = [c.split()[0] for c in _BLOCK.split(", ")]
    own = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    left = anchors.select("anchors", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("side"), *held)
    right = blocks.select(every.alias("anchors"), own.alias("group"), F.lit(1).alias("side"), *held)
    tasks = min(n_blocks * groups, MOST_TASKS)
    dealt = left.unionByName(right).repartition(tasks, "anchors", "group").sortWithinPartitions("anchors", "group", "side")
    return dealt.mapInArrow(run, "row long, band int, score long, id long, other long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each anchor and band over all groups, with rank from 1."""
    order = Window.partitionBy("row", "band").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x).  An anchor's positives are the best
    ``positives`` other rows of its label; of each, the best ``negatives`` rows
    of other labels score from ``low`` to ``high`` percent of it.  Higher scores
    come first, then smaller ids, null ids last.  Rows with a null label, a null
    vector, or a null or non-finite component take no part.  A row is itself,
    whatever its id: rows with equal ids are others to each other and anchors
    each, and ``is_anchor`` null is no anchor.  Missing components of a shorter
    vector count as 0; scores beyond 64 bits are cut to these.  An empty table
    gives no rows, other columns are ignored.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`").cast("long")
    sound = label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    codes = F.transform(vector, lambda x: F.floor(x * scale).cast("long"))
    rows = df.filter(F.coalesce(sound, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), codes.alias("codes"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        F.expr("CAST(array() AS array<bigint>)").alias("scores"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, n_anchors = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    n_blocks = max(-(-n_anchors // ANCHORS), 1)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = min(max(-(-n * n_anchors // (PAIRS * n_blocks)), -(-partitions // n_blocks)), n // ROWS + 1)
    numbered = F.expr("row div 1024")
    blocks = written(pack(rows.withColumn("block", numbered), "block"), "vector-blocks")

    def packed(some: DataFrame) -> DataFrame:
        some = some.withColumn("anchors", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("long"))
        return pack(some.repartition("anchors").sortWithinPartitions("anchors"), "anchors")

    anchors = rows.filter("is_anchor")
    found = best(sweep(packed(anchors), blocks, n_blocks, groups, positives, None), positives)
    found = written(found.select("row", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    with_scores = anchors.drop("scores").join(scores, "row")
    mined = best(sweep(packed(with_scores), blocks, n_blocks, groups, negatives, (low, high)), negatives)
    mined = mined.select("row", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = mined.join(found, ["row", "band"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
