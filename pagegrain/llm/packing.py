"""Packing token ids into fixed windows by minimum bin slack.

Long documents give full windows and one remainder; the remainders of a block
are packed so that each window gets the multiset of remaining lengths whose
sum comes closest to the capacity, found by subset sums on bitsets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import id_text, slices, written
from ._tokens import BATCH_BYTES, ByteLevelIds, kept, with_end

#: Remainders packed together; each block leaves one window that is not nearly full.
BLOCK = 4096
#: Sequence ids of full windows start here; those of blocks are block << 32 + window.
FULL = 1 << 62


def fill(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths (with repeats) that fill one window best; the largest one left is always among them.

    Bit s of a state tells that the lengths seen so far can add up to s.  Each
    length enters in copies of 1, 2, 4 ...; walking the states back gives the
    copies of each length.
    """
    seed = max(counts)
    room = capacity - seed
    mask = (1 << (room + 1)) - 1
    state, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length)
        size = 1
        while left > 0:
            copies = min(size, left)
            grown = (state | state << copies * length) & mask
            if grown != state:
                steps.append((length, copies, state))
                state = grown
            left -= copies
            size *= 2
        if state >> room & 1:
            break
    total = state.bit_length() - 1
    chosen = [seed]
    for length, copies, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * copies
            total -= copies * length
    return chosen


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset for each of the lengths."""
    order = np.argsort(lengths, kind="stable")
    values, first, number = np.unique(lengths[order], return_index=True, return_counts=True)
    queue = {int(v): order[a : a + n].tolist()[::-1] for v, a, n in zip(values, first, number)}
    counts = {int(v): int(n) for v, n in zip(values, number)}
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    at = 0
    while counts:
        used = 0
        for length in fill(counts, capacity):
            i = queue[length].pop()
            window[i], offset[i] = at, used
            used += length
            counts[length] -= 1
            if not counts[length]:
                del counts[length]
        at += 1
    return window, offset


def pieces(
    df: DataFrame, vocabulary_path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool
) -> DataFrame:
    """Each document's ids and the end id, cut into full windows and a remainder: a row for each piece."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches):
        encode = kept(ByteLevelIds, vocabulary_path)
        for batch in slices(batches, limit=BATCH_BYTES):
            ids, bounds = with_end(*encode(batch.column(1)), end_id)
            totals = np.diff(bounds)
            n = -(-totals // capacity)
            row = np.repeat(np.arange(len(totals)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(totals[row] - start, capacity)
            at = bounds[row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            cols = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(totals[row])]
            if with_ids:
                edges = np.concatenate([at, bounds[-1:]]).astype(np.int32) * 4
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(ids)]))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names[: len(cols)])

    return id_text(df, id_col, text_col).mapInArrow(run, schema + ", ids binary" * with_ids)


def pack(
    df: DataFrame,
    vocabulary_path: str,
    capacity: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Pieces of one sequence_id lie gapless from offset 0 and hold ``capacity``
    ids at most; ``ids`` are little-endian unsigned 32-bit.  Remainders are
    dealt into blocks of about ``block`` by a hash of id and row, so a hot id
    or many equal rows spread; a sequence never spans blocks.  Full windows are
    sequences of their own and join no block, so a very long document makes no
    large group.  Null text is the end id alone; null and repeated ids are rows like others; an empty table
    gives no rows; other columns are ignored.
    """
    cut = written(pieces(df, vocabulary_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    row = F.monotonically_increasing_id()
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": F.lit(FULL) + row, "offset": F.lit(0).cast("long")})
    short = cut.filter(F.col("length") < capacity)
    blocks = max(1, -(-short.count() // block))
    dealt = short.withColumn("block", F.pmod(F.xxhash64("doc_id", row), F.lit(blocks)))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        window, offset = pack_block(table["length"].to_numpy(), capacity)
        sequence = (table["block"].to_numpy() << 32) + window
        at = table.schema.get_field_index("block")
        return table.remove_column(at).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("block").applyInArrow(one, schema).unionByName(full)


def padding(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """A row for each sequence: ids in it, and what it is padded to (its own length at a power of two)."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.expr("bit_count(used) = 1")
    return used.withColumn("padded", F.when(power, F.col("used")).otherwise(F.lit(capacity)))
