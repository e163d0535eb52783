"""Token ids in a binary format of directly addressable codes.

An id is split into 8-bit chunks.  Level 0 holds the low chunk of every id and
a bitmap that tells which ids go on; level 1 holds the next chunk of those, and
so on.  A rank directory over each bitmap gives any id's place in the next
level, so one token is read without decoding its neighbours.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import id_text, shared_folder, slices
from ._tokens import BATCH_BYTES, ByteLevelIds, kept, with_end

MAGIC = b"DAC1"
SCHEMA = "shard long, segment long, first_doc long, doc_ids array<long>, stops array<long>, from_before boolean, goes_on boolean, codes binary"
#: Bits of a bitmap for each entry of its rank directory.
RANK_BITS = 512
#: Ids of a segment.
SEGMENT_IDS = 1 << 18
_ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """Header, then for each level: its size, chunks, bitmap and rank directory."""
    level, out = ids.astype(np.uint32), []
    while True:
        more = level > 255
        bitmap = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(_ones[np.pad(bitmap, (0, -len(bitmap) % (RANK_BITS // 8)))].reshape(-1, RANK_BITS // 8).sum(1))])
        out.append(struct.pack("<Q", len(level)) + (level & 255).astype(np.uint8).tobytes() + bitmap.tobytes() + ranks.astype("<u4").tobytes())
        level = level[more] >> np.uint32(8)
        if not len(level):
            return MAGIC + struct.pack("<I", len(out)) + b"".join(out)


class Codes:
    """Reads an encoded segment; ``codes[i]`` and ``codes.take(places)`` touch only what they need."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (levels,) = struct.unpack_from("<I", raw, 4)
        at, self.levels = 8, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            at += 8
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bitmap = np.frombuffer(raw, np.uint8, -(-n // 8), at + n)
            at += n + len(bitmap)
            ranks = np.frombuffer(raw, "<u4", -(-len(bitmap) // (RANK_BITS // 8)) + 1, at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bitmap, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places: at each level, chunk, continuation bit, and rank of the place."""
        out = np.zeros(len(places), np.uint32)
        live, places = np.arange(len(places)), np.asarray(places, np.int64)
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[live] |= chunks[places].astype(np.uint32) << np.uint32(8 * depth)
            goes_on = (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
            live, places = live[goes_on], places[goes_on]
            if not len(live):
                break
            start = places // RANK_BITS
            rank = ranks[start].astype(np.int64)
            width = RANK_BITS // 8
            for b in range(width):  # whole bytes before the place, then the bits below it
                at = start * width + b
                whole = at < places >> 3
                if not whole.any():
                    break
                rank[whole] += _ones[bitmap[at[whole]]]
            rank += _ones[bitmap[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8)]
            places = rank
        return out

    def __getitem__(self, place: int) -> int:
        return int(self.take(np.array([place]))[0])

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range; one rank a level, the rest of the range lies side by side."""
        out = np.zeros(stop - start, np.uint32)
        live, a, b = np.arange(stop - start), start, stop
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            out[live] |= chunks[a:b].astype(np.uint32) << np.uint32(8 * depth)
            bits = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            live = live[bits]
            if not len(live):
                break
            block = a // RANK_BITS
            a = int(ranks[block]) + int(_ones[bitmap[block * (RANK_BITS // 8) : a >> 3]].sum()) + int(_ones[bitmap[a >> 3] & ((1 << (a & 7)) - 1)])
            b = a + len(live)
        return out


def write_store(
    df: DataFrame, vocabulary_path: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write all documents' ids, each with ``end_id``, in ascending doc_id order; returns the folder.

    Rows of the files: shard (range of doc_id), segment in it, first_doc (number
    of its first document in the shard), doc_ids and stops (where each document
    ends in the segment), from_before and goes_on (whether the first one began
    in the segment before, and the last one goes on in the next) and codes (the
    format above).  All segments of a shard but the last
    hold ``SEGMENT_IDS`` ids, so a long document is spread over segments.
    Nulls: text empty, doc_id first.  Equal doc_ids lie side by side in order
    of a hash of their text.
    """
    path = path or f"{shared_folder(df.sparkSession)}/pagegrain/store-{uuid.uuid4().hex}"
    docs = id_text(df, id_col, text_col)
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, *place).sortWithinPartitions(*place)

    def run(batches):
        encode_texts = kept(ByteLevelIds, vocabulary_path)
        segment, first_doc, from_before = 0, 0, False
        ids, docs, sizes = np.zeros(0, "<u4"), [], np.zeros(0, np.int64)

        def cut(size):
            """The next ``size`` held ids as a row; what is left stays held."""
            nonlocal segment, first_doc, from_before, ids, docs, sizes
            ends = np.cumsum(sizes)
            n = int(np.searchsorted(ends, size)) + 1  # documents with ids in the segment
            stops, goes_on = np.minimum(ends[:n], size), bool(ends[n - 1] > size)
            row = [[segment], [first_doc], [docs[:n]], [stops], [from_before], [goes_on], [encode(ids[:size])]]
            done = n - goes_on
            left = sizes[done:].copy()
            if goes_on:
                left[0] = ends[n - 1] - size
            segment, first_doc, from_before = segment + 1, first_doc + done, goes_on
            ids, docs, sizes = ids[size:], docs[done:], left
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.binary()]
            names = ["segment", "first_doc", "doc_ids", "stops", "from_before", "goes_on", "codes"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=names)

        for batch in slices(batches, limit=BATCH_BYTES):
            more, bounds = with_end(*encode_texts(batch.column(1)), end_id)
            ids = np.concatenate([ids, more])
            docs += batch.column(0).to_pylist()
            sizes = np.concatenate([sizes, np.diff(bounds)])
            while len(ids) >= SEGMENT_IDS:
                yield cut(SEGMENT_IDS)
        if len(ids):
            yield cut(len(ids))

    rows = ordered.mapInArrow(run, SCHEMA.removeprefix("shard long, "))
    rows.select(F.spark_partition_id().cast("long").alias("shard"), "*").write.option("compression", "none").parquet(path)
    return path


def segment_starts(files: DataFrame) -> DataFrame:
    """shard, segment, start (ids before the segment): sums within shards, and over one row a shard.

    The shards are as many as shuffle partitions wrote them, so the one window over all of them stays small.
    """
    totals = files.select("shard", "segment", F.element_at("stops", -1).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "segment", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("in_shard"))
    return starts.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("in_shard")).alias("start"))


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), bits reversed, modulo that of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def join_crc32(parts) -> int:
    """crc32 of a text from (bytes, crc32) of its parts in order: each shifts what came before by its length."""
    out = 0
    for size, crc in parts:
        shift, power = 1 << 31, 1 << 23  # 1 and x ** 8
        while size:
            if size & 1:
                shift = _times(shift, power)
            power, size = _times(power, power), size >> 1
        out = _times(out, shift) ^ crc
    return out


def read_store(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""
    files = spark.read.schema(SCHEMA).parquet(path)
    names = ["shard", "segment", "number", "doc_id", "at", "n", "crc", "whole"]

    def run(batches):
        for batch in batches:
            for shard, segment, number, docs, stops, from_before, goes_on, raw in zip(*(c.to_pylist() for c in batch.columns)):
                codes, a, rows = Codes(raw), 0, []
                ids = codes.span(0, len(codes)).astype("<u4", copy=False)
                for i, (doc, b) in enumerate(zip(docs, stops)):
                    whole = (i > 0 or not from_before) and not (goes_on and i == len(docs) - 1)
                    rows.append((shard, segment, number + i, doc, a, b - a, zlib.crc32(ids[a:b]), whole))
                    a = b
                kinds = [pa.int64()] * 7 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return pd.Series([join_crc32((4 * p["n"], p["crc"]) for p in row) for row in parts], dtype="int64")

    part_of = files.mapInArrow(
        run, "shard long, segment long, number long, doc_id long, at long, n long, crc long, whole boolean"
    )
    place = segment_starts(files).withColumnRenamed("start", "before")
    read = part_of.join(place, ["shard", "segment"]).withColumn("start", F.col("before") + F.col("at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "n", "crc"))), lambda p: F.struct(p["n"].alias("n"), p["crc"].alias("crc")))
    spread = read.filter("NOT whole").groupBy("shard", "number").agg(  # documents that lie in several segments
        F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), parts.alias("parts")
    )
    spread = spread.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))
    return read.filter("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")).unionByName(spread)


def token_at(spark, path: str, place: int) -> int | None:
    """The id at a global place, or None past the end: one segment is fetched, one code is read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    spans = files.join(segment_starts(files), ["shard", "segment"])
    row = spans.filter((F.col("start") <= place) & (F.element_at("stops", -1) + F.col("start") > place)).first()
    return None if row is None else Codes(bytes(row["codes"]))[place - row["start"]]
