"""Helpers shared by the operators: shared-folder tables and vectorised text views.

Everything here works on one Arrow batch at a time inside a task; nothing
collects rows to the driver.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts, as a regular-expression class body.
SEPARATORS = r"\x20\x09-\x0D"
#: Text bytes that one numpy step handles; a longer single text is handled alone.
SLICE_BYTES = 2 << 20


#: Bytes of an Arrow batch between executors and Python workers; Spark's own default lets a worker hold many times that.
BATCH_BYTES = 5 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where none is set, local mode takes a temporary one; a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagegrain-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors.

    The files are compressed and columnar, so later steps read only what they use.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/pagegrain/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and no later result reads."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()[:1]}:
            hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A key with over one in so many of a table's rows is hot, so there are at most as many hot keys.
HOT_SHARE = 1000
#: Rows of a key that are never called hot.
HOT_LEAST = 10_000


#: Salts of rows that are known to meet nothing in a join.
FREE_SALTS = 1024


def join_salted(
    left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int, spread: list, how: str = "inner", free: Column | None = None
) -> DataFrame:
    """Join; ``right`` has a row for each key and says in ``count`` how many of ``left``'s ``rows`` rows have it.

    A hot key's rows are dealt by a hash of ``spread`` to as many salts as it
    fills shares.  In a left join, rows for which ``free`` holds surely meet
    nothing and are dealt freely, whatever their key.  Only the hot keys, ``HOT_SHARE`` at most, and the most
    frequent of the others, so that plans are alike with and without hot ones,
    are broadcast.
    """
    share = max(rows // HOT_SHARE, HOT_LEAST)
    salts = f"CAST({count} div {share} + 1 AS INT)"
    hot = right.filter(F.col(count) > share).select(*keys, F.expr(salts).alias("__salts"))
    most = right.filter(F.col(count) <= share).agg(F.max_by(F.struct(*keys), count).alias("most")).select("most.*", F.lit(1).alias("__salts"))
    marked = left.join(F.broadcast(hot.unionByName(most)), keys, "left")
    of = F.coalesce("__salts", F.lit(1))
    if free is not None:
        of = F.when(free, F.lit(FREE_SALTS)).otherwise(of)
    marked = marked.withColumn("__salt", F.pmod(F.xxhash64(*spread), of).cast("int")).drop("__salts")
    many = right.withColumn("__salt", F.explode(F.expr(f"sequence(0, {salts} - 1)")))
    return marked.join(many.hint("shuffle_hash"), [*keys, "__salt"], how).drop("__salt")


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; extra columns never clash."""
    bounded_batches(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Cut record batches so that each slice holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = view(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < n:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            stop = min(n, max(stop, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and int64 row offsets into them, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()[-3:]
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and for each row the index of its first word (n+1 long)."""
    solid = np.ones(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    solid[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    inner = solid[1:-1]
    first = inner & ~solid[:-2]
    last = inner & ~solid[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inner[edges]
    last[edges - 1] = inner[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes its argument."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of any byte range of a buffer, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(RangeHash._powers) < n:
            size = max(n, SLICE_BYTES + 2)
            for name, base in (("_powers", self.BASE), ("_inverse", pow(self.BASE, -1, 1 << 64))):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(RangeHash, name, np.multiply.accumulate(table))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(self._values[data] * self._powers[: n - 1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self._inverse[starts])
