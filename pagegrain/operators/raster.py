"""Raster operators on bands (page_id, y, data): a row of pixels is an array, so no pixel is a row of its own.

Masks hold 0 and 1.  What needs neighbouring rows works on blocks of rows, each
with the rows around it that it reaches, in one step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import bounded_batches, by_merge

#: Width of the strips that runs are looked for in; also the height from which a run is no line.
SPLIT_UNIT = 11


def bands(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """page_id, y, data of every row of pages (page_id, width, height), on where ``pixels`` (page_id, y, x) has a row."""
    rows = pixels.groupBy("page_id", "y").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    every = sizes.select("page_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y"))
    joined = spread(by_merge(every, rows, ["page_id", "y"], "left"), "page_id", "y")
    xs = F.coalesce(F.col("xs").cast("array<bigint>"), F.expr("CAST(array() AS array<bigint>)"))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, BATCH_ROWS) for i in range(0, batch.num_rows, BATCH_ROWS)):
                width, xs = part.column(2).to_numpy(), part.column(3)
                of = np.repeat(np.arange(part.num_rows), xs.value_lengths().to_numpy())
                x, ends = xs.flatten().to_numpy(), np.concatenate([[0], np.cumsum(width)])
                if (x < 0).any() or (x >= width[of]).any():
                    raise ValueError("a pixel lies outside its page")
                data = np.zeros(ends[-1], np.int32)
                data[ends[of] + x] = 1
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(data))], names=["page_id", "y", "data"])

    rows = joined.select(F.col("page_id").cast("string"), F.col("y").cast("long"), F.col("width").cast("long"), xs.alias("xs"))
    return rows.mapInArrow(run, "page_id string, y long, data array<int>")


def pixels(masks: DataFrame) -> DataFrame:
    """page_id, y, x of the pixels that are on."""
    return masks.select("page_id", "y", F.posexplode("data").alias("x", "on")).filter("on > 0").select("page_id", "y", F.col("x").cast("long").alias("x"))


#: Rows of pixels that a step of a worker makes or reads at a time.
BATCH_ROWS = 1024

#: Rows of a block, the most that a task's step sees of a page beside the rows around it.
BLOCK_ROWS = 128


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys to as many tasks as the session shuffles to.

    Rasters are few bytes and much work, so sizes in bytes must not join their partitions.
    """
    bounded_batches(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blocks(rows: DataFrame, before: int, after: int) -> DataFrame:
    """Adds block to rows (page_id, y, ...): each row comes once for its own block and for those that have it
    among the ``before`` rows above them or the ``after`` rows below them."""
    reach = F.sequence(F.floor(F.greatest(F.col("y") - after, F.lit(0)) / BLOCK_ROWS), F.floor((F.col("y") + before) / BLOCK_ROWS))
    return spread(rows.withColumn("block", F.explode(reach)), "page_id", "block")


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of arrays."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def _moved(mask: np.ndarray, axis: int, kind: str, size: int) -> np.ndarray:
    """Any or all of ``size`` pixels along an axis, size // 2 of them before; outside never decides."""
    pick, edge = {"dilate": (np.maximum, 0), "erode": (np.minimum, 1)}[kind]
    before, after = size // 2, size - size // 2 - 1
    n = mask.shape[axis]
    padded = np.pad(mask, [(before, after) if k == axis else (0, 0) for k in range(2)], constant_values=edge)
    out = mask
    for k in range(size):
        out = pick(out, padded[k : k + n] if axis == 0 else padded[:, k : k + n])
    return out


def morphed(masks: DataFrame, steps: list[tuple[str, str, int]]) -> DataFrame:
    """Masks after steps of (axis, kind, size): all of them at once on blocks of rows with the rows around that they reach."""
    before = sum(size // 2 for axis, _, size in steps if axis == "y")
    after = sum(size - size // 2 - 1 for axis, _, size in steps if axis == "y")

    def one(key, table):
        table = table.sort_by("y")
        y, mask = table["y"].to_numpy(), matrix(table["data"], table.num_rows)
        for axis, kind, size in steps:
            mask = _moved(mask, 0 if axis == "y" else 1, kind, size)
        own = y // BLOCK_ROWS == key[1].as_py()
        return pa.table([pa.array([key[0].as_py()] * int(own.sum()), pa.string()), pa.array(y[own]), lists(mask[own], pa.int32())], names=["page_id", "y", "data"])

    rows = masks.select(F.col("page_id").cast("string"), F.col("y").cast("long"), F.col("data").cast("array<int>"))
    return blocks(rows, before, after).groupBy("page_id", "block").applyInArrow(one, "page_id string, y long, data array<int>")


def morphology(masks: DataFrame, axis: str, kind: str, size: int = 6) -> DataFrame:
    """Dilate (any) or erode (all) along y or x over size pixels, size // 2 of them before; outside never decides."""
    return morphed(masks, [(axis, kind, size)])


def thicken(masks: DataFrame) -> DataFrame:
    """Dilate down the columns, then open along the rows."""
    return morphed(masks, [("y", "dilate", 6), ("x", "erode", 6), ("x", "dilate", 6)])


def mask_sizes(masks: DataFrame, sizes: DataFrame) -> DataFrame:
    """The masks; raises where a page's rows are not as many or not as long as its size (page_id, width, height) says."""
    told = masks.groupBy("page_id").agg(F.min(F.size("data")).alias("least"), F.max(F.size("data")).alias("most"), F.count_distinct("y").alias("rows"))
    told = told.join(sizes.select("page_id", "width", "height"), "page_id")
    fits = (F.col("least") == F.col("width")) & (F.col("most") == F.col("width")) & (F.col("rows") == F.col("height"))
    good = told.filter(F.assert_true(fits, F.lit("a mask has another size than its page")).isNull()).select("page_id")
    return masks.join(good, "page_id", "left_semi")


def strip_grids(masks: DataFrame, unit: int = SPLIT_UNIT) -> DataFrame:
    """page_id, id, left, top, right, bottom (half open) of short runs of rows that are on in a strip.

    A strip's row is on with more than unit // 2 pixels; ids go strip by strip, then down.
    """

    def strips(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(first, BATCH_ROWS)
                widths = part.column(2).value_lengths().to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), len(widths)]
                for a, b in zip(cuts, cuts[1:]):  # rows of pages of one width
                    if not (width := int(widths[a])):
                        continue
                    data = part.column(2).slice(a, b - a).flatten().to_numpy().reshape(b - a, width)
                    at, strip = np.nonzero(np.add.reduceat(data, np.arange(0, width, unit), axis=1) > unit // 2)
                    left = strip * unit
                    columns = [part.column(k).slice(a, b - a).take(pa.array(at)) for k in range(2)]
                    columns += [pa.array(strip, pa.int32()), pa.array(left), pa.array(np.minimum(left + unit, width))]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "y", "strip", "left", "right"])

    rows = masks.select(F.col("page_id").cast("string"), F.col("y").cast("long"), F.col("data").cast("array<int>"))
    on = rows.mapInArrow(strips, "page_id string, y long, strip int, left long, right long")
    # rows that are on and follow each other share y - rank
    run = F.col("y") - F.row_number().over(Window.partitionBy("page_id", "strip").orderBy("y"))
    runs = on.withColumn("run", run).groupBy("page_id", "strip", "run").agg(
        F.min("left").cast("long").alias("left"), F.min("y").alias("top"), F.max("right").cast("long").alias("right"), (F.max("y") + 1).alias("bottom")
    )
    short = runs.filter(F.col("bottom") - F.col("top") < unit)
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("strip", "top")) - 1
    return short.select("page_id", number.alias("id"), "left", "top", "right", "bottom")


def region_members(regions: DataFrame) -> DataFrame:
    """page_id, region, grid_ids: the sorted grids (page_id, id, region) of each region."""
    return regions.groupBy("page_id", "region").agg(F.sort_array(F.collect_set("id")).alias("grid_ids"))


def region_groups(members: DataFrame, grids: DataFrame) -> DataFrame:
    """page_id, id, grid_ids and a box from the grids with the lowest and the highest id; widest first, then by region."""
    ends = members.select("page_id", "region", "grid_ids", F.explode(F.array(F.array_min("grid_ids"), F.array_max("grid_ids"))).alias("id"))
    boxed = by_merge(ends, grids, ["page_id", "id"]).groupBy("page_id", "region").agg(
        F.first("grid_ids").alias("grid_ids"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom")
    )
    order = Window.partitionBy("page_id").orderBy((F.col("right") - F.col("left")).desc(), "region")
    return boxed.select("page_id", (F.row_number().over(order) - 1).alias("id"), "left", "top", "right", "bottom", "grid_ids")


def majority(labels: DataFrame, keys: list[str], label: str, where: Column | None = None) -> DataFrame:
    """The most frequent label for the keys among the rows of ``where``, the lowest on ties; null where there is none."""
    mine = F.col(label) if where is None else F.when(where, F.col(label))
    return labels.groupBy(*keys).agg(F.mode(mine, True).alias(label))


def control_points(columns: DataFrame, sizes: DataFrame, ratio: float = 0.4, period: int = 10) -> DataFrame:
    """page_id, target_row, column, source_row: every ``period``-th column of wide regions, and the page's first and last row.

    ``columns`` has page_id, region, x, n and total: how many pixels a region has in a column, and the sum of their rows.
    A region is wide if it spans ``ratio`` of the page's width.
    """
    by = Window.partitionBy("page_id", "region")
    told = by_merge(columns, sizes.select("page_id", "width"), ["page_id"]).select(
        "page_id", "x", "width", S.half_up(F.sum("total").over(by) / F.sum("n").over(by)).alias("target_row"),
        S.half_up(F.col("total") / F.col("n")).alias("source_row"), (F.max("x").over(by) - F.min("x").over(by)).alias("span"),
        F.row_number().over(by.orderBy("x")).alias("at"),
    )
    inner = told.filter((F.col("span") >= ratio * F.col("width")) & ((F.col("at") - 1) % period == 0))
    edge = sizes.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("column"), "height")
    rows = F.array_distinct(F.array(F.lit(0).cast("long"), (F.col("height") - 1).cast("long")))
    edge = edge.select("page_id", F.explode(rows).alias("target_row"), "column").withColumn("source_row", F.col("target_row"))
    return inner.select("page_id", "target_row", F.col("x").alias("column"), "source_row").unionByName(edge)
