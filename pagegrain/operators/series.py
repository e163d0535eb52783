"""Series analytics: density, z-scores, peaks, groups of five lines; a series is (series_id, i, v), dense from 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _by():
    return Window.partitionBy("series_id")


def _ordered():
    return _by().orderBy("i")


def dense(sparse: DataFrame) -> DataFrame:
    """Adds a row with v = 0 for every i from 0 to the largest that is missing."""
    spine = sparse.groupBy("series_id").agg(F.max("i").alias("top"))
    spine = spine.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("i"))
    return spine.join(sparse, ["series_id", "i"], "left").select("series_id", "i", F.coalesce("v", F.lit(0)).cast("double").alias("v"))


def checked_zones(zones: DataFrame) -> DataFrame:
    """Zones (page_id, zone_left, zone_right, width, height); raises where one leaves its page or ends before it begins."""
    fits = (F.col("zone_left") >= 0) & (F.col("zone_left") <= F.col("zone_right")) & (F.col("zone_right") <= F.col("width"))
    return zones.filter(F.assert_true(fits, F.lit("a zone does not lie on its page")).isNull())


def in_zone(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Pixels (page_id, y, x) in their page's columns from zone_left up to zone_right."""
    inside = pixels.join(checked_zones(zones).select("page_id", "zone_left", "zone_right"), "page_id")
    return inside.filter("x >= zone_left AND x < zone_right").select("page_id", "y", "x")


def zone_density(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """A series for each zone (page_id, zone_left, zone_right, width, height): its pixels that are on in every row of the page."""
    counts = in_zone(pixels, zones).groupBy("page_id", "y").agg(F.countDistinct("x").alias("n"))
    rows = checked_zones(zones).select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)).alias("y"))
    joined = rows.join(counts, ["page_id", "y"], "left")
    return joined.select(F.col("page_id").alias("series_id"), F.col("y").alias("i"), F.coalesce("n", F.lit(0)).cast("double").alias("v"))


def z_scores(series: DataFrame) -> DataFrame:
    """v becomes its z-score (population deviation, single precision); a constant series gives no rows."""
    # a row a series is joined back, so a long series' samples stay where they are
    told = series.groupBy("series_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).filter("deviation > 0")
    z = (F.col("v") - F.col("mean")) / F.col("deviation")
    return series.join(told, "series_id").select("series_id", "i", z.cast("float").cast("double").alias("v")).filter("v IS NOT NULL")


def local_maxima(series: DataFrame) -> DataFrame:
    """(series_id, i, v): strict maxima, plateaus by their middle (down), ends excluded."""
    change = F.coalesce((F.col("v") != F.lag("v").over(_ordered())).cast("int"), F.lit(0))
    runs = series.withColumn("change", change).withColumn("run", F.sum("change").over(_ordered()))
    runs = runs.groupBy("series_id", "run").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.first("v").alias("v"))
    order = _by().orderBy("run")
    around = runs.withColumn("before", F.lag("v").over(order)).withColumn("after", F.lead("v").over(order))
    return around.filter("v > before AND v > after").select("series_id", F.expr("(lo + hi) div 2").alias("i"), "v")


#: Samples of a block, the most of a series that one step sees.
BLOCK = 1 << 16
#: Rounds in which peaks that are the highest around are kept, before what is left is decided run by run.
ROUNDS = 2


def far_apart(peaks: DataFrame, distance: int) -> DataFrame:
    """Greedy from the highest (on ties the later): peaks strictly closer than ``distance`` to a kept one go.

    A peak that no open peak so near exceeds is kept and closes those around
    it, whatever happens elsewhere.  Blocks of a series, with the peaks around
    them, decide most peaks so in a few rounds; what stays open falls into
    short runs with gaps of ``distance`` or more between them, and each run is
    decided in order of height.
    """
    if distance < 1:
        raise ValueError("distance must be at least 1")
    near, block = distance - 1, max(BLOCK, 2 * distance)
    told = peaks.select("series_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"), F.lit(0).alias("state"))
    rank = F.when(F.col("state") == 0, F.struct("v", "i"))
    for _ in range(ROUNDS):
        for step in ("keep", "close"):
            reach = F.sequence(F.floor((F.col("i") - near) / block), F.floor((F.col("i") + near) / block))
            spread = told.withColumn("block", F.explode(reach))
            around = Window.partitionBy("series_id", "block").orderBy("i").rangeBetween(-near, near)
            if step == "keep":
                new = F.when((F.col("state") == 0) & (F.max(rank).over(around) == F.struct("v", "i")), 1).otherwise(F.col("state"))
            else:
                new = F.when((F.col("state") == 0) & (F.max(F.when(F.col("state") == 1, 1)).over(around) == 1), -1).otherwise(F.col("state"))
            spread = spread.withColumn("new", new).filter(F.col("block") == F.floor(F.col("i") / block))
            told = spread.select("series_id", "i", "v", F.col("new").alias("state"))
    kept = told.filter("state = 1").select("series_id", "i", "v")
    left = told.filter("state = 0")
    new = F.coalesce((F.col("i") - F.lag("i").over(_ordered()) >= distance).cast("int"), F.lit(0))
    left = left.withColumn("new", new).withColumn("run", F.sum("new").over(_ordered())).select("series_id", "run", "i", "v")

    def one(table: pa.Table) -> pa.Table:
        at, v = table["i"].to_numpy(), table["v"].to_numpy()
        by_place = np.argsort(at)
        at, v = at[by_place], v[by_place]
        low, high = np.searchsorted(at, at - near), np.searchsorted(at, at + near, side="right")
        open_ = np.ones(len(at), bool)
        stays = []
        for k in np.lexsort([at, v])[::-1]:
            if open_[k]:
                stays.append(k)
                open_[low[k] : high[k]] = False
        return table.take(pa.array(by_place[np.array(stays, np.int64)])).select(["series_id", "i", "v"])

    decided = left.groupBy("series_id", "run").applyInArrow(one, "series_id string, i long, v double")
    return kept.unionByName(decided)


def side_least(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the least one between it and the nearest strictly greater sample before it (itself included),
    and whether there is no such sample."""
    out, free, stack = np.empty(len(values)), np.empty(len(values), bool), []
    for i, v in enumerate(values.tolist()):
        least = v
        while stack and stack[-1][0] <= v:
            least = min(least, stack.pop()[1])
        out[i], free[i] = least, not stack
        stack.append((v, least))
    return out, free


def prominences(peaks: DataFrame, series: DataFrame) -> DataFrame:
    """Adds prominence on the whole series: height over the higher of the two side minima.

    A side ends at the nearest strictly greater sample.  Blocks of the series
    find it within themselves; for a side that leaves its block, the blocks'
    greatest samples tell which block it ends in and the blocks' least ones
    what lies between; that last block is then asked.
    """
    mine = F.floor(F.col("i") / BLOCK).alias("block")
    samples = series.select(F.col("series_id").cast("string"), mine, F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))
    marked = samples.join(peaks.select(F.col("series_id").cast("string"), F.col("i").cast("long").alias("i"), F.lit(True).alias("peak")), ["series_id", "i"], "left")
    names = ["series_id", "block", "i", "v", "side", "low", "free"]

    def within(key, table):
        table = table.sort_by("i")
        v, at = table["v"].to_numpy(), table["i"].to_numpy()
        here = np.flatnonzero(table["peak"].is_valid().to_numpy())
        sides = [side_least(v), tuple(x[::-1] for x in side_least(v[::-1]))]
        told = [pa.array([key[0].as_py()] * (2 * len(here)), pa.string()), pa.array([key[1].as_py()] * (2 * len(here)), pa.int64()), pa.array(np.tile(at[here], 2))]
        told += [pa.array(np.tile(v[here], 2)), pa.array(np.repeat(np.array([0, 1], np.int32), len(here)))]
        told += [pa.array(np.concatenate([s[k][here] for s in sides])) for k in range(2)]
        return pa.table(told, names=names)

    found = written(marked.groupBy("series_id", "block").applyInArrow(within, "series_id string, block long, i long, v double, side int, low double, free boolean"), "sides")
    bounds = written(samples.groupBy("series_id", "block").agg(F.max("v").alias("most"), F.min("v").alias("least")), "block-bounds")
    leaving = found.filter("free")
    asking = leaving.select("series_id", F.col("block").alias("of")).distinct()
    others = bounds.join(asking, "series_id").filter("block <> of").withColumnRenamed("of", "asks")

    def across(key, sides, blocks):
        own = key[1].as_py()
        blocks = blocks.sort_by("block")
        number, most, least = (blocks[c].to_numpy() for c in ("block", "most", "least"))
        v, side, low = (sides[c].to_numpy() for c in ("v", "side", "low"))
        low, target = low.copy(), np.full(len(v), -1)
        for k, some in enumerate((np.flatnonzero(number < own)[::-1], np.flatnonzero(number > own))):
            mine = np.flatnonzero(side == k)
            if len(some) and len(mine):
                n = np.searchsorted(np.maximum.accumulate(most[some]), v[mine], side="right")  # blocks that nothing in exceeds v
                lows = np.minimum.accumulate(np.concatenate([[np.inf], least[some]]))
                low[mine] = np.minimum(low[mine], lows[n])
                target[mine] = np.where(n < len(some), number[some[np.minimum(n, len(some) - 1)]], -1)
        told = {"series_id": sides["series_id"], "i": sides["i"], "v": sides["v"], "side": sides["side"], "low": pa.array(low), "target": pa.array(target)}
        return pa.table(told)

    schema = "series_id string, i long, v double, side int, low double, target long"
    gone = leaving.groupBy("series_id", "block").cogroup(others.groupBy("series_id", "asks")).applyInArrow(across, schema)
    gone = written(gone, "sides-across")
    asked = gone.filter("target >= 0").withColumnRenamed("target", "block")

    def inside(key, sides, table):
        if not sides.num_rows:
            return pa.table({"series_id": pa.array([], pa.string()), "i": pa.array([], pa.int64()), "v": pa.array([], pa.float64()), "low": pa.array([], pa.float64())})
        values = table.sort_by("i")["v"].to_numpy()
        v, side, low = (sides[c].to_numpy() for c in ("v", "side", "low"))
        told = low.copy()
        for k, run in enumerate((values[::-1], values)):  # from the side that the peak lies on
            n = np.searchsorted(np.maximum.accumulate(run), v, side="right")
            told = np.where(side == k, np.minimum(told, np.minimum.accumulate(np.concatenate([[np.inf], run]))[n]), told)
        return pa.table({"series_id": sides["series_id"], "i": sides["i"], "v": sides["v"], "low": pa.array(told)})

    ended = asked.groupBy("series_id", "block").cogroup(samples.groupBy("series_id", "block")).applyInArrow(inside, "series_id string, i long, v double, low double")
    columns = ["series_id", "i", "v", "low"]
    sides = found.filter("NOT free").select(columns).unionByName(gone.filter("target < 0").select(columns)).unionByName(ended)
    return sides.groupBy("series_id", "i").agg(F.first("v").alias("v"), (F.first("v") - F.max("low")).alias("prominence"))


def find_peaks(series: DataFrame, height: float | None = None, distance: int = 1, prominence: float | None = None) -> DataFrame:
    """Maxima, then height, distance, prominence, in this order; null switches a test off."""
    peaks = local_maxima(series)
    if height is not None:
        peaks = peaks.filter(F.col("v") >= height)
    peaks = prominences(far_apart(peaks, distance), series)
    return peaks if prominence is None else peaks.filter(F.col("prominence") >= prominence)


def unit_sizes(peaks: DataFrame, share: float = 0.2) -> DataFrame:
    """series_id, unit: the mean of the smallest ``share`` of the gaps, one at least."""
    gaps = peaks.select("series_id", (F.col("i") - F.lag("i").over(_ordered())).cast("double").alias("gap")).filter("gap IS NOT NULL")
    ranked = gaps.withColumn("rank", F.row_number().over(_by().orderBy("gap"))).withColumn("n", F.count("*").over(_by()))
    few = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return ranked.filter(F.col("rank") <= few).groupBy("series_id").agg(F.avg("gap").alias("unit"))


def group_peaks(peaks: DataFrame, units: DataFrame, factor: float = 1.5) -> DataFrame:
    """Adds group: a gap over ``factor`` units begins a new one."""
    gap = F.col("i") - F.lag("i").over(_ordered())
    new = F.coalesce((gap > factor * F.col("unit")).cast("int"), F.lit(0))
    return peaks.join(units, "series_id").withColumn("new", new).withColumn("group", F.sum("new").over(_ordered())).drop("new")


def best_five(groups: DataFrame, lines: int = 5) -> DataFrame:
    """Of each group with at least five peaks the stronger of its first and last five, the first on ties."""
    by = Window.partitionBy("series_id", "group")
    ranked = groups.withColumn("up", F.row_number().over(by.orderBy("i"))).withColumn("down", F.row_number().over(by.orderBy(F.desc("i"))))
    head = F.sum(F.when(F.col("up") <= lines, F.col("v"))).over(by)
    tail = F.sum(F.when(F.col("down") <= lines, F.col("v"))).over(by)
    ranked = ranked.withColumn("first_wins", head >= tail).withColumn("n", F.count("*").over(by))
    mine = F.when(F.col("first_wins"), F.col("up") <= lines).otherwise(F.col("down") <= lines)
    return ranked.filter(mine & (F.col("n") >= lines)).drop("up", "down", "first_wins", "n")


def five_line_groups(series: DataFrame, height=0.8, distance=8, prominence=1.0, most=15.0) -> DataFrame:
    """series_id, staff, line (1 at the largest i), i, v, prominence, unit: the whole chain on a dense series."""
    z = z_scores(series)
    peaks = find_peaks(z, height, distance, prominence).filter(F.col("v") <= most)
    enough = peaks.groupBy("series_id").agg(F.count("*").alias("n")).filter("n >= 5").select("series_id")
    peaks = peaks.join(enough, "series_id", "left_semi")
    five = best_five(group_peaks(peaks, unit_sizes(peaks)))
    by = Window.partitionBy("series_id", "group").orderBy(F.desc("i"))
    staff = F.dense_rank().over(_by().orderBy("group"))
    return five.select("series_id", staff.alias("staff"), F.row_number().over(by).alias("line"), "i", "v", "prominence", "unit")


def assign_pixels(lines: DataFrame, pixels: DataFrame, zone_left: int) -> DataFrame:
    """series_id, staff, position, n, x and y ranges, centres and slope of each of five lines.

    ``lines`` has (series_id, staff, i, unit), ``pixels`` (series_id, x, y).  A
    pixel goes to the nearest of a staff's centres, the smaller on ties, if it
    is no farther than max(1, half a unit rounded).  A line without pixels
    stands at its centre; FIRST is the lowest on the page.
    """
    centres = lines.groupBy("series_id", "staff").agg(
        F.array_sort(F.collect_list("i")).alias("centres"), F.greatest(F.lit(1), F.floor(F.first("unit") / 2 + 0.5)).alias("gap")
    )
    rows = pixels.select("series_id", "y").distinct().join(centres, "series_id")
    near = F.array_min(F.transform("centres", lambda c, k: F.struct(F.abs(F.col("y") - c).alias("d"), k.alias("k"))))
    rows = rows.withColumn("near", near).filter("near.d <= gap").select("series_id", "staff", "y", F.col("near.k").alias("k"))
    hits = pixels.join(rows, ["series_id", "y"])
    hits = hits.groupBy("series_id", "staff", "k").agg(
        F.count("*").alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.avg("x").alias("x_centre"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.avg("y").alias("y_centre"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"),
    )
    every = centres.select("series_id", "staff", F.posexplode("centres").alias("k", "centre"))
    full = every.join(hits, ["series_id", "staff", "k"], "left")
    left = F.lit(zone_left).cast("long")
    full = full.select(
        "series_id", "staff", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("x_min", left).alias("x_min"), F.coalesce("x_max", left).alias("x_max"),
        F.coalesce("x_centre", left.cast("double")).alias("x_centre"), F.coalesce("y_min", "centre").alias("y_min"),
        F.coalesce("y_max", "centre").alias("y_max"), F.coalesce("y_centre", F.col("centre").cast("double")).alias("y_centre"),
        F.coalesce("slope", F.lit(0.0)).alias("slope"),
    )
    rank = F.row_number().over(Window.partitionBy("series_id", "staff").orderBy(F.desc("y_centre")))
    names = F.array(*[F.lit(x) for x in ("FIRST", "SECOND", "THIRD", "FOURTH", "FIFTH")])
    return full.withColumn("position", F.element_at(names, rank))


def staff_sizes(lines: DataFrame) -> DataFrame:
    """series_id, staff, y_centre, unit_size (mean gap of neighbouring lines); raises unless there are five lines."""
    grouped = lines.groupBy("series_id", "staff").agg(
        F.avg("y_centre").alias("y_centre"), ((F.max("y_centre") - F.min("y_centre")) / 4).alias("unit_size"), F.count("*").alias("n")
    )
    ok = F.assert_true(F.col("n") == 5, F.lit("a staff has five lines")).isNull()
    return grouped.filter(ok).drop("n")
