"""Joins of pages: rows that are exploded, or come from Python or small files, are never broadcast through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.operators import dewarp, raster, recognition, tiles
from pagegrain.plans import registry
from pagegrain.sources import standins
from pagegrain.sources.shared import written


def through_driver(df) -> list[str]:
    return [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Broadcast" in x]


def known(spark, sql, schema):
    """A table whose few bytes Spark knows, as it does those of files."""
    return written(spark.sql(f"SELECT * FROM VALUES {sql}").toDF(*[x.split()[0] for x in schema.split(", ")]).selectExpr(*[f"CAST({n} AS {k}) AS {n}" for n, k in (x.split() for x in schema.split(", "))]), "known")


@pytest.fixture(scope="module")
def page(spark):
    """Boxes, bands and size of a page with one line."""
    boxes = known(spark, "('p', 0, 0, 4, 11, 6), ('p', 1, 11, 4, 22, 6)", "page_id string, id int, left bigint, top bigint, right bigint, bottom bigint")
    sizes = known(spark, "('p', 22, 12)", "page_id string, width bigint, height bigint")
    bands = written(raster.bands(spark.range(22).selectExpr("'p' AS page_id", "4L AS y", "id AS x"), sizes), "bands")
    return boxes, sizes, bands


def test_regions_of_pixels_stay_on_executors(spark):
    pixels = known(spark, "('p', 0, 1), ('p', 1, 1), ('p', 3, 5)", "page_id string, y bigint, x bigint")
    regions = dewarp.pixel_regions(pixels)
    assert not through_driver(regions)
    assert sorted(map(tuple, regions.collect())) == [("p", 0, 1, 1), ("p", 1, 1, 1), ("p", 3, 5, 2)]


def test_bridged_boxes_stay_on_executors(page):
    boxes, sizes, _ = page
    groups = written(dewarp.grouped(boxes), "groups")
    told = dewarp.bridge(boxes, groups, sizes)
    assert not through_driver(told)
    assert sorted(r["id"] for r in told.collect()) == [0, 1]


def test_groups_stay_on_executors(page):
    groups = dewarp.grouped(page[0])
    assert not through_driver(groups)
    assert [r["grid_ids"] for r in groups.collect()] == [[0, 1]]


def test_strips_of_pages_of_several_widths(spark):
    """Strips are cut in Python, a run of equally wide rows at a time."""
    rows = [("a", 0, [1] * 11 + [0] * 3 + [1] * 3), ("a", 1, [1] * 11 + [1] * 6), ("b", 0, [0, 1, 1, 1, 1, 1, 1]), ("c", 0, [])]
    grids = raster.strip_grids(spark.createDataFrame(rows, "page_id string, y long, data array<int>"))
    assert sorted(map(tuple, grids.collect())) == [("a", 0, 0, 0, 11, 2), ("a", 1, 11, 1, 17, 2), ("b", 0, 0, 0, 7, 1)]


def test_a_pixel_outside_its_page_raises(spark):
    pixels = spark.createDataFrame([("p", 0, 4)], "page_id string, y long, x long")
    sizes = spark.createDataFrame([("p", 4, 1)], "page_id string, width long, height long")
    with pytest.raises(Exception, match="a pixel lies outside its page"):
        raster.bands(pixels, sizes).collect()


def test_geometry_stays_on_executors(page):
    boxes, sizes, _ = page
    groups = dewarp.grouped(boxes)
    told = dewarp.page_geometry(boxes, groups, sizes)
    assert not through_driver(told)
    assert [tuple(r) for r in told.collect()] == [("p", 2, 1, True)]


def test_control_points_stay_on_executors(page):
    boxes, sizes, _ = page
    regions = written(dewarp.box_regions(boxes), "regions")
    points = raster.control_points(dewarp.region_columns(boxes, regions, sizes), sizes)
    assert not through_driver(points)
    assert points.filter("target_row = 5").count() == 3


def test_row_maps_stay_on_executors(spark, page):
    points = known(spark, "('p', 0, 0, 0), ('p', 5, 3, 6), ('p', 11, 0, 11)", "page_id string, target_row bigint, column bigint, source_row bigint")
    rows = dewarp.row_map(points, page[1])
    assert not through_driver(rows)
    assert rows.filter("y = 5").first()["source"] == [6.0] * 22


def _ink(channels):
    return lambda: lambda pixels: np.eye(channels, dtype=np.float32)[(pixels[..., 0] > 0) * (channels - 2)]


def test_scored_pages_stay_on_executors_and_tiles_are_scored_once(page):
    _, sizes, bands = page
    masks = tiles.score_pages(bands, sizes, {"staff_and_symbols": _ink(3), "symbol_detail": _ink(4)})
    assert not through_driver(masks)
    plan = masks._jdf.queryExecution().optimizedPlan().toString()
    # for each model tiles are cut and merged, scored and classified: no second scoring that finds how far tiles reach
    assert (plan.count("FlatMapGroupsInArrow"), plan.count("MapInArrow")) == (4, 4)
    assert masks.filter("exists(staff, v -> v)").select("y").collect() == [(4,)]


def test_a_page_without_bands_has_no_masks(spark, page):
    _, sizes, bands = page
    more = sizes.unionByName(known(spark, "('q', 22, 12)", "page_id string, width bigint, height bigint"))
    masks = tiles.score_pages(bands, more, {"staff_and_symbols": _ink(3), "symbol_detail": _ink(4)})
    assert [tuple(r) for r in masks.groupBy("page_id").count().collect()] == [("p", 12)]


def test_tiles_are_cut_on_executors_and_scored_a_few_at_a_time(spark, page):
    _, sizes, bands = page
    pages = sizes.selectExpr("*", "256L AS window", "'staff_and_symbols' AS model")
    cut = tiles.cut_tiles(bands, pages)
    assert not through_driver(cut)

    def make():
        def run(pixels):
            if len(pixels) > tiles.SCORED_TILES:
                raise ValueError("too many tiles at a time")
            return np.zeros((*pixels.shape[:3], 3), np.float32)

        return run

    many = written(cut.withColumn("tile_seq", F.explode(F.sequence(F.lit(0), F.lit(19)))).coalesce(1), "tiles")
    assert tiles.score_tiles(many, make, 3).count() == 80
    good, _ = recognition.score_runs(bands, sizes, "staff_and_symbols", make)
    assert good.count() == 4


def test_remapped_rows_stay_on_executors(page):
    _, sizes, bands = page
    layers = bands.selectExpr("page_id", "'staff' AS layer", "y", "data")
    rows = written(sizes.selectExpr("page_id", "explode(sequence(0L, height - 1)) AS y").selectExpr("page_id", "y", "array_repeat(CAST(y + 1 AS DOUBLE), 22) AS source"), "rows")
    out = dewarp.remap_bands(layers, rows, sizes)
    assert not through_driver(out)
    assert out.filter("exists(data, v -> v > 0)").select("y").collect() == [(3,)]
    level = dewarp.straighten(layers, sizes)
    assert level.filter("NOT was_dewarped").isEmpty() and level.count() == 12


def test_resized_rows_stay_on_executors(page):
    _, sizes, bands = page
    out = dewarp.resize_bands(bands, sizes.selectExpr("*", "11L AS new_width", "6L AS new_height", "1 AS depth"))
    assert not through_driver(out)
    assert out.count() == 6 and out.filter("size(data) = 11").count() == 6


def test_rows_of_images_stay_on_executors(spark):
    folder = "/root/testdata/sf0.001"
    assert not [x for x in through_driver(standins.images(spark, folder)) if "Join" in x]
    assert not [x for x in through_driver(registry.image_planes(spark, folder)) if "Join" in x]


def test_aligned_rows_and_planes_stay_on_executors(spark, page):
    _, sizes, bands = page
    grown = tiles.align_bands(bands, F.lit(24).cast("long"), F.lit(13).cast("long"))
    assert not through_driver(grown)
    assert grown.filter("size(data) = 24").count() == 13
    depths = known(spark, "('p', 2)", "page_id string, depth int")
    assert not through_driver(tiles.planes(bands, depths))


def test_batches_to_workers_are_bounded(spark, page):
    raster.spread(page[1], "page_id")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(5 << 20)
