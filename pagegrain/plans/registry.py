"""The library's queries over the given tables, by operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dewarp as W
from ..operators import geometry as G
from ..operators import library as L
from ..operators import recognition as C
from ..operators import raster as R
from ..operators import series as Z
from ..operators import tiles as T
from ..sources import imports as I
from ..sources import standins as D
from ..sources.shared import by_merge, shared_folder, written
from .page_oracles import SMALL_AREA

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(column, digits=4):
    return F.round(column, digits) + F.lit(0.0)


# library


@query
def lib_get_all(spark, d):
    scores = L.placed(D.library(spark, d), L.newest(), "page_count")
    return L.newest_first(scores).select("id", "title", "import_date", "is_favorite", "place")


@query
def lib_domain(spark, d):
    return L.to_domain(L.to_entity(L.to_domain(D.library(spark, d)))).drop("musicXmlPath", "notes")


@query
def lib_by_id(spark, d):
    return L.by_id(D.library(spark, d), 42).select("id", "title", "page_count")


@query
def lib_favorites(spark, d):
    return L.favorites(L.placed(D.library(spark, d), L.view_order("DATE_IMPORTED"), "page_count")).select("id", "title", "place")


@query
def lib_search_name(spark, d):
    found = L.library_view(D.library(spark, d), "A", "NAME")
    return L.placed(found, L.view_order("NAME"), "page_count").select("id", "title", "is_favorite", "place")


@query
def lib_search_recent(spark, d):
    found = L.library_view(D.library(spark, d), " ", "RECENTLY_PRACTICED")
    return L.placed(found, L.view_order("RECENTLY_PRACTICED"), "page_count").select("id", "last_opened_date", "place")


@query
def lib_empty(spark, d):
    return L.library_is_empty(D.library(spark, d))


@query
def lib_updates(spark, d):
    s = D.library(spark, d)
    s = L.set_last_opened(s, 3, 1700000000000)
    s = L.set_last_viewed_page(s, 3, 7)
    s = L.set_last_viewed_zoom(s, 4, 2.5)
    s = L.set_practice_progress(s, 5, 0.5)
    s = L.set_music_xml_path(s, 6, "x.musicxml")
    s = L.rename(L.rename(L.toggle_favorite(s, 7), 8, "  New name "), 9, "   ")
    return s.select("id", "title", "last_opened_date", "last_viewed_page", F.col("last_viewed_zoom").cast("double").alias("zoom"),
                    F.col("practice_progress").cast("double").alias("progress"), "music_xml_path", "is_favorite")


@query
def lib_replace_delete(spark, d):
    s = D.library(spark, d)
    rows = s.filter("id % 10 = 0").withColumn("title", F.upper("title"))
    return L.delete_rows(L.replace_rows(s, rows), s.filter("id % 3 = 0")).select("id", "title")


@query
def lib_inserts(spark, d):
    """Every tenth score once more without an id, and as many with ids of their own."""
    s = D.library(spark, d)
    some = s.filter("id % 10 = 0").withColumn("title", F.concat("title", F.lit(" "), F.col("id").cast("string")))
    rows = some.withColumn("id", F.lit(0).cast("long")).unionByName(some.withColumn("id", -F.col("id") - 1))
    return L.insert_rows(s, rows).select("id", "title")


@query
def lib_changed_views(spark, d):
    s = D.library(spark, d)
    wanted = s.select("id", (F.col("id") % 3).cast("int").alias("page"), F.lit(1.0).cast("float").alias("zoom"))
    return L.changed_views(s, wanted).select("id", "page")


@query
def import_outcomes(spark, d):
    files = D.table(spark, d, "pages").select(
        F.col("page_id").alias("file_id"), F.element_at(F.split(F.regexp_replace("url", r"[?#].*$", ""), "/"), 4).alias("lang"), "html"
    )
    kind = F.when(F.col("file_id") % 3 == 0, ".PDF").when(F.col("file_id") % 3 == 1, ".jpg").otherwise(".txt")
    number = F.when(F.col("file_id") % 7 == 0, F.concat(F.lit(" ("), F.col("file_id") % 4, F.lit(")"))).otherwise("")
    path = F.concat(F.lit("in/"), F.coalesce("lang", F.lit("x")), number, kind)
    content = F.encode(F.concat(F.repeat(F.lit("/Type /Page "), (F.col("file_id") % 4).cast("int")), "html"), "UTF-8")
    files = files.select("file_id", path.alias("path"), F.when(F.col("file_id") % 5 == 0, "image/png").alias("mime"), content.alias("content"))
    taken = files.filter("file_id % 50 = 0").select(F.explode(F.array(F.lit("en.PDF"), F.lit("en (2).PDF"), F.lit("de (1).jpg"))).alias("file")).distinct()
    return I.plan_imports(files, taken, 1700000000000).select("file_id", "status", "title", "original_file_path", "page_count")


@query
def name_functions(spark, d):
    docs = D.table(spark, d, "documents")
    name = F.concat("source", F.lit(":a/b."), F.col("lang"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(".Pdf"))
    named = docs.select("doc_id", name.alias("name"))
    base, suffix = S.split_name(F.col("name"))
    return named.select("doc_id", S.sanitised(F.col("name")).alias("clean"), S.extension(F.col("name")).alias("ext"), S.stem(F.col("name")).alias("stem"),
                        S.display_name(F.col("name")).alias("display"), base.alias("base"), suffix.alias("suffix"))


# series


def _series(spark, d):
    return Z.dense(D.sparse_series(spark, d))


@query
def series_density(spark, d):
    return _series(spark, d)


@query
def series_z_scores(spark, d):
    return Z.z_scores(_series(spark, d)).select("series_id", "i", _r("v").alias("v"))


@query
def series_maxima(spark, d):
    return Z.local_maxima(_series(spark, d))


@query
def series_far_apart(spark, d):
    return Z.far_apart(Z.local_maxima(_series(spark, d)), 8)


@query
def series_prominence(spark, d):
    s = _series(spark, d)
    return Z.prominences(Z.local_maxima(s), s)


@query
def series_find_peaks(spark, d):
    return Z.find_peaks(Z.z_scores(_series(spark, d)), 0.8, 8, 1.0).select("series_id", "i", _r("v").alias("v"), _r("prominence").alias("prominence"))


@query
def series_groups(spark, d):
    p = Z.find_peaks(Z.z_scores(_series(spark, d)), 0.8, 8, 1.0)
    return Z.group_peaks(p, Z.unit_sizes(p)).select("series_id", "i", _r("unit").alias("unit"), "group")


@query
def flagship_lines(spark, d):
    found = Z.five_line_groups(_series(spark, d))
    return found.select("series_id", "staff", "line", "i", _r("v").alias("v"), _r("prominence").alias("prominence"), _r("unit").alias("unit"))


def _pixels(spark, d):
    lines = D.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("series_id"), D._day("l_shipdate").alias("y"), (F.col("l_orderkey") % 500).alias("x"))
    return lines.distinct()


@query
def staff_lines(spark, d):
    found = Z.assign_pixels(Z.five_line_groups(_series(spark, d)).select("series_id", "staff", "i", "unit"), _pixels(spark, d), 0)
    return found.select("series_id", "staff", "position", "n", "x_min", "x_max", _r("x_centre").alias("x_centre"), "y_min", "y_max",
                        _r("y_centre").alias("y_centre"), _r("slope", 6).alias("slope"))


@query
def staff_sizes(spark, d):
    found = Z.assign_pixels(Z.five_line_groups(_series(spark, d)).select("series_id", "staff", "i", "unit"), _pixels(spark, d), 0)
    return Z.staff_sizes(found).select("series_id", "staff", _r("y_centre").alias("y_centre"), _r("unit_size").alias("unit_size"))


@query
def zone_lines(spark, d):
    """The flagship chain from a mask and a zone: columns 100 to 619 of each page."""
    zones = D.staff_sizes(spark, d).select("page_id", F.lit(100).cast("long").alias("zone_left"), F.lit(620).cast("long").alias("zone_right"), "width", "height")
    pixels = Z.in_zone(D.staff_pixels(spark, d), zones)
    found = Z.five_line_groups(Z.zone_density(pixels, zones)).select("series_id", "staff", "i", "unit")
    found = Z.assign_pixels(found, pixels.select(F.col("page_id").alias("series_id"), "y", "x"), 100)
    return found.select("series_id", "staff", "position", "n", "x_min", "x_max", _r("x_centre").alias("x_centre"), "y_min", "y_max",
                        _r("y_centre").alias("y_centre"), _r("slope", 6).alias("slope"))


# tiles


@query
def tile_origins(spark, d):
    part = D.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("page_id"), (F.col("p_partkey") % 500 + 288).alias("width"), (F.col("p_size") * 7 + 288).cast("long").alias("height")
    )
    pages = part.select("*", F.explode(F.array(*[F.lit(m["window"]) for m in T.MODELS.values()])).alias("window"))
    return T.origins(pages)


@query
def target_sizes(spark, d):
    w, h = S.target_size((F.col("p_partkey") % 5000 + 1).cast("long"), (F.col("p_size") * 61).cast("long"))
    return D.table(spark, d, "part").select("p_partkey", w.alias("width"), h.alias("height"))


@query
def merge_overlap(spark, d):
    return T.pixel_values(T.merge_tiles(D.tiles(spark, d))).select("page_id", "y", "x", "channel", _r("v", 5).alias("v"))


@query
def page_extents(spark, d):
    return T.page_extent(D.tiles(spark, d))


@query
def class_masks(spark, d):
    merged = T.merge_tiles(D.tiles(spark, d))
    return T.mask_pixels(T.class_masks(T.classes(T.first_channels(merged, 3)), T.classes(merged)))


def _ink_scorer(channels):
    """Stands in for a model: ink is class 1 (of three channels) or 2 (of four), all else background."""

    def make():
        import numpy as np

        return lambda pixels: np.eye(channels, dtype=np.float32)[(pixels[..., 0] > 0) * (channels - 2)]

    return make


def _dark_scorer(channels):
    """Stands in for a model: dark is class 1 (of three channels) or 2 (of four), all else background."""

    def make():
        import numpy as np

        return lambda pixels: np.eye(channels, dtype=np.float32)[(pixels[..., 0] < 128) * (channels - 2)]

    return make


@query
def scored_pages(spark, d):
    """Pages cut into tiles, scored, merged and turned into masks."""
    sizes = D.staff_sizes(spark, d)
    masks = T.score_pages(written(_bands(spark, d), "bands"), sizes, {name: _ink_scorer(m["channels"]) for name, m in T.MODELS.items()})
    return T.mask_pixels(masks).filter("staff OR noteheads OR symbols OR stems_rests OR clefs_keys")


@query
def align_bands(spark, d):
    bands = D.table(spark, d, "embeddings").select(
        F.expr("CAST(vec_id div 100 AS STRING)").alias("page_id"), F.expr("vec_id % 100").alias("y"), F.col("embedding").alias("data")
    )
    grown = T.align_bands(bands, F.lit(67).cast("long"), F.lit(103).cast("long"))
    return grown.select("page_id", "y", F.posexplode("data").alias("x", "v")).select("page_id", "y", "x", _r(F.col("v").cast("double"), 5).alias("v"))


# raster


def _bands(spark, d):
    return R.bands(D.staff_pixels(spark, d), D.staff_sizes(spark, d))


def _grids(spark, d):
    return R.strip_grids(R.thicken(_bands(spark, d)))


@query
def raster_dilate(spark, d):
    return R.pixels(R.morphology(_bands(spark, d), "y", "dilate"))


@query
def raster_thicken(spark, d):
    return R.pixels(R.thicken(_bands(spark, d)))


@query
def raster_grids(spark, d):
    return _grids(spark, d)


@query
def raster_regions(spark, d):
    return W.pixel_regions(D.raster(spark, d))


@query
def raster_groups(spark, d):
    groups = W.grouped(written(_grids(spark, d), "grids"))
    return groups.select("page_id", "id", "left", "top", "right", "bottom", F.array_join("grid_ids", ",").alias("grid_ids"))


@query
def page_geometry(spark, d):
    grids = written(_grids(spark, d), "grids")
    return W.page_geometry(grids, W.grouped(grids), D.staff_sizes(spark, d))


@query
def raster_bridges(spark, d):
    """All boxes after bridging, on pages whose gaps SQL can follow."""
    sizes = D.gapped_sizes(spark, d)
    grids = written(R.strip_grids(R.thicken(R.bands(D.gapped_lines(spark, d), sizes))), "grids")
    most = grids.groupBy("page_id").agg(F.max("id").alias("most"))
    boxes = by_merge(W.bridge(grids, W.grouped(grids), sizes), most, ["page_id"])
    return boxes.select("page_id", "left", "top", "right", "bottom", "owner", (F.col("id") > F.col("most")).alias("fills"))


@query
def raster_majority(spark, d):
    labels = D.raster(spark, d).select("page_id", F.expr("y div 10").alias("block"), (F.col("x") % 7).alias("label"))
    return R.majority(labels, ["page_id", "block"], "label")


@query
def raster_majority_where(spark, d):
    """As above among the even labels; null where a block has none."""
    labels = D.raster(spark, d).select("page_id", F.expr("y div 10").alias("block"), (F.col("x") % 7).alias("label"))
    return R.majority(labels, ["page_id", "block"], "label", F.col("label") % 2 == 0)


def _points(spark, d):
    grids = written(_grids(spark, d), "grids")
    sizes = D.staff_sizes(spark, d)
    return R.control_points(W.region_columns(grids, W.box_regions(grids), sizes), sizes)


@query
def mapping_points(spark, d):
    return _points(spark, d)


@query
def row_maps(spark, d):
    """The fractional source row of every column of every row of a page, from control points."""
    rows = W.row_map(_points(spark, d), D.staff_sizes(spark, d))
    # outer: else Spark computes the values anew to filter out empty rows, of which there are none
    cells = rows.select("page_id", "y", F.posexplode_outer("source").alias("x", "v"))
    # many values lie on a half of the fourth digit: they are rounded after the product, as SQL does, not by their decimal digits
    return cells.select("page_id", "y", "x", (S.half_up(F.col("v") * 10000) / 10000).alias("v"))


# images


@query
def image_planes(spark, d):
    """The planes of images of bytes: width and sum of each row and channel."""
    planes = T.channel_planes(D.images(spark, d))
    total = F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v)
    return planes.select("page_id", "channel", "y", F.size("data").cast("long").alias("width"), total.alias("total"))


def _image_pages(spark, d):
    images = written(D.images(spark, d), "images")
    return T.image_bands(images), images.select("page_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.lit(3).alias("depth"))


@query
def canonical_pages(spark, d):
    """Images in canonical size (of a smaller area than the models'): sums of each row's channels."""
    bands, _ = C.canonical(*_image_pages(spark, d), *SMALL_AREA)
    sums = [F.expr(f"aggregate(filter(data, (v, i) -> i % 3 = {c}), 0L, (a, v) -> a + v)").alias(f"c{c}") for c in range(3)]
    dark = F.expr("CAST(size(filter(data, (v, i) -> i % 3 = 0 AND v < 128)) AS BIGINT)").alias("dark")
    return bands.select("page_id", "y", F.expr("CAST(size(data) div 3 AS BIGINT)").alias("width"), *sums, dark)


@query
def recognized_pages(spark, d):
    """The whole chain from images to level layers: sums of each row."""
    out = C.recognize(*_image_pages(spark, d), {name: _dark_scorer(m["channels"]) for name, m in T.MODELS.items()}, *SMALL_AREA)
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    return out.select("page_id", "layer", "y", F.floor(total + 0.37).alias("total"), "was_dewarped")


# geometry


@query
def line_fits(spark, d):
    points = D.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    flat = points.select("l_returnflag", F.lit("flat").alias("l_linestatus"), F.lit(5.0).alias("x"), "y")
    fitted = G.fit_lines(points.unionByName(flat), ["l_returnflag", "l_linestatus"])
    return fitted.select("l_returnflag", "l_linestatus", _r("slope", 3).alias("slope"), _r("intercept", 2).alias("intercept"), "n")


@query
def interpolated_series(spark, d):
    sparse = D.sparse_series(spark, d).filter("i % 7 = 0")
    spans = D.sparse_series(spark, d).groupBy("series_id").agg(F.max("i").alias("top"))
    return G.interpolate(sparse, ["series_id"], "i", "v", 0, spans).select("series_id", "i", _r("v").alias("v"))


def _remapped(bands, source):
    """Bands resampled by an expression of y for each column x of a row's 64."""
    sizes = bands.groupBy("page_id").agg((F.max("y") + 1).alias("height"))
    rows = bands.select("page_id", "y", F.expr(f"transform(sequence(0, 63), x -> CAST({source} AS DOUBLE))").alias("source"))
    return W.remap_bands(bands, rows, sizes).select("page_id", "y", F.posexplode("data").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


@query
def cubic_remap(spark, d):
    return _remapped(D.vector_bands(spark, d), "y + x % 8 * 0.25D - 1.5D").select("page_id", "y", "x", _r("v", 4).alias("v"))


@query
def remap_mask(spark, d):
    masks = D.vector_bands(spark, d).withColumn("data", F.transform("data", lambda v: (v > 0).cast("double")))
    return _remapped(masks, "y + 0.5D").select("page_id", "y", "x", (F.round("v", 9) > 0).alias("on"))


@query
def straightened_pages(spark, d):
    """The chain from a staff mask to a level one, on pages whose gaps SQL can follow."""
    sizes = D.gapped_sizes(spark, d)
    bands = R.bands(D.gapped_lines(spark, d), sizes).select("page_id", F.lit("staff").alias("layer"), "y", F.col("data").cast("array<double>").alias("data"))
    out = W.straighten(written(bands, "layers"), sizes)
    return out.select("page_id", "layer", "y", F.expr("CAST(aggregate(data, 0D, (a, v) -> a + v) AS BIGINT)").alias("on_pixels"), "was_dewarped")


# live views


@query
def snapshot_changes(spark, d):
    from ..streaming import views as V

    e = D.table(spark, d, "events").select("event_id", "user_id", "event_type")
    return V.changes(e, ["user_id"], ["event_id"], "event_type")


@query
def stream_changes(spark, d):
    """Changes of each user's event type by a stateful stream; the events come in three parts, and the stream stops between them."""
    from ..streaming import views as V

    e = D.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("long").alias("seq"), F.col("event_type").alias("value"))
    low, high = e.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    folder = f"{shared_folder(spark)}/pagegrain/stream-{uuid.uuid4().hex}"
    bounds = [low - 1, low + (high - low) // 3, low + 2 * (high - low) // 3, high]
    for after, upto in zip(bounds, bounds[1:]):
        e.filter((F.col("seq") > after) & (F.col("seq") <= upto)).write.mode("append").parquet(f"{folder}/in")
        V.follow_changes(spark, f"{folder}/in", f"{folder}/out", f"{folder}/check")
    out = spark.read.schema("key string, seq long, value string").parquet(f"{folder}/out")
    return out.select(F.col("key").alias("user"), F.col("seq").alias("event_id"), F.col("value").alias("event_type"))


def _least_ink_scorer(channels, least):
    """As ``_ink_scorer``, but a batch with a tile of less ink fails."""

    def make():
        scorer = _ink_scorer(channels)()

        def run(pixels):
            ink = (pixels[..., 0] > 0).sum((1, 2)).min()
            if ink < least:
                raise ValueError(f"{ink} pixels of ink are too few")
            return scorer(pixels)

        return run

    return make


@query
def scored_runs(spark, d):
    """State of each page's run of a scorer that fails on some pages, and how many tiles the others have."""
    good, states = C.score_runs(_bands(spark, d), D.staff_sizes(spark, d), "staff_and_symbols", _least_ink_scorer(3, 3090))
    return states.join(good.groupBy("page_id").agg(F.count("*").alias("n_tiles")), "page_id", "left")


@query
def run_state_counts(spark, d):
    from ..streaming import views as V

    orders = D.table(spark, d, "orders")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("ok"), F.lit(None).cast("string").alias("message"))
    return V.run_states(runs).groupBy("state").agg(F.count("*").alias("n"), F.count("message").alias("n_messages"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_lines(spark, sf_dir)
