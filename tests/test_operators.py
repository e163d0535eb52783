import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
import oracle
from pagegrain.operators import dewarp, geometry, raster, series, tiles
from pagegrain.operators import library as L
from pagegrain.sources import imports
from pagegrain.streaming import views

# Small inputs and what must come of them (peaks, grids, mappings, zones) are fixed values.
SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    assert oracle.compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], SF) == ""


def peaks(spark, values, **options):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "series_id string, i long, v double")
    return {r.i: r.prominence for r in series.find_peaks(df, **options).collect()}


def test_peaks(spark):
    assert peaks(spark, [0, 1, 0, 2, 0, 3, 0]) == {1: 1.0, 3: 2.0, 5: 3.0}
    assert set(peaks(spark, [0, 1, 2, 5, 5, 5, 2, 1, 0])) == {4}
    assert set(peaks(spark, [9, 1, 2, 1, 9])) == {2}
    assert set(peaks(spark, [0, 1, 3, 1, 2, 5, 1], distance=8)) == {5}


def page(spark, rows, height=None):
    """Bands of one page from rows of 0 and 1, and its size."""
    masks = spark.createDataFrame([("p", y, list(map(int, r))) for y, r in enumerate(rows)], "page_id string, y long, data array<int>")
    return masks, spark.createDataFrame([("p", len(rows[0]), len(rows))], "page_id string, width long, height long")


def lit(masks):
    return sorted((r.y, r.x) for r in raster.pixels(masks).collect())


def test_morphology(spark):
    dot, _ = page(spark, [[x == 5 for x in range(10)]])
    assert lit(raster.morphology(dot, "x", "dilate")) == [(0, x) for x in range(3, 9)]
    run, _ = page(spark, [[2 <= x <= 8 for x in range(10)]])
    assert lit(raster.morphology(run, "x", "erode")) == [(0, 5), (0, 6)]
    column, _ = page(spark, [[y == 5] for y in range(10)])
    assert lit(raster.morphology(column, "y", "dilate")) == [(y, 0) for y in range(3, 9)]
    off, _ = page(spark, [[0] * 12])
    assert lit(raster.morphology(off, "x", "dilate")) == []
    line, _ = page(spark, [[y == 1] * 20 for y in range(3)])
    assert lit(raster.thicken(line)) == [(y, x) for y in range(3) for x in range(20)]
    dots, sizes = page(spark, [[0] * 20] * 12)
    pixel = spark.createDataFrame([("p", 5, 5)], "page_id string, y long, x long")
    assert lit(raster.thicken(raster.bands(pixel, sizes))) == []
    assert lit(raster.bands(pixel, sizes)) == [(5, 5)] and raster.bands(pixel, sizes).count() == 12


def grids_of(spark, rows):
    grids = raster.strip_grids(page(spark, rows)[0])
    return grids, sorted(tuple(r)[1:] for r in grids.collect())


def test_grids_and_groups(spark):
    grids, told = grids_of(spark, [[y < 3] * 22 for y in range(5)])
    assert told == [(0, 0, 0, 11, 3), (1, 11, 0, 22, 3)]
    groups = raster.region_groups(raster.region_members(dewarp.box_regions(grids)), grids)
    assert [tuple(r)[1:] for r in groups.collect()] == [(0, 0, 0, 22, 3, [0, 1])]
    assert grids_of(spark, [[y < 13] * 11 for y in range(15)])[1] == []
    grids, _ = grids_of(spark, [[y < 3 or 10 <= y < 13] * 11 for y in range(20)])
    groups = raster.region_groups(raster.region_members(dewarp.box_regions(grids)), grids)
    assert sorted(r.grid_ids for r in groups.collect()) == [[0], [1]]


def test_regions_equal_a_flood_fill(spark):
    rng = np.random.default_rng(2)
    mask = rng.random((25, 40)) < 0.55
    want, number = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if not want[y, x]:
            number += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 25 and 0 <= b < 40 and mask[a, b] and not want[a, b]:
                    want[a, b] = number
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    spots = spark.createDataFrame([("p", int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "page_id string, y long, x long")
    got = {(r.y, r.x): r.region for r in dewarp.pixel_regions(spots).collect()}
    assert got == {(int(y), int(x)): want[y, x] for y, x in zip(*np.nonzero(mask))}


def test_mapping_and_row_map(spark):
    sizes = spark.createDataFrame([("p", 20, 10)], "page_id string, width long, height long")
    columns = spark.createDataFrame([("p", 1, x, 3, 12) for x in range(20)] + [("p", 2, x, 1, 7) for x in range(3)], "page_id string, region int, x long, n long, total long")
    points = {(r.target_row, r.column, r.source_row) for r in raster.control_points(columns, sizes).collect()}
    assert points == {(4, 0, 4), (4, 10, 4)} | {(y, x, y) for y in (0, 9) for x in range(20)}
    thin = spark.createDataFrame([("p", 0, 0, 0), ("p", 2, 0, 5), ("p", 4, 0, 4)], "page_id string, target_row long, column long, source_row long")
    tall = spark.createDataFrame([("p", 1, 5)], "page_id string, width long, height long")
    rows = dewarp.row_map(thin, tall).orderBy("y").collect()
    assert [r.source for r in rows] == [[0.0], [2.5], [5.0], [4.5], [4.0]]


def test_row_maps_have_every_column(spark):
    points, told = {}, {}
    for r in entry.queries()["mapping_points"](spark, SF).collect():
        line = points.setdefault(r.page_id, {}).setdefault(r.target_row, {})
        line[r.column] = max(line.get(r.column, -1), r.source_row)
    for r in entry.queries()["row_maps"](spark, SF).collect():
        told.setdefault(r.page_id, {})[r.y, r.x] = r.v
    assert told.keys() == points.keys() and points
    for page, lines in points.items():
        rows = sorted(lines)
        across = np.array([np.interp(range(720), *zip(*sorted(lines[k].items()))) for k in rows])
        want = np.array([np.interp(range(280), rows, column) for column in across.T]).T
        assert len(told[page]) == 280 * 720
        assert np.abs(np.array([[told[page][y, x] for x in range(720)] for y in range(280)]) - want).max() < 5.001e-5


def remapped(spark, plane, source):
    height, width = np.shape(plane)
    bands = spark.createDataFrame([("p", "v", y, list(map(float, r))) for y, r in enumerate(plane)], "page_id string, layer string, y long, data array<double>")
    rows = spark.createDataFrame([("p", y, list(map(float, r))) for y, r in enumerate(source)], "page_id string, y long, source array<double>")
    sizes = spark.createDataFrame([("p", width, height)], "page_id string, width long, height long")
    return [r.data for r in dewarp.remap_bands(bands, rows, sizes).orderBy("y").collect()]


def test_remap(spark):
    plane = np.arange(1.0, 9).reshape(4, 2)
    assert np.allclose(remapped(spark, plane, np.repeat(np.arange(4.0)[:, None], 2, 1)), plane)
    assert remapped(spark, plane, np.full((4, 2), -50.0)) == [[1.0, 2.0]] * 4
    rng = np.random.default_rng(3)
    plane, source = rng.random((7, 5)), rng.random((7, 5)) * 10 - 2
    weight = lambda t: (1.25 * t - 2.25) * t * t + 1 if t <= 1 else ((-0.75 * t + 3.75) * t - 6) * t + 3
    want = [[sum(weight(abs(k - (s - np.floor(s)))) * plane[int(np.clip(np.floor(s) + k, 0, 6)), x] for k in range(-1, 3)) for x, s in enumerate(row)] for row in source]
    assert np.allclose(remapped(spark, plane, source), want)


def test_bridge_fills_a_gap(spark):
    rows = [[15 <= y < 18 and (x < 33 or x >= 66) for x in range(132)] for y in range(40)]
    masks, sizes = page(spark, rows)
    grids = raster.strip_grids(masks)
    groups = raster.region_groups(raster.region_members(dewarp.box_regions(grids)), grids)
    boxes = dewarp.bridge(grids, groups, sizes)
    new = sorted((r.left, r.top, r.right, r.bottom) for r in boxes.collect() if r.id >= grids.count())
    assert groups.count() == 2 and new == [(x, 15, x + 11, 18) for x in (33, 44, 55)]
    regions = dewarp.box_regions(boxes)
    assert {r.region for r in regions.collect()} == {1}
    columns = dewarp.region_columns(boxes, regions, sizes).collect()
    assert len(columns) == 132 and {(r.n, r.total) for r in columns} == {(3, 15 + 16 + 17)}


def test_bridges_leave_alone(spark):
    for rows in ([[15 <= y < 18 and (x < 11 or x >= 121) for x in range(132)] for y in range(40)], [[15 <= y < 18] * 22 for y in range(40)]):
        masks, sizes = page(spark, rows)
        grids = raster.strip_grids(masks)
        assert dewarp.bridge(grids, dewarp.grouped(grids), sizes).count() == grids.count()


def test_straighten(spark):
    bands = lambda rows: [("staff", y, list(map(float, r))) for y, r in enumerate(rows)] + [("channel0", y, [1.0] * len(r)) for y, r in enumerate(rows)]
    pages = {"blank": [[0] * 30] * 20, "line": [[y == 15] * 60 for y in range(40)], "bent": [[y == 15 + x // 20 for x in range(60)] for y in range(40)]}
    layers = spark.createDataFrame([(p, *b) for p, rows in pages.items() for b in bands(rows)], "page_id string, layer string, y long, data array<double>")
    sizes = spark.createDataFrame([(p, len(rows[0]), len(rows)) for p, rows in pages.items()], "page_id string, width long, height long")
    out = {(r.page_id, r.layer, r.y): r for r in dewarp.straighten(layers, sizes).collect()}
    assert len(out) == 2 * sum(map(len, pages.values()))
    assert {p: {r.was_dewarped for (q, _, _), r in out.items() if q == p} for p in pages} == {"blank": {False}, "line": {True}, "bent": {True}}
    assert out["line", "staff", 15].data == [1.0] * 60
    assert all(np.allclose(r.data, 1) for (p, layer, _), r in out.items() if layer == "channel0")
    # grids reach from 13 to 18, 14 to 19 and 15 to 20: their rows' mean is row 16, where the map asks for rows 16, 17 and 18
    bent = layers.filter("page_id = 'bent' AND layer = 'staff'").select("page_id", "y", F.col("data").cast("array<int>").alias("data"))
    grids = raster.strip_grids(raster.thicken(bent))
    sizes = sizes.filter("page_id = 'bent'")
    points = raster.control_points(dewarp.region_columns(grids, dewarp.box_regions(grids), sizes), sizes)
    source = dewarp.row_map(points, sizes).filter("y = 16").first().source
    assert (source[0], source[30], source[50]) == (16, 17, 18)


def test_line_fit_needs_two_points(spark):
    one = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    with pytest.raises(Exception, match="two points"):
        geometry.fit_lines(one, ["k"]).collect()


def test_inserts_and_deletes(spark, tmp_path):
    row = lambda i, t: (i, t, f"file://{tmp_path}/{t}.pdf", None, 5, None, 1, False, 0, 1.0, 0.0, None)
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in L.SCHEMA])
    table = lambda *rows: spark.createDataFrame([row(*r) for r in rows], loose)
    scores = table((4, "d"), (7, "g"))
    got = L.insert_rows(scores, table((0, "b"), (None, "a"), (9, "i"), (0, "c")))
    assert {(r.id, r.title) for r in got.collect()} == {(4, "d"), (7, "g"), (9, "i"), (10, "a"), (11, "b"), (12, "c")}
    for rows in (table((7, "x")), table((8, "x"), (8, "y"))):
        with pytest.raises(Exception, match="this id exists"):
            L.insert_rows(scores, rows).collect()
    assert L.insert_rows(table(), table((0, "b"))).first().id == 1
    (tmp_path / "g.pdf").write_text("x")
    assert [r.id for r in L.delete_with_files(scores, 7).collect()] == [4] and not (tmp_path / "g.pdf").exists()
    assert L.delete_with_files(scores, 4).count() == 1  # its file was never there
    many = spark.range(1000).select(F.expr("CAST((id * 37) % 1000 AS STRING)").alias("title"))
    numbers = {r.title: r.number for r in L.numbered(many, [F.col("title")]).collect()}
    assert numbers == {t: n for n, t in enumerate(sorted(numbers), 1)}


def test_live_view_sees_all_that_is_stored(spark, tmp_path):
    folder, told = f"file://{tmp_path}/scores", []
    for titles in (["a", "c"], ["ac"]):
        spark.createDataFrame([(t,) for t in titles], "title string").write.mode("append").parquet(folder)
        views.live_view(
            spark, folder, "title string", lambda s: L.search(s, "c"), lambda df, n: told.append(sorted(r.title for r in df.collect())), f"file://{tmp_path}/check"
        ).awaitTermination()
    assert told == [["c"], ["ac", "c"]]


def test_event_log_gives_each_event_once(spark, tmp_path):
    log, told = f"file://{tmp_path}/log", []
    for names in (["a", "b"], ["c"]):
        views.append_events(spark.createDataFrame([(n,) for n in names], "name string"), log)
        views.new_events(spark, log, "name string", lambda df, n: told.append(sorted(r.name for r in df.collect())), f"file://{tmp_path}/check").awaitTermination()
    assert told == [["a", "b"], ["c"]]


def test_changes_of_snapshots(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("a", 3, "y"), ("b", 2, "x"), ("a", 4, "x")]
    df = spark.createDataFrame(rows, "key string, seq long, value string")
    want = {("a", 1, "x"), ("a", 3, "y"), ("a", 4, "x"), ("b", 1, "x")}
    assert {tuple(r) for r in views.changes(df, ["key"], ["seq"], "value").collect()} == want


def test_changes_of_a_stream(spark, tmp_path):
    """Two runs of the stream; a key's last value, null ones too, is known to the second."""
    parts = [[("a", 1, "x"), ("a", 2, "x"), ("b", 1, None), ("a", 3, "y")], [("b", 2, None), ("a", 4, "y"), ("a", 5, "x"), ("b", 3, "z"), ("c", 9, "q")]]
    folder = f"file://{tmp_path}"
    for part in parts:
        spark.createDataFrame(part, "key string, seq long, value string").write.mode("append").parquet(f"{folder}/in")
        views.follow_changes(spark, f"{folder}/in", f"{folder}/out", f"{folder}/check")
    got = {tuple(r) for r in spark.read.parquet(f"{folder}/out").select("key", "seq", "value").collect()}
    assert got == {("a", 1, "x"), ("a", 3, "y"), ("a", 5, "x"), ("b", 1, None), ("b", 3, "z"), ("c", 9, "q")}


def names_of(spark, paths, taken=()):
    names = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "file_id long, name string")
    stored = spark.createDataFrame([(t,) for t in taken], "file string")
    return [r.file for r in imports.free_names(names, stored).orderBy("file_id").collect()]


def test_free_names(spark):
    assert names_of(spark, ["a.pdf", "a.pdf", "a.pdf"]) == ["a.pdf", "a (1).pdf", "a (2).pdf"]
    assert names_of(spark, ["a.pdf", "a.pdf", "a (1).pdf"]) == ["a.pdf", "a (2).pdf", "a (1).pdf"]
    assert names_of(spark, ["a.pdf"] * 3, ["a.pdf", "a (2).pdf"]) == ["a (1).pdf", "a (3).pdf", "a (4).pdf"]
    assert names_of(spark, [".pdf", ".pdf", "plain", "plain", "x:y?.png", " "]) == [".pdf", ".pdf (1)", "plain", "plain (1)", "x_y_.png", "score"]
    many = names_of(spark, ["b.jpg"] * 50 + [f"b ({n}).jpg" for n in range(1, 60, 2)])
    assert len(set(many)) == len(many) and many[1:4] == ["b (2).jpg", "b (4).jpg", "b (6).jpg"]


def test_import_matrix(spark, tmp_path):
    kinds = [(m, n) for m in (None, "application/pdf", "image/jpeg", "image/png", "text/plain") for n in ("f.pdf", "f.JPG", "f.jpeg", "f.png", "f.txt", "f")]
    files = [(i, f"in/{n}", m, b"%PDF /Type /Page x /Type/Pages /Type/Page") for i, (m, n) in enumerate(kinds)]
    df = spark.createDataFrame(files, "file_id long, path string, mime string, content binary")
    outcomes = imports.plan_imports(df, spark.createDataFrame([], "file string"), 7)
    got = {r.file_id: r for r in outcomes.collect()}
    for i, (mime, name) in enumerate(kinds):
        good = mime in ("application/pdf", "image/jpeg", "image/png") or name.rsplit(".")[-1].lower() in ("pdf", "jpg", "jpeg", "png")
        assert (got[i].status == "Success") == good
        if good:
            assert got[i].page_count == (2 if mime == "application/pdf" or name == "f.pdf" else 1) and got[i].title.startswith("f")
    stored = imports.copy_files(df, outcomes, f"file://{tmp_path}/files").collect()
    assert sorted(r.path for r in stored) == sorted(r.original_file_path for r in got.values() if r.status == "Success")


def test_library_orders(spark):
    row = lambda i, t, imported, opened, favourite: (i, t, t, None, imported, opened, 1, favourite, 0, 1.0, 0.0, None)
    rows = [row(1, "b", 5, None, False), row(2, "A", 5, 9, False), row(3, "a", 7, None, False), row(4, "c", 5, 9, True), row(5, "b", 5, None, False), row(6, "z", 1, 3, False)]
    scores = spark.createDataFrame(rows, L.SCHEMA)
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(L.library_view(scores, "", "NAME")) == [4, 3, 2, 1, 5, 6]
    assert ids(L.library_view(scores, "", "DATE_IMPORTED")) == [4, 3, 1, 2, 5, 6]
    assert ids(L.library_view(scores, "", "RECENTLY_PRACTICED")) == [4, 2, 6, 3, 1, 5]
    assert [r.id for r in L.placed(scores, L.view_order("NAME"), "page_count").orderBy("place").collect()] == [4, 3, 2, 1, 5, 6]


def zone(spark, ys, width=30, height=140, left=0, right=30):
    pixels = spark.createDataFrame([("z", y, x) for y in ys for x in range(width)], "page_id string, y long, x long")
    zones = spark.createDataFrame([("z", left, right, width, height)], "page_id string, zone_left long, zone_right long, width long, height long")
    return series.five_line_groups(series.zone_density(pixels, zones)).collect()


def test_zones(spark):
    found = zone(spark, [40, 52, 64, 76, 88])
    assert sorted((r.line, r.i) for r in found) == [(1, 88), (2, 76), (3, 64), (4, 52), (5, 40)] and {r.unit for r in found} == {12.0}
    assert zone(spark, [40, 52, 64, 76]) == []
    assert sorted(r.i for r in zone(spark, range(28, 101, 12))) == [28, 40, 52, 64, 76]
    assert zone(spark, [40, 52, 64, 76, 88], width=15, left=15, right=15) == []
    for left, right in ((-1, 5), (6, 5), (0, 31)):
        with pytest.raises(Exception, match="does not lie on its page"):
            zone(spark, [40], left=left, right=right)


def test_tiles(spark):
    """Windows of 4 over a page of 6 x 3: grown to the window, and each pixel's mean is the pixel."""
    bands = spark.createDataFrame([("p", y, [10 * y + x for x in range(6)]) for y in range(3)], "page_id string, y long, data array<int>")
    pages = spark.createDataFrame([("p", 6, 3, 4, "m")], "page_id string, width long, height long, window long, model string")
    cut = {r.tile_seq: r for r in tiles.cut_tiles(bands, pages, 2).collect()}
    assert [(r.ox, r.oy) for _, r in sorted(cut.items())] == [(0, 0), (2, 0), (2, 0)] * 2 and cut[0].pix == bytes([0, 1, 2, 3, 10, 11, 12, 13, 20, 21, 22, 23, 20, 21, 22, 23])
    narrow = spark.createDataFrame([("p", 2, 2, 4, "m")], "page_id string, width long, height long, window long, model string")
    small = spark.createDataFrame([("p", 0, [1, 2]), ("p", 1, [3, 4])], "page_id string, y long, data array<int>")
    assert tiles.cut_tiles(small, narrow, 2).first().pix == bytes([1, 2, 2, 2, 3, 4, 4, 4, 3, 4, 4, 4, 3, 4, 4, 4])
    scored = tiles.score_tiles(tiles.cut_tiles(bands, pages, 2), lambda: lambda p: np.concatenate([p, 255 - p], -1), 2)
    sizes = spark.createDataFrame([("p", 7, 2)], "page_id string, width long, height long")
    merged = {r.y: r for r in tiles.merge_tiles(scored, sizes).collect()}
    assert len(merged) == 4 and merged[2].data == [v for x in range(6) for v in (20.0 + x, 235.0 - x)] + [0.0, 0.0]


def test_tiles_of_two_kinds_raise(spark):
    two = spark.createDataFrame([("p", 0, 0, 1, 1, [1.0]), ("p", 0, 0, 1, 2, [1.0, 2.0])], "page_id string, ox long, oy long, window long, channels int, values array<float>")
    with pytest.raises(Exception, match="differ in their channels"):
        tiles.merge_tiles(two).collect()


def test_classes_and_masks(spark):
    nan = float("nan")
    rows = [("p", 0, 5, 3, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.5, 0.5, 0.0, nan, 5.0, 6.0, 0.0, 1.0, nan]), ("p", 1, 5, 4, [0.0] * 20)]
    bands = spark.createDataFrame(rows, "page_id string, y long, width long, channels int, data array<double>")
    told = tiles.classes(bands).orderBy("y").collect()
    assert told[0].classes == [0, 1, 0, 0, 1] and told[1].classes == [0] * 5
    a = spark.createDataFrame([("p", 0, 3, [0, 1, 2])], "page_id string, y long, channels int, classes array<int>")
    b = spark.createDataFrame([("p", 0, 4, [1, 2, 3])], "page_id string, y long, channels int, classes array<int>")
    masks = tiles.class_masks(a, b).first()
    assert (masks.staff, masks.symbols, masks.stems_rests) == ([False, True, False], [False, False, True], [True, False, False])
    for other in (b.withColumn("channels", F.lit(3)), b.withColumn("y", F.lit(1).cast("long"))):
        with pytest.raises(Exception, match="do not fit"):
            tiles.class_masks(a, other).collect()
