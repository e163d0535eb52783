"""DuckDB SQL for the registered queries, written apart from the plans."""

from __future__ import annotations

LIBRARY = """lib AS (SELECT p_partkey AS id, p_name AS title, 'scores/' || p_brand || '.pdf' AS original_file_path,
    CAST(coalesce(a, 0) AS BIGINT) AS import_date, b AS last_opened_date, CAST(p_size AS INT) AS page_count, p_partkey % 7 = 0 AS is_favorite
    FROM part LEFT JOIN (SELECT l_partkey, min(epoch_ms(l_shipdate)) AS a, max(CASE WHEN l_returnflag = 'R' THEN epoch_ms(l_shipdate) END) AS b
        FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""
SERIES = """sparse AS (SELECT l_returnflag AS series_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS i, count(*) AS v
    FROM lineitem GROUP BY ALL),
spine AS (SELECT series_id, unnest(range(0, max(i) + 1)) AS i FROM sparse GROUP BY series_id),
raw AS (SELECT series_id, i, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM spine LEFT JOIN sparse USING (series_id, i))"""
Z = """z AS (SELECT * FROM (SELECT series_id, i, CAST(CAST((v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0) AS FLOAT) AS DOUBLE) AS v
    FROM raw WINDOW p AS (PARTITION BY series_id)) WHERE v IS NOT NULL)"""


def maxima(table: str) -> str:
    return f"""c AS (SELECT *, CASE WHEN v <> lag(v) OVER o THEN 1 ELSE 0 END AS ch FROM {table} WINDOW o AS (PARTITION BY series_id ORDER BY i)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY i) AS run FROM c),
g AS (SELECT series_id, run, min(i) AS lo, max(i) AS hi, min(v) AS v FROM r GROUP BY series_id, run),
n AS (SELECT *, lag(v) OVER o AS b, lead(v) OVER o AS a FROM g WINDOW o AS (PARTITION BY series_id ORDER BY run)),
maxima AS (SELECT series_id, CAST((lo + hi) // 2 AS BIGINT) AS i, v FROM n WHERE v > b AND v > a)"""


def apart(table: str, distance: int = 8) -> str:
    return f"""kept AS (SELECT series_id, unnest(list_reduce(list([i] ORDER BY v DESC, i DESC),
        lambda k, p: CASE WHEN len(list_filter(k, lambda q: abs(q - p[1]) < {distance})) > 0 THEN k ELSE list_concat(k, p) END)) AS i FROM {table} GROUP BY series_id),
far AS (SELECT series_id, i, v FROM kept JOIN {table} USING (series_id, i))"""


def prominence(peaks: str, table: str) -> str:
    return f"""bounds AS (SELECT p.series_id, p.i, any_value(p.v) AS v, max(CASE WHEN s.i < p.i AND s.v > p.v THEN s.i END) AS l, min(CASE WHEN s.i > p.i AND s.v > p.v THEN s.i END) AS h
    FROM {peaks} p JOIN {table} s ON s.series_id = p.series_id GROUP BY p.series_id, p.i),
prom AS (SELECT b.series_id, b.i, any_value(b.v) AS v, any_value(b.v) - greatest(min(CASE WHEN s.i <= b.i THEN s.v END), min(CASE WHEN s.i >= b.i THEN s.v END)) AS prominence
    FROM bounds b JOIN {table} s ON s.series_id = b.series_id AND s.i > coalesce(b.l, -1) AND s.i < coalesce(b.h, 1e18) GROUP BY b.series_id, b.i)"""


PEAKS = f"""{SERIES}, {Z}, {maxima("z")}, high AS (SELECT * FROM maxima WHERE v >= 0.8), {apart("high")}, {prominence("far", "z")},
peaks AS (SELECT * FROM prom WHERE prominence >= 1.0)"""


def groups(table: str) -> str:
    return f"""gaps AS (SELECT series_id, CAST(i - lag(i) OVER (PARTITION BY series_id ORDER BY i) AS DOUBLE) AS gap FROM {table}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY gap) AS k, count(*) OVER (PARTITION BY series_id) AS m FROM gaps WHERE gap IS NOT NULL),
units AS (SELECT series_id, avg(gap) AS unit FROM ranked WHERE k <= greatest(1, floor(m * 0.2)) GROUP BY series_id),
new AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY series_id ORDER BY i) > 1.5 * unit THEN 1 ELSE 0 END AS nw FROM {table} JOIN units USING (series_id)),
grouped AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY series_id ORDER BY i) AS BIGINT) AS "group" FROM new)"""


LINES = f"""{PEAKS}, ok AS (SELECT * FROM peaks WHERE v <= 15 AND series_id IN (SELECT series_id FROM peaks WHERE v <= 15 GROUP BY 1 HAVING count(*) >= 5)), {groups("ok")},
o AS (SELECT *, row_number() OVER (PARTITION BY series_id, "group" ORDER BY i) AS up, row_number() OVER (PARTITION BY series_id, "group" ORDER BY i DESC) AS down,
    count(*) OVER (PARTITION BY series_id, "group") AS m FROM grouped),
w AS (SELECT *, sum(v) FILTER (up <= 5) OVER (PARTITION BY series_id, "group") >= sum(v) FILTER (down <= 5) OVER (PARTITION BY series_id, "group") AS head FROM o WHERE m >= 5),
five AS (SELECT *, dense_rank() OVER (PARTITION BY series_id ORDER BY "group") AS staff, row_number() OVER (PARTITION BY series_id, "group" ORDER BY i DESC) AS line
    FROM w WHERE CASE WHEN head THEN up <= 5 ELSE down <= 5 END)"""
STAFF = f"""{LINES}, px AS (SELECT DISTINCT l_returnflag AS series_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS y, l_orderkey % 500 AS x FROM lineitem),
cand AS (SELECT p.series_id, f.staff, p.y, p.x, f.i AS centre, row_number() OVER (PARTITION BY p.series_id, f.staff, p.y, p.x ORDER BY abs(p.y - f.i), f.i) AS k,
    abs(p.y - f.i) AS dist, greatest(1, floor(f.unit / 2 + 0.5)) AS gap FROM px p JOIN five f USING (series_id)),
hit AS (SELECT series_id, staff, centre, count(*) AS n, min(x) AS x_min, max(x) AS x_max, avg(x) AS x_centre, min(y) AS y_min, max(y) AS y_max, avg(y) AS y_centre,
    CASE WHEN count(DISTINCT x) < 2 THEN 0 ELSE regr_slope(y, x) END AS slope FROM cand WHERE k = 1 AND dist <= gap GROUP BY series_id, staff, centre),
lines AS (SELECT f.series_id, f.staff, coalesce(n, 1) AS n, coalesce(x_min, 0) AS x_min, coalesce(x_max, 0) AS x_max, coalesce(x_centre, 0) AS x_centre,
    coalesce(y_min, f.i) AS y_min, coalesce(y_max, f.i) AS y_max, coalesce(y_centre, f.i) AS y_centre, coalesce(slope, 0) AS slope
    FROM five f LEFT JOIN hit h ON h.series_id = f.series_id AND h.staff = f.staff AND h.centre = f.i)"""
EVENTS = """px AS (SELECT DISTINCT event_type || '/' || user_id // 150 || '/' || CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) // 720 AS page_id, user_id % 150 AS y,
    CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) % 720 AS x FROM events)"""
RASTER = """seg AS (SELECT CAST(o_custkey // 150 AS VARCHAR) AS page_id, o_custkey % 150 // 10 AS slot, o_orderkey * 37 % 690 AS x0, 4 + o_orderkey % 27 AS length FROM orders),
px AS (SELECT DISTINCT page_id, 10 + slot // 5 * 90 + slot % 5 * 12 + x0 // 240 AS y, unnest(range(x0, x0 + length)) AS x FROM seg),
page AS (SELECT DISTINCT page_id FROM seg),
grid AS (SELECT page_id, y, x, coalesce(hit, 0) AS "on" FROM (SELECT page_id, y, x FROM page, range(280) a(y), range(720) b(x)) LEFT JOIN (SELECT *, 1 AS hit FROM px) USING (page_id, y, x))"""


def window(name: str, table: str, axis: str, pick: str) -> str:
    across = "x" if axis == "y" else "y"
    return f"""{name} AS (SELECT page_id, y, x, {pick}("on") OVER (PARTITION BY page_id, {across} ORDER BY {axis} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS "on" FROM {table})"""


GRIDS = f"""{RASTER}, {window("ta", "grid", "y", "max")}, {window("tb", "ta", "x", "min")}, {window("dil", "tb", "x", "max")},
sr AS (SELECT page_id, x // 11 AS strip, y, sum("on") > 5 AS act, min(x) AS l, max(x) + 1 AS r FROM dil GROUP BY ALL),
sc AS (SELECT *, CASE WHEN act <> lag(act) OVER (PARTITION BY page_id, strip ORDER BY y) THEN 1 ELSE 0 END AS ch FROM sr),
sq AS (SELECT *, sum(ch) OVER (PARTITION BY page_id, strip ORDER BY y) AS run FROM sc),
grids AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY strip, "top") - 1 AS INT) AS id, "left", "top", "right", bottom FROM
    (SELECT page_id, strip, min(l) AS "left", min(y) AS "top", max(r) AS "right", max(y) + 1 AS bottom FROM sq WHERE act GROUP BY page_id, strip, run) WHERE bottom - "top" < 11)"""
REGIONS = f"""{GRIDS},
adj AS (SELECT a.page_id, a.id AS a, b.id AS b FROM grids a JOIN grids b ON a.page_id = b.page_id AND (a."right" = b."left" OR b."right" = a."left") AND a."top" < b.bottom AND b."top" < a.bottom),
lab AS (SELECT page_id, id, id AS root FROM grids UNION SELECT l.page_id, adj.b, l.root FROM lab l JOIN adj ON adj.page_id = l.page_id AND adj.a = l.id AND l.root < adj.b),
low AS (SELECT page_id, id, min(root) AS root FROM lab GROUP BY ALL),
firsts AS (SELECT page_id, root, min("top" * 10000 + "left") AS f FROM low JOIN grids USING (page_id, id) GROUP BY ALL),
regions AS (SELECT page_id, id, dense_rank() OVER (PARTITION BY page_id ORDER BY f) AS region FROM low JOIN firsts USING (page_id, root))"""
POINTS = f"""{REGIONS}, gx AS (SELECT DISTINCT page_id, region, y, unnest(range("left", "right")) AS x FROM
    (SELECT page_id, region, unnest(range("top", bottom)) AS y, "left", "right" FROM grids JOIN regions USING (page_id, id))),
cols AS (SELECT page_id, region, x, sum(y) AS total, count(*) AS n FROM gx GROUP BY ALL),
tot AS (SELECT page_id, region, floor(sum(total) / sum(n) + 0.5) AS target, max(x) - min(x) AS span FROM cols GROUP BY ALL),
pick AS (SELECT page_id, CAST(target AS BIGINT) AS target_row, x AS "column", CAST(floor(total / n + 0.5) AS BIGINT) AS source_row, span, row_number() OVER (PARTITION BY page_id, region ORDER BY x) AS k
    FROM cols JOIN tot USING (page_id, region)),
points AS (SELECT page_id, target_row, "column", source_row FROM pick WHERE span >= 0.4 * 720 AND (k - 1) % 10 = 0
    UNION ALL SELECT page_id, r, x, r FROM page, (VALUES (0), (279)) t(r), range(720) q(x))"""
ZONE_SERIES = f"""{RASTER}, zpx AS (SELECT page_id, y, x FROM px WHERE x >= 100 AND x < 620),
raw AS (SELECT page_id AS series_id, y AS i, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT page_id, y FROM page, range(280) q(y)) LEFT JOIN (SELECT page_id, y, count(*) AS n FROM zpx GROUP BY ALL) USING (page_id, y))"""
ZONE_STAFF = STAFF.replace(SERIES, ZONE_SERIES).replace(STAFF[STAFF.index(", px AS ") : STAFF.index(",\ncand AS")], ", zp AS (SELECT page_id AS series_id, y, x FROM zpx)").replace(
    "FROM px p JOIN five f", "FROM zp p JOIN five f"
).replace("coalesce(x_min, 0) AS x_min, coalesce(x_max, 0) AS x_max, coalesce(x_centre, 0)", "coalesce(x_min, 100) AS x_min, coalesce(x_max, 100) AS x_max, coalesce(x_centre, 100)")
TILES = """cell AS (SELECT CAST(vec_id // 400 AS VARCHAR) AS page_id, vec_id % 20 * 2 AS ox, vec_id // 20 % 20 * 2 AS oy, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings),
covered AS (SELECT page_id, oy + pos // 16 AS y, ox + pos // 4 % 4 AS x, CAST(pos % 4 AS INT) AS channel, avg(CAST(v AS DOUBLE)) AS v FROM cell GROUP BY ALL),
ext AS (SELECT page_id, max(y) AS my, max(x) AS mx FROM covered GROUP BY 1),
merged AS (SELECT e.page_id, a.y, b.x, CAST(c.ch AS INT) AS channel, coalesce(m.v, 0) AS v FROM ext e JOIN range(1000) a(y) ON a.y <= my JOIN range(1000) b(x) ON b.x <= mx CROSS JOIN range(4) c(ch)
    LEFT JOIN covered m ON m.page_id = e.page_id AND m.y = a.y AND m.x = b.x AND m.channel = c.ch)"""
MATRIX = """m AS (SELECT CAST(vec_id // 100 AS VARCHAR) AS page_id, vec_id % 100 AS y, unnest(range(64)) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def remapped(source: str, shift: str) -> str:
    return f"""h AS (SELECT page_id, max(y) AS top FROM m GROUP BY 1),
c AS (SELECT page_id, y, x, {shift} AS src, top FROM m JOIN h USING (page_id)),
t AS (SELECT page_id, y, x, least(greatest(floor(src) + k, 0), top) AS row, abs(k - (src - floor(src))) AS d FROM c, (VALUES (-1), (0), (1), (2)) q(k)),
out AS (SELECT t.page_id, t.y, t.x, sum({source} * CASE WHEN d <= 1 THEN (1.25 * d - 2.25) * d * d + 1 WHEN d < 2 THEN ((-0.75 * d + 3.75) * d - 6) * d + 3 ELSE 0 END) AS v
    FROM t JOIN m ON m.page_id = t.page_id AND m.y = t.row AND m.x = t.x GROUP BY ALL)"""


ORACLES = {
    "lib_get_all": f"WITH {LIBRARY} SELECT id, title, import_date, is_favorite, row_number() OVER (PARTITION BY page_count ORDER BY import_date DESC, id) AS place FROM lib",
    "lib_domain": f"""WITH {LIBRARY} SELECT id, title, original_file_path AS "originalFilePath", import_date AS "importDate", last_opened_date AS "lastOpenedDate",
        page_count AS "pageCount", is_favorite AS "isFavorite", CAST(0 AS INT) AS "lastViewedPage", CAST(1 AS FLOAT) AS "lastViewedZoom", CAST(0 AS FLOAT) AS "practiceProgress" FROM lib""",
    "lib_by_id": f"WITH {LIBRARY} SELECT id, title, page_count FROM lib WHERE id = 42",
    "lib_favorites": f"WITH {LIBRARY} SELECT id, title, place FROM (SELECT *, row_number() OVER (PARTITION BY page_count ORDER BY is_favorite DESC, import_date DESC, id) AS place FROM lib) WHERE is_favorite",
    "lib_search_name": f"WITH {LIBRARY} SELECT id, title, is_favorite, row_number() OVER (PARTITION BY page_count ORDER BY is_favorite DESC, lower(title), import_date DESC, id) AS place FROM lib WHERE title ILIKE '%a%'",
    "lib_search_recent": f"WITH {LIBRARY} SELECT id, last_opened_date, row_number() OVER (PARTITION BY page_count ORDER BY is_favorite DESC, coalesce(last_opened_date, 0) DESC, import_date DESC, id) AS place FROM lib",
    "lib_empty": "SELECT count(*) = 0 AS all_scores_empty FROM part",
    "lib_updates": f"""WITH {LIBRARY} SELECT id, CASE WHEN id = 8 THEN 'New name' ELSE title END AS title, CASE WHEN id = 3 THEN 1700000000000 ELSE last_opened_date END AS last_opened_date,
        CAST(CASE WHEN id = 3 THEN 7 ELSE 0 END AS INT) AS last_viewed_page, CAST(CASE WHEN id = 4 THEN 2.5 ELSE 1 END AS DOUBLE) AS zoom,
        CAST(CASE WHEN id = 5 THEN 0.5 ELSE 0 END AS DOUBLE) AS progress, CASE WHEN id = 6 THEN 'x.musicxml' END AS music_xml_path,
        CASE WHEN id = 7 THEN NOT is_favorite ELSE is_favorite END AS is_favorite FROM lib""",
    "lib_replace_delete": "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END AS title FROM part WHERE p_partkey % 3 <> 0",
    "lib_inserts": f"""WITH {LIBRARY}, few AS (SELECT id, title || ' ' || id AS title, original_file_path AS path FROM lib WHERE id % 10 = 0)
        SELECT id, title FROM lib UNION ALL SELECT -id - 1, title FROM few
        UNION ALL SELECT (SELECT max(id) FROM lib) + row_number() OVER (ORDER BY title, path), title FROM few""",
    "lib_changed_views": "SELECT p_partkey AS id, CAST(p_partkey % 3 AS INT) AS page FROM part WHERE p_partkey % 3 <> 0",
    "series_density": f"WITH {SERIES} SELECT * FROM raw",
    "series_z_scores": f"WITH {SERIES}, {Z} SELECT series_id, i, round(v, 4) + 0 AS v FROM z",
    "series_maxima": f"WITH {SERIES}, {maxima('raw')} SELECT * FROM maxima",
    "series_far_apart": f"WITH {SERIES}, {maxima('raw')}, {apart('maxima')} SELECT * FROM far",
    "series_prominence": f"WITH {SERIES}, {maxima('raw')}, {prominence('maxima', 'raw')} SELECT * FROM prom",
    "series_find_peaks": f"WITH {PEAKS} SELECT series_id, i, round(v, 4) + 0 AS v, round(prominence, 4) + 0 AS prominence FROM peaks",
    "series_groups": f'WITH {PEAKS}, {groups("peaks")} SELECT series_id, i, round(unit, 4) + 0 AS unit, "group" FROM grouped',
    "flagship_lines": f"""WITH {LINES} SELECT series_id, CAST(staff AS INT) AS staff, CAST(line AS INT) AS line, i, round(v, 4) + 0 AS v, round(prominence, 4) + 0 AS prominence, round(unit, 4) + 0 AS unit FROM five""",
    "staff_lines": f"""WITH {STAFF} SELECT series_id, CAST(staff AS INT) AS staff, ['FIRST', 'SECOND', 'THIRD', 'FOURTH', 'FIFTH'][row_number() OVER (PARTITION BY series_id, staff ORDER BY y_centre DESC)] AS "position",
        n, x_min, x_max, round(x_centre, 4) + 0 AS x_centre, y_min, y_max, round(y_centre, 4) + 0 AS y_centre, round(slope, 6) + 0 AS slope FROM lines""",
    "staff_sizes": f"""WITH {STAFF} SELECT series_id, CAST(staff AS INT) AS staff, round(avg(y_centre), 4) + 0 AS y_centre, round((max(y_centre) - min(y_centre)) / 4, 4) + 0 AS unit_size FROM lines GROUP BY series_id, staff""",
    "tile_origins": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS page_id, p_partkey % 500 + 288 AS width, p_size * 7 + 288 AS height, w AS "window" FROM part, (VALUES (256), (288)) t(w)),
        a AS (SELECT *, unnest(range(0, height, 128)) AS y FROM p), b AS (SELECT *, unnest(range(0, width, 128)) AS x FROM a)
        SELECT page_id, "window", CAST(row_number() OVER (PARTITION BY page_id, "window" ORDER BY y, x) - 1 AS INT) AS tile_seq, least(x, width - "window") AS ox, least(y, height - "window") AS oy FROM b""",
    "target_sizes": """WITH p AS (SELECT p_partkey, p_partkey % 5000 + 1 AS w, p_size * 61 AS h FROM part), s AS (SELECT *, sqrt((3e6 / (w * h) + 4.35e6 / (w * h)) / 2) AS k FROM p)
        SELECT p_partkey, CAST(floor(w * k + 0.5) AS BIGINT) AS width, CAST(floor(h * k + 0.5) AS BIGINT) AS height FROM s""",
    "merge_overlap": f"WITH {TILES} SELECT page_id, y, x, channel, round(v, 5) + 0 AS v FROM merged",
    "page_extents": """SELECT CAST(vec_id // 400 AS VARCHAR) AS page_id, max(vec_id % 20 * 2) + 4 AS width, max(vec_id // 20 % 20 * 2) + 4 AS height, CAST(max(len(embedding)) // 16 AS INT) AS channels FROM embeddings GROUP BY 1""",
    "class_masks": f"""WITH {TILES}, a AS (SELECT page_id, y, x, arg_max(channel, (v, -channel)) FILTER (channel < 3) AS f, arg_max(channel, (v, -channel)) AS s FROM merged GROUP BY ALL)
        SELECT page_id, y, x, f = 1 AS staff, f = 2 AS symbols, s = 1 AS stems_rests, s = 2 AS noteheads, s = 3 AS clefs_keys FROM a""",
    "align_bands": """WITH b AS (SELECT CAST(vec_id // 100 AS VARCHAR) AS page_id, vec_id % 100 AS y, embedding AS e FROM embeddings), t AS (SELECT page_id, max(y) AS top FROM b GROUP BY 1)
        SELECT b.page_id, CASE WHEN r.k = 0 THEN b.y ELSE t.top + r.k END AS y, CAST(c.x AS INT) AS x, round(CAST(e[least(c.x, 63) + 1] AS DOUBLE), 5) + 0 AS v
        FROM b JOIN t USING (page_id), range(103) r(k), range(67) c(x) WHERE r.k = 0 OR (b.y = t.top AND t.top + r.k <= 102)""",
    "raster_dilate": f"""WITH {RASTER}, {window("o", "grid", "y", "max")} SELECT page_id, y, x FROM o WHERE "on" = 1""",
    "raster_thicken": f"""WITH {RASTER}, {window("a", "grid", "y", "max")}, {window("b", "a", "x", "min")}, {window("c", "b", "x", "max")} SELECT page_id, y, x FROM c WHERE "on" = 1""",
    "raster_grids": f'WITH {GRIDS} SELECT page_id, id, "left", "top", "right", bottom FROM grids',
    "raster_groups": f"""WITH RECURSIVE {REGIONS}, ends AS (SELECT page_id, region, min(id) AS a, max(id) AS b, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS grid_ids FROM regions GROUP BY ALL)
        SELECT e.page_id, CAST(row_number() OVER (PARTITION BY e.page_id ORDER BY greatest(g."right", h."right") - least(g."left", h."left") DESC, region) - 1 AS INT) AS id,
        least(g."left", h."left") AS "left", least(g."top", h."top") AS "top", greatest(g."right", h."right") AS "right", greatest(g.bottom, h.bottom) AS bottom, grid_ids
        FROM ends e JOIN grids g ON g.page_id = e.page_id AND g.id = a JOIN grids h ON h.page_id = e.page_id AND h.id = b""",
    "mapping_points": f"""WITH RECURSIVE {POINTS} SELECT * FROM points""",
    "row_maps": f"""WITH RECURSIVE {POINTS}, s AS (SELECT page_id, target_row, "column", max(source_row) AS v FROM points GROUP BY ALL),
        rws AS (SELECT DISTINCT page_id, target_row FROM s), cx AS (SELECT x FROM range(720) q(x)),
        a AS (SELECT r.page_id, r.target_row, x, s."column" AS c0, s.v AS v0 FROM (SELECT * FROM rws, cx) r ASOF LEFT JOIN s ON s.page_id = r.page_id AND s.target_row = r.target_row AND r.x >= s."column"),
        b AS (SELECT a.*, s."column" AS c1, s.v AS v1 FROM a ASOF LEFT JOIN s ON s.page_id = a.page_id AND s.target_row = a.target_row AND a.x <= s."column"),
        l AS (SELECT page_id, target_row, x, CASE WHEN c0 IS NULL THEN v1 WHEN c1 IS NULL OR c0 = c1 THEN v0 ELSE v0 + (x - c0) / CAST(c1 - c0 AS DOUBLE) * (v1 - v0) END AS v FROM b),
        p AS (SELECT page_id, y, x FROM page, range(280) q(y), cx),
        u AS (SELECT p.*, l.target_row AS r0, l.v AS v0 FROM p ASOF LEFT JOIN l ON l.page_id = p.page_id AND l.x = p.x AND p.y >= l.target_row),
        w AS (SELECT u.*, l.target_row AS r1, l.v AS v1 FROM u ASOF LEFT JOIN l ON l.page_id = u.page_id AND l.x = u.x AND u.y <= l.target_row)
        SELECT page_id, y, CAST(x AS INT) AS x, round(CASE WHEN r0 = r1 THEN v0 ELSE v0 + (y - r0) / CAST(r1 - r0 AS DOUBLE) * (v1 - v0) END, 4) + 0 AS v FROM w""",
    "scored_pages": f"""WITH {RASTER} SELECT page_id, y, x, true AS staff, false AS symbols, false AS stems_rests, true AS noteheads, false AS clefs_keys FROM px""",
    "zone_lines": f"""WITH {ZONE_STAFF} SELECT series_id, CAST(staff AS INT) AS staff, ['FIRST', 'SECOND', 'THIRD', 'FOURTH', 'FIFTH'][row_number() OVER (PARTITION BY series_id, staff ORDER BY y_centre DESC)] AS "position",
        n, x_min, x_max, round(x_centre, 4) + 0 AS x_centre, y_min, y_max, round(y_centre, 4) + 0 AS y_centre, round(slope, 6) + 0 AS slope FROM lines""",
    "import_outcomes": r"""WITH f AS (SELECT page_id AS file_id, coalesce(list_element(string_split(regexp_replace(url, '[?#].*$', ''), '/'), 4), 'x') ||
            CASE WHEN page_id % 7 = 0 THEN ' (' || page_id % 4 || ')' ELSE '' END || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' ELSE '.txt' END AS name,
            page_id % 5 = 0 AS png, page_id % 4 + len(regexp_extract_all(html, '/Type\s*/Page([^A-Za-z]|$)')) AS pages FROM pages),
        ok AS (SELECT *, CASE WHEN trim(regexp_replace(name, '[/\:*?"<>|]', '_', 'g')) = '' THEN 'score' ELSE regexp_replace(name, '[/\:*?"<>|]', '_', 'g') END AS clean FROM f WHERE png OR page_id_ok),
        stored AS (SELECT unnest(CASE WHEN EXISTS (SELECT 1 FROM f WHERE file_id % 50 = 0) THEN ['en.PDF', 'en (2).PDF', 'de (1).jpg'] ELSE [] END) AS file),
        cut AS (SELECT *, CASE WHEN strpos(clean[2:], '.') > 0 THEN regexp_extract(clean, '^(.+)\.[^.]*$', 1) ELSE clean END AS base FROM ok),
        named AS (SELECT *, clean[len(base) + 1:] AS suffix, row_number() OVER (PARTITION BY clean ORDER BY file_id) AS k, count(*) OVER (PARTITION BY clean) AS m,
            clean IN (SELECT file FROM stored) AS taken FROM cut),
        used AS (SELECT list(x) AS xs FROM (SELECT file AS x FROM stored UNION SELECT clean FROM cut)),
        free AS (SELECT *, k - CASE WHEN taken THEN 0 ELSE 1 END AS place, list_filter(list_transform(range(1, m + 400), lambda i: base || ' (' || i || ')' || suffix), lambda v: NOT list_contains(xs, v)) AS options FROM named, used),
        filed AS (SELECT *, CASE WHEN place = 0 THEN clean ELSE options[place] END AS file FROM free)
        SELECT f.file_id, CASE WHEN file IS NULL THEN 'Failure' ELSE 'Success' END AS status, regexp_replace(file, '\.[^.]*$', '') AS title, 'scores/' || file AS original_file_path,
        CAST(CASE WHEN file IS NULL THEN NULL WHEN f.file_id % 3 = 0 THEN greatest(1, f.pages) ELSE 1 END AS INT) AS page_count FROM f LEFT JOIN filed USING (file_id)""".replace("page_id_ok", "file_id % 3 < 2").replace("\\\\", "\\"),
    "raster_majority": f"""WITH {EVENTS}, n AS (SELECT page_id, y // 10 AS block, x % 7 AS label, count(*) AS k FROM px GROUP BY ALL)
        SELECT DISTINCT page_id, block, first_value(label) OVER (PARTITION BY page_id, block ORDER BY k DESC, label) AS label FROM n""",
    "raster_majority_where": f"""WITH {EVENTS}, n AS (SELECT page_id, y // 10 AS block, x % 7 AS label, count(*) FILTER (x % 7 % 2 = 0) AS k FROM px GROUP BY ALL)
        SELECT DISTINCT page_id, block, first_value(CASE WHEN k > 0 THEN label END) OVER (PARTITION BY page_id, block ORDER BY k DESC, label) AS label FROM n""",
    "raster_regions": f"""WITH RECURSIVE {EVENTS}, lab AS (SELECT page_id, y, x, y * 720 + x AS root FROM px
        UNION SELECT p.page_id, p.y, p.x, l.root FROM lab l JOIN px p ON p.page_id = l.page_id AND abs(p.y - l.y) + abs(p.x - l.x) = 1 AND l.root < p.y * 720 + p.x),
        low AS (SELECT page_id, y, x, min(root) AS root FROM lab GROUP BY ALL)
        SELECT page_id, y, x, dense_rank() OVER (PARTITION BY page_id ORDER BY root) AS region FROM low""",
    "line_fits": """WITH p AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT l_returnflag, 'flat', 5, l_extendedprice FROM lineitem)
        SELECT l_returnflag, l_linestatus, CASE WHEN min(x) = max(x) THEN 0 ELSE round(regr_slope(y, x), 3) + 0 END AS slope,
        CASE WHEN min(x) = max(x) THEN round(avg(y), 2) ELSE round(regr_intercept(y, x), 2) + 0 END AS intercept, count(*) AS n FROM p GROUP BY ALL""",
    "interpolated_series": f"""WITH {SERIES}, k AS (SELECT series_id, i, v FROM sparse WHERE i % 7 = 0),
        a AS (SELECT s.series_id, s.i, x.i AS i0, x.v AS v0 FROM raw s ASOF LEFT JOIN k x ON x.series_id = s.series_id AND s.i >= x.i),
        b AS (SELECT a.*, y.i AS i1, y.v AS v1 FROM a ASOF LEFT JOIN k y ON y.series_id = a.series_id AND a.i <= y.i)
        SELECT series_id, i, round(CASE WHEN i0 IS NULL THEN v1 WHEN i1 IS NULL OR i0 = i1 THEN v0 ELSE v0 + (i - i0) / CAST(i1 - i0 AS DOUBLE) * (v1 - v0) END, 4) + 0 AS v FROM b""",
    "cubic_remap": f"WITH {MATRIX}, {remapped('m.v', 'y + (x % 8) * 0.25 - 1.5')} SELECT page_id, y, x, round(v, 4) + 0 AS v FROM out",
    "remap_mask": f"WITH {MATRIX}, {remapped('CASE WHEN m.v > 0 THEN 1.0 ELSE 0.0 END', 'y + 0.5')} SELECT page_id, y, x, round(v, 9) > 0 AS \"on\" FROM out",
    "snapshot_changes": """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER o AS b, row_number() OVER o AS k FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
        WHERE k = 1 OR event_type IS DISTINCT FROM b""",
    "stream_changes": """SELECT CAST(user_id AS VARCHAR) AS "user", event_id, event_type FROM (SELECT *, lag(event_type) OVER o AS b, row_number() OVER o AS k FROM events
        WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) WHERE k = 1 OR event_type IS DISTINCT FROM b""",
    "scored_runs": f"""WITH {RASTER}, tile AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS seq, oy, ox
            FROM page, (VALUES (0, 0), (1, 24), (2, 24)) a(i, oy), (VALUES (0, 0), (1, 128), (2, 256), (3, 384), (4, 464), (5, 464)) b(j, ox)),
        ink AS (SELECT t.page_id, t.seq, count(p.x) AS n FROM tile t LEFT JOIN px p ON p.page_id = t.page_id AND p.y >= oy AND p.y < oy + 256 AND p.x >= ox AND p.x < ox + 256 GROUP BY ALL),
        low AS (SELECT page_id, min(seq) FILTER (n < 3090) AS seq FROM ink GROUP BY 1)
        SELECT page_id, CASE WHEN low.seq IS NULL THEN 'Completed' ELSE 'Failed' END AS state, CASE WHEN low.seq IS NOT NULL THEN n || ' pixels of ink are too few' END AS message,
        CASE WHEN low.seq IS NULL THEN 18 END AS n_tiles FROM low LEFT JOIN ink USING (page_id, seq)""",
    "run_state_counts": """SELECT CASE o_orderstatus WHEN 'P' THEN 'Recognizing' WHEN 'F' THEN 'Completed' ELSE 'Failed' END AS state, count(*) AS n,
        count(*) FILTER (o_orderstatus NOT IN ('P', 'F')) AS n_messages FROM orders GROUP BY 1""",
    "name_functions": r"""WITH n AS (SELECT doc_id, source || ':a/b.' || lang || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.Pdf' END AS name FROM documents)
        SELECT doc_id, regexp_replace(name, '[/\\:*?"<>|]', '_', 'g') AS clean, CASE WHEN doc_id % 4 = 0 THEN regexp_extract(name, '[^.]*$') ELSE 'pdf' END AS ext,
        regexp_replace(name, '\.[^.]*$', '') AS stem, regexp_extract(name, '[^/]*$') AS display, regexp_replace(name, '\.[^.]*$', '') AS base, regexp_extract(name, '\.[^.]*$') AS suffix FROM n""",
}
