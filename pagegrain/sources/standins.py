"""Tables of the analytics, made from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_merge


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1995-01-01").cast("date")).cast("long")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each part: dates are days of shipping as milliseconds."""
    millis = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.min(millis).alias("import_date"), F.max(F.when(F.col("l_returnflag") == "R", millis)).alias("last_opened_date")
    )
    return table(spark, sf_dir, "part").join(lines, "p_partkey", "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("scores/"), "p_brand", F.lit(".pdf")).alias("original_file_path"),
        F.lit(None).cast("string").alias("music_xml_path"), F.coalesce("import_date", F.lit(0)).cast("long").alias("import_date"), "last_opened_date",
        F.col("p_size").cast("int").alias("page_count"), (F.col("p_partkey") % 7 == 0).alias("is_favorite"), F.lit(0).alias("last_viewed_page"),
        F.lit(1.0).cast("float").alias("last_viewed_zoom"), F.lit(0.0).cast("float").alias("practice_progress"), F.lit(None).cast("string").alias("notes"),
    )


def sparse_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped a day, a series for each return flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("series_id"), _day("l_shipdate").alias("i"))
    return lines.groupBy("series_id", "i").agg(F.count("*").alias("v"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (page_id, y, x): a page for each event type, 150 users and 720 hours; y is the user, x the hour."""
    hour = F.expr("CAST((unix_seconds(CAST(ts AS TIMESTAMP)) - 1704067200) div 3600 AS BIGINT)")
    events = table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("long").alias("user"), hour.alias("hour"))
    page = F.concat_ws("/", "event_type", F.floor(F.col("user") / 150), F.floor(F.col("hour") / 720))
    return events.select(page.alias("page_id"), F.pmod("user", F.lit(150)).alias("y"), F.pmod("hour", F.lit(720)).alias("x")).distinct()


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 tile of 4 channels for each vector, 20 to a row, overlapping by half; a page for each 400."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("CAST(vec_id div 400 AS STRING)").alias("page_id"), F.expr("CAST(vec_id % 20 * 2 AS BIGINT)").alias("ox"),
        F.expr("CAST((vec_id div 20) % 20 * 2 AS BIGINT)").alias("oy"), F.lit(4).cast("long").alias("window"), F.lit(4).alias("channels"),
        F.col("embedding").alias("values"),
    )


def vector_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as the rows (page_id, layer, y, data) of pages 100 high and 64 wide."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.expr("CAST(vec_id div 100 AS STRING)").alias("page_id"), F.lit("v").alias("layer"), F.expr("CAST(vec_id % 100 AS BIGINT)").alias("y"), F.col("embedding").cast("array<double>").alias("data"))


#: Size of a page of staff lines.
STAFF_WIDTH, STAFF_HEIGHT = 720, 280


def staff_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal segments (page_id, y, x, length): three staffs of five lines on a page for each 150 customers.

    Ten customers draw a line, a segment for each of their orders; lines drop
    by a pixel every 240 and have gaps.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.expr("CAST(o_custkey div 150 AS STRING)").alias("page_id"), F.expr("o_custkey % 150 div 10").alias("slot"),
        F.expr("o_orderkey * 37 % 690").alias("x"), F.expr("4 + o_orderkey % 27").alias("length"),
    )
    y = F.expr("10 + slot div 5 * 90 + slot % 5 * 12 + x div 240")
    return orders.select("page_id", y.cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("length").cast("long").alias("length"))


def staff_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, y, x of every pixel of the segments."""
    drawn = staff_segments(spark, sf_dir).select("page_id", "y", F.explode(F.expr("sequence(x, x + length - 1)")).alias("x"))
    return drawn.distinct()


def staff_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = staff_segments(spark, sf_dir).select("page_id").distinct()
    return pages.select("page_id", F.lit(STAFF_WIDTH).cast("long").alias("width"), F.lit(STAFF_HEIGHT).cast("long").alias("height"))


def gapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (page_id, y, x) of pages of 15 lines, a line for each supplier: three segments with gaps, dropping by 0 to 2 pixels every 240."""
    lines = table(spark, sf_dir, "supplier").select(
        F.expr("CAST(s_suppkey div 15 AS STRING)").alias("page_id"), F.expr("10 + s_suppkey % 15 * 18").alias("top"), F.expr("s_suppkey % 3").alias("drop"),
        F.expr("150 + s_suppkey * 37 % 60").alias("a"), F.expr("20 + s_suppkey * 13 % 70").alias("a_gap"),
        F.expr("430 + s_suppkey * 53 % 60").alias("b"), F.expr("20 + s_suppkey * 29 % 90").alias("b_gap"),
    )
    spans = F.expr(f"array(named_struct('l', 0L, 'r', a), named_struct('l', a + a_gap, 'r', b), named_struct('l', b + b_gap, 'r', {STAFF_WIDTH}L))")
    drawn = lines.select("page_id", "top", "drop", F.explode(spans).alias("s")).select("page_id", "top", "drop", F.explode(F.expr("sequence(s.l, s.r - 1)")).alias("x"))
    return drawn.select("page_id", F.expr("CAST(top + x * drop div 240 AS BIGINT)").alias("y"), "x")


def gapped_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "supplier").select(F.expr("CAST(s_suppkey div 15 AS STRING)").alias("page_id")).distinct()
    return pages.select("page_id", F.lit(STAFF_WIDTH).cast("long").alias("width"), F.lit(STAFF_HEIGHT).cast("long").alias("height"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images (page_id, width, height, channels, data: bytes, blue first, with alpha) of the pages of gapped lines.

    Pages with an odd number have half the size: of each two by two pixels the
    last one.  Ink is 20, 40, 60 on paper of 230, 235, 240.
    """
    scale = F.expr("CAST(page_id AS BIGINT) % 2 + 1")
    spots = gapped_lines(spark, sf_dir).withColumn("k", scale).filter("k = 1 OR x % 2 = 1")
    # a line of one pixel must not fall between the rows that stay
    spots = spots.select("page_id", F.expr("y div k").alias("y"), F.expr("x div k").alias("x")).distinct()
    sizes = gapped_sizes(spark, sf_dir).withColumn("k", scale)
    sizes = sizes.select("page_id", F.expr("width div k").alias("width"), F.expr("height div k").alias("height"))
    rows = spots.groupBy("page_id", "y").agg(F.array_sort(F.collect_set("x")).alias("xs"))
    every = sizes.select("page_id", "width", "height", F.explode(F.expr("sequence(0L, height - 1)")).alias("y"))
    joined = by_merge(every, rows, ["page_id", "y"], "left")
    paper, ink = "'E6EBF0FF'", "'14283CFF'"
    bits = F.expr(
        f"IF(xs IS NULL, repeat({paper}, CAST(width AS INT)), array_join(flatten(array(transform(xs, (x, i) -> concat(repeat({paper}, "
        f"CAST(x - IF(i = 0, -1L, xs[i - 1]) - 1 AS INT)), {ink})), array(repeat({paper}, CAST(width - 1 - xs[size(xs) - 1] AS INT))))), ''))"
    )
    lines = joined.select("page_id", "width", "height", "y", bits.alias("bits"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "bits"))), lambda r: r["bits"]), "")
    return lines.groupBy("page_id", "width", "height").agg(F.unhex(whole).alias("data")).select("page_id", "width", "height", F.lit(4).alias("channels"), "data")
