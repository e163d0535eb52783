"""Library views: search, sort orders, and single-row changes of the scores table, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("original_file_path", T.StringType(), False),
        T.StructField("music_xml_path", T.StringType()),
        T.StructField("import_date", T.LongType(), False),
        T.StructField("last_opened_date", T.LongType()),
        T.StructField("page_count", T.IntegerType(), False),
        T.StructField("is_favorite", T.BooleanType(), False),
        T.StructField("last_viewed_page", T.IntegerType(), False),
        T.StructField("last_viewed_zoom", T.FloatType(), False),
        T.StructField("practice_progress", T.FloatType(), False),
        T.StructField("notes", T.StringType()),
    ]
)
#: Names of the application's object for the stored columns, in order.
DOMAIN = ("id", "title", "originalFilePath", "musicXmlPath", "importDate", "lastOpenedDate", "pageCount", "isFavorite",
          "lastViewedPage", "lastViewedZoom", "practiceProgress", "notes")


def to_domain(scores: DataFrame) -> DataFrame:
    return scores.select(*[F.col(f.name).alias(n) for f, n in zip(SCHEMA, DOMAIN)])


def to_entity(scores: DataFrame) -> DataFrame:
    return scores.select(*[F.col(n).cast(f.dataType).alias(f.name) for f, n in zip(SCHEMA, DOMAIN)])


def newest() -> list[Column]:
    return [F.desc("import_date"), F.col("id").asc()]


def newest_first(scores: DataFrame) -> DataFrame:
    return scores.orderBy(*newest())


def by_id(scores: DataFrame, score_id: int) -> DataFrame:
    return scores.filter(F.col("id") == score_id)


def favorites(scores: DataFrame) -> DataFrame:
    return newest_first(scores.filter("is_favorite"))


def search(scores: DataFrame, query: str) -> DataFrame:
    """Titles that contain the query, case apart; a blank query keeps all, others are not trimmed."""
    return scores if not query.strip() else scores.filter(F.contains(F.lower("title"), F.lower(F.lit(query))))


SORTS = {
    "NAME": lambda: [F.lower("title").asc()],
    "DATE_IMPORTED": lambda: [],
    "RECENTLY_PRACTICED": lambda: [F.coalesce("last_opened_date", F.lit(0)).desc()],
}


def view_order(sort: str) -> list[Column]:
    """Favourites first in the given order; ties by newest import, then id."""
    return [F.desc("is_favorite"), *SORTS[sort](), *newest()]


def library_view(scores: DataFrame, query: str = "", sort: str = "DATE_IMPORTED") -> DataFrame:
    return search(scores, query).orderBy(*view_order(sort))


def placed(scores: DataFrame, order: list[Column], within: str) -> DataFrame:
    """Adds place: where a row stands in the order among the rows that share ``within``, from 1."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*order)))


def library_is_empty(scores: DataFrame) -> DataFrame:
    return scores.agg((F.count("*") == 0).alias("all_scores_empty"))


def set_column(scores: DataFrame, score_id: int, column: str, value: Column) -> DataFrame:
    """One column of one row; the other rows pass through."""
    kind = scores.schema[column].dataType
    return scores.withColumn(column, F.when(F.col("id") == score_id, value.cast(kind)).otherwise(F.col(column)))


def set_last_opened(scores: DataFrame, score_id: int, at: int) -> DataFrame:
    return set_column(scores, score_id, "last_opened_date", F.lit(at))


def set_last_viewed_page(scores: DataFrame, score_id: int, page: int) -> DataFrame:
    return set_column(scores, score_id, "last_viewed_page", F.lit(page))


def set_last_viewed_zoom(scores: DataFrame, score_id: int, zoom: float) -> DataFrame:
    return set_column(scores, score_id, "last_viewed_zoom", F.lit(zoom))


def set_practice_progress(scores: DataFrame, score_id: int, progress: float) -> DataFrame:
    return set_column(scores, score_id, "practice_progress", F.lit(progress))


def set_music_xml_path(scores: DataFrame, score_id: int, path: str) -> DataFrame:
    return set_column(scores, score_id, "music_xml_path", F.lit(path))


def toggle_favorite(scores: DataFrame, score_id: int) -> DataFrame:
    return set_column(scores, score_id, "is_favorite", ~F.col("is_favorite"))


def rename(scores: DataFrame, score_id: int, title: str) -> DataFrame:
    """The trimmed title, unless that is empty."""
    return set_column(scores, score_id, "title", F.lit(title.strip())) if title.strip() else scores


def changed_views(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of the wanted (id, page, zoom), those that differ from what is stored."""
    old = scores.select("id", "last_viewed_page", "last_viewed_zoom")
    same = F.col("page").eqNullSafe(F.col("last_viewed_page")) & F.col("zoom").eqNullSafe(F.col("last_viewed_zoom"))
    return wanted.join(old, "id").filter(~same).select("id", "page", "zoom")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds number, from 1 in the order given: ranges are numbered apart, and only one row a range is counted through."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "ordered").withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))
    told = placed.join(counts, "__part").withColumn("number", F.col("__before") + F.col("__at") - F.shiftleft("__part", 33) + 1)
    return told.drop("__part", "__at", "__before")


def insert_rows(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """The scores with new rows: id 0 or null gets the next ids in order of title and path; an id that exists raises.

    Written back, it is the table after the insert; an append of the new rows alone is ``new_rows``.
    """
    return scores.unionByName(new_rows(scores, rows))


def new_rows(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of an insert with their ids: given ones checked against the table and each other, the others made."""
    fresh = F.coalesce(F.col("id") == 0, F.lit(True))
    given = rows.filter(~fresh)
    known = given.join(scores.select("id", F.lit(True).alias("__known")), "id", "left").withColumn("__times", F.count("*").over(Window.partitionBy("id")))
    free = F.assert_true(F.col("__known").isNull() & (F.col("__times") == 1), F.lit("a score with this id exists")).isNull()
    given = known.filter(free).select(*scores.columns)
    top = scores.select("id").unionByName(rows.filter(~fresh).select("id")).agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    made = numbered(rows.filter(fresh).drop("id"), [F.col("title"), F.col("original_file_path")])
    made = made.join(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("number"))  # one row: the greatest id
    return given.unionByName(made.select(*scores.columns))


def delete_with_files(scores: DataFrame, score_id: int) -> DataFrame:
    """The scores without a row, whose files are removed as far as they are there.  Written back, it is the table after the delete."""
    spark = scores.sparkSession
    gone = by_id(scores, score_id).select("original_file_path", "music_xml_path").first()
    for path in gone or ():
        if path:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            try:
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, False)
            except Exception:  # noqa: BLE001  a file that cannot go must not keep the row
                pass
    return scores.filter(F.col("id") != score_id)


def replace_rows(scores: DataFrame, rows: DataFrame) -> DataFrame:
    """Whole rows by id; ids that are not stored are ignored."""
    known = rows.join(scores.select("id"), "id", "left_semi").select(*scores.columns)
    return scores.join(known.select("id"), "id", "left_anti").unionByName(known)


def delete_rows(scores: DataFrame, ids: DataFrame) -> DataFrame:
    return scores.join(ids.select("id"), "id", "left_anti")
