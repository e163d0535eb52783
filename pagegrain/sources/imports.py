"""Import of files: accept, name without clashes, count pages, and one outcome row a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _numbered(names: DataFrame) -> DataFrame:
    """clean, number of every name (file) that is another one with `` (number)`` before its suffix."""
    base, suffix = S.split_name(F.col("file"))
    told = names.select(base.alias("base"), suffix.alias("suffix"))
    number = F.regexp_extract("base", r"^.* \(([1-9][0-9]{0,8})\)$", 1)
    told = told.filter(number != "").select(F.concat(F.regexp_replace("base", r" \([1-9][0-9]{0,8}\)$", ""), "suffix").alias("clean"), number.cast("long").alias("number"))
    return told.distinct()


def free_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """file_id, name and the free ``file`` for it: `` (1)``, `` (2)`` ... before the last dot.

    Names are sanitised first.  Of the files of one sanitised name the first by
    file_id keeps it, unless it is taken; the others get the numbers whose
    names neither ``taken`` (file) nor any file of the batch has, in order.
    The k-th free number is k plus how many used ones have under k free ones
    before them, so one running count over a name's files and used numbers
    finds all of them.
    """
    clean = names.select("file_id", "name", S.sanitised(F.col("name")).alias("clean"))
    stored = taken.select("file").distinct()
    used = _numbered(stored.union(clean.select("clean")))
    before = F.row_number().over(Window.partitionBy("clean").orderBy("number"))
    used = used.select("clean", (F.col("number") - before).alias("key"), F.lit(1).alias("used"))
    own = stored.select(F.col("file").alias("clean"), F.lit(1).alias("own"))
    place = F.row_number().over(Window.partitionBy("clean").orderBy("file_id")) - F.when(F.col("own").isNull(), 1).otherwise(0)
    rows = clean.join(own, "clean", "left").select("clean", place.cast("long").alias("key"), F.lit(0).alias("used"), "file_id", "name")
    # at equal keys a file comes before a used number: as many free ones as it asks for lie below
    count = F.sum("used").over(Window.partitionBy("clean").orderBy("key", "used").rowsBetween(Window.unboundedPreceding, 0))
    number = F.col("key") + F.when(F.col("key") > 0, count).otherwise(0)
    chosen = rows.unionByName(used, allowMissingColumns=True).withColumn("number", number).filter("used = 0")
    base, suffix = S.split_name(F.col("clean"))
    file = F.when(F.col("number") == 0, F.col("clean")).otherwise(F.concat(base, F.lit(" ("), F.col("number").cast("string"), F.lit(")"), suffix))
    return chosen.select("file_id", "name", file.alias("file"))


def page_count(content: Column) -> Column:
    """Page objects named in a PDF's plain bytes; 1 where none can be seen, as for a file that cannot be read."""
    seen = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page(?![A-Za-z])"))
    return F.greatest(F.lit(1), F.coalesce(seen, F.lit(0)))


def copy_files(files: DataFrame, outcomes: DataFrame, folder: str) -> DataFrame:
    """Keeps the accepted files' bytes: appends (path, content) to the Parquet table ``folder``; returns path and bytes of each.

    A file that could not be read (null content) raises.
    """
    chosen = outcomes.filter("status = 'Success'").select("file_id", F.col("original_file_path").alias("path"))
    readable = F.assert_true(F.col("content").isNotNull(), F.lit("a file could not be read")).isNull()
    files.select("file_id", "content").join(chosen, "file_id").filter(readable).select("path", "content").write.mode("append").parquet(folder)
    return files.sparkSession.read.parquet(folder).select("path", F.length("content").cast("long").alias("bytes"))


def plan_imports(files: DataFrame, taken: DataFrame, now: int, folder: str = "scores") -> DataFrame:
    """An outcome for each file (file_id, path, mime, and content, or null): status, message, and the new score's columns."""
    named = files.withColumn("name", S.display_name(F.col("path")))
    ok = S.accepted(F.col("mime"), F.col("name"))
    names = free_names(named.filter(ok).select("file_id", F.coalesce("name", F.lit(f"score_{now}")).alias("name")), taken)
    pages = F.when(S.is_pdf(F.col("mime"), F.col("name")), page_count(F.col("content"))).otherwise(1) if "content" in files.columns else F.lit(1)
    joined = named.drop("name").withColumn("name", S.display_name(F.col("path"))).join(names.select("file_id", "file"), "file_id", "left")
    done = F.col("file").isNotNull()
    return joined.select(
        "file_id",
        F.when(done, "Success").otherwise("Failure").alias("status"),
        F.when(~done, F.lit("unsupported file type")).alias("message"),
        F.when(done, S.stem(F.col("file"))).alias("title"),
        F.when(done, F.concat(F.lit(folder + "/"), "file")).alias("original_file_path"),
        F.when(done, F.lit(now)).alias("import_date"),
        F.when(done, pages).cast("int").alias("page_count"),
    )


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file_id, path, mime (null: unknown), content of all files, in order of path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file_id"), "path", F.lit(None).cast("string").alias("mime"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """page_id, height, width, channels and BGR bytes of every decodable image; others are dropped by the source."""
    images = spark.read.format("image").option("dropInvalid", "true").load(path)
    return images.select(
        F.col("image.origin").alias("page_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data"
    )
