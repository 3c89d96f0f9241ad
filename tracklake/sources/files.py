"""Camera cards: scanning files and describing their contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of the image formats.
MAGIC = {"jpeg": "FFD8FF", "png": "89504E470D0A1A0A", "bmp": "424D", "tiff": "49492A00", "tiff_be": "4D4D002A", "webp": "52494646"}


def sniffed_format(content):
    """Format by the first bytes; null if unknown.  WEBP also needs its name at byte 8."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        starts = F.hex(F.substring(content, 1, len(magic) // 2)) == magic
        if name == "webp":
            starts = starts & (F.hex(F.substring(content, 9, 4)) == "57454250")
        out = F.when(starts, name.removesuffix("_be")).otherwise(out)
    return out


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Files without content below ``root``: Spark's file sources leave them out, so they are taken from the listing.

    Only their names pass the driver, as in any listing of a folder.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    listing = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    rows = []
    while listing.hasNext():
        f = listing.next()
        if f.getLen() == 0:
            rows.append((f.getPath().toString(), f.getModificationTime(), 0))
    found = spark.createDataFrame(rows, "path string, ms long, length long")
    return found.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", F.lit(b"").alias("content"))


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, name, bytes, modified_at, format, sha256, corrupt and flags of every file below ``root``.

    Files without a known format or content are corrupt, with a reason among the flags; their hash is that of their
    path, so they are no duplicates of each other.  Nothing is collected; the listing gives the partitions.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).unionByName(empty_files(spark, root))
    kind = sniffed_format(F.col("content"))
    reason = F.when(F.col("length") == 0, "empty").when(kind.isNull(), "unknown_format")
    df = files.withColumn("format", kind).withColumn("reason", reason)
    return df.select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("folder"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
        "format",
        F.when(F.col("reason").isNull(), F.sha2("content", 256)).otherwise(F.sha2("path", 256)).alias("sha256"),
        F.col("reason").isNotNull().alias("corrupt"),
        F.array_compact(F.array(F.col("reason"))).alias("flags"),
    )


def shaped_images(scanned: DataFrame, run_id: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image rows of a scan, without copies inside it and without ids in ``known`` (image_id); and the counts of what was left out."""
    from tracklake.operators.changes import first_by_hash

    first = first_by_hash(scanned, "sha256", "path")
    rows = first.select(F.substring("sha256", 1, 16).alias("image_id"), F.lit(run_id).alias("run_id"), F.when(F.col("corrupt"), "CORRUPT").otherwise("pending").alias("status"), "path", "folder", "name", "bytes", F.to_json("flags").alias("flags"))
    new = rows.join(known.select("image_id"), "image_id", "left_anti")
    counts = scanned.agg(F.count("*").alias("files"), F.count_if("corrupt").alias("corrupt"), (F.count("*") - F.countDistinct("sha256")).alias("copies"))
    return new, counts


def preflight(scanned: DataFrame, free_bytes: int) -> DataFrame:
    """Files, MB, MB needed with a tenth to spare, and a warning."""
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    needed = F.round(total * 1.1 / 1048576, 1)
    warning = F.when(F.count("*") == 0, "no files").when(total * 1.1 > free_bytes, "not enough space")
    return scanned.agg(F.count("*").alias("files"), F.round(total / 1048576, 1).alias("mb"), needed.alias("needed_mb"), warning.alias("warning"))


def annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """images (id, file_name, location, date_captured) and annotations (image_id, category_id) of an annotation file in JSON, as ``lists.image_truth`` takes them."""
    schema = "images array<struct<id:string,file_name:string,location:string,date_captured:string>>, annotations array<struct<image_id:string,category_id:int>>"
    whole = spark.read.schema(schema).option("multiLine", "true").json(path)
    return whole.select(F.inline("images")), whole.select(F.inline("annotations"))


def found_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """``images`` whose file was found (``files``: name, path), with its path; of files of one name the first by path."""
    return images.join(files.groupBy(F.col("name").alias("file_name")).agg(F.min("path").alias("orig_path")), "file_name")
