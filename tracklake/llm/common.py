"""What several corpus operators share: reading tables, shared storage, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracklake.storage import checkpointed, packed, shared_folder

__all__ = ["SPACE", "bounded_texts", "checkpointed", "numbered", "packed", "portable_hash", "private", "removed", "shared_folder", "table", "text_or_empty"]

#: White space that separates words in most contracts: blank, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def removed(spark: SparkSession, at: str) -> None:
    """Removes a file or folder that Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def portable_hash(*columns: Column) -> Column:
    """60-bit non-negative hash of the columns' texts that any engine with SHA-256 can repeat; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def bounded_texts(docs: DataFrame, chosen: DataFrame, most_bytes: int) -> DataFrame:
    """One row of ``docs`` for each of the ``chosen`` ids (doc_id, a bounded number), with at most ``most_bytes`` of text in all.

    Of several rows of an id the text of the smallest SHA-256 counts.  Ids come in the order of a hash; one whose text no
    longer fits is passed over.  The driver sees ids, digests and sizes alone.  Returns doc_id and text.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id")
    sized = rows.select("doc_id", F.struct(F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size")).alias("own"))
    found = sized.groupBy("doc_id").agg(F.min("own").alias("own")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, total = [], 0
    for r in found:
        if total + r["own"]["size"] <= most_bytes:
            taken.append((r["doc_id"], r["own"]["digest"]))
            total += r["own"]["size"]
    kind = rows.schema["doc_id"].dataType
    picked = docs.sparkSession.createDataFrame(taken, StructType([StructField("picked", kind), StructField("digest", StringType())]))
    same = (F.col("doc_id") == F.col("picked")) & (F.sha2("text", 256) == F.col("digest"))
    return rows.join(F.broadcast(picked), same).groupBy("doc_id").agg(F.min("text").alias("text"))


def private(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has (names are compared without case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, count: str, name: str) -> DataFrame:
    """Every row as often as its column ``count`` says, numbered from 0 in ``name``; in two steps, so that no array is as long as the count."""
    block, step = private("block", df), 4096
    blocks = df.filter(F.col(count) > 0).withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(step).cast("long"))))
    return blocks.withColumn(name, F.explode(F.sequence(F.col(block), F.least(F.col(block) + step, F.col(count)) - 1))).drop(block)
