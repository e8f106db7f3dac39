"""A table of vectors with logical deletes: tombstones are read along, and folders with many dead rows are rewritten.

Rows lie in folders by their id, with the version that wrote them; a change appends. A row is live
if it is the newest of its id and no tombstone of its version or a later one names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def append(path: str, vectors: DataFrame, version: int, folders: int = 16) -> None:
    """Adds ``vectors`` (vec_id, ...) below ``path``; they replace rows of their ids."""
    rows = vectors.withColumns({"version": F.lit(version).cast("long"), "folder": F.pmod("vec_id", F.lit(folders)).cast("int")})
    rows.repartition("folder", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("append").partitionBy("folder").parquet(f"{path}/rows")


def delete(path: str, ids: DataFrame, version: int) -> None:
    """Marks the rows of ``ids`` (vec_id) as deleted, as of ``version``."""
    ids.select("vec_id", F.lit(version).cast("long").alias("gone")).distinct().write.mode("append").parquet(f"{path}/tombstones")


def with_life(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows, with ``live``."""
    rows = spark.read.parquet(f"{path}/rows")
    stones = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/tombstones")
    newest = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("version").desc()))
    rows = rows.withColumn("nth", newest)
    if not stones.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(stones):
        return rows.withColumn("live", F.col("nth") == 1).drop("nth")
    gone = spark.read.parquet(f"{path}/tombstones").groupBy("vec_id").agg(F.max("gone").alias("gone"))
    return rows.join(gone, "vec_id", "left").withColumn("live", (F.col("nth") == 1) & (F.col("version") > F.coalesce("gone", F.lit(-1)))).drop("nth", "gone")


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """The live rows, by merge on read."""
    return with_life(spark, path).where("live").drop("live", "version", "folder")


def compact(spark: SparkSession, path: str, share: float = 0.2) -> DataFrame:
    """(folder, stored, dead, rewritten): rewrites the folders in which more than ``share`` of the rows are dead, and no others.

    Live rows of these folders are written aside first, so a job that is lost on the way leaves
    either the old rows of a folder or the new ones, which read the same.
    """
    rows = with_life(spark, path)
    counts = rows.groupBy("folder").agg(F.count("*").alias("stored"), F.count_if(~F.col("live")).alias("dead"))
    counts = stored(counts.withColumn("rewritten", F.col("dead") > share * F.col("stored")), "folders")
    folders = [r.folder for r in counts.where("rewritten and dead < stored").select("folder").collect()]  # a row a folder
    aside = stored(rows.where(F.col("live") & F.col("folder").isin(folders)).drop("live"), "live")
    aside.repartition("folder", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{path}/rows")
    for r in counts.where("rewritten and dead = stored").select("folder").collect():  # nothing left to write
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/folder={r.folder}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return counts
