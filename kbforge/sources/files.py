"""Directories of text files, event logs, question-and-answer exports, tables in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import stored

TEXT_FILES = r"(?i)\.(?:md|txt|json|csv|html?|xml|ya?ml|log)$"
SKIPPED = r"(?:^|/)(?:~\$[^/]*|Thumbs\.db)$"
EVENTS = "ts timestamp, baseline string, type string, id string, payload string"


def scan_text_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): path, size and text of the supported files below ``folder``, and those that are no UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.col("path").rlike(TEXT_FILES) & ~F.col("path").rlike(SKIPPED))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.where(good).select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    return rows, files.where(~good).select("path", F.col("length").alias("size"), F.lit("no UTF-8").alias("error"))


def scan_text_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): path and each line of the files that ``scan_text_files`` takes, and the same errors.

    Files are read in splits, so a task holds a line, not a file; what is no UTF-8 is found in a pass before.
    """
    of = F.col("_metadata")
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(folder)
    lines = lines.select(of["file_path"].alias("path"), of["file_size"].alias("size"), F.col("value").alias("line"))
    lines = lines.where(F.col("path").rlike(TEXT_FILES) & ~F.col("path").rlike(SKIPPED))
    bad = stored(lines.where(~F.is_valid_utf8("line")).select("path", "size").distinct(), "bad")  # written, so that a short list meets the lines without a shuffle
    return lines.join(bad.select("path"), "path", "left_anti").select("path", "line"), bad.withColumn("error", F.lit("no UTF-8"))


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Events of a JSON-lines log; malformed lines and those without baseline or type are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("baseline").isNotNull() & F.col("type").isNotNull())


def append_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))


def pipe_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, row): rows of Markdown tables as maps from header to cell; separator rows go, short rows are filled with ''."""
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    piped = F.startswith(F.trim("line"), F.lit("|"))
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("table", F.sum((~piped).cast("int")).over(by)).where(piped & ~F.trim("line").rlike(r"^\|[ :|-]+\|?$"))
    first = F.first("line").over(Window.partitionBy(key, "table").orderBy("line_no"))
    start = F.min("line_no").over(Window.partitionBy(key, "table"))
    lines = lines.withColumn("header", _cells(first)).withColumn("cells", _cells(F.col("line"))).withColumn("start", start).where("line_no > start")
    filled = F.transform("header", lambda h, i: F.coalesce(F.get("cells", i), F.lit("")))
    return lines.select(key, F.col("line_no").cast("long").alias("line_no"), F.map_from_arrays("header", filled).alias("row"))


def activity_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, source, summary) of lines ``- ts ｜ /source ｜ summary``."""
    lines = docs.select(key, F.explode(F.split(text, "\n")).alias("line"))
    pattern = r"^- *([^｜]+?) *｜ *(/[^｜]*?) *｜ *(.*)$"
    return lines.where(F.col("line").rlike(pattern)).select(key, *[F.regexp_extract("line", pattern, n).alias(c) for n, c in ((1, "at"), (2, "source"), (3, "summary"))])
