"""JSON-lines audit log and report files: sinks, tails, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroudline.functions.text import csv_cell

#: A line of the log: the request without its image.
LINE = "taskId string, iteration int, prompt string, siteConfigId string, _receivedAt double, body string, _corrupt_record string"


def append_log(entries: DataFrame, folder: str, rows_per_file: int = 100_000) -> None:
    """Append entries as JSON lines; the file sink rotates by rows."""
    entries.write.mode("append").option("maxRecordsPerFile", rows_per_file).json(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """All readable lines; broken ones are left out."""
    lines = spark.read.text(folder).select(F.from_json("value", LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return lines.where("r is not null and r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def tail(log: DataFrame, n: int) -> DataFrame:
    """The newest n lines, n between 1 and 500: a top-k report."""
    return log.orderBy(F.desc("_receivedAt"), "taskId", "iteration").limit(max(1, min(500, n)))


def retained(images: DataFrame, by: list[str], time: str, tie: str, keep: int = 500) -> DataFrame:
    """The newest ``keep`` of each group; older ones may be deleted."""
    return images.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(time), tie))).where(F.col("age") <= keep).drop("age")


def csv_lines(items: DataFrame, columns: list[str]) -> DataFrame:
    """One text line per row, cells quoted only where needed."""
    return items.select(F.concat_ws(",", *[csv_cell(F.col(c).cast("string")) for c in columns]).alias("value"))


def write_report(items: DataFrame, columns: list[str], folder: str) -> None:
    """The report as CSV files with a header."""
    items.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


#: Fixed value: a log file of more bytes is rotated.
FILE_BYTES = 20_000_000


def rotated(entries: DataFrame, by: list[str], order: list[str], line: str, most: int = FILE_BYTES, keep: int = 2) -> DataFrame:
    """The lines of the newest ``keep`` files of each log, with the number of their file: a file takes lines until it holds ``most`` bytes."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(F.octet_length(line) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = entries.withColumn("file", F.floor(before / most).cast("bigint"))
    return placed.withColumn("last", F.max("file").over(Window.partitionBy(*by))).where(F.col("file") > F.col("last") - keep).drop("last")


def recent(log: DataFrame, time: str, tie: str, n: int = 20) -> DataFrame:
    """The newest entries by arrival: a ring of n, 100 at most."""
    return log.orderBy(F.desc(time), F.desc(tie)).limit(max(1, min(100, n)))


def markdown_lines(items: DataFrame, by: str, title: Column, notes: Column, images: Column, count: Column) -> DataFrame:
    """(by, report): a report of notes array<struct<label,text>>, saved images array<struct<filename,caption>> and a count of items."""
    note = F.transform(F.coalesce(notes, F.array().cast("array<struct<label:string,text:string>>")), lambda n: F.concat(F.lit("- "), F.when(F.coalesce(n["label"], F.lit("")) != "", F.concat(F.lit("**"), n["label"], F.lit(":** "))).otherwise(""), n["text"]))
    image = F.transform(F.coalesce(images, F.array().cast("array<struct<filename:string,caption:string>>")), lambda i: F.concat(F.lit("- `"), i["filename"], F.lit("`"), F.when(F.coalesce(i["caption"], F.lit("")) != "", F.concat(F.lit(" — "), i["caption"])).otherwise("")))
    part = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(head), F.lit("")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    closing = F.when(count > 0, F.array(F.concat(F.lit("## Collected items ("), count.cast("string"), F.lit(") — see report.csv for full data")), F.lit(""))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(F.concat(F.lit("# "), F.coalesce(title, F.lit("Task report"))), F.lit("")), part("## Notes", note), part("## Saved images", image), closing)
    return items.select(by, F.array_join(lines, "\n").alias("report"))


def bundle(facts: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(by, bundle): the rows of each group as one JSON text, in order of their columns; a group's facts are a bounded list."""
    return facts.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*columns))), {"ignoreNullFields": "false"}).alias("bundle"))


def unbundled(bundles: DataFrame, by: str, schema: str) -> DataFrame:
    """The rows of bundles read back; a bundle that cannot be read gives none."""
    return bundles.select(by, F.explode(F.from_json("bundle", f"array<struct<{schema}>>")).alias("r")).select(by, "r.*")
