"""Readers and writers of the catalogue's files: JSON metadata, subtitles, logs and media listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuemill.functions.numbers import ass_time, srt_time
from cuemill.functions.text import escape_ass, redact, squeeze

SEGMENT = "start double, end double, text string, language string, language_confidence double, timing_source string, source_language string"
MEDIA = ("mp4", "mov", "mkv", "webm", "avi", "m4v")


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """``raw`` and ``path`` of whole JSON files, for ``operators.migrate``; broken ones stay readable."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("path"))


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """``raw`` and ``pos`` of the objects of JSON array files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw"), F.col("_metadata.file_path").alias("path"))


def parse_segments(texts: DataFrame, text: str = "value", key: str = "path") -> DataFrame:
    """key, seq and the fields of the segments of JSON array texts, in their order."""
    each = texts.select(key, F.posexplode(F.from_json(text, f"array<struct<{SEGMENT.replace(' double', ':double').replace(' string', ':string')}>>")).alias("seq", "s"))
    return each.select(key, "seq", "s.*")


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON array files in their order: path, seq and the fields."""
    return parse_segments(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))


def parse_srt(texts: DataFrame, text: str = "value", key: str = "path") -> DataFrame:
    """key, seq, start, end, text of subtitle texts: blocks parted by blank lines, other blocks left out."""
    pattern = r"(?s)^\s*(?:\d+\s*\n)?\s*(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)[^\n]*\n?(.*)$"
    blocks = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+")).alias("seq", "block")).filter(F.col("block").rlike(pattern))
    part = lambda i: F.regexp_extract("block", pattern, i)
    seconds = lambda i: F.round(part(i).cast("double") * 3600 + part(i + 1).cast("double") * 60 + part(i + 2).cast("double") + F.rpad(part(i + 3), 3, "0").cast("double") / 1000, 3)
    return blocks.select(key, "seq", seconds(1).alias("start"), seconds(5).alias("end"), squeeze(part(9)).alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    return parse_srt(spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")))


def to_srt(cues: DataFrame, by: str, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """One subtitle text a key, its cues numbered from 1 by time."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(start, end, text))
    block = F.format_string("%d\n%s --> %s\n%s\n", n, srt_time(F.col(start)), srt_time(F.col(end)), F.col(text))
    return cues.select(by, n.alias("n"), block.alias("block")).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n").alias("value"))


def to_ass_events(cues: DataFrame, start: str = "start", end: str = "end", text: str = "text") -> DataFrame:
    """Event lines of a positioned subtitle file."""
    return cues.withColumn("value", F.concat(F.lit("Dialogue: 0,"), ass_time(F.col(start)), F.lit(","), ass_time(F.col(end)), F.lit(",Default,,0,0,0,,"), escape_ass(F.col(text))))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """path, seq and value of log lines; the order inside a file is that of its lines."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("seq", "value"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size and modified of the files below a folder, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def media_files(files: DataFrame, most_bytes: int = 10**10) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): by extension and size, paths once, by name without regard to case."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    named = files.dropDuplicates(["path"]).withColumn("name", F.regexp_extract("path", r"([^/\\]+)$", 1)).withColumn("ok", extension.isin(*MEDIA) & (F.col("size") > 0) & (F.col("size") < most_bytes))
    return named.filter("ok").drop("ok").orderBy(F.lower("name"), "path"), named.filter("not ok").drop("ok")


def recent_files(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("modified"), "path").limit(n)


def write_redacted(lines: DataFrame, path: str, text: str = "value") -> None:
    """Log lines without credentials and personal paths, for support."""
    lines.select(redact(F.col(text)).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Replaces a table; Spark's commit shows all of it or nothing."""
    rows.write.mode("overwrite").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def unchanged(rows: DataFrame, kept: DataFrame) -> bool:
    """Whether a write would change nothing."""
    return rows.exceptAll(kept).isEmpty() and kept.exceptAll(rows).isEmpty()
