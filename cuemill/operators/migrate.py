"""Metadata of older versions brought to the present one on reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.numbers import clamped_int
from cuemill.functions.text import identity_key, watermark

VIDEO_VERSION, PROJECT_VERSION = 8, 4
# Fixed values: (least, greatest, default) of the bounded settings.
VIDEO_LIMITS = {"original_video_volume": (0, 100, 60), "background_music_volume": (0, 100, 30), "tts_volume": (0, 100, 100)}
STYLE_LIMITS = {"font_size": (10, 120, 42), "position_x_percent": (0, 100, 50), "position_y_percent": (0, 100, 86), "box_width_percent": (20, 100, 80), "box_height_percent": (1, 100, 12)}
CROP_LIMITS = {"zoom_percent": (1, 400, 100), "pan_x_percent": (-100, 100, 0), "pan_y_percent": (-100, 100, 0), "left_percent": (0, 84, 0), "right_percent": (0, 84, 0), "top_percent": (0, 84, 0), "bottom_percent": (0, 84, 0)}


# Every field is read as text first: a value of another type must not lose the row.
_VIDEO = "schema_version string, video_id string, project_name string, status string, progress string, watermark_text string, files map<string,string>, checkpoints map<string,string>, " + ", ".join(
    [f"{n} string" for n in VIDEO_LIMITS] + [f"{k} struct<{', '.join(f'{n}: string' for n in v)}>" for k, v in (("subtitle_style", STYLE_LIMITS), ("crop", CROP_LIMITS))]
)
_PROJECT = "schema_version string, key string, name string, directory string, project_type string"


def _bounded(source: Column, limits: dict) -> list[Column]:
    return [clamped_int(source[name].try_cast("double"), *limit).alias(name) for name, limit in limits.items()]


def _parsed(rows: DataFrame, raw: str, schema: str, newest: int) -> DataFrame:
    """``rows`` with ``r``, parsed once, its ``version`` and the ``reason`` to reject it, if any."""
    out = rows.withColumn("r", F.from_json(raw, schema))
    out = out.withColumn("version", F.coalesce(F.col("r")["schema_version"].try_cast("int"), F.lit(1)))
    broken = ~F.coalesce(F.get_json_object(raw, "$").startswith("{"), F.lit(False))
    return out.withColumn("reason", F.when(broken, "corrupt").when(F.col("version") > newest, "newer version"))


def migrate_videos(rows: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(videos, rejected) of JSON objects: missing fields get defaults, numbers are clamped, version becomes the present one.

    Rejected, with ``reason``: rows that are no JSON object, and those of a newer version.
    """
    judged, r, none = _parsed(rows, raw, _VIDEO, VIDEO_VERSION), F.col("r"), F.create_map().cast("map<string,string>")
    status = F.coalesce(F.nullif(r["status"], F.lit("")), F.lit("pending"))
    videos = judged.filter("reason is null").select(
        F.lit(VIDEO_VERSION).alias("schema_version"), r["video_id"].alias("video_id"), F.coalesce(r["project_name"], F.lit("")).alias("project_name"),
        F.when((F.col("version") < 3) & (status == "error"), "failed").otherwise(status).alias("status"), clamped_int(r["progress"].try_cast("double"), 0, 100, 0).alias("progress"),
        *_bounded(r, VIDEO_LIMITS), F.struct(*_bounded(r["subtitle_style"], STYLE_LIMITS)).alias("subtitle_style"), F.struct(*_bounded(r["crop"], CROP_LIMITS)).alias("crop"), watermark(r["watermark_text"]).alias("watermark_text"),
        F.coalesce(r["files"], none).alias("files"), F.coalesce(r["checkpoints"], none).alias("checkpoints"),
    )
    return videos, judged.filter("reason is not null").drop("r", "version")


def migrate_projects(rows: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(projects, rejected) of JSON objects; a project without key gets one of its name and directory."""
    judged, r = _parsed(rows, raw, _PROJECT, PROJECT_VERSION), F.col("r")
    name, directory, kind = (F.coalesce(r[c], F.lit(d)) for c, d in (("name", ""), ("directory", ""), ("project_type", "single")))
    projects = judged.filter("reason is null").select(
        F.lit(PROJECT_VERSION).alias("schema_version"), F.coalesce(F.nullif(r["key"], F.lit("")), F.sha2(identity_key(name, directory), 256)).alias("project_key"), name.alias("name"), directory.alias("directory"),
        F.when(kind.isin("single", "batch", "download", "publish"), kind).otherwise("single").alias("project_type"),
    )
    return projects, judged.filter("reason is not null").drop("r", "version")


def rewrite_paths(rows: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Values of a map of paths moved from one root to another."""
    return rows.withColumn(column, F.transform_values(column, lambda k, v: F.when(v.startswith(old), F.concat(F.lit(new), F.substring(v, len(old) + 1, F.length(v)))).otherwise(v)))
