"""Files and lines that jobs leave: which file a video has, log and event lines, assets, devices, and states that are valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.geometry import GIB, is_inside
from cuemill.functions.links import bound

# Fields of a build's description that go into a report, and file kinds of downloads.
BUILD_FIELDS = (
    "application", "version", "build_id", "built_at_utc", "git_commit", "git_branch", "git_dirty", "python", "packaging", "model_delivery", "model_storage", "bundled_cpu_model", "bundled_gpu_model", "bundled_whisper_model",
    "bundled_demucs_model", "bundled_alignment_models",
)
DOWNLOADS = ("mkv", "mov", "mp4", "webm")
STAGGER_STEP = 0.15


def downloaded_file(jobs: DataFrame, named: DataFrame, files: DataFrame, key: str, workspace: str, extensions: Sequence[str] = DOWNLOADS) -> DataFrame:
    """``jobs`` with ``path``: what a download left in its workspace.

    ``named`` (key, position, path) are the files that the download named, tried in order, each with its own extension and then with
    the others; ``files`` (path, modified) are those that exist. The first that exists inside the workspace with a known
    extension counts, else the newest such file directly in the workspace, else null.
    """
    known = files.select(F.col("path").alias("path"), "modified").filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    tried = F.concat(F.array("path"), F.array(*[F.concat(stem, F.lit(f".{e}")) for e in sorted(extensions)]))
    candidates = named.filter("coalesce(path, '') <> ''").select(key, "position", F.posexplode(tried).alias("turn", "path"))
    named_ones = candidates.join(jobs.select(key, workspace), key).filter(is_inside(F.col("path"), F.col(workspace))).join(known.select("path"), "path", "left_semi")
    best = named_ones.groupBy(key).agg(F.min_by("path", F.struct("position", "turn")).alias("__named"))
    parent = known.select("path", "modified", F.regexp_replace("path", "/[^/]*$", "").alias(workspace))
    newest = jobs.select(key, workspace).join(parent, workspace).groupBy(key).agg(F.max_by("path", F.struct("modified", "path")).alias("__newest"))
    return jobs.join(best, key, "left").join(newest, key, "left").withColumn("path", F.coalesce("__named", "__newest")).drop("__named", "__newest")


def resolved_file(videos: DataFrame, files: DataFrame, key: str, kinds: Sequence[str], fallback: Column) -> DataFrame:
    """``videos`` (with a map column ``files``) with ``path``: the first of the files under ``kinds`` that exists, else ``fallback``
    if that exists, else what the first kind names, else ``fallback``."""
    named = [F.nullif(F.try_element_at("files", F.lit(k)), F.lit("")) for k in kinds]
    each = videos.select(key, F.posexplode(F.array(*named, fallback)).alias("turn", "path")).filter("path is not null").join(files.select("path"), "path", "left_semi")
    found = each.groupBy(key).agg(F.min_by("path", "turn").alias("__found"))
    return videos.join(found, key, "left").withColumn("path", F.coalesce("__found", named[0], fallback)).drop("__found")


def log_lines(messages: DataFrame, videos: DataFrame, key: str, at: str, message: str) -> DataFrame:
    """key and ``line`` of the messages of known videos: the time in UTC in brackets, then the message."""
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return messages.join(videos.select(key).distinct(), key, "left_semi").select(key, F.concat(F.lit("["), stamp, F.lit("] "), F.col(message)).alias("line"))


def append_log(lines: DataFrame, path: str) -> None:
    """Adds log lines to a folder of text files; what is there stays."""
    lines.select("line").write.mode("append").text(path)


def ascii_json(payload: Column) -> Column:
    """A struct as one line of JSON in ASCII: other characters as escaped UTF-16 units."""
    parts = F.regexp_extract_all(F.to_json(payload), F.lit(r"([\x00-\x7F]+|[^\x00-\x7F])"), F.lit(1))
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    return F.array_join(F.transform(parts, lambda c: F.when(c.rlike(r"^[\x00-\x7F]"), c).otherwise(units(c))), "")


def build_information(payload: Column) -> Column:
    """Of a map of a build's description the fields that may go into a report."""
    return F.map_filter(F.coalesce(payload, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*BUILD_FIELDS))


def required_assets(assets: DataFrame, device: str, role: str = "device") -> DataFrame:
    """The assets of all devices and those of one: "gpu", or "cpu" for anything else."""
    return assets.filter(F.col(role).isNull() | (F.col(role) == ("gpu" if device == "gpu" else "cpu")))


def device_verdict(preference: Column, machine: Column) -> Column:
    """``ok`` and ``message`` for processing on "gpu" or "cpu" (also for anything else).

    ``machine``: cuda, cuda_name, ac_powered (null if not known), total_vram, free_vram, ram (bytes, 0 if not known), cpus.
    """

    def judge(m: Column) -> Column:
        gb = lambda c, places: F.format_string(f"%.{places}f", c / GIB)
        no = lambda *parts: F.struct(F.lit(False).alias("ok"), F.concat(*parts).alias("message"))
        yes = lambda *parts: F.struct(F.lit(True).alias("ok"), F.concat(*parts).alias("message"))
        t = F.lit
        gpu = (
            F.when(~m["cuda"], no(t("CUDA-compatible NVIDIA GPU was not detected.")))
            .when(m["ac_powered"] == F.lit(False), no(t("GPU mode requires AC power for stable processing. Connect the charger and try again.")))
            .when(m["total_vram"] < 7 * GIB, no(t("GPU mode requires at least 7 GB VRAM; detected "), gb(m["total_vram"], 1), t(" GB.")))
            .when((m["free_vram"] > 0) & (m["free_vram"] < 5 * GIB), no(t("GPU mode requires at least 5 GB free VRAM; detected "), gb(m["free_vram"], 1), t(" GB free.")))
            .when((m["ram"] > 0) & (m["ram"] < 8 * GIB), no(t("GPU mode requires at least 8 GB system RAM; detected "), gb(m["ram"], 1), t(" GB.")))
            .otherwise(yes(t("GPU ready: "), m["cuda_name"], t(", "), gb(m["total_vram"], 0), t(" GB VRAM.")))
        )
        weak = (m["ram"] > 0) & (m["ram"] < 5 * GIB)
        cpu = F.when(weak, no(t("CPU mode requires approximately 6 GB RAM; detected "), gb(m["ram"], 1), t(" GB."))).otherwise(yes(t("CPU ready: "), gb(m["ram"], 0), t(" GB RAM, "), m["cpus"].cast("string"), t(" logical processors.")))
        return F.when(preference == "gpu", gpu).otherwise(cpu)

    return bound(machine, judge)


def in_time_order(segments: DataFrame, by: str, start: str = "start", tie: str = "seq") -> DataFrame:
    """``segments`` with ``place`` from 0 by start (a missing one is 0), those of one start in their order."""
    w = Window.partitionBy(by).orderBy(F.coalesce(start, F.lit(0.0)), tie)
    return segments.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def looked_up(ids: DataFrame, primary: DataFrame, backup: DataFrame, key: str, raw: str = "raw") -> DataFrame:
    """key, ``raw`` and ``source`` of the metadata of some ids: "primary" if it is a JSON object, else "backup" if that is one, else
    "unreadable"; "missing" without a primary."""
    good = lambda c: F.coalesce(F.get_json_object(c, "$").startswith("{"), F.lit(False))
    met = ids.select(key).join(primary.select(key, F.col(raw).alias("__a"), F.lit(True).alias("__there")), key, "left").join(backup.select(key, F.col(raw).alias("__b")), key, "left")
    source = F.when(F.col("__there").isNull(), "missing").when(good(F.col("__a")), "primary").when(good(F.col("__b")), "backup").otherwise("unreadable")
    return met.withColumn("source", source).select(key, F.when(F.col("source") == "primary", F.col("__a")).when(F.col("source") == "backup", F.col("__b")).alias("raw"), "source")


def state_payload(raw: Column, version: int) -> Column:
    """The payload if it is a JSON object of that schema version, else null."""
    return F.when(F.coalesce(F.get_json_object(raw, "$").startswith("{"), F.lit(False)) & (F.get_json_object(raw, "$.schema_version").try_cast("int") == version), raw)


def stagger(text: Column) -> Column:
    """Seconds by which retries of a text are shifted: the sum of its UTF-8 bytes modulo 7, times 0.15."""
    code = F.hex(F.encode(text, "UTF-8"))
    total = F.aggregate(F.transform(F.regexp_extract_all(code, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return total % 7 * F.lit(STAGGER_STEP)


def untranslated(segments: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """by, ``segments`` and ``fault`` of each transcript: null, or which segment is the first without text."""
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    first = F.min(F.when(blank, F.col(order)))
    return segments.groupBy(by).agg(F.count("*").alias("segments"), F.when(first.isNotNull(), F.concat(F.lit("segment "), first.cast("string"), F.lit(" is missing text"))).alias("fault"))
