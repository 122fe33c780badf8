"""Channel scans: raw entries to ranked candidates with duplicates marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.numbers import published_day
from cuemill.functions.text import first_filled, url_key
from cuemill.operators.dedup import first_accepted

SHORT_SECONDS = 180
IMAGE_EXTENSIONS = ("avif", "bmp", "gif", "heic", "jpeg", "jpg", "png", "webp")
VIDEO_EXTENSIONS = ("mkv", "mov", "mp4", "webm")
ENTRY = (
    "id string, display_id string, webpage_url string, original_url string, url string, uploader_id string, channel_id string, uploader string, channel string, creator string, title string, description string, "
    "upload_date string, timestamp string, release_timestamp string, is_live boolean, live_status string, availability string, duration string, view_count string, play_count string, thumbnail string, "
    "thumbnails array<struct<url:string>>, images array<string>, formats array<struct<vcodec:string>>, entries array<struct<ext:string,vcodec:string>>, _type string"
)


def _number(*columns: Column) -> Column:
    """The first number that is neither missing nor zero."""
    return F.coalesce(*[F.nullif(c.try_cast("double").try_cast("long"), F.lit(0)) for c in columns])


def candidate_url(platform: Column) -> Column:
    value, remote = F.trim(first_filled(F.col("webpage_url"), F.col("original_url"), F.col("url"))), F.trim(first_filled(F.col("id"), F.col("display_id")))
    uploader = first_filled(F.regexp_replace(first_filled(F.col("uploader_id"), F.col("channel_id"), F.lit("_")), "^@+|@+$", ""), F.lit("_"))
    made = F.when(platform == "YouTube", F.concat(F.lit("https://www.youtube.com/watch?v="), remote)).when(platform == "TikTok", F.concat(F.lit("https://www.tiktok.com/@"), uploader, F.lit("/video/"), remote))
    return F.when(value.rlike("^https?://"), value).otherwise(made.when(platform == "Douyin", F.concat(F.lit("https://www.douyin.com/video/"), remote)))


def to_candidates(entries: DataFrame, platform: str, content_type: Column | None = None) -> DataFrame:
    """Candidates of ``entries`` (position and the columns of ``ENTRY``): live, private and unnamed ones are left out."""
    p, kind = F.lit(platform), content_type if content_type is not None else F.lit("")
    remote = F.trim(first_filled(F.col("id"), F.col("display_id")))
    barred = F.coalesce(F.col("is_live"), F.lit(False)) | F.coalesce(F.col("live_status").isin("is_live", "is_upcoming"), F.lit(False))
    barred |= F.coalesce(F.lower("availability").isin("private", "premium_only", "subscriber_only"), F.lit(False))
    out = entries.filter(~barred).select(
        "position", remote.alias("remote_video_id"), candidate_url(p).alias("source_url"), F.trim(first_filled(F.col("title"), F.col("description"), F.concat(F.lit("Video "), remote))).alias("title"), p.alias("platform"),
        F.when(kind.isin("short", "long"), kind).otherwise("").alias("content_type"), F.trim(F.coalesce(first_filled(F.col("uploader"), F.col("channel"), F.col("creator")), F.lit(""))).alias("uploader"),
        F.greatest(F.lit(0).cast("long"), F.coalesce(_number(F.col("duration")), F.lit(0))).alias("duration_seconds"), published_day(F.col("upload_date"), _number(F.col("timestamp"), F.col("release_timestamp"))).alias("published_at"),
        _number(F.col("view_count"), F.col("play_count")).alias("view_count"), F.coalesce(first_filled(F.col("thumbnail"), F.element_at(F.col("thumbnails.url"), F.greatest(F.size("thumbnails"), F.lit(1)))), F.lit("")).alias("thumbnail_url"),
    )
    return out.filter("remote_video_id is not null and source_url is not null")


def is_not_video() -> Column:
    """Entries that are pictures only: images first, then formats, then the entries of a playlist."""
    no_picture = F.forall("formats", lambda f: F.lower(F.coalesce(f["vcodec"], F.lit(""))) == "none")
    pictures = F.forall("entries", lambda e: F.lower(F.coalesce(e["ext"], F.lit(""))).isin(*IMAGE_EXTENSIONS) | (F.lower(F.coalesce(e["vcodec"], F.lit(""))) == "none") & ~F.lower(F.coalesce(e["ext"], F.lit(""))).isin(*VIDEO_EXTENSIONS))
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(filled("images"), True).when(filled("formats"), no_picture).when((F.col("_type") == "playlist") & filled("entries"), pictures).otherwise(False)


def merge_hydrated(candidates: DataFrame, hydrated: DataFrame) -> DataFrame:
    """Candidates with the refreshed values of ``hydrated`` (same columns and ``is_video``), by remote_video_id.

    A candidate that was not hydrated stays; one found to be no video goes. URL and tab are kept from the original, other
    values are the refreshed ones where there are any.
    """
    fresh = hydrated.select("remote_video_id", F.lit(True).alias("__met"), "is_video", F.struct(*[c for c in candidates.columns if c in hydrated.columns]).alias("new"))
    both = candidates.join(fresh, "remote_video_id", "left").filter("__met is null or is_video")
    pick = lambda c: first_filled(F.col("new")[c], F.col(c))
    merged = {"source_url": first_filled(F.col("source_url"), F.col("new")["source_url"]), "content_type": F.coalesce(first_filled(F.col("content_type"), F.col("new")["content_type"]), F.lit(""))}
    merged |= {c: pick(c) for c in ("title", "uploader", "thumbnail_url", "published_at")}
    merged |= {"duration_seconds": F.coalesce(F.nullif(F.col("new")["duration_seconds"], F.lit(0)), F.col("duration_seconds")), "view_count": F.coalesce(F.col("new")["view_count"], F.col("view_count"))}
    return both.select(*[merged.get(c, F.col(c)).alias(c) for c in candidates.columns])


def needs_hydration(ranking: str) -> Column:
    missing = (F.coalesce(F.col("duration_seconds"), F.lit(0)) <= 0) | (F.coalesce(F.col("published_at"), F.lit("")) == "")
    return (F.col("platform") == "TikTok") | missing | (F.lit(ranking == "popular") & F.col("view_count").isNull())


def passes_duration(wanted: str) -> Column:
    """A tab's class counts before the duration on YouTube; an unknown duration passes for "all" only."""
    if wanted == "all":
        return F.lit(True)
    seconds = F.coalesce(F.col("duration_seconds"), F.lit(0))
    by_length = (seconds > 0) & ((seconds <= SHORT_SECONDS) if wanted == "short" else (seconds > SHORT_SECONDS))
    has_tab = (F.col("platform") == "YouTube") & (F.coalesce(F.col("content_type"), F.lit("")) != "")
    return F.when(has_tab, F.col("content_type") == wanted).otherwise(by_length)


def popular_order() -> list[Column]:
    views = F.coalesce(F.nullif(F.col("view_count"), F.lit(0)), F.lit(-1))
    return [F.col("view_count").isNotNull().desc(), views.desc(), F.col("published_at").desc_nulls_last(), F.col("position").asc()]


def newest_order(source_order: bool = False) -> list[Column]:
    """Newest first, undated last; ``source_order`` for a single tab that is in order already."""
    day = F.nullif(F.col("published_at"), F.lit(""))
    return [F.col("position").asc()] if source_order else [day.desc_nulls_last(), F.col("position").asc()]


def top_candidates(candidates: DataFrame, wanted: str, ranking: str, limit: int, source_order: bool = False) -> DataFrame:
    """Filter, total order, limit; Spark keeps only ``limit`` rows of each partition."""
    return candidates.filter(passes_duration(wanted)).orderBy(*(popular_order() if ranking == "popular" else newest_order(source_order))).limit(limit)


def mark_duplicates(candidates: DataFrame, existing: DataFrame, key: str = "remote_key") -> DataFrame:
    """``duplicate``: the id key or the URL key is among the existing ones, themselves taken as they are in lower case and as URL keys."""
    known = existing.select(F.explode(F.array(F.lower(key), url_key(F.col(key)))).alias("__known")).distinct()
    by_id = F.lower(F.concat_ws(":", "platform", "remote_video_id"))
    marked = candidates.withColumn("__id", by_id).withColumn("__url", url_key(F.col("source_url")))
    marked = marked.join(known.select(F.col("__known").alias("__id"), F.lit(True).alias("__a")), "__id", "left").join(known.select(F.col("__known").alias("__url"), F.lit(True).alias("__b")), "__url", "left")
    duplicate = F.col("__a").isNotNull() | F.col("__b").isNotNull()
    out = marked.withColumn("duplicate", duplicate).drop("__id", "__url", "__a", "__b")
    return out.withColumn("status", F.when(F.col("duplicate"), "duplicate").otherwise("ready"))


def greedy_dedup(rows: DataFrame, group: str, id_col: str, url_col: str, position: str) -> DataFrame:
    """Rows in order of position, one dropped if its id or its URL is that of a row kept before in its group.

    A dropped row blocks nothing, so no window can express it; see ``dedup``.
    """
    return first_accepted(rows, [[group, id_col], [group, url_col]], [position])


def session_metrics(candidates: DataFrame, by: str) -> DataFrame:
    """All counters of a session in one pass, and its progress."""
    n = lambda status: F.count_if(F.col("status") == status)
    eligible = F.col("status") != "duplicate"
    return candidates.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("selected")).alias("selected"), n("duplicate").alias("duplicates"), n("downloading").alias("downloading"), n("importing").alias("importing"),
        n("imported").alias("imported"), n("failed").alias("failed"), n("ready").alias("ready"), F.coalesce(F.bround(F.avg(F.when(eligible, F.col("progress")))).cast("int"), F.lit(0)).alias("progress"),
    )


def downloadable(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("selected") & ~F.col("duplicate") & F.col("status").isin("ready", "failed"))


def interrupted_to_failed(sessions: DataFrame) -> DataFrame:
    """Candidates that were under way when a session ended are failed."""
    change = lambda c: c.withField("status", F.when(c["status"].isin("downloading", "importing"), "failed").otherwise(c["status"]))
    return sessions.withColumn("candidates", F.transform("candidates", change))


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy().agg(F.max_by(F.struct(*sessions.columns), F.struct("updated_at", "session_id")).alias("s")).filter("s is not null").select("s.*")


def scan_budget(limit: Column, tabs: Column) -> Column:
    """Entries to ask each tab for."""
    return F.ceil(limit / F.greatest(tabs, F.lit(1))).cast("int")
