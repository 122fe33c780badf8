"""The working view: queues, lookups, selections, restarts, published sources and messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.numbers import count_label, date_label, duration_label
from cuemill.functions.text import first_filled

# What a stage is called; any other shows its own detail.
STAGE_LABELS = {
    "starting": "Preparing project",
    "extracting_audio": "Extracting audio",
    "separating_audio": "Separating vocals",
    "transcribing": "Transcribing speech",
    "translating": "Translating",
    "review_translation": "Waiting for translation review",
    "creating_subtitle": "Creating subtitles",
    "creating_voice": "Generating voice",
    "building_audio_timeline": "Mixing audio",
    "rendering": "Rendering video",
    "paused": "Paused",
    "done": "Export complete",
}
# Exit codes of a worker that have a meaning.
EXIT_CODES = {
    "C0000005": "Windows access violation in native code (Torch, CUDA, driver, or a native dependency)",
    "C0000017": "Windows could not reserve enough virtual memory",
    "C000009A": "Windows reported insufficient system resources",
    "C000012D": "Windows commit limit was reached",
    "C0000409": "Windows terminated the process after a native stack or security check failure",
}
# Columns that a restart sets.
RESTARTED = {
    "status": "pending",
    "progress": 0,
    "step": "queued",
    "step_detail": "Queued to restart",
    "resume_step": "",
    "current_item": 0,
    "total_items": 0,
    "review_approved": False,
}
CLEARED = ("error", "started_at")


def all_videos(current: DataFrame, legacy: DataFrame, key: str = "video_id", order: str = "updated_at") -> DataFrame:
    """Videos of both layouts, newest first; of a key in both the one in the present layout."""
    return current.unionByName(legacy.join(current, key, "left_anti")).orderBy(F.desc(order), key)


def resolve_directory(ids: DataFrame, *places: DataFrame, key: str = "video_id") -> DataFrame:
    """``directory`` of each id: of the first of ``places`` (key, directory) that has one; null if none has."""
    out, names = ids, []
    for i, place in enumerate(places):
        names.append(f"__place{i}")
        out = out.join(place.groupBy(key).agg(F.min(F.nullif("directory", F.lit(""))).alias(names[-1])), key, "left")
    return out.withColumn("directory", F.coalesce(*names)).drop(*names)


def settings(saved: DataFrame, defaults: dict, raw: str = "raw") -> DataFrame:
    """Known settings of JSON objects over ``defaults``; others are ignored, a broken object gives the defaults."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    r = F.from_json(raw, ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in defaults.items()))
    return saved.withColumn("__r", r).select(*[c for c in saved.columns if c != raw], *[F.coalesce(F.col("__r")[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def changed_settings(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new`` that are not as in ``old``: what a conditional write has to write."""
    same = F.lit(True)
    for c in new.columns:
        same &= F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return new.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left").filter(~same).select("n.*")


def restarted(videos: DataFrame) -> DataFrame:
    """Videos set back to the start; those being processed stay as they are."""
    under_way = F.col("status") == "processing"
    put = {c: F.lit(v).cast(videos.schema[c].dataType) for c, v in RESTARTED.items() if c in videos.columns} | {c: F.lit(None).cast(videos.schema[c].dataType) for c in CLEARED if c in videos.columns}
    return videos.select(*[F.when(under_way, F.col(c)).otherwise(put[c]).alias(c) if c in put else F.col(c) for c in videos.columns])


def with_change(changes: DataFrame, saved: DataFrame, by: str, key: str) -> DataFrame:
    """The change table (``by``, revision, id) with a row for each saved id, numbered on in each catalogue ``by``."""
    last = changes.groupBy(by).agg(F.max("revision").alias("__last"))
    new = saved.select(by, F.col(key).alias("id")).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("id")))
    return changes.select(by, "revision", "id").unionByName(new.join(last, by, "left").select(by, (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long").alias("revision"), "id"))


def enqueue(queue: DataFrame, wanted: DataFrame, active: DataFrame, by: str, key: str = "video_id") -> DataFrame:
    """Queues (``by``, key, position) with the wanted ids (same columns) behind what is there, each once; active ids and those
    in the queue not again."""
    last = queue.groupBy(by).agg(F.max("position").alias("__last"))
    fresh = wanted.groupBy(by, key).agg(F.min("position").alias("position")).join(queue, [by, key], "left_anti").join(active, key, "left_anti")
    placed = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("position", key))).join(last, by, "left")
    return queue.select(by, key, "position").unionByName(placed.select(by, key, (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast(queue.schema["position"].dataType).alias("position")))


def detach(queue: DataFrame, active: DataFrame, targets: DataFrame, key: str = "video_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rest, removed, active): the queue without the targets, the removed waiters, and the active ids among them."""
    return queue.join(targets, key, "left_anti"), queue.join(targets, key, "left_semi"), active.join(targets, key, "left_semi")


def resumable(videos: DataFrame, queue: DataFrame, statuses: Sequence[str], key: str = "video_id") -> DataFrame:
    """Videos to put into the queue: of these statuses and not in it."""
    return videos.filter(F.col("status").isin(*statuses)).join(queue, key, "left_anti")


def busy_projects(videos: DataFrame, queue: DataFrame, by: str = "project_key", key: str = "video_id") -> DataFrame:
    """``busy``: whether a project has a video that is being processed or waits in the queue."""
    marked = videos.join(queue.select(key, F.lit(True).alias("__queued")).distinct(), key, "left")
    return marked.groupBy(by).agg(F.bool_or((F.col("status") == "processing") | F.coalesce("__queued", F.lit(False))).alias("busy"))


def matching(projects: DataFrame, name: Column, directory: Column) -> DataFrame:
    """Projects by name and directory without regard to case and outer spaces."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return projects.filter((plain(F.col("name")) == plain(name)) & (plain(F.col("directory")) == plain(directory)))


def with_project_key(videos: DataFrame, projects: DataFrame) -> DataFrame:
    """``project_key`` of each video: the stored one, else that of the only project of its name and directory."""
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    named = projects.groupBy(plain("name").alias("__name"), plain("directory").alias("__directory")).agg(F.min("project_key").alias("__only"), F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    out = videos.withColumn("__name", plain("project_name")).withColumn("__directory", plain("project_directory")).join(named, ["__name", "__directory"], "left")
    return out.withColumn("project_key", F.coalesce(F.nullif("project_key", F.lit("")), "__only")).drop("__name", "__directory", "__only")


def publish_sources(videos: DataFrame) -> DataFrame:
    """What can be published: finished single videos one by one, those of a batch project together, in order of ``position``."""
    name = F.coalesce(first_filled(F.col("project_name"), F.regexp_replace("original_filename", r"\.[^.]*$", "")), F.lit(""))
    group = F.when(F.col("project_type") == "batch", F.concat(F.lit("batch:"), first_filled(F.col("project_key"), name))).otherwise(F.col("video_id").cast("string"))
    source = F.struct("position", "output_path", F.concat(name, F.lit(" — "), F.col("original_filename")).alias("display_name"))
    rows = videos.filter(F.col("project_type").isin("single", "batch") & (F.col("status") == "done") & (F.coalesce("output_path", F.lit("")) != ""))
    rows = rows.select(group.alias("source_id"), "project_type", name.alias("project_name"), "position", source.alias("source"))
    return rows.groupBy("source_id").agg(F.first("project_type").alias("project_type"), F.min_by("project_name", "position").alias("project_name"), F.count("*").alias("video_count"), F.array_sort(F.collect_list("source")).alias("sources"))


def override_summaries(summaries: DataFrame, publish: DataFrame, key: str = "project_key") -> DataFrame:
    """Project summaries with the values of their publishing queue (key, item_count, status, progress) for publish projects."""
    p = publish.select(key, F.struct("item_count", "status", "progress").alias("__p"))
    out = summaries.join(p, key, "left")
    use = (F.col("project_type") == "publish") & F.col("__p").isNotNull()
    for column, value in (("video_count", "item_count"), ("status", "status"), ("progress", "progress")):
        out = out.withColumn(column, F.when(use, F.col("__p")[value].cast(summaries.schema[column].dataType)).otherwise(F.col(column)))
    return out.drop("__p")


def stage_label(step: Column, detail: Column, status: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in STAGE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, step), first_filled(detail, status))


def elapsed_label(started: Column, ended: Column) -> Column:
    """Time between two ISO strings as a label; "" without a start or where one is no time."""
    seconds = F.unix_micros(F.try_to_timestamp(ended)) - F.unix_micros(F.try_to_timestamp(started))
    return F.coalesce(F.when(F.coalesce(started, F.lit("")) != "", duration_label(F.bround(F.greatest(F.lit(0), seconds) / 1e6))), F.lit(""))


def candidate_view(candidates: DataFrame) -> DataFrame:
    """Candidates as a list shows them."""
    return candidates.select(
        "remote_video_id", "title", "platform", duration_label(F.col("duration_seconds")).alias("duration"), date_label(F.col("published_at")).alias("published"), count_label(F.col("view_count")).alias("views"),
    )


def video_view(videos: DataFrame) -> DataFrame:
    """Videos as a list shows them: a project's name falls back on the file's."""
    size = F.when((F.col("video_width") > 0) & (F.col("video_height") > 0), F.format_string("%d x %d", "video_width", "video_height")).otherwise("")
    return videos.select("video_id", "original_filename", "status", "updated_at", "progress", first_filled(F.col("project_name"), F.col("original_filename")).alias("project_name"), size.alias("video_size"))


def recent_with_new(projects: DataFrame, order: str, n: int = 40) -> DataFrame:
    """``pos`` 0 is the row that makes a new project, then the newest ``n``."""
    newest = projects.orderBy(F.desc(order), "project_key").limit(n)
    placed = newest.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(order), "project_key")))  # at most n rows
    return projects.sparkSession.range(1).select(F.lit(0).alias("pos")).unionByName(placed, allowMissingColumns=True)


def supported_voice(rows: DataFrame, voices: DataFrame, language: str = "language", voice: str = "voice", default: str = "en") -> DataFrame:
    """``supported``: the row's voice if its language has it, else the language's first; a language without voices has those
    of the default. ``voices`` is a small catalogue (language, voice, pos), aggregated to a row a language."""
    of = voices.groupBy(F.col("language").alias("__language")).agg(F.array_sort(F.collect_list(F.struct("pos", "voice"))).alias("__v"))
    fallback = of.filter(F.col("__language") == default).select(F.col("__v").alias("__d"))
    out = rows.join(of, F.col(language) == F.col("__language"), "left").join(F.broadcast(fallback), F.lit(True), "left")
    options = F.coalesce("__v", "__d")
    return out.withColumn("supported", F.when(F.exists(options, lambda v: v["voice"] == F.col(voice)), F.col(voice)).otherwise(F.coalesce(F.try_element_at(options, F.lit(1))["voice"], F.lit("")))).drop("__language", "__v", "__d")


def option_list(languages: DataFrame) -> DataFrame:
    return languages.withColumn("search", F.lower(F.concat_ws(" ", "code", "english_name", "native_name")))


def inspected(info: DataFrame) -> DataFrame:
    """Metadata of one video as shown before a download, the platform in its usual spelling."""
    named = F.trim(first_filled(F.col("extractor_key"), F.col("extractor"), F.col("platform")))
    platform = F.when(F.lower(named).contains("youtube"), "YouTube")
    for name in ("TikTok", "Douyin", "Bilibili"):
        platform = platform.when(F.lower(named).contains(name.lower()), name)
    return info.select(
        "id", F.trim(first_filled(F.col("title"), F.lit("Untitled video"))).alias("title"), F.coalesce(first_filled(platform, named), F.col("platform")).alias("platform"),
        F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("duration").cast("long"), F.lit(0))).alias("duration_seconds"), F.trim(F.coalesce(first_filled(F.col("uploader"), F.col("channel")), F.lit(""))).alias("uploader"),
    )


def cover_url(*lists: Column) -> Column:
    """The first web address in lists of addresses, "" if there is none."""
    every = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])
    return F.coalesce(F.try_element_at(F.filter(every, lambda u: u.rlike("^https?://")), F.lit(1)), F.lit(""))


def second_source_candidates(items: DataFrame) -> DataFrame:
    """Candidates of another source's items: picture posts and those without an address to play are left out, durations over
    10,000 are milliseconds."""
    duration = F.coalesce(F.nullif("video_duration", F.lit(0)), "duration", F.lit(0)).cast("long")
    seconds = F.when(duration > 10_000, F.floor(duration / 1000)).otherwise(duration)
    playable = F.exists("play_urls", lambda u: u.rlike("^https?://"))
    remote = F.trim(F.col("aweme_id").cast("string"))
    rows = items.filter((F.coalesce(F.size("images"), F.lit(0)) <= 0) & F.coalesce(playable, F.lit(False)) & (F.coalesce(remote, F.lit("")) != ""))
    return rows.select(
        remote.alias("remote_video_id"), F.concat(F.lit("https://www.douyin.com/video/"), remote).alias("source_url"), F.trim(first_filled(F.col("desc"), F.concat(F.lit("Video "), remote))).alias("title"),
        F.greatest(F.lit(0).cast("long"), seconds).alias("duration_seconds"), F.coalesce(F.date_format(F.timestamp_seconds("create_time"), "yyyyMMdd"), F.lit("")).alias("published_at"), cover_url(F.col("cover"), F.col("origin_cover")).alias("thumbnail_url"),
    )


def tagged_union(*tabs: tuple[DataFrame, str]) -> DataFrame:
    """Collections of several tabs as one, each row with its tab's class."""
    parts = [rows.withColumn("content_type", F.lit(kind)) for rows, kind in tabs]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sorted_union(*lists: DataFrame) -> DataFrame:
    """Distinct values of one-column tables, in order without regard to case."""
    out = lists[0]
    for rows in lists[1:]:
        out = out.union(rows)
    c = out.columns[0]
    return out.distinct().orderBy(F.lower(c), c)


def split_post(text: Column) -> Column:
    """(caption, tags) of a post: its last line is the tags if it has nothing else."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    last = F.regexp_extract(t, r"([^\n]*)$", 1)
    tokens = F.filter(F.split(last, r"(?U)\s+"), lambda x: x != "")
    tagged = (F.size(tokens) > 0) & F.forall(tokens, lambda x: x.rlike(r"^(?U)#[^\s#]+$"))
    head = F.regexp_extract(t, r"(?s)^(.*)\n[^\n]*$", 1)
    return F.struct(F.when(tagged, head).otherwise(t).alias("caption"), F.when(tagged, tokens).otherwise(F.array().cast("array<string>")).alias("tags"))


def last_stages(lines: DataFrame, by: str, position: str, text: str) -> DataFrame:
    """The last stage that a worker's JSON lines name; other lines are passed over."""
    kind, detail = F.get_json_object(text, "$.event"), F.get_json_object(text, "$.detail")
    stage = F.when((kind == "diagnostic") & detail.startswith("{"), F.get_json_object(text, "$.detail.stage")).when(kind == "status", detail)
    named = lines.withColumn("__stage", F.nullif(stage, F.lit("")))
    return named.groupBy(by).agg(F.coalesce(F.max_by("__stage", F.when(F.col("__stage").isNotNull(), F.col(position))), F.lit("worker startup")).alias("stage"))


def exit_text(code: Column, phase: Column, stage: Column) -> Column:
    """What an exit code of a worker says."""
    unsigned = F.lpad(F.hex(F.coalesce(code, F.lit(0)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    meaning = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in EXIT_CODES.items() for x in pair]), unsigned), F.lit("unexpected worker process termination"))
    return F.concat(F.lit("Worker stopped unexpectedly during "), phase, F.lit(". Exit code: "), F.coalesce(code, F.lit(0)).cast("string"), F.lit(" (0x"), unsigned, F.lit("); classification: "), meaning, F.lit("; last stage: "), stage, F.lit("."))


def prompts(lines: DataFrame, by: str, order: Sequence[str], text: str = "text") -> DataFrame:
    """``prompt`` of each line: up to three lines before as P1.. and after as N1.., nearest first, then the line itself."""
    w = Window.partitionBy(by).orderBy(*order)
    near = lambda step, sign: [F.when(F.coalesce(step(text, k).over(w), F.lit("")) != "", F.concat(F.lit(f"{sign}{k}: "), step(text, k).over(w))) for k in (1, 2, 3)]
    return lines.withColumn("prompt", F.concat_ws("\n", *near(F.lag, "P"), *near(F.lead, "N"), F.concat(F.lit("TEXT: "), F.coalesce(text, F.lit("")))))


def with_results(lines: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines with the ``translated`` text of their place; ``fault`` where a line has none or several."""
    counted = results.groupBy(*key).agg(F.min("translated").alias("translated"), F.count("*").alias("__n"))
    out = lines.join(counted, list(key), "left")
    return out.withColumn("fault", F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated")).drop("__n")


def needs_translation(source: Column, target: Column) -> Column:
    """Whether the languages differ, without regard to case."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return plain(source) != plain(target)


def timing_is_current(segments: DataFrame, by: str, source: str) -> DataFrame:
    """``current``: whether a file has segments and all were timed by ``source``."""
    return segments.groupBy(by).agg(F.bool_and(F.coalesce(F.col("timing_source") == source, F.lit(False))).alias("current"))


def mix_track(separates: Column, background: Column, size: Column, fallback: Column) -> Column:
    """The track to mix: the plain one, the separated background if it holds more than a header, or none."""
    return F.when(~F.coalesce(separates, F.lit(False)), fallback).when((F.coalesce(background, F.lit("")) != "") & (size > 44), background).otherwise("")


def language_groups(segments: DataFrame, by: str, order: str, language: str = "language") -> DataFrame:
    """Languages of a recording with their numbers of segments, in the order in which they are first heard."""
    kind = F.coalesce(F.nullif(F.col(language), F.lit("")), F.lit("en"))
    counted = segments.groupBy(by, kind.alias("language")).agg(F.count("*").alias("segments"), F.min(order).alias("first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("first", "language")))


def rejection_message(rejected: DataFrame, by: str, order: str, name: str, shown: int = 12) -> DataFrame:
    """The first rejected names and how many more there are; only ``shown`` names of a key are gathered."""
    w = Window.partitionBy(by)
    numbered = rejected.withColumn("__n", F.row_number().over(w.orderBy(order)))
    total = rejected.groupBy(by).agg(F.count("*").alias("n"))
    names = numbered.filter(F.col("__n") <= shown).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(name).alias("v")))).alias("__l"))
    more = F.when(F.col("n") > shown, F.array(F.format_string("... and %d more", F.col("n") - shown))).otherwise(F.array().cast("array<string>"))
    heading = F.format_string("%d unsupported or unreadable item(s):", "n")
    return names.join(total, by).select(by, F.concat(heading, F.lit("\n\n"), F.array_join(F.concat(F.transform("__l", lambda x: x["v"]), more), "\n")).alias("message"))


def final_states(metrics: DataFrame) -> DataFrame:
    """``state`` and ``message`` of sessions with nothing under way; null for the others."""
    idle = (F.col("downloading") + F.col("importing")) == 0
    state = F.when(idle, F.when(F.col("failed") > 0, "partial").otherwise("success"))
    text = F.when(F.col("failed") > 0, F.format_string("Imported %d videos; %d need attention", "imported", "failed")).otherwise(F.format_string("Imported %d videos", "imported"))
    return metrics.withColumn("state", state).withColumn("message", F.when(idle, text))


def failed_parts(expected: DataFrame, valid: DataFrame, failures: DataFrame, key: Sequence[str]) -> DataFrame:
    """Parts that are missing or broken, or failed for good: each once."""
    return expected.select(*key).join(valid.select(*key), list(key), "left_anti").union(failures.select(*key)).distinct()


def download_sums(assets: DataFrame, there: DataFrame, by: str, key: str) -> DataFrame:
    """Bytes of all assets of a group and of those still missing."""
    marked = assets.join(there.select(key, F.lit(True).alias("__there")).distinct(), key, "left")
    return marked.groupBy(by).agg(F.sum("size").alias("total_bytes"), F.coalesce(F.sum(F.when(F.col("__there").isNull(), F.col("size"))), F.lit(0)).cast("long").alias("missing_bytes"))


def unlocked(required: DataFrame, lock: DataFrame) -> DataFrame:
    """``fault`` of required packages (name, version): not in the lock, or another version; null if as locked."""
    plain = F.lower(F.regexp_replace("name", "[-_.]+", "-"))
    locked = lock.select(plain.alias("__name"), F.col("version").alias("__locked"))
    out = required.withColumn("__name", plain).join(locked, "__name", "left")
    fault = F.when(F.col("__locked").isNull(), "not locked").when(F.col("version").isNotNull() & (F.col("version") != F.col("__locked")), "other version")
    return out.select(*required.columns, fault.alias("fault"))


def fingerprint(content: Column, block: int = 65_536) -> Column:
    """A sampled fingerprint: SHA-256 of the size and of the first, middle and last ``block`` bytes."""
    n = F.octet_length(content)
    part = lambda at: F.substring(content, F.greatest(F.lit(1), at).cast("int"), F.lit(block))
    return F.sha2(F.concat(F.encode(n.cast("string"), "UTF-8"), part(F.lit(1)), part(F.floor((n - block) / 2) + 1), part(n - block + 1)), 256)


def thumbnail_url(path: Column, modified: Column, size: Column) -> Column:
    """An address that changes when the file does."""
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(F.lit("file:///"), F.replace(path, F.lit("\\"), F.lit("/")), F.lit("?v="), modified.cast("string"), F.lit("-"), size.cast("string")))


def localized_voice(label: Column, language: Column) -> Column:
    return F.when(language == "vi", F.replace(F.replace(label, F.lit("Female"), F.lit("Nữ")), F.lit("Male"), F.lit("Nam"))).otherwise(label)
