"""Text functions on columns. Unless said otherwise a null gives a null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POST_LIMIT = 2200  # UTF-16 units of a post

# Host suffixes and the platform that each stands for; the first that fits counts.
PLATFORM_HOSTS = (
    ("youtube.com", "YouTube"),
    ("tiktok.com", "TikTok"),
    ("douyin.com", "Douyin"),
    ("bilibili.com", "Bilibili"),
    ("instagram.com", "Instagram"),
    ("facebook.com", "Facebook"),
    ("x.com", "X"),
    ("twitter.com", "X"),
    ("vimeo.com", "Vimeo"),
    ("dailymotion.com", "Dailymotion"),
    ("twitch.tv", "Twitch"),
    ("reddit.com", "Reddit"),
    ("vk.com", "VK"),
)

# Characters that speech synthesis gets in a plain form.
SPEECH_CHARACTERS = {
    "\u00a0": " ",
    "\u200b": "",
    "\u200c": "",
    "\u200d": "",
    "\ufeff": "",
    "\u2018": "'",
    "\u2019": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": ",",
    "\u2014": ",",
    "\u2026": "...",
}

# Scripts that a translation into a language must show.
REQUIRED_SCRIPTS = {
    "Hindi": "[\u0900-\u097f]",
    "Arabic": "[\u0600-\u06ff]",
    "Russian": "[\u0400-\u04ff]",
    "Korean": "[\uac00-\ud7af]",
    "Thai": "[\u0e00-\u0e7f]",
}
CJK = "[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]"
CJK_LANGUAGES = ("zh", "ja", "ko", "yue")

# What redaction replaces, in this order.
REDACTIONS = (
    (r"(?iU)\b(authorization|cookie|password|passwd|secret|token|api[_-]?key)\b(\s*[:=]\s*)([^\s,;]+)", "$1$2<redacted>"),
    (r"(?iU)https?://[^\s\"'<>]+", "<url>"),
    (r"(?U)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])", "<email>"),
    (r"(?i)(?:[A-Z]:\\|\\\\)[^\r\n\"'<>|]*", "<path>"),
    (r"(?iU)(?<![\w.-])/(?:home|users)/[^/\s]+(?:/[^\s\"'<>]*)?", "<path>"),
)


def squeeze(text: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def text_key(text: Column) -> Column:
    """For comparing texts: lower case, spaces squeezed."""
    return squeeze(F.lower(text))


def alphanumerics(text: Column) -> Column:
    """How many letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def is_meaningful(text: Column) -> Column:
    return alphanumerics(text) >= 2


def is_standalone_label(text: Column) -> Column:
    trimmed = F.trim(text)
    return (trimmed != "") & (F.length(trimmed) <= 48) & (F.size(F.regexp_extract_all(trimmed, F.lit(r"(?U)(\w+)"), F.lit(1))) <= 4)


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and closing dots; https is assumed where no scheme is given."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))
    rest = F.regexp_extract(full, r"^[^:/?#]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(rest, "^.*@", ""), r":\d*$", "")), r"\.+$", "")


def url_key(url: Column) -> Column:
    """A URL without tracking: https, host in lower case, path without closing slashes; of a query only YouTube's video id.

    A blank gives "", a string without host itself in lower case.
    """
    raw = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = host_of(raw)
    path = F.regexp_replace(F.regexp_extract(full, r"^[^:/?#]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    video = F.regexp_extract(full, r"^[^?#]*\?(?:[^#]*&)?v=([^&#]+)", 1)
    is_youtube = (host == "youtube.com") | host.endswith(".youtube.com")
    query = F.when(is_youtube & (video != ""), F.concat(F.lit("?v="), video)).otherwise("")
    return F.when(raw == "", "").when(host == "", F.lower(raw)).otherwise(F.concat(F.lit("https://"), host, path, query))


def platform_of_host(host: Column) -> Column:
    """Platform by the first suffix in ``PLATFORM_HOSTS`` that fits; "" for none."""
    out = None
    for domain, platform in PLATFORM_HOSTS:
        fits = (host == domain) | host.endswith("." + domain)
        out = F.when(fits, platform) if out is None else out.when(fits, platform)
    return out.otherwise("")


def collection_urls(channel: Column, duration: Column) -> Column:
    """Array of (url, content_type): the tabs of a channel that a duration filter needs."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(channel, r"[?#].*$", ""), "/+$", ""), r"(?i)/(videos|shorts|streams)$", "")
    tab = lambda name, kind: F.struct(F.concat(base, F.lit("/" + name)).alias("url"), F.lit(kind).alias("content_type"))
    return F.when(duration == "short", F.array(tab("shorts", "short"))).when(duration == "long", F.array(tab("videos", "long"))).otherwise(F.array(tab("videos", "long"), tab("shorts", "short")))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def truncate_utf16(text: Column, limit: Column | int) -> Column:
    """The longest beginning of whole characters with at most ``limit`` UTF-16 units, trailing white space dropped."""
    limit = F.greatest(limit if isinstance(limit, Column) else F.lit(limit), F.lit(0))
    units = F.encode(text, "UTF-16LE")
    halved = F.hex(F.substring(units, limit * 2, F.lit(1))).between("D8", "DB")  # the last unit is the first of a pair
    cut = F.decode(F.substring(units, F.lit(1), 2 * (limit - F.when(halved, 1).otherwise(0))), "UTF-16LE")
    return F.regexp_replace(F.when(F.octet_length(units) <= 2 * limit, text).otherwise(cut), r"(?U)\s+$", "")


def normalize_caption(text: Column) -> Column:
    """Lines squeezed, empty ones dropped, at most ``POST_LIMIT`` UTF-16 units."""
    lines = F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "\n"), squeeze), lambda line: line != "")
    return truncate_utf16(F.array_join(lines, "\n"), POST_LIMIT)


def hashtag_list(text: Column) -> Column:
    """Tags with "#", cleaned, the first spelling of each kept, in order."""
    tokens = F.split(F.coalesce(text, F.lit("")), r"(?U)[\s,;]+")
    clean = F.filter(F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^#+", ""), r"(?U)[^\w]", ""), "^_+|_+$", "")), lambda t: t != "")
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # evaluates the value once, however often it is used

    def first_ones(tags: Column) -> Column:
        return bound(F.transform(tags, lambda t: F.lower(t)), lambda keys: F.filter(tags, lambda t, i: F.array_position(keys, keys[i]) == i + 1))

    return F.transform(bound(clean, first_ones), lambda t: F.concat(F.lit("#"), t))


def fitting_tags(tags: Column) -> Column:
    """Tags of a list, joined by spaces, up to the first that is over the limit."""
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("units"), F.lit(True).alias("open"))

    def add(s: Column, tag: Column) -> Column:
        units = s["units"] + utf16_length(tag) + F.when(s["units"] > 0, 1).otherwise(0)
        fits = s["open"] & (units <= POST_LIMIT)
        return F.struct(F.when(fits, F.concat_ws(" ", F.nullif(s["text"], F.lit("")), tag)).otherwise(s["text"]).alias("text"), F.when(fits, units).otherwise(s["units"]).alias("units"), fits.alias("open"))

    return F.aggregate(tags, state, add, lambda s: s["text"])


def compose_post(caption: Column, tags: Column) -> Column:
    """A normal caption and fitting tags as one text of at most ``POST_LIMIT`` UTF-16 units; tags go first when room is short."""
    separator = F.when((caption != "") & (tags != ""), "\n").otherwise("")
    body = truncate_utf16(caption, F.lit(POST_LIMIT) - utf16_length(F.concat(separator, tags)))
    return F.trim(F.concat(body, F.when(body != "", separator).otherwise(""), tags))


def speech_text(text: Column) -> Column:
    """Text for speech synthesis: plain characters, squeezed, no space before punctuation, a stop at the end.

    Composed characters are expected: Spark has no normalisation function.
    """
    out = F.coalesce(text, F.lit(""))
    for old, new in SPEECH_CHARACTERS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(squeeze(out), r"(?U)\s+([,.;:!?])", "$1")
    return F.when(out.rlike(r"[^.!?,;:]$"), F.concat(out, F.lit("."))).otherwise(out)


def clean_translation(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.trim(text), '^"+|"+$', ""))


def unwrap_translation(response: Column) -> Column:
    """A model's answer without code fence, JSON list or JSON string around it; null if nothing is left."""
    text = F.trim(response)
    fenced = F.trim(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"```\s*$", ""))
    text = F.when(text.startswith("```"), fenced).otherwise(text)
    listed = F.from_json(text, "array<string>")
    text = F.when(text.startswith("[") & (F.size(listed) == 1), listed[0]).otherwise(text)
    return F.nullif(F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', "")), F.lit(""))


def is_suspicious_translation(source: Column, translated: Column, language: Column) -> Column:
    """Empty, far too short, or without a letter of the script that the language needs."""
    n, m = alphanumerics(source), alphanumerics(translated)
    wrong = F.lit(False)
    for name, script in REQUIRED_SCRIPTS.items():
        wrong = F.when(language == name, ~translated.rlike(script)).otherwise(wrong)
    return F.when((n > 0) & (m == 0), True).when((n >= 35) & (m < F.greatest(F.lit(6), F.floor(n / 10))), True).when(n >= 12, wrong).otherwise(False)


def retranscription_language(language: Column, text: Column, primary: Column) -> Column:
    """The detected language, or the primary one if a CJK language was detected for a text without CJK characters."""
    primary = F.lower(first_filled(primary, F.lit("en")))
    found = F.lower(first_filled(language, primary))
    return F.when(found.isin(*CJK_LANGUAGES) & ~primary.isin(*CJK_LANGUAGES) & ~F.coalesce(text, F.lit("")).rlike(CJK), primary).otherwise(found)


def redact(text: Column) -> Column:
    """Credentials, URLs, addresses and user paths replaced, in this order."""
    out = F.coalesce(text, F.lit(""))
    for pattern, new in REDACTIONS:
        out = F.regexp_replace(out, pattern, new)
    return out


def safe_name(text: Column) -> Column:
    """Letters, digits, "-" and "_" only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "")


def identity_key(name: Column, directory: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(name)), F.lower(F.regexp_replace(F.replace(directory, F.lit("\\"), F.lit("/")), "/+$", "")))


def escape_ass(text: Column) -> Column:
    """Text of a subtitle event: backslash and braces escaped, line breaks as \\N."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for old, new in (("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def watermark(text: Column) -> Column:
    return F.left(squeeze(F.coalesce(text, F.lit(""))), F.lit(80))


def preview(text: Column, limit: int = 160) -> Column:
    """Terminal colours dropped, squeezed, cut."""
    return F.left(squeeze(F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")), F.lit(limit))


def join_text(left: Column, right: Column) -> Column:
    """Two transcript pieces as one: no space between CJK characters or before closing punctuation."""
    a, b = F.trim(F.coalesce(left, F.lit(""))), F.trim(F.coalesce(right, F.lit("")))
    spaced = F.concat(a, F.lit(" "), b)
    both_cjk = F.right(a, F.lit(1)).rlike(CJK) & F.left(b, F.lit(1)).rlike(CJK)
    closes = b.rlike("^[,.;:!?%)\\]}\u3001\u3002\uff0c\uff01\uff1f]")
    return F.when(a == "", b).when(b == "", a).when(F.coalesce(right, F.lit("")).rlike(r"(?U)^\s"), spaced).when(both_cjk | closes, F.concat(a, b)).otherwise(spaced)


def wrap_lines(text: Column, limit: int) -> Column:
    """Greedy word wrap: lines of at most ``limit`` characters where words allow, joined by line breaks."""
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(s: Column, word: Column) -> Column:
        full = (s["line"] != "") & (F.length(s["line"]) + F.length(word) + 1 > limit)
        done = F.when(full, F.concat(s["done"], s["line"], F.lit("\n"))).otherwise(s["done"])
        line = F.when(full | (s["line"] == ""), word).otherwise(F.concat(s["line"], F.lit(" "), word))
        return F.struct(done.alias("done"), line.alias("line"))

    words = F.filter(F.split(squeeze(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    return F.aggregate(words, state, add, lambda s: F.concat(s["done"], s["line"]))


# Markers of a lost accelerator, of crashes that must not be taken for one, and of errors that pass on their own.
GPU_MARKERS = ("cuda", "cudnn", "cublas", "nvidia", "gpu", "device-side", "driver")
CRASH_MARKERS = ("0xc0000005", "3221225477", "native torch crash", "native windows crash", "paging file is too small", "os error 1455")
PASSING_MARKERS = ("unable to extract universal data for rehydration", "unable to extract webpage video data", "unable to download api page", "http error 429", "http error 502", "http error 503", "http error 504", "timed out", "timeout")
FORMAT_MARKERS = ("requested format is not available", "no video formats found", "no formats found", "unable to download video data", "video data is empty")


def _has_any(text: Column, markers: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def _plain_error(message: Column) -> Column:
    """Lower case without terminal colours; a null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(message, F.lit("")), "\\x1b\\[[0-?]*[ -/]*[@-~]", ""))


def error_code(kind: Column, message: Column) -> Column:
    """The class of an error from its type's name and its text; the first that fits, so a missing answer comes before a
    timeout, and both before what the type alone says."""
    k, m = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    says = lambda *parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(k, p))
    out = F.when(says("noaudioreceived") | F.contains(m, F.lit("no audio was received")), "edge_no_audio")
    out = out.when(says("timeout") | F.contains(m, F.lit("timed out")), "network_timeout").when(says("websocket", "clientconnector", "connection"), "network_connection")
    out = out.when(k.isin("valueerror", "unicodedecodeerror", "jsondecodeerror"), "invalid_tts_input").when(k.isin("oserror", "ioerror", "filenotfounderror", "permissionerror"), "file_io")
    return out.when((k == "runtimeerror") & F.contains(m, F.lit("invalid mp3")), "invalid_audio").otherwise("unexpected_error")


def is_gpu_failure(message: Column, has_gpu: Column) -> Column:
    """Whether a lost accelerator explains the error; a native crash does not, whatever else its text names."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return F.coalesce(has_gpu, F.lit(False)) & ~_has_any(m, CRASH_MARKERS) & _has_any(m, GPU_MARKERS)


def is_retryable(message: Column, platform: Column) -> Column:
    """Whether a new session may get the media: a stale format anywhere, a passing error on TikTok only."""
    m = _plain_error(message)
    return _has_any(m, FORMAT_MARKERS) | (F.coalesce(platform == "TikTok", F.lit(False)) & _has_any(m, PASSING_MARKERS))


def numbered_names(name: Column, nth: Column) -> Column:
    """``name`` with " (n)" before its extension from the second of equal names on."""
    stem, extension = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.when(nth <= 1, name).otherwise(F.concat(stem, F.lit(" ("), nth.cast("string"), F.lit(")"), extension))
