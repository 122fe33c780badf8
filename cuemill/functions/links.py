"""Checks of pasted links, in the JVM. A link is split once; its platform is one map lookup, and the rules of all platforms are two
patterns over ``platform:path``, so a check's plan has the same small size for any number of platforms and rules."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PLATFORM_HOSTS, host_of

# Parts of a path that show a single video of a platform instead of a profile.
VIDEO_MARKERS = {
    "TikTok": ("/video/",),
    "Douyin": ("/video/",),
    "Bilibili": ("/video/",),
    "Instagram": ("/p/", "/reel/", "/tv/", "/stories/"),
    "Facebook": ("/watch", "/reel/", "/share/"),
    "X": ("/status/",),
    "Vimeo": ("/video/",),
    "Dailymotion": ("/video/",),
    "Twitch": ("/videos/", "/clip/", "/clips/"),
    "Reddit": ("/comments/",),
    "VK": ("video",),
}
# Fixed value: a host of single videos only.
STREAMABLE = ("streamable.com", "Streamable")
#: What a path of the platform must not look like, besides its markers.
SINGLE = {"YouTube": "/watch|/shorts/", "TikTok": "(?!/@)"}
#: What it must look like.
PROFILE = {"YouTube": "/@|/channel/|/c/|/user/", "Douyin": ".*/user/"}
_SINGLE = "(?s)^(?:" + "|".join([*(f"{p}:(?:{rule})" for p, rule in SINGLE.items()), *(f"{p}:.*(?:{'|'.join(m)})" for p, m in VIDEO_MARKERS.items())]) + ")"
_NO_PROFILE = "(?s)^(?:" + "|".join(f"{p}:(?!{rule})" for p, rule in PROFILE.items()) + ")"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def platform_by_domain(host: Column, more: tuple = ()) -> Column:
    """Platform of a host by its last two labels, "" for none."""
    known = F.create_map(*map(F.lit, chain.from_iterable((*PLATFORM_HOSTS, *more))))
    return F.coalesce(F.try_element_at(known, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)), F.lit(""))


def _parts(link: Column, more: tuple = ()) -> Column:
    """scheme, netloc, host, path (without closing slashes) and platform of a trimmed link with its scheme."""
    netloc = F.regexp_extract(link, r"^[^:/?#]*://([^/?#]*)", 1)
    raw = F.struct(
        F.lower(F.regexp_extract(link, r"^([^:/?#]*)://", 1)).alias("scheme"), netloc.alias("netloc"), host_of(link).alias("host"), F.regexp_replace(F.regexp_extract(link, r"(?s)^[^:/?#]*://[^/?#]*([^?#]*)", 1), "/+$", "").alias("path"),
    )
    return bound(raw, lambda p: p.withField("platform", platform_by_domain(p["host"], more)))


def _with_scheme(link: Column, has_scheme: Callable[[Column], Column]) -> Column:
    return F.when(has_scheme(link), link).otherwise(F.concat(F.lit("https://"), link))


def channel_check(link: Column, expected: Column) -> Column:
    """fault, url and platform of a channel's link; url and platform are null where there is a fault, else fault is null.

    Faults in this order: "empty", "no link", "unknown platform", "other platform" than the expected one, "single video",
    "no channel". The url is https, with host in lower case and without query, fragment and closing slashes. A null link is
    empty, a null or blank expectation takes any platform.
    """
    want = F.lower(F.trim(F.coalesce(expected, F.lit(""))))

    def judge(p: Column) -> Column:
        place = F.concat(p["platform"], F.lit(":"), F.lower(p["path"]))
        fault = (
            F.when(p["link"] == "", "empty").when(~p["scheme"].isin("http", "https") | (p["host"] == ""), "no link").when(p["platform"] == "", "unknown platform")
            .when((want != "") & (want != F.lower(p["platform"])), "other platform").when(place.rlike(_SINGLE), "single video").when(place.rlike(_NO_PROFILE) & ~((p["platform"] == "Douyin") & p["host"].startswith("v.")), "no channel")
        )
        url = F.concat(F.lit("https://"), F.lower(p["netloc"]), F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]))
        return bound(fault, lambda f: F.struct(f.alias("fault"), F.when(f.isNull(), url).alias("url"), F.when(f.isNull(), p["platform"]).alias("platform")))

    split = lambda t: bound(_with_scheme(t, lambda x: x.contains("://")), lambda full: _parts(full).withField("link", t))
    return bound(bound(F.trim(F.coalesce(link, F.lit(""))), split), judge)


def channel_error(link: Column, expected: Column) -> Column:
    """What is wrong with a channel's link, null if nothing."""
    return channel_check(link, expected)["fault"]


def video_check(link: Column) -> Column:
    """fault ("empty", "no link", "unknown source"), url (trimmed, with its scheme) and platform of a video's link."""

    def judge(p: Column) -> Column:
        fault = F.when(p["link"] == "", "empty").when(~p["scheme"].isin("http", "https") | (p["host"] == ""), "no link").when(p["platform"] == "", "unknown source")
        return bound(fault, lambda f: F.struct(f.alias("fault"), F.when(f.isNull(), p["full"]).alias("url"), F.when(f.isNull(), p["platform"]).alias("platform")))

    split = lambda t: bound(_with_scheme(t, lambda x: x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")), lambda full: _parts(full, (STREAMABLE,)).withField("link", t).withField("full", full))
    return bound(bound(F.trim(F.coalesce(link, F.lit(""))), split), judge)
