import time

from pyspark.sql import functions as F

from cuemill.functions import links as L
from cuemill.plans.registry import QUERIES

CHANNELS = (
    ("", "YouTube", "empty"), ("https://", "", "no link"), ("ftp://youtube.com/@a", "", "no link"), ("example.org/@a", "", "unknown platform"), ("https://www.youtube.com/@a", "TikTok", "other platform"), ("youtube.com/watch?v=1", "", "single video"),
    ("https://youtube.com/shorts/x", "YouTube", "single video"), ("https://youtube.com/feed", "", "no channel"), ("https://YouTube.com/@A/videos", "youtube", None), ("https://youtube.com/channel/UC1", "", None), ("https://www.tiktok.com/@a/video/1", "", "single video"),
    ("https://tiktok.com/foo", "", "single video"), ("https://www.tiktok.com/@a", "TikTok", None), ("https://www.douyin.com/video/1", "", "single video"), ("https://www.douyin.com/user/a", "", None), ("https://v.douyin.com/abc", "", None), ("https://douyin.com/abc", "", "no channel"),
    ("https://www.bilibili.com/video/BV1", "", "single video"), ("https://space.bilibili.com/1", "", None), ("https://instagram.com/reel/1", "", "single video"), ("https://x.com/a/status/1", "X", "single video"), ("https://x.com/a", None, None), ("https://vimeo.com/a", "", None),
    ("https://www.reddit.com/r/a/comments/1", "", "single video"), ("https://facebook.com/watch?v=1", "", "single video"), ("https://twitch.tv/a", "Twitch", None), (None, None, "empty"), ("  ", " ", "empty"), ("https://vk.com/myvideos", "", "single video"), ("https://notyoutube.com/@a", "", "unknown platform"),
)


def test_channel_links(spark):
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CHANNELS)], "i int, link string, wanted string")
    found = [r["x"] for r in rows.select("i", L.channel_check(F.col("link"), F.col("wanted")).alias("x")).orderBy("i").collect()]
    assert [f["fault"] for f in found] == [c[2] for c in CHANNELS]
    assert [(f["url"], f["platform"]) for f, c in zip(found, CHANNELS, strict=True) if c[2]] == [(None, None)] * sum(c[2] is not None for c in CHANNELS)
    by_link = dict(zip((c[0] for c in CHANNELS), found, strict=True))
    assert tuple(by_link["https://YouTube.com/@A/videos"]) == (None, "https://youtube.com/@A/videos", "YouTube")
    assert by_link["https://twitch.tv/a"]["url"] == "https://twitch.tv/a"


def test_video_links(spark):
    links = ["youtube.com/watch?v=1 ", "HTTP://x.com/a", "streamable.com/1", "", "mailto:a@b", "https:///x", "https://b.org/x", None]
    rows = spark.createDataFrame(list(enumerate(links)), "i int, link string")
    found = [tuple(r["x"]) for r in rows.select("i", L.video_check(F.col("link")).alias("x")).orderBy("i").collect()]
    assert found[:3] == [(None, "https://youtube.com/watch?v=1", "YouTube"), (None, "HTTP://x.com/a", "X"), (None, "https://streamable.com/1", "Streamable")]
    assert [f[0] for f in found[3:]] == ["empty", "unknown source", "no link", "unknown source", "empty"]


def test_plans_stay_small(spark, sf):
    for name in ("channel_faults", "video_links", "caption_styles"):
        began = time.time()
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 20_000 and time.time() - began < 10, (name, len(plan))
