"""Queries of candidate entries, picture geometry, name and URL rules, files in and out, and small labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions import geometry as G
from cuemill.functions import links as L
from cuemill.functions import numbers as N
from cuemill.functions import text as X
from cuemill.operators import candidates as C
from cuemill.operators import catalog, migrate, publish
from cuemill.sources import files
from cuemill.streaming import feeds, maintained

from .tables import VIDEOS_SQL, Registry, new_folder, table, videos

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as raw entries of a scan, with gaps in every field."""
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    made = {
        "position": k, "id": F.when(k % 11 == 0, "").otherwise(s(k)), "display_id": F.when(k % 22 != 0, F.concat(F.lit(" d"), s(k))), "webpage_url": F.when(k % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), s(k))).when(k % 3 == 1, "ftp://x"),
        "title": F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Order "), s(k))), "description": F.when(k % 10 == 0, "Text"), "uploader": F.when(k % 4 == 0, " u "), "channel": F.when(k % 4 == 2, "c"), "is_live": k % 13 == 0,
        "live_status": F.when(k % 17 == 0, "is_upcoming"), "availability": F.when(k % 19 == 0, "Private"), "duration": F.when(k % 7 == 0, "x").otherwise(s(F.col("o_totalprice") / 100)), "upload_date": F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")),
        "timestamp": F.when(k % 4 == 1, s(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000000)), "view_count": F.when(k % 6 == 0, "0").otherwise(s(k)), "play_count": F.when(k % 12 == 0, "5"), "thumbnail": F.when(k % 2 == 0, "t"),
    }
    empty = [f.split(" ", 1) for f in C.ENTRY.replace("array<struct<url:string>>", "A").split(", ")]
    rest = {n: F.lit(None).cast("array<struct<url:string>>" if t == "A" else t) for n, t in empty if n not in made}
    return table(spark, sf_dir, "orders").select(*[v.alias(n) for n, v in (made | rest).items()])


@R.add(
    """WITH e AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate AS d, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey AS VARCHAR) WHEN o_orderkey % 22 <> 0 THEN 'd' || o_orderkey END AS r FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0)
SELECT k AS position, r AS remote_video_id, 'https://www.youtube.com/watch?v=' || CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) ELSE r END AS source_url, CASE WHEN k % 5 <> 0 THEN 'Order ' || k WHEN k % 10 = 0 THEN 'Text' ELSE 'Video ' || r END AS title,
CASE k % 4 WHEN 0 THEN 'u' WHEN 2 THEN 'c' ELSE '' END AS uploader, CASE WHEN k % 7 = 0 THEN 0 ELSE CAST(trunc(p / 100) AS BIGINT) END AS duration_seconds, CASE WHEN k % 4 IN (0, 1) THEN strftime(d, '%Y%m%d') ELSE '' END AS published_at,
CASE WHEN k % 6 <> 0 THEN k WHEN k % 12 = 0 THEN 5 END AS view_count, CASE WHEN k % 2 = 0 THEN 't' ELSE '' END AS thumbnail_url FROM e WHERE r IS NOT NULL"""
)
def entry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.to_candidates(_entries(spark, sf_dir), "YouTube").drop("platform", "content_type")


@R.add(
    """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN true ELSE false END AS no_video FROM orders"""
)
def picture_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images; only silent formats; one real format; a playlist of pictures; a playlist with a film; nothing."""
    k = F.col("o_orderkey")
    form = lambda *v: F.array(*[F.struct(F.lit(c).alias("vcodec")) for c in v])
    item = lambda *v: F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(c).alias("vcodec")) for e, c in v])
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 6 == 0, F.array(F.lit("a.jpg"))).alias("images"), F.when(k % 6 == 1, form("none", "NONE")).when(k % 6 == 2, form("none", "h264")).alias("formats"),
        F.when(k % 6 == 3, item(("JPG", ""), ("bin", "none"))).when(k % 6 == 4, item(("png", ""), ("mp4", "none"))).alias("entries"), F.when(k % 6 >= 3, "playlist").alias("_type"),
    )
    return rows.select("k", C.is_not_video().alias("no_video"))


@R.add(
    """WITH c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS d, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '20240101' END AS day, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS v FROM part),
h AS (SELECT *, d <= 0 OR day = '' OR v IS NULL AS needed FROM c)
SELECT k, CASE WHEN needed AND k % 4 = 1 THEN 'new ' || k ELSE 'old ' || k END AS title, CASE WHEN needed AND k % 4 = 1 THEN 99 ELSE d END AS duration_seconds, CASE WHEN needed AND k % 4 = 1 THEN coalesce(NULL, v) ELSE v END AS view_count, needed FROM h WHERE NOT (needed AND k % 8 = 3)"""
)
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that lack something are looked up again; some turn out to be no video, some can not be reached."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(
        k.cast("string").alias("remote_video_id"), F.lit("https://www.youtube.com/watch?v=1").alias("source_url"), F.lit("").alias("content_type"), F.concat(F.lit("old "), k.cast("string")).alias("title"), F.lit("u").alias("uploader"), F.lit("").alias("thumbnail_url"), F.lit("YouTube").alias("platform"),
        F.when(k % 7 == 0, "").otherwise("20240101").alias("published_at"), F.when(k % 5 == 0, 0).otherwise(F.col("p_size")).cast("long").alias("duration_seconds"), F.when(k % 3 != 0, k).alias("view_count"),
    ).withColumn("needed", C.needs_hydration("popular"))
    i = F.col("remote_video_id").cast("long")
    fresh = c.filter(F.col("needed") & ((i % 4 == 1) | (i % 8 == 3))).withColumn("title", F.concat(F.lit("new "), "remote_video_id")).withColumn("duration_seconds", F.lit(99).cast("long")).withColumn("view_count", F.lit(None).cast("long"))
    merged = C.merge_hydrated(c, fresh.withColumn("is_video", i % 4 == 1))
    return merged.select(i.alias("k"), "title", "duration_seconds", "view_count", "needed")


_case = lambda column, values, kind="string": F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (F.pmod(column, F.lit(len(values))) + 1).cast("int"))
_quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
_listed = lambda column, values: f"([{', '.join(map(_quoted, values))}])[{column} % {len(values)} + 1]"


# Parts that links are put together from: what comes before the host, hosts, paths, and platforms asked for.
_SCHEMES = ("https://", "", "http://", "ftp://", "https://u:p@")
_HOSTS = ("youtube.com", "www.YouTube.com", "m.youtube.com:443", "tiktok.com", "www.douyin.com", "v.douyin.com", "space.bilibili.com", "instagram.com", "facebook.com", "x.com", "mobile.twitter.com", "vimeo.com", "dailymotion.com", "twitch.tv", "reddit.com", "vk.com", "notyoutube.com", "example.org", "streamable.com", "")
_PATHS_OF_LINKS = ("/@", "/channel/", "/c/", "/user/", "/watch?v=", "/shorts/", "/Video/", "/p/", "/reel/", "/share/", "/a/status/", "/clip/", "/r/a/comments/", "/feed/", "/video", "")
_WANTED = ("", "YouTube", " tiktok ", "", "X", "Vimeo", "")
_LINKS_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, {_listed('o_custkey', _SCHEMES)} AS scheme, {_listed('(o_orderkey // 3)', _HOSTS)} AS host, {_listed('(o_orderkey // 7 + o_custkey)', _PATHS_OF_LINKS)} AS path, {_listed('(o_orderkey // 5)', _WANTED)} AS wanted FROM orders),
l AS (SELECT *, CASE WHEN path = '' THEN '' ELSE path || c || CASE WHEN c % 3 = 0 THEN '/' ELSE '' END END || CASE WHEN c % 4 = 0 THEN '#x' ELSE '' END AS rest, lower(regexp_replace(host, ':.*', '')) AS h FROM o),
m AS (SELECT *, scheme || host || rest AS link, rtrim(regexp_replace(rest, '[?#].*', ''), '/') AS p, list_filter([{', '.join(f"['{d}', '{n}']" for d, n in X.PLATFORM_HOSTS)}, ['streamable.com', 'Streamable']], lambda x: h = x[1] OR ends_with(h, '.' || x[1])) AS hit FROM l),
n AS (SELECT *, coalesce(hit[1][2], '') AS platform, lower(p) AS low, trim(link) = '' AS nothing, scheme = 'ftp://' OR host = '' AND (scheme <> '' OR starts_with(rest, '/')) AS broken FROM m)
"""


@R.add(
    _LINKS_SQL
    + """, f AS (SELECT *, CASE WHEN nothing THEN 'empty' WHEN broken OR host = '' THEN 'no link' WHEN platform IN ('', 'Streamable') THEN 'unknown platform' WHEN trim(wanted) <> '' AND lower(trim(wanted)) <> lower(platform) THEN 'other platform'
  WHEN platform = 'YouTube' AND (low LIKE '/watch%' OR low LIKE '/shorts/%') THEN 'single video' WHEN platform = 'YouTube' AND NOT (low LIKE '/@%' OR low LIKE '/channel/%' OR low LIKE '/c/%' OR low LIKE '/user/%') THEN 'no channel'
  WHEN platform = 'TikTok' AND low NOT LIKE '/@%' THEN 'single video' WHEN platform IN ('TikTok', 'Douyin', 'Bilibili', 'Vimeo', 'Dailymotion') AND low LIKE '%/video/%' THEN 'single video'
  WHEN platform = 'Douyin' AND low NOT LIKE '%/user/%' AND NOT starts_with(h, 'v.') THEN 'no channel' WHEN platform = 'Instagram' AND (low LIKE '%/p/%' OR low LIKE '%/reel/%') THEN 'single video'
  WHEN platform = 'Facebook' AND (low LIKE '%/watch%' OR low LIKE '%/reel/%' OR low LIKE '%/share/%') THEN 'single video' WHEN platform = 'X' AND low LIKE '%/status/%' THEN 'single video' WHEN platform = 'Twitch' AND low LIKE '%/clip/%' THEN 'single video'
  WHEN platform = 'Reddit' AND low LIKE '%/comments/%' THEN 'single video' WHEN platform = 'VK' AND low LIKE '%video%' THEN 'single video' END AS fault FROM n)
SELECT k, fault, CASE WHEN fault IS NULL THEN 'https://' || CASE WHEN contains(scheme, '@') THEN 'u:p@' ELSE '' END || lower(host) || CASE WHEN p = '' THEN '/' ELSE p END END AS url, CASE WHEN fault IS NULL THEN platform END AS platform FROM f"""
)
def channel_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links put together from the keys of orders, and what is wrong with them as links of a channel."""
    k, link, wanted = _links()
    return table(spark, sf_dir, "orders").select(k.alias("k"), L.channel_check(link, wanted).alias("c")).select("k", "c.fault", "c.url", "c.platform")


def _links() -> tuple[Column, Column, Column]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = _case(F.floor(k / 7) + c, _PATHS_OF_LINKS)
    rest = F.concat(L.bound(path, lambda p: F.when(p == "", p).otherwise(F.concat(p, c.cast("string"), F.when(c % 3 == 0, "/").otherwise("")))), F.when(c % 4 == 0, "#x").otherwise(""))
    return k, F.concat(_case(c, _SCHEMES), _case(F.floor(k / 3), _HOSTS), rest), _case(F.floor(k / 5), _WANTED)


@R.add(
    _LINKS_SQL
    + """SELECT k, CASE WHEN nothing THEN 'empty' WHEN broken OR host = '' THEN 'no link' WHEN platform = '' THEN 'unknown source' END AS fault,
CASE WHEN NOT nothing AND NOT broken AND host <> '' AND platform <> '' THEN CASE WHEN scheme = '' THEN 'https://' ELSE '' END || link END AS url, CASE WHEN NOT nothing AND NOT broken AND host <> '' AND platform <> '' THEN platform END AS platform FROM n"""
)
def video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links as links of a video."""
    k, link, _ = _links()
    return table(spark, sf_dir, "orders").select(k.alias("k"), L.video_check(link).alias("c")).select("k", "c.fault", "c.url", "c.platform")


@R.add(
    """WITH c AS (SELECT c_custkey AS k, 'https://www.youtube.com/@c' || c_custkey AS base FROM customer)
SELECT k, CASE k % 3 WHEN 0 THEN base || '/shorts=short' WHEN 1 THEN base || '/videos=long' ELSE base || '/videos=long ' || base || '/shorts=short' END AS tabs FROM c"""
)
def channel_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://www.youtube.com/@c"), k.cast("string"), F.when(k % 2 == 0, "/Videos/").otherwise("/?x=1"))
    tabs = X.collection_urls(url, F.when(k % 3 == 0, "short").when(k % 3 == 1, "long").otherwise("all"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.array_join(F.transform(tabs, lambda t: F.concat_ws("=", t["url"], t["content_type"])), " ").alias("tabs"))


# What new projects' names and paths below a folder are put together from.
_BEFORE, _AFTER = ("", "", "con", "LPT1.", "a|", "<", "  ", "COM10", "Aux"), ("", ".", " ", "*", ".txt", " x", "", "")
_STEPS = ("/a/b", "/a/b/", "\\a\\b\\", "/a/bc/", "/a//b/./", "/a/b/../", "/x/", "/A/b/")


@R.add(
    f"""WITH o AS (SELECT o_orderkey AS k, {_listed('o_orderkey', _BEFORE)} || CASE WHEN o_custkey % 4 = 0 THEN '' WHEN o_custkey % 4 = 1 THEN repeat('n', CAST(o_custkey % 130 AS INTEGER)) ELSE CAST(o_custkey AS VARCHAR) END || {_listed('(o_orderkey // 5)', _AFTER)} AS name,
  {_listed('o_orderkey', _STEPS)} || CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) || '/' END AS path FROM orders),
n AS (SELECT *, trim(name) AS t, rtrim(replace(replace(replace(path, '\\', '/'), '/./', '/'), '//', '/'), '/') AS p FROM o)
SELECT k, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 120 THEN 'too long' WHEN t LIKE '%|%' OR t LIKE '%<%' OR t LIKE '%*%' THEN 'barred character' WHEN ends_with(t, '.') THEN 'bad end'
  WHEN upper(split_part(t, '.', 1)) IN ('CON', 'AUX', 'LPT1') THEN 'reserved' END AS fault, starts_with(p, '/a/b/') AND NOT contains(p || '/', '/../') AS inside FROM n""".replace("\\\\", "\\")
)
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and paths put together from the keys of orders."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    middle = F.when(c % 4 == 0, "").when(c % 4 == 1, F.repeat(F.lit("n"), (c % 130).cast("int"))).otherwise(c.cast("string"))
    name = F.concat(_case(k, _BEFORE), middle, _case(F.floor(k / 5), _AFTER))
    path = F.concat(_case(k, _STEPS), F.when(c % 3 == 0, "").otherwise(F.concat(c.cast("string"), F.lit("/"))))
    return table(spark, sf_dir, "orders").select(k.alias("k"), G.name_error(name).alias("fault"), G.is_inside(path, F.lit("/a/b/")).alias("inside"))


@R.add(
    """WITH p AS (SELECT p_partkey AS k, CAST(640 + p_partkey % 5 * 320 AS DOUBLE) AS w, CAST(360 + p_partkey % 4 * 180 AS DOUBLE) AS h, p_partkey % 3 = 0 AS edges, CAST(p_partkey % 40 AS DOUBLE) AS l, CAST(p_partkey % 30 AS DOUBLE) AS t, CAST(80 + p_partkey % 90 AS DOUBLE) AS zoom, CAST(p_partkey % 201 - 100 AS DOUBLE) AS pan FROM part),
c AS (SELECT *, greatest(zoom / 100, 1.0) AS z FROM p)
SELECT k, round(CASE WHEN edges AND (l > 0 OR t > 0) THEN w * (l / 100) ELSE (w - w / z) * least(1.0, greatest(0.0, (pan + 100) / 200)) END, 4) AS x, round(CASE WHEN edges AND (l > 0 OR t > 0) THEN h * (t / 100) ELSE (h - h / z) * 0.5 END, 4) AS y,
round(CASE WHEN edges AND (l > 0 OR t > 0) THEN w * greatest(0.15, 1 - l / 100 - 0.5) ELSE w / z END, 4) AS width, round(CASE WHEN edges AND (l > 0 OR t > 0) THEN h * greatest(0.15, 1 - t / 100) ELSE h / z END, 4) AS height FROM c"""
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number = lambda c: c.cast("double")
    edges = k % 3 == 0
    left, top = F.when(edges, number(k % 40)).otherwise(0.0), F.when(edges, number(k % 30)).otherwise(0.0)
    crop = F.struct(left.alias("left_percent"), F.when((left > 0) | (top > 0), 50.0).otherwise(0.0).alias("right_percent"), top.alias("top_percent"), F.lit(0.0).alias("bottom_percent"), number(80 + k % 90).alias("zoom_percent"), number(k % 201 - 100).alias("pan_x_percent"), F.lit(0.0).alias("pan_y_percent"))
    box = G.crop_box(number(640 + k % 5 * 320), number(360 + k % 4 * 180), crop)
    return table(spark, sf_dir, "part").select(k.alias("k"), *[F.round(box[c], 4).alias(c) for c in ("x", "y", "width", "height")])


@R.add(
    """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 60 AS DOUBLE) AS x, CAST(p_partkey % 90 AS DOUBLE) AS y, CAST(p_partkey % 45 AS DOUBLE) AS w, CAST(p_partkey % 13 AS DOUBLE) AS h, ['stretch', 'tiktok_9_16_crop', 'blur_background_9_16'][p_partkey % 3 + 1] AS f FROM part),
s AS (SELECT *, CASE f WHEN 'stretch' THEN 1080 / 1600.0 WHEN 'tiktok_9_16_crop' THEN greatest(1080 / 1600.0, 1920 / 900.0) ELSE least(1080 / 1600.0, 1920 / 900.0) END AS sx, CASE f WHEN 'stretch' THEN 1920 / 900.0 WHEN 'tiktok_9_16_crop' THEN greatest(1080 / 1600.0, 1920 / 900.0) ELSE least(1080 / 1600.0, 1920 / 900.0) END AS sy FROM p),
b AS (SELECT *, (1600 * x / 100 - 0) * sx + CASE f WHEN 'stretch' THEN 0.0 ELSE (1080 - 1600 * sx) / 2 END AS a, (900 * y / 100 - 0) * sy + CASE f WHEN 'stretch' THEN 0.0 ELSE (1920 - 900 * sy) / 2 END AS o FROM s),
r AS (SELECT *, greatest(0.0, a) AS l, greatest(0.0, o) AS t, least(1080.0, a + 1600 * w / 100 * sx) AS rr, least(1920.0, o + 900 * h / 100 * sy) AS bb, 900 * h / 100 * sy AS line FROM b)
SELECT k, CASE WHEN rr - l >= 24 AND bb - t >= 20 THEN CAST(round_even(least(100.0, greatest(0.0, (l + (rr - l) / 2) * 100 / 1080)), 0) AS INTEGER) END AS across, CASE WHEN rr - l >= 24 AND bb - t >= 20 THEN CAST(round_even(least(112.0, greatest(12.0, round_even(line * 0.6, 0))), 0) AS INTEGER) END AS font FROM r"""
)
def caption_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source region in three output formats, and the style it asks for."""
    k = F.col("p_partkey")
    number = lambda c: c.cast("double")
    region = F.struct(number(k % 60).alias("x_percent"), number(k % 90).alias("y_percent"), number(k % 45).alias("width_percent"), number(k % 13).alias("height_percent"), F.lit(None).cast("double").alias("line_height_percent"))
    crop = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1600.0).alias("width"), F.lit(900.0).alias("height"))
    kind = F.when(k % 3 == 0, "stretch").when(k % 3 == 1, "tiktok_9_16_crop").otherwise("blur_background_9_16")
    layout = G.output_region(region, F.lit(1600.0), F.lit(900.0), crop, kind, F.lit(1080.0), F.lit(1920.0))
    style = G.region_style(layout, F.lit(4), F.lit(1080.0), F.lit(1920.0))
    return table(spark, sf_dir, "part").select(k.alias("k"), style["position_x_percent"].alias("across"), style["font_size"].alias("font"))


@R.add(
    """WITH p AS (SELECT p_partkey AS k, 640 + p_partkey % 700 AS w, 360 + p_partkey % 500 AS h, p_partkey % 90 AS x, p_partkey % 80 AS y, 1 + p_partkey % 30 AS a, p_partkey % 20 AS b FROM part),
e AS (SELECT *, floor(floor(w * x / 100) / 2) * 2 AS ex, floor(floor(h * y / 100) / 2) * 2 AS ey, floor(floor(w * a / 100) / 2) * 2 AS ew, floor(floor(h * b / 100) / 2) * 2 AS eh FROM p)
SELECT k, CAST(ex AS INTEGER) AS x, CAST(ey AS INTEGER) AS y, CAST(least(greatest(2, ew), w - ex) AS INTEGER) AS width, CAST(least(greatest(2, eh), h - ey) AS INTEGER) AS height,
CAST(least(16, greatest(2, round_even(least(w, h) * 0.08, 0))) + least(16, greatest(2, round_even(least(w, h) * 0.08, 0))) % 2 AS INTEGER) AS feather,
CAST(least(18, (greatest(2, least(w, h)) - 2) // 2) AS INTEGER) AS luma, CAST(least(9, (greatest(2, least(w, h)) - 2) // 4) AS INTEGER) AS chroma FROM e"""
)
def even_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    w, h = 640 + k % 700, 360 + k % 500
    region = F.struct((k % 90).alias("x_percent"), (k % 80).alias("y_percent"), (1 + k % 30).alias("width_percent"), (k % 20).alias("height_percent"))
    box, blur = G.even_region(region, w, h), G.blur_radii(w, h)
    return table(spark, sf_dir, "part").select(k.alias("k"), *[box[c].cast("int").alias(c) for c in ("x", "y", "width", "height")], G.feather(w, h).alias("feather"), blur["luma"].alias("luma"), blur["chroma"].alias("chroma"))


@R.add(
    """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 70 + 1 AS DOUBLE) AS n, CAST(100 + p_partkey % 900 AS DOUBLE) AS w, CAST(30 + p_partkey % 200 AS DOUBLE) AS h, CASE WHEN p_partkey % 2 = 0 THEN CAST(20 + p_partkey % 90 AS DOUBLE) ELSE 0.0 END AS line FROM part)
SELECT k, greatest(10, least(48, CAST(floor(greatest(20.0, least(h, CASE WHEN line > 0 THEN line ELSE h END) - 4) / 1.05) AS INTEGER), CAST(floor(greatest(24.0, w - 8) / greatest(1.0, n * 0.48)) AS INTEGER))) AS font,
round(CAST((1080 - greatest(160.0, 1080 * greatest(0.82, n / 100))) / 2 AS DOUBLE), 4) AS default_x, round(CAST(greatest(72.0, 1920 * 0.07) AS DOUBLE), 4) AS default_height FROM p"""
)
def fonts_and_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number = lambda c: c.cast("double")
    layout = F.struct(number(100 + k % 900).alias("width"), number(30 + k % 200).alias("height"), F.when(k % 2 == 0, number(20 + k % 90)).otherwise(0.0).alias("line_height"))
    default = G.default_layout(number(k % 70 + 1), F.lit(86.0), F.lit(1080.0), F.lit(1920.0))
    return table(spark, sf_dir, "part").select(k.alias("k"), G.fitted_font(number(k % 70 + 1), layout, F.lit(48), F.lit(2)).alias("font"), F.round(default["x"], 4).alias("default_x"), F.round(default["height"], 4).alias("default_height"))


@R.add(
    """WITH p AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS gpu, CAST(p_partkey % 16 AS BIGINT) * 1073741824 AS vram, CAST(p_partkey % 24 AS BIGINT) * 1073741824 AS ram, 1 + p_partkey % 12 AS cpus FROM part),
q AS (SELECT *, CASE WHEN gpu THEN CASE WHEN vram < 8589934592 THEN 'cuda_low_memory' ELSE 'cuda' END WHEN ram = 0 OR ram >= 15032385536 THEN 'cpu_balanced' WHEN ram >= 7516192768 THEN 'cpu_low_memory' ELSE 'cpu_minimum' END AS key, CASE WHEN cpus > 2 THEN cpus - 1 ELSE cpus END AS spare FROM p)
SELECT k, key, CAST(greatest(1, CASE key WHEN 'cpu_minimum' THEN least(2, cpus) WHEN 'cpu_low_memory' THEN least(4, spare) ELSE least(8, spare) END) AS BIGINT) AS threads, CASE key WHEN 'cuda' THEN 16 WHEN 'cuda_low_memory' THEN 8 WHEN 'cpu_balanced' THEN 4 WHEN 'cpu_low_memory' THEN 2 ELSE 1 END AS batch FROM q"""
)
def machine_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, gib = F.col("p_partkey"), 1024**3
    p = G.runtime_profile(k % 3 == 0, (k % 16) * gib, (k % 24) * gib, 1 + k % 12)
    return table(spark, sf_dir, "part").select(k.alias("k"), p["key"].alias("key"), p["cpu_threads"].cast("long").alias("threads"), p["batch_size"].alias("batch"))


@R.add(
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN '--' ELSE printf('%.1f GB', o_orderkey * 1000000.0 / 1073741824) END AS memory, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS day,
printf('%d:%02d:%02d.%02d', c // 360000, c % 360000 // 6000, c % 6000 // 100, c % 100) AS ass, least(12.0, 0.5 * pow(2.0, o_orderkey % 7) + 0.25) AS delay, CAST(ceil(o_custkey / greatest(1, o_orderkey % 4)) AS INTEGER) AS budget,
CASE WHEN o_custkey > 0 THEN least(100, CAST(round_even(100 * (o_orderkey % 300) / o_custkey, 0) AS INTEGER)) ELSE 0 END AS share, greatest(1, 1 + CASE WHEN f <= 2 THEN 0 WHEN f <= 4 THEN 1 WHEN f <= 8 THEN 2 ELSE 3 END) AS tempos
FROM (SELECT *, CAST(o_orderkey % 100000 AS BIGINT) * 25 AS c, 1 + o_orderkey % 12 AS f FROM orders)"""
)
def small_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), N.memory_label(F.when(k % 5 != 0, k * 1000000.0)).alias("memory"), N.date_label(F.when(k % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon")).alias("day"), N.ass_time((k % 100000) * 0.25).alias("ass"),
        N.retry_delay(k % 7 + 1, 0.5, F.lit(0.25)).alias("delay"), C.scan_budget(F.col("o_custkey"), k % 4).alias("budget"), N.percent_of(k % 300, F.col("o_custkey")).alias("share"), F.size(N.tempo_chain((1 + k % 12).cast("double"))).alias("tempos"),
    )


# Types and parts of messages that errors are put together from.
_KINDS = ("NoAudioReceived", "KeyError", "ServerTimeoutError", "ClientConnectorError", "WebSocketError", "ValueError", "JSONDecodeError", "OSError", "PermissionError", "RuntimeError", "Error")
_SAID = ("", "No audio was received", "it Timed out", "Invalid MP3 header", "HTTP Error 429", "Requested format is not available", "video data is empty", "CUDA failed", "\x1b[31mcuBLAS\x1b[0m", "exit 0xC0000005", "HTTP Error 403", "no video formats found", "device-side assert")
_SOURCES = ("TikTok", "YouTube", "", "tiktok")
_has_sql = lambda column, words: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@R.add(
    f"""WITH o AS (SELECT o_orderkey AS k, lower({_listed('o_orderkey', _KINDS)}) AS kind, {_listed('(o_orderkey // 2)', _SAID)} || ' ' || o_orderkey || ' ' || {_listed('o_custkey', _SAID)} AS said, {_listed('o_custkey', _SOURCES)} AS source FROM orders),
m AS (SELECT *, lower(said) AS low, lower(regexp_replace(said, '\x1b\[[0-9;]*m', '', 'g')) AS plain FROM o)
SELECT k, CASE WHEN contains(kind, 'noaudioreceived') OR contains(low, 'no audio was received') THEN 'edge_no_audio' WHEN contains(kind, 'timeout') OR contains(low, 'timed out') THEN 'network_timeout' WHEN {_has_sql('kind', ('websocket', 'clientconnector', 'connection'))} THEN 'network_connection'
  WHEN kind IN ('valueerror', 'unicodedecodeerror', 'jsondecodeerror') THEN 'invalid_tts_input' WHEN kind IN ('oserror', 'ioerror', 'filenotfounderror', 'permissionerror') THEN 'file_io' WHEN kind = 'runtimeerror' AND contains(low, 'invalid mp3') THEN 'invalid_audio' ELSE 'unexpected_error' END AS code,
{_has_sql('plain', X.FORMAT_MARKERS)} OR source = 'TikTok' AND {_has_sql('plain', X.PASSING_MARKERS)} AS retry, k % 3 <> 0 AND NOT {_has_sql('low', X.CRASH_MARKERS)} AND {_has_sql('low', X.GPU_MARKERS)} AS lost_gpu FROM m"""
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a type and a message of two parts each: their class, whether a new try may help, and whether a lost accelerator explains them."""
    k = F.col("k")
    said = F.concat_ws(" ", _case(F.floor(F.col("o_orderkey") / 2), _SAID), F.col("o_orderkey").cast("string"), _case(F.col("o_custkey"), _SAID))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _case(F.col("o_orderkey"), _KINDS).alias("kind"), said.alias("said"), _case(F.col("o_custkey"), _SOURCES).alias("source"))
    return rows.select("k", X.error_code(F.col("kind"), F.col("said")).alias("code"), X.is_retryable(F.col("said"), F.col("source")).alias("retry"), X.is_gpu_failure(F.col("said"), k % 3 != 0).alias("lost_gpu"))


@R.add(
    r"""SELECT o_orderkey AS k, 'Name' || o_orderkey || '_x-' AS safe, 'my name:d:/a/b' AS identity, 'a\\b\{c\}\Nd' AS escaped, CASE WHEN o_orderkey % 3 = 0 THEN 'clip.mp4' ELSE 'clip (' || (o_orderkey % 3 + 1) || ').mp4' END AS numbered, repeat('red ', 40) AS preview,
CASE o_orderkey % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'x y' WHEN 3 THEN 'plain' END AS translation, CASE o_orderkey % 3 WHEN 0 THEN 'vi' WHEN 1 THEN 'zh' ELSE 'fr' END AS language, o_orderkey % 2 = 0 AS label FROM orders"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    s = k.cast("string")
    answer = F.when(k % 4 == 0, '```json\n["hi"]\n```').when(k % 4 == 1, '"x y"').when(k % 4 == 2, " ").otherwise("plain")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), X.safe_name(F.concat(F.lit("Na me/"), s, F.lit("_x-!"))).alias("safe"), X.identity_key(F.lit(" My Name "), F.lit("D:\\a\\b\\")).alias("identity"), X.escape_ass(F.lit("a\\b{c}\nd")).alias("escaped"),
        X.numbered_names(F.lit("clip.mp4"), k % 3 + 1).alias("numbered"), X.preview(F.concat(F.lit("\x1b[31m"), F.repeat(F.lit("red \n"), F.lit(60)))).alias("preview"), X.unwrap_translation(answer).alias("translation"),
        X.retranscription_language(F.when(k % 3 == 2, "FR").otherwise("zh"), F.when(k % 3 == 1, "你好").otherwise("xin chao"), F.lit("vi")).alias("language"), X.is_standalone_label(F.when(k % 2 == 0, "one two three four").otherwise("one two three four five")).alias("label"),
    )


@R.add("SELECT p_partkey, 400 + p_size * 10 >= 512 AND (p_partkey % 5 = 0 OR p_partkey % 3 = 0 AND p_partkey // 2 % 256 >= 224) AS mp3 FROM part")
def mp3_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many sizes that begin with a tag, or with two bytes made of their keys, of which some are a frame's sync."""
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "494433").otherwise(F.concat(F.when(k % 3 == 0, "FF").otherwise("4F"), F.lpad(F.hex(F.floor(k / 2) % 256), 2, "0"), F.lit("00")))
    content = F.unhex(F.concat(head, F.repeat(F.lit("00"), (F.col("p_size") * 10 + 397).cast("int"))))
    return table(spark, sf_dir, "part").select(k, G.is_mp3(content).alias("mp3"))


@R.add(
    f"""WITH {VIDEOS_SQL} SELECT video_id, CASE WHEN video_id % 4 = 0 THEN language ELSE 'vi' END AS language, CASE status WHEN 'processing' THEN 'paused' ELSE status END AS status FROM videos"""
)
def settings_for_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = videos(spark, sf_dir).select("video_id", "language", "status")
    queued = v.filter("video_id % 4 = 0").select("video_id")
    return catalog.interrupted_to_paused(catalog.apply_settings(v, queued.union(queued), "video_id", {"language": "vi"}))


@R.add(
    """WITH c AS (SELECT o_custkey AS session_id, list(CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'imported' END || o_orderkey ORDER BY o_orderkey) AS l, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey)
SELECT session_id, array_to_string(l, ',') AS candidates FROM c ORDER BY latest DESC, session_id DESC LIMIT 1"""
)
def resumed_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest session, what was under way when it ended marked as failed."""
    item = F.struct("o_orderkey", F.when(F.col("o_orderstatus") == "O", "downloading").otherwise("imported").alias("status"))
    sessions = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.max("o_orderdate").alias("updated_at"), F.array_sort(F.collect_list(item)).alias("candidates"))
    last = C.interrupted_to_failed(C.latest_session(sessions))
    return last.select("session_id", F.array_join(F.transform("candidates", lambda c: F.concat(c["status"], c["o_orderkey"].cast("string"))), ",").alias("candidates"))


@R.add(f"WITH {VIDEOS_SQL} SELECT video_id FROM videos WHERE video_id % 3 = 0 AND video_id % 5 <> 0 AND status IN ('pending', 'done')")
def to_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("status") == "pending", "ready").when(F.col("status") == "done", "failed").otherwise("importing")
    c = videos(spark, sf_dir).select("video_id", status.alias("status"), (F.col("video_id") % 3 == 0).alias("selected"), (F.col("video_id") % 5 == 0).alias("duplicate"))
    return C.downloadable(c).select("video_id")


@R.add("WITH l AS (SELECT c_custkey * 13 AS id, c_custkey AS pos FROM customer) SELECT pos, o_orderkey AS id FROM l JOIN orders ON o_orderkey = l.id")
def rows_in_list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 13).alias("id"), F.col("c_custkey").alias("pos"))
    return catalog.find_rows(ids, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id").select("pos", "id")


@R.add(
    """WITH p AS (SELECT c_custkey AS key, 'r' || c_custkey AS root FROM customer WHERE c_custkey % 3 <> 2), m AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN 'r' || (c_custkey + 1) ELSE 'm' || c_custkey END AS root FROM customer WHERE c_custkey % 3 <> 0),
ok AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.root = m.root AND p.key <> m.key)), r AS (SELECT * FROM p WHERE key NOT IN (SELECT key FROM ok) UNION ALL SELECT * FROM ok)
SELECT key, root, (SELECT count(*) FROM r AS o WHERE o.root = r.root) > 1 AS shared FROM r"""
)
def recovered_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    p = c.filter(k % 3 != 2).select(k.alias("key"), F.concat(F.lit("r"), k.cast("string")).alias("root"))
    m = c.filter(k % 3 != 0).select(k.alias("key"), F.when(k % 4 == 0, F.concat(F.lit("r"), (k + 1).cast("string"))).otherwise(F.concat(F.lit("m"), k.cast("string"))).alias("root"))
    rows = catalog.recover(p, m, "key", "root")
    both = catalog.shared_roots(rows, "key", "root").select("key", F.lit(True).alias("shared"))
    return rows.join(both, "key", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


@R.add(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'k' || c_custkey ELSE sha256('p' || c_custkey || ':d:/x') END AS project_key, CASE WHEN c_custkey % 4 = 1 THEN 'batch' ELSE 'single' END AS project_type, 'E:/y/' || c_custkey AS moved FROM customer WHERE c_custkey % 7 <> 6 AND c_custkey % 9 <> 8"""
)
def migrated_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of older versions, some broken, some of a newer version; files moved to another root."""
    k = F.col("c_custkey")
    body = F.struct(F.when(k % 7 == 6, 9).otherwise(2).alias("schema_version"), F.when(k % 5 == 0, F.concat(F.lit("k"), k.cast("string"))).alias("key"), F.concat(F.lit(" P"), k.cast("string")).alias("name"), F.lit("D:\\x\\").alias("directory"), F.when(k % 4 == 1, "batch").otherwise("odd").alias("project_type"))
    rows = table(spark, sf_dir, "customer").select(F.when(k % 9 == 8, "{oops").otherwise(F.to_json(body)).alias("raw"))
    kept, _ = migrate.migrate_projects(rows)
    moved = migrate.rewrite_paths(kept.withColumn("files", F.create_map(F.lit("f"), F.concat(F.lit("D:/x/"), F.regexp_extract("name", "[0-9]+", 0)))), "files", "D:/x/", "E:/y/")
    return moved.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("id"), "project_key", "project_type", F.col("files")["f"].alias("moved"))


@R.add(
    """WITH q AS (SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 3 = 0), new AS (SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders WHERE o_orderkey % 3 = 1),
b AS (SELECT owner, id, n FROM q UNION ALL SELECT owner, id, n + coalesce((SELECT max(n) + 1 FROM q WHERE q.owner = new.owner), 0) FROM new)
SELECT owner, id, CAST(row_number() OVER (PARTITION BY owner ORDER BY n, id) - 1 AS INTEGER) AS "order", CASE WHEN id % 4 = 0 THEN 'old' WHEN id % 10 = 1 THEN 'own' ELSE 'def' END AS caption FROM b WHERE id % 5 <> 2"""
)
def queue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items appended, default texts, one item's text, and items taken out."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), k.alias("id"), F.col("o_orderdate").alias("created_at"), F.when(k % 4 == 0, "posted").otherwise("ready").alias("status"), F.lit("old").alias("caption"), F.lit("").alias("hashtags"))
    queue = catalog.gap_numbering(o.filter("id % 3 = 0"), "owner", [F.col("id")], step=1).withColumn("order", (F.col("position") - 1).cast("int")).drop("position")
    queue = publish.update_defaults(publish.append_items(queue, o.filter("id % 3 = 1"), "owner"), " def ", "#x")
    queue = publish.update_items(queue, {"caption": F.lit("own\n")}, (F.col("id") % 10 == 1) & (F.col("id") % 4 != 0))
    return publish.remove_items(queue, o.filter("id % 5 = 2"), "owner").select("owner", "id", F.col("order").cast("int").alias("order"), "caption")


@R.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'asr=2,tts=1' ELSE 'tts=1' || CASE WHEN o_orderkey % 2 = 0 THEN ',asr=9' ELSE '' END END AS marks FROM orders")
def checkpoint_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    marks = F.when((k % 3 == 0) | (k % 2 == 0), F.create_map(F.lit("asr"), F.lit("1"), F.lit("tts"), F.lit("1"))).otherwise(F.create_map(F.lit("tts"), F.lit("1")))
    rows = table(spark, sf_dir, "orders").select(k, marks.alias("checkpoints"))
    some = publish.mark_checkpoints(rows.filter(k % 3 == 0), "asr", F.lit("2")).unionByName(publish.mark_checkpoints(rows.filter((k % 3 != 0) & (k % 2 == 0)), "asr", F.lit("9"))).unionByName(rows.filter((k % 3 != 0) & (k % 2 != 0)))
    listed = F.transform(F.array_sort(F.map_entries("checkpoints")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return some.select(k, F.when(k % 3 == 0, F.array_join(listed, ",")).otherwise(F.array_join(F.reverse(listed), ",")).alias("marks"))


@R.add(
    """SELECT conv_id, turn, CAST(turn * 2.5 AS DOUBLE) AS start, CAST(turn * 2.5 + 2 AS DOUBLE) AS "end", 'cue ' || turn AS text FROM conversations"""
)
def subtitle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues to one subtitle text a conversation, many to a file, read again."""
    cues = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2).alias("end"), F.concat(F.lit("cue "), F.col("turn").cast("string")).alias("text"))
    path = new_folder(spark)
    files.write_json(files.to_srt(cues, "conv_id").select("conv_id", "value"), path)
    found = files.parse_srt(spark.read.schema("conv_id long, value string").json(path), key="conv_id")
    return found.select("conv_id", F.regexp_extract("text", "([0-9]+)$", 1).cast("long").alias("turn"), "start", "end", "text")


@R.add("SELECT conv_id, turn, CAST(turn * 2.0 AS DOUBLE) AS start, role AS language FROM conversations")
def segment_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a JSON array a conversation, many to a file, and back."""
    seg = F.struct((F.col("turn") * 2.0).alias("start"), (F.col("turn") * 2.0 + 1).alias("end"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("language"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", seg.alias("s")))), lambda x: x["s"])).alias("value"))
    path = new_folder(spark)
    files.write_json(rows, path)
    read = files.parse_segments(spark.read.schema("conv_id long, value string").json(path), key="conv_id")
    return read.select("conv_id", F.col("seq").cast("long").alias("turn"), "start", "language")


@R.add("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON and as a table; the table is written again only if something changed."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    a, b = new_folder(spark), new_folder(spark)
    files.write_json(rows, a)
    read = spark.read.schema(rows.schema).json(a)
    files.write_table(rows, b)
    if not files.unchanged(read, spark.read.parquet(b)):
        raise ValueError("JSON changed the rows")
    return spark.read.parquet(b)


@R.add("SELECT event_id, 'event ' || event_id || ' token: <redacted> <url>' AS line FROM events")
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" token: abc https://a.b/c")).alias("value"))
    path = new_folder(spark)
    files.write_redacted(lines, path)
    return files.read_log(spark, path).filter("value <> ''").select(F.regexp_extract("value", "event ([0-9]+)", 1).cast("long").alias("event_id"), F.col("value").alias("line"))


@R.add(
    """WITH f AS (SELECT DISTINCT 'c:/' || p_name || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.txt' ELSE '.webm' END AS path, p_partkey % 5 * 3000000000 AS size FROM part)
SELECT path, NOT ends_with(path, '.txt') AND size > 0 AND size < 10000000000 AS ok FROM f"""
)
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("c:/"), "p_name", k.cast("string"), _case(k, [".MP4", ".mkv", ".txt", ".webm"])).alias("path"), (k % 5 * 3000000000).alias("size"))
    good, bad = files.media_files(rows.union(rows))
    return good.select("path", F.lit(True).alias("ok")).union(bad.select("path", F.lit(False)))


@R.add("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("path"), F.col("ts").alias("modified"))
    return files.recent_files(rows, 25).select(F.col("path").cast("long").alias("event_id"))


@R.add("SELECT conv_id, turn, 'Dialogue: 0,' || c || '.50,' || c || '.75,Default,,0,0,0,,a\\{' || turn || '\\}' AS line FROM (SELECT conv_id, turn, printf('%d:%02d:%02d', turn // 3600, turn % 3600 // 60, turn % 60) AS c FROM conversations)")
def positioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 0.5).alias("start"), (F.col("turn") + 0.75).alias("end"), F.concat(F.lit("a{"), F.col("turn").cast("string"), F.lit("}")).alias("text"))
    return files.to_ass_events(cues).select("conv_id", "turn", F.col("value").alias("line"))


@R.add("SELECT event_id FROM events e WHERE event_id % 3 = user_id % 3")
def current_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the request that is the present one of their user."""
    e = table(spark, sf_dir, "events")
    now = e.select("user_id", (F.col("user_id") % 3).alias("generation")).distinct()
    return feeds.current_only(e.select("event_id", "user_id", (F.col("event_id") % 3).alias("generation")), now, "user_id").select("event_id")


@R.add(
    """WITH l AS (SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY user_id) SELECT user_id, event_id, event_id % 2 = 0 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS remembered FROM l"""
)
def last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, and whether it is a failure of the last hour."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 2 == 1).alias("ok"))
    now = F.lit(e.agg(F.max("ts").cast("string")).first()[0]).cast(e.schema["ts"].dataType)
    last = feeds.latest_state(e, "user_id", ["ts", -F.col("event_id")])  # of events at one moment the first, as arg_max reads them
    return last.select("user_id", "event_id", feeds.is_remembered(F.col("ok"), F.col("ts"), now, 3600).alias("remembered"))


@R.add("SELECT user_id, count(*) AS events, max(event_id) AS newest FROM events GROUP BY user_id")
def maintained_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events that keeps a table of the latest event of each user, then counted again from the source."""
    path = new_folder(spark)
    source = f"{path}/source"
    table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_id").alias("revision")).repartition(3).write.parquet(source)
    schema = "user_id long, event_id long, revision long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    kept = maintained.BucketTable(spark, f"{path}/kept", "user_id", "revision", schema, buckets=16)
    maintained.maintain_buckets(stream, kept, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    counts = spark.read.parquet(source).groupBy("user_id").agg(F.count("*").alias("events"))
    return kept.read().join(counts, "user_id").select("user_id", "events", F.col("event_id").alias("newest"))


@R.add(
    """WITH e AS (SELECT user_id, list({'kept': CAST([] AS BIGINT[]), 'last': '', 'since': 0.0, 'id': event_id, 'v': event_type, 't': epoch_us(ts) / 1e6} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id)
SELECT unnest(list_reduce(l, lambda a, b: CASE WHEN len(a.kept) = 0 OR a.last <> b.v OR b.t - a.since >= 36000 THEN {'kept': list_append(a.kept, b.id), 'last': b.v, 'since': b.t, 'id': b.id, 'v': b.v, 't': b.t}
  ELSE {'kept': a.kept, 'last': a.last, 'since': a.since, 'id': b.id, 'v': b.v, 't': b.t} END, {'kept': CAST([] AS BIGINT[]), 'last': '', 'since': 0.0, 'id': 0, 'v': '', 't': 0.0}).kept) AS event_id FROM e"""
)
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events: of each user those of another type than the one let through last, or ten hours after it."""
    path = new_folder(spark)
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{path}/source")
    stream = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").parquet(f"{path}/source")
    out = feeds.throttled(stream, "user_id", "event_type", "ts", 36_000)
    out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{path}/kept").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/kept").select("event_id")
