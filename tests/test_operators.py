"""Operators without SQL against plain Python, and exact small cases."""

import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions import numbers as N
from cuemill.functions import text as X
from cuemill.operators import candidates, catalog, migrate, publish, regions
from cuemill.operators import timed_text as T


def one(spark, expr, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(expr.alias("x")).first()["x"]


def each(spark, function, values, *more):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", function(F.col("v"), *more).alias("x")).orderBy("i").collect()]


def test_url_keys(spark):
    cases = {
        "https://Example.com/a/b/?utm_source=x#frag": "https://example.com/a/b", "http://m.YouTube.com/watch?list=1&v=Ab_1&t=3": "https://m.youtube.com/watch?v=Ab_1", "example.com": "https://example.com/",
        "https://user@host.org:8080/": "https://host.org/", "": "", " not a url but host": "https:// not a url but host/", "https:///nohost/X": "https:///nohost/x",
    }
    got = each(spark, X.url_key, list(cases))
    assert [g for c, g in zip(cases, got, strict=True) if "not a url" not in c] == [v for c, v in cases.items() if "not a url" not in c]
    assert each(spark, X.platform_of_host, ["youtube.com", "m.youtube.com", "notyoutube.com", "x.com", "vk.com"]) == ["YouTube", "YouTube", "", "X", "VK"]


def test_captions_and_posts(spark):
    assert each(spark, X.normalize_caption, [" a  b \r\n\n c\t d ", None, "x" * 3000]) == ["a b\nc d", "", "x" * 2200]
    assert each(spark, X.hashtag_list, ["#One, one;#TWO  _x_ ##é!a", "", None]) == [["#One", "#TWO", "#x", "#éa"], [], []]
    assert each(spark, lambda c: X.truncate_utf16(c, 4), ["ab😀cd", "abc😀d", "abcd", "a b  c"]) == ["ab😀", "abc", "abcd", "a b"]
    assert each(spark, X.utf16_length, ["a😀", ""]) == [3, 0]
    queue = spark.createDataFrame([("c" * 2300, "#Fyp #review #fyp #Video"), ("", "#a"), ("cap", "")], "caption string, hashtags string")
    posts = [r["post_text"] for r in publish.with_post_text(queue).collect()]
    assert posts[1:] == ["#a", "cap"] and len(posts[0]) == 2200 and posts[0].endswith("c\n#Fyp #review #Video")


def test_texts(spark):
    assert each(spark, X.speech_text, ["Xin chào​,  bạn – khoẻ…", "ok !", "", None]) == ["Xin chào, bạn, khoẻ...", "ok!", "", ""]
    assert each(spark, X.redact, ["token: abc, see https://a.b/c", "a@b.co C:\\Users\\x /home/me/y"]) == ["token: <redacted>, see <url>", "<email> <path>"]
    assert each(spark, X.unwrap_translation, ['```json\n["hi"]\n```', '"x y"', " ", "plain"]) == ["hi", "x y", None, "plain"]
    assert each(spark, lambda c: X.join_text(F.lit("你"), c), ["好", " 好", ", x", ""]) == ["你好", "你 好", "你, x", "你"]
    assert each(spark, lambda c: X.wrap_lines(c, 10), ["one two three four", "abcdefghijklmno p", ""]) == ["one two\nthree four", "abcdefghijklmno\np", ""]
    assert each(spark, T.sentences, ["One 3.14 two. Three!? (Four.) five", "你好。再见！a", ""]) == [["One 3.14 two.", "Three!?", "(Four.)", "five"], ["你好。", "再见！", "a"], []]
    assert each(spark, X.is_standalone_label, ["A b c d", "a b c d e", "", "x" * 49]) == [True, False, False, False]
    kinds = ["NoAudioReceived", "ServerTimeoutError", "ClientConnectorError", "ValueError", "OSError", "RuntimeError", "KeyError", None]
    codes = ["edge_no_audio", "network_timeout", "network_connection", "invalid_tts_input", "file_io", "invalid_audio", "unexpected_error", "unexpected_error"]
    assert each(spark, lambda c: X.error_code(c, F.lit("Invalid MP3 data")), kinds) == codes
    assert each(spark, lambda c: X.error_code(F.lit("ConnectionTimeout"), c), ["no audio was received, timed out", "reset", None]) == ["edge_no_audio", "network_timeout", "network_timeout"]
    assert each(spark, lambda c: X.is_gpu_failure(c, F.lit(True)), ["CUDA error", "native torch crash in cuda", "disk full", None]) == [True, False, False, False]
    assert each(spark, lambda c: X.is_retryable(c, F.lit("TikTok")), ["\x1b[31mHTTP Error 429", "Requested format is not available", "HTTP Error 403", None]) == [True, True, False, False]
    assert each(spark, lambda c: X.is_retryable(c, F.lit("YouTube")), ["HTTP Error 429", "No formats found"]) == [False, True]
    assert each(spark, lambda c: X.retranscription_language(c, F.lit("xin chao"), F.lit("vi")), ["zh", "vi", "fr"]) == ["vi", "vi", "fr"]


def test_numbers(spark):
    assert each(spark, lambda c: N.count_label(c.cast("long")), ["999", "1000", "1250000", "3000000000", None, "0"]) == ["999", "1K", "1.2M", "3B", "-", "0"]
    ties = [str(n) for n in [*range(1050, 200_000, 100), *range(1_050_000, 90_000_000, 1_100_000), 999_950, 999_949, 10_150_000_000]]
    assert each(spark, lambda c: N.count_label(c.cast("long")), ties) == [f"{int(n) / u:.1f}".removesuffix(".0") + s for n in ties for u, s in [next((u, s) for u, s in ((10**9, "B"), (10**6, "M"), (1000, "K")) if int(n) >= u)]]
    assert each(spark, lambda c: N.duration_label(c.cast("int")), ["59", "61", "3661", "-4", None]) == ["0:59", "1:01", "1:01:01", "0:00", "0:00"]
    assert each(spark, lambda c: N.clamped_int(c, 0, 100, 60), ["999", "-4", "x", None, "44"]) == [100, 0, 60, 60, 44]
    assert each(spark, N.date_label, ["20240131", "soon"]) == ["2024-01-31", "soon"]
    assert each(spark, lambda c: N.token_budget(c.cast("int")), ["1", "6", "50", "900"]) == [24, 48, 160, 256]
    assert each(spark, lambda c: N.tempo_chain(c.cast("double")), ["0.5", "2", "5"]) == [[1.0], [2.0], [2.0, 2.0, 1.25]]
    assert each(spark, lambda c: N.ass_time(c.cast("double")), ["3661.239"]) == ["1:01:01.24"]
    assert each(spark, lambda c: N.percent_of(c.cast("int"), F.lit(8)), ["1", "20"]) == [12, 100]


def test_project_ladder(spark):
    rows = [("a", 1, "done", 100), ("a", 2, "processing", 50), ("b", 3, "done", 100), ("c", 4, "done", 100), ("c", 5, "failed", 0), ("z", 6, "odd", 5)]
    videos = spark.createDataFrame([(*r, "2024", "2024", 0, "t" if r[1] == 2 else "") for r in rows], "project_key string, video_id int, status string, progress int, updated_at string, created_at string, batch_import_order int, thumbnail string")
    projects = spark.createDataFrame([("a", "batch"), ("b", "single"), ("d", "download"), ("e", "batch")], "project_key string, project_type string")
    got = {r["project_key"]: (r["video_count"], r["status"], r["progress"], r["thumbnail"]) for r in catalog.rollup_projects(projects, videos).collect()}
    assert got == {"a": (2, "processing", 75, "t"), "b": (1, "done", 100, ""), "c": (2, "failed", 50, ""), "d": (0, "ready", 0, ""), "e": (0, "empty", 0, ""), "z": (1, "odd", 5, "")}


def test_greedy_dedup_is_a_fold(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randrange(12), rng.randrange(12)) for g in range(6) for i in range(30)] + [(9, 1, 1, 1), (9, 2, 2, 1), (9, 3, 2, 2)]
    want = []
    for g in {r[0] for r in rows}:
        ids, urls = set(), set()
        for r in rows:
            if r[0] == g and r[2] not in ids and r[3] not in urls:
                ids.add(r[2])
                urls.add(r[3])
                want.append(r)
    got = candidates.greedy_dedup(spark.createDataFrame(rows, "g int, pos int, id int, url int"), "g", "id", "url", "pos").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {tuple(r) for r in got} >= {(9, 1, 1, 1), (9, 3, 2, 2)}


ENTRIES = [
    {"position": 0, "id": "a1", "title": " T ", "duration": "61", "view_count": "0", "play_count": "7", "upload_date": "20240101"},
    {"position": 1, "id": "b", "is_live": True},
    {"position": 2, "display_id": "c", "webpage_url": "https://x/y", "description": "d", "timestamp": "86400", "duration": "bad", "thumbnails": [("t1",), ("t2",)]},
    {"position": 3, "id": "e", "availability": "Private"},
    {"position": 4, "title": "no id"},
]


def test_candidates(spark):
    schema = "position long, " + candidates.ENTRY
    names = [f.split()[0] for f in schema.replace("array<struct<ext:string,vcodec:string>>", "x").split(", ")]
    rows = spark.createDataFrame([tuple(e.get(n) for n in names) for e in ENTRIES], schema)
    got = [(r["remote_video_id"], r["source_url"], r["title"], r["duration_seconds"], r["view_count"], r["published_at"], r["thumbnail_url"]) for r in candidates.to_candidates(rows, "YouTube").orderBy("position").collect()]
    assert got == [("a1", "https://www.youtube.com/watch?v=a1", "T", 61, 7, "20240101", ""), ("c", "https://x/y", "d", 0, None, "19700102", "t2")]
    assert [r["x"] for r in rows.select(candidates.is_not_video().alias("x")).collect()] == [False] * 5


SEG = "k int, seq int, start double, end double, text string, language string"


def test_folds_on_known_cases(spark):
    frame = lambda rows: spark.createDataFrame([(1, i, float(r[0]), float(r[1]), *r[2:]) for i, r in enumerate(rows)], SEG)
    fixed = T.repair_overlaps(frame([(1.0, 3.0, "a", "en"), (2.5, 4.0, "b", "en")]), "k", ["seq"]).orderBy("seq").collect()
    assert [(r["start"], r["end"], r["repaired"]) for r in fixed] == [(1.0, 2.75, 1), (2.75, 4.0, 1)]
    short = T.coalesce_short(frame([(20.0, 21.75, "a", "x"), (21.75, 21.874, "b", "x"), (30.0, 31.0, "c", "x")]), "k", ["seq"]).orderBy("pos").collect()
    assert [(r["start"], r["end"], r["text"]) for r in short] == [(20.0, 21.874, "a b"), (30.0, 31.0, "c")]
    first = T.coalesce_short(frame([(0.0, 0.2, "a", "x"), (0.3, 2.0, "b", "x")]), "k", ["seq"]).collect()
    assert [(r["start"], r["end"], r["text"]) for r in first] == [(0.0, 2.0, "a b")]
    groups = T.span_groups(frame([(0, 1, "", "en"), (1.5, 2, "", "en"), (2, 3, "", "fr"), (6, 7, "", "fr"), (7, 80, "", "fr"), (80, 82, "", "fr")]), "k", ["seq"]).orderBy("seq").collect()
    assert [r["group_id"] for r in groups] == [1, 1, 2, 3, 3, 4]
    merged = T.merge_contiguous(frame([(0, 5.57, "one", ""), (5.57, 7, "two.", ""), (7, 7.5, "three", "")]), "k", ["seq"]).orderBy("pos").collect()
    assert [(r["end"], r["text"]) for r in merged] == [(7.0, "one two."), (7.5, "three")]


def plain_repair(rows):
    rows, n = [list(r) for r in rows], 0
    for p, c in zip(rows, rows[1:], strict=False):
        if p[1] - c[0] <= 0.05:
            continue
        low = p[0] + min(0.25, max(0.001, (p[1] - p[0]) / 2))
        high = c[1] - min(0.25, max(0.001, (c[1] - c[0]) / 2))
        if low <= high:
            p[1] = c[0] = round(min(max((p[1] + c[0]) / 2, low), high), 3)
            n += 1
    return rows, n


def test_repair_equals_plain_fold(spark):
    rng = random.Random(4)
    groups = {k: sorted((round(rng.uniform(0, 20), 2), 0) for _ in range(15)) for k in range(8)}
    groups = {k: [(a, round(a + rng.uniform(0.1, 4), 2)) for a, _ in g] for k, g in groups.items()}
    rows = spark.createDataFrame([(k, i, a, b, "", "") for k, g in groups.items() for i, (a, b) in enumerate(g)], SEG)
    got = T.repair_overlaps(rows, "k", ["seq"]).orderBy("k", "seq").collect()
    want = [(k, x[0], x[1], n) for k, g in groups.items() for r, n in [plain_repair(g)] for x in r]
    assert all(a["k"] == b[0] and a["repaired"] == b[3] and abs(a["start"] - b[1]) < 0.0011 and abs(a["end"] - b[2]) < 0.0011 for a, b in zip(got, want, strict=True))


def test_cues_keep_text_and_span(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "word", "longerword", "end.", "why?"]) for _ in range(rng.randint(1, 40))) for _ in range(20)]
    rows = spark.createDataFrame([(1, i, float(i), i + 9.0, t, "") for i, t in enumerate(texts)], SEG)
    cues = T.split_cues(rows, ["k", "seq"], 24).orderBy("seq", "pos").collect()
    for i, t in enumerate(texts):
        mine = [c for c in cues if c["seq"] == i]
        assert " ".join(c["cue"].replace("\n", " ") for c in mine) == t
        assert mine[0]["cue_start"] == i and i + 9.0 <= mine[-1]["cue_end"] <= i + 9.1  # a cue lasts 0.1 s at least
        assert all(len(c["cue"].split()) <= 8 and c["cue"].count("\n") < 2 for c in mine)


def test_phrases():
    assert regions.phrases("one two three four five six", 12) == ["one two three", "four five six"]
    assert regions.phrases("", 10) == [""]
    parts = regions.phrases("字" * 14, 6)
    assert "".join(parts) == "字" * 14 and max(map(len, parts)) - min(map(len, parts)) <= 1
    rng = random.Random(6)
    for _ in range(200):
        text = " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 12)))
        assert " ".join(regions.phrases(text, 14, strict=True)) == text


def test_caption_region(spark):
    rows = []
    for f in range(8):
        rows += [("v", f, 30.0, 80.0, 15.0, 4.0, f"hello{f}", 0.9), ("v", f, 46.0, 80.5, 20.0, 4.0, "there", 0.9), ("v", f, 40.0, 5.0, 20.0, 4.0, "LOGO", 0.95), ("v", f, 1.0, 1.0, 2.0, 2.0, "x", 0.9)]
    rows += [("w", f, 30.0, 80.0, 40.0, 4.0, "same", 0.9) for f in range(8)]
    got = regions.caption_regions(spark.createDataFrame(rows, regions.BOX)).collect()
    assert [(r["video_id"], r["x_percent"], r["y_percent"], r["width_percent"], r["height_percent"], r["samples"]) for r in got] == [("v", 30.0, 80.0, 36.0, 4.5, 8)]


def test_migration(spark):
    raws = ['{"video_id":"a","original_video_volume":999,"tts_volume":-4,"subtitle_style":{"font_size":-2},"crop":{"zoom_percent":0},"watermark_text":" a  b "}', "not json", '{"schema_version": 9}', "[1]", '{"video_id":"z","crop":"odd","files":3,"tts_volume":[1],"schema_version":"2","status":"error"}']
    kept, rejected = migrate.migrate_videos(spark.createDataFrame([(r,) for r in raws], "raw string"))
    z = kept.filter("video_id = 'z'").first()
    assert (z["crop"]["zoom_percent"], z["files"], z["tts_volume"], z["status"]) == (100, {}, 100, "failed")
    r = kept.filter("video_id = 'a'").first()
    assert (r["schema_version"], r["original_video_volume"], r["background_music_volume"], r["tts_volume"], r["subtitle_style"]["font_size"], r["crop"]["zoom_percent"], r["watermark_text"], r["status"]) == (8, 100, 30, 0, 10, 1, "a b", "pending")
    assert sorted(x["reason"] for x in rejected.collect()) == ["corrupt", "corrupt", "newer version"]
    projects, _ = migrate.migrate_projects(spark.createDataFrame([('{"name":"N","directory":"/d"}',)], "raw string"))
    assert len(projects.first()["project_key"]) == 64


def test_queue_updates(spark):
    items = spark.createDataFrame([("p", "a", 5, "one", "#x", "posted", "1", "", "/a"), ("p", "b", 2, "two", "", "", "2", "", "/gone")], "project string, id string, order int, caption string, hashtags string, status string, created_at string, error string, file_path string")
    queue = publish.load_queue(items, "project", spark.createDataFrame([("/a",)], "path string"))
    assert {r["id"]: (r["order"], r["status"]) for r in queue.collect()} == {"b": (0, "missing"), "a": (1, "posted")}
    changed = {r["id"]: (r["caption"], r["hashtags"]) for r in publish.update_defaults(queue, " new  text ", "a a b").collect()}
    assert changed == {"a": ("one", "#x"), "b": ("new text", "#a #b")}
    more = publish.append_items(queue, queue.filter("id = 'a'").withColumn("id", F.lit("c")), "project")
    assert {r["id"]: r["order"] for r in more.collect()} == {"b": 0, "a": 1, "c": 2}
    assert {r["id"]: r["order"] for r in publish.remove_items(more, spark.createDataFrame([("a",)], "id string"), "project").collect()} == {"b": 0, "c": 1}


@pytest.mark.parametrize("limit", [(3, 30), (2, 10), (10, 13), (10, 14)])
def test_log_tail_is_the_longest_suffix(spark, limit):
    lines = ["one", "two", "three", "four"]
    rows = spark.createDataFrame(list(enumerate(lines)), "seq int, line string")
    got = [r["line"] for r in publish.log_tail(rows, "seq", "line", most_lines=limit[0], most_characters=limit[1]).orderBy("seq").collect()]
    want = max((lines[i:] for i in range(5) if len(lines[i:]) <= limit[0] and len("\n".join(lines[i:])) <= limit[1]), key=len)
    assert got == want
