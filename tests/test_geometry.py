from pyspark.sql import functions as F

from cuemill.functions import geometry as G

CROP = "zoom_percent int, pan_x_percent int, pan_y_percent int, left_percent int, right_percent int, top_percent int, bottom_percent int"


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def column(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def crop(**fields):
    names = [c.split()[0] for c in CROP.split(", ")]
    return F.struct(*[F.lit(fields.get(n, 100 if n == "zoom_percent" else 0)).alias(n) for n in names])


def test_crop_and_region(spark):
    assert tuple(value(spark, G.crop_box(F.lit(1000), F.lit(500), crop()))) == (0, 0, 1000, 500)
    assert tuple(value(spark, G.crop_box(F.lit(1000), F.lit(500), crop(zoom_percent=200, pan_x_percent=100)))) == (500, 125, 500, 250)
    assert tuple(value(spark, G.crop_box(F.lit(1000), F.lit(500), crop(left_percent=10, right_percent=90)))) == (100, 0, 150, 500)
    region = F.struct(*[F.lit(v).alias(k) for k, v in (("x_percent", 25.0), ("y_percent", 80.0), ("width_percent", 50.0), ("height_percent", 10.0), ("line_height_percent", 5.0))])
    box = G.crop_box(F.lit(1920.0), F.lit(1080.0), crop())
    plain = value(spark, G.output_region(region, F.lit(1920.0), F.lit(1080.0), box, F.lit("original"), F.lit(960.0), F.lit(540.0)))
    assert tuple(round(v, 6) for v in plain) == (240, 432, 480, 54, 27)
    fit = value(spark, G.output_region(region, F.lit(1920.0), F.lit(1080.0), box, F.lit("blur_background_9_16"), F.lit(1080.0), F.lit(1920.0)))
    assert (round(fit["x"], 3), round(fit["y"], 3), round(fit["width"], 3)) == (270.0, 1142.25, 540.0)
    assert value(spark, G.output_region(region, F.lit(40.0), F.lit(40.0), G.crop_box(F.lit(40.0), F.lit(40.0), crop()), F.lit("original"), F.lit(40.0), F.lit(40.0))) is None
    assert tuple(value(spark, G.even_region(region, F.lit(1921), F.lit(1081)))) == (480, 864, 960, 108)
    assert value(spark, G.feather(F.lit(100), F.lit(110))) == 8
    assert tuple(value(spark, G.blur_radii(F.lit(30), F.lit(100)))) == (14, 7)


def test_rules(spark):
    assert column(spark, G.name_error, ["ok", " ", "a<b", "x.", "con.txt", "n" * 121]) == [None, "empty", "barred character", "bad end", "reserved", "too long"]
    assert column(spark, lambda c: G.is_inside(c, F.lit("/data/p")), ["/data/p/a", "/data/p", "/data/pq/a", "/data/p/../q", "/data/p//x/"]) == [True, False, False, False, True]
    mp3 = lambda head: F.lit(head + bytes(600))
    assert [value(spark, G.is_mp3(mp3(h))) for h in (b"ID3", b"\xff\xfb\x00", b"RIF")] == [True, True, False] and value(spark, G.is_mp3(F.lit(b"ID3"))) is False
    assert value(spark, G.runtime_profile(F.lit(False), F.lit(0), F.lit(8 * G.GIB), F.lit(16)))["key"] == "cpu_low_memory"
    assert tuple(value(spark, G.runtime_profile(F.lit(True), F.lit(24 * G.GIB), F.lit(0), F.lit(2)))) == ("cuda", 2, 16, 0)
