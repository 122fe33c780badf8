"""Picture geometry and eligibility rules on columns; a region is a struct of x, y, width, height and line_height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .links import bound
from .numbers import clamp

GIB = 1024**3
# Names that Windows keeps for devices, and characters that it bars from names.
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"{n}{i}" for n in ("COM", "LPT") for i in range(1, 10)))
BARRED_CHARACTERS = r'[<>:"/\\|?*\x00-\x1f]'


def _box(x: Column, y: Column, width: Column, height: Column, *line: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"), *[c.alias("line_height") for c in line])


def crop_box(width: Column, height: Column, crop: Column) -> Column:
    """What a crop leaves of a picture: by its edges if any is set, else by zoom and pan."""
    return bound(crop, lambda c: _crop_box(width, height, c))


def _crop_box(width: Column, height: Column, crop: Column) -> Column:
    edge = lambda name: clamp(crop[name], 0, 84) / 100
    has_edges = F.greatest(*[F.abs(crop[f"{n}_percent"]) for n in ("left", "right", "top", "bottom")]) > 0
    left, right, top, bottom = (edge(f"{n}_percent") for n in ("left", "right", "top", "bottom"))
    zoom = F.greatest(crop["zoom_percent"] / 100, F.lit(1.0))
    w, h = width / zoom, height / zoom
    pan = lambda name: clamp((crop[name] + 100) / 200, 0.0, 1.0)
    by_edges = _box(width * left, height * top, width * F.greatest(F.lit(0.15), 1 - left - right), height * F.greatest(F.lit(0.15), 1 - top - bottom))
    return F.when(has_edges, by_edges).otherwise(_box((width - w) * pan("pan_x_percent"), (height - h) * pan("pan_y_percent"), w, h))


def output_region(region: Column, width: Column, height: Column, crop: Column, output_format: Column, output_width: Column, output_height: Column) -> Column:
    """A source region (percent fields) in the output picture, cut to it; null if under 24 by 20.

    ``crop`` is the struct of ``crop_box``. A plain format stretches the crop to the output, the two upright ones scale
    it to cover or to fit 1080 by 1920 and centre it.
    """
    given = F.struct(region.alias("region"), crop.alias("crop"), output_format.alias("format"))
    return bound(given, lambda g: _output_region(g["region"], width, height, g["crop"], g["format"], output_width, output_height))


def _output_region(region: Column, width: Column, height: Column, crop: Column, output_format: Column, output_width: Column, output_height: Column) -> Column:
    cover = F.greatest(1080 / crop["width"], 1920 / crop["height"])
    fit = F.least(1080 / crop["width"], 1920 / crop["height"])
    upright = output_format.isin("tiktok_9_16_crop", "blur_background_9_16")
    scale = F.when(output_format == "tiktok_9_16_crop", cover).otherwise(fit)
    across = F.when(upright, scale).otherwise(output_width / F.greatest(F.lit(1.0), crop["width"]))
    down = F.when(upright, scale).otherwise(output_height / F.greatest(F.lit(1.0), crop["height"]))
    shift = lambda size, out: F.when(upright, (out - size * scale) / 2).otherwise(0.0)
    x = (width * region["x_percent"] / 100 - crop["x"]) * across + shift(crop["width"], output_width)
    y = (height * region["y_percent"] / 100 - crop["y"]) * down + shift(crop["height"], output_height)
    right = F.least(output_width, x + width * region["width_percent"] / 100 * across)
    bottom = F.least(output_height, y + height * region["height_percent"] / 100 * down)
    line = height * F.coalesce(region["line_height_percent"], region["height_percent"]) / 100 * down
    edges = F.struct(F.greatest(F.lit(0.0), x).alias("left"), F.greatest(F.lit(0.0), y).alias("top"), right.alias("right"), bottom.alias("bottom"), line.alias("line"))
    cut = lambda e: F.when((e["right"] - e["left"] >= 24) & (e["bottom"] - e["top"] >= 20), _box(e["left"], e["top"], e["right"] - e["left"], e["bottom"] - e["top"], e["line"]))
    return bound(edges, cut)


def region_style(layout: Column, outline: Column, output_width: Column, output_height: Column) -> Column:
    """Position, font size and outline of captions centred in a region, sized after one of its rows."""
    return bound(layout, lambda box: _region_style(box, outline, output_width, output_height))


def _region_style(layout: Column, outline: Column, output_width: Column, output_height: Column) -> Column:
    at = lambda start, size, whole: F.bround(clamp((layout[start] + layout[size] / 2) * 100 / whole, 0.0, 100.0)).cast("int")
    font = clamp(F.bround(F.coalesce(layout["line_height"], layout["height"]) * 0.6), 12.0, 112.0).cast("int")
    return F.when(layout.isNotNull(), F.struct(at("x", "width", output_width).alias("position_x_percent"), at("y", "height", output_height).alias("position_y_percent"), font.alias("font_size"), F.least(outline, F.greatest(F.lit(1), F.floor(font / 14).cast("int"))).alias("outline")))


def default_layout(box_percent: Column, y_percent: Column, output_width: Column, output_height: Column) -> Column:
    """A wide caption row for pictures without captions of their own."""
    width = F.greatest(F.lit(160.0), output_width * F.greatest(F.lit(0.82), box_percent / 100))
    height = F.greatest(F.lit(72.0), output_height * 0.07)
    y = F.greatest(height / 2, F.least(output_height - height / 2, output_height * y_percent / 100 - height / 2))
    return _box((output_width - width) / 2, y, F.least(width, output_width), height)


def even_region(region: Column, width: Column, height: Column) -> Column:
    """The region in even pixels, as codecs need; null if nothing is left."""
    even = lambda whole, name: (F.floor(F.floor(whole * region[name] / 100) / 2) * 2).cast("int")
    x, y = even(width, "x_percent"), even(height, "y_percent")
    w = F.least(F.greatest(F.lit(2), even(width, "width_percent")), width - x)
    h = F.least(F.greatest(F.lit(2), even(height, "height_percent")), height - y)
    return F.when((w >= 2) & (h >= 2), _box(x, y, w, h))


def feather(width: Column, height: Column) -> Column:
    n = clamp(F.bround(F.least(width, height) * 0.08).cast("int"), 2, 16)
    return n + n % 2


def blur_radii(width: Column, height: Column) -> Column:
    side = F.greatest(F.lit(2), F.least(width, height))
    return F.struct(F.least(F.lit(18), F.floor((side - 2) / 2).cast("int")).alias("luma"), F.least(F.lit(9), F.floor((side - 2) / 4).cast("int")).alias("chroma"))


def fitted_font(length: Column, layout: Column, preferred: Column, outline: Column) -> Column:
    """The largest font, at most the preferred, at which a line fits its region."""
    across = F.greatest(F.lit(24.0), layout["width"] - outline * 4) / F.greatest(F.lit(1.0), length * 0.48)
    row = F.least(layout["height"], F.coalesce(F.nullif(layout["line_height"], F.lit(0.0)), layout["height"]))
    down = F.greatest(F.lit(20.0), row - outline * 2) / 1.05
    return F.greatest(F.lit(10), F.least(preferred, F.floor(down).cast("int"), F.floor(across).cast("int")))


def name_error(name: Column) -> Column:
    """What is wrong with a new project's name, null if nothing."""
    n = F.trim(name)
    stem = F.upper(F.regexp_extract(n, r"^([^.]*)", 1))
    return F.when(F.coalesce(n, F.lit("")) == "", "empty").when(F.length(n) > 120, "too long").when(n.rlike(BARRED_CHARACTERS), "barred character").when(n.rlike("[ .]$"), "bad end").when(stem.isin(*RESERVED_NAMES), "reserved")


def is_inside(path: Column, root: Column) -> Column:
    """Whether a path is below a root, by its parts; one that climbs ("..") is not."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/(\\./)+|/{2,}", "/"), "/$", "")
    return ~plain(path).rlike(r"(^|/)\.\.(/|$)") & plain(path).startswith(F.concat(plain(root), F.lit("/")))


def is_mp3(content: Column, least: int = 512) -> Column:
    """By the header of the content and its size."""
    head = F.hex(F.substring(content, 1, 3))
    sync = F.substring(head, 1, 2) == "FF"
    return (F.octet_length(content) >= least) & ((head == "494433") | sync & F.substring(head, 3, 1).isin("E", "F"))


def runtime_profile(use_gpu: Column, vram: Column, ram: Column, cpus: Column, full_vram: int = 8 * GIB) -> Column:
    """Key, threads, batch size and idle seconds of a machine."""
    gib = F.coalesce(F.nullif(ram, F.lit(0)) / GIB, F.lit(16.0))
    spare = F.when(cpus > 2, cpus - 1).otherwise(cpus)
    row = lambda key, most, batch, idle: F.struct(F.lit(key).alias("key"), F.greatest(F.lit(1), F.least(F.lit(most), cpus if most == 2 else spare)).alias("cpu_threads"), F.lit(batch).alias("batch_size"), F.lit(idle).alias("idle_seconds"))
    gpu = F.when(vram < full_vram, row("cuda_low_memory", 8, 8, 0)).otherwise(row("cuda", 8, 16, 0))
    return F.when(use_gpu, gpu).when(gib >= 14, row("cpu_balanced", 8, 4, 300)).when(gib >= 7, row("cpu_low_memory", 4, 2, 90)).otherwise(row("cpu_minimum", 2, 1, 30))
