"""Caption regions from text boxes by first-fit grouping in the JVM, and balanced phrases by dynamic programming.

First-fit is a fold in order, as each choice depends on the groups made so far. Boxes that no group could ever join are parted
first: along a sweep, a gap wider than any group reaches over cuts the boxes of a frame, or of a video, into independent
pieces, and only a piece is folded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.functions.links import bound
from cuemill.functions.text import is_meaningful, text_key
from cuemill.sources.shared import written

LEAST_CONFIDENCE = 0.68
BOX = "video_id string, frame int, x double, y double, width double, height double, text string, confidence double"
GROUP = "array<struct<n:int,middles:double,x:double,y:double,right:double,bottom:double,text:string,confidence:double>>"
#: Added to the widest gap that a group may reach over: pieces may be too large, never too small.
SLACK = 1e-6


def _first_fit(items: Column, kind: str, start: Callable, fits: Callable, joined: Callable) -> Column:
    """Groups of the ``items`` of an array: each joins the first group that ``fits`` it, or starts one."""

    def step(groups: Column, item: Column) -> Column:
        first = F.array_position(F.transform(groups, lambda g: fits(g, item)), F.lit(True))
        put = lambda at: F.when(at == 0, F.concat(groups, F.array(start(item)))).otherwise(F.transform(groups, lambda g, i: F.when(i + 1 == at, joined(g, item)).otherwise(g)))
        return bound(first, put)

    return F.aggregate(items, F.array().cast(kind), step)


def _pieces(rows: DataFrame, by: list[str], low: Column, high: Column, reach: float) -> DataFrame:
    """``rows`` with ``piece``, counted up where ``low`` is further than ``reach`` from every ``high`` before it."""
    w = Window.partitionBy(*by).orderBy("__low")
    far = F.max("__high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__low", low).withColumn("__high", high).withColumn("__new", (F.col("__low") - far > reach + SLACK).cast("int"))
    return marked.withColumn("piece", F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__low", "__high", "__new")


def _grouped(pieces: DataFrame, order: list[str], fits: Callable) -> DataFrame:
    """Boxes of each piece of a frame joined first-fit in order to their envelopes."""
    rest = [c for c in ("x", "y", "text", "confidence", "width", "height") if c not in order]
    found = pieces.groupBy("video_id", "frame", "piece").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("items"))
    middle = lambda b: b["y"] + b["height"] / 2
    right, bottom = (lambda b: b["x"] + b["width"]), (lambda b: b["y"] + b["height"])
    made = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, ("n", "middles", "x", "y", "right", "bottom", "text", "confidence"), strict=True)])
    start = lambda b: made(F.lit(1), middle(b), b["x"], b["y"], right(b), bottom(b), b["text"], b["confidence"])
    joined = lambda g, b: made(g["n"] + 1, g["middles"] + middle(b), F.least(g["x"], b["x"]), F.least(g["y"], b["y"]), F.greatest(g["right"], right(b)), F.greatest(g["bottom"], bottom(b)), F.concat_ws(" ", g["text"], b["text"]), g["confidence"] + b["confidence"])
    each = found.select("video_id", "frame", F.explode(_first_fit(F.col("items"), GROUP, start, fits, joined)).alias("g"))
    g = F.col("g")
    return each.select("video_id", "frame", g["x"].alias("x"), g["y"].alias("y"), (g["right"] - g["x"]).alias("width"), (g["bottom"] - g["y"]).alias("height"), g["text"].alias("text"), (g["confidence"] / g["n"]).alias("confidence"))


def lines(boxes: DataFrame) -> DataFrame:
    """Word boxes joined to lines: middles within 2.5 and a gap of at most 8 per cent."""
    usable = boxes.filter((F.col("confidence") >= LEAST_CONFIDENCE) & is_meaningful(F.col("text")))
    middle = F.col("y") + F.col("height") / 2
    fits = lambda g, b: (F.abs(b["y"] + b["height"] / 2 - g["middles"] / g["n"]) <= 2.5) & (b["x"] - g["right"] <= 8)
    return _grouped(_pieces(usable, ["video_id", "frame"], middle, middle, 2.5), ["x", "y"], fits)


def blocks(line_boxes: DataFrame) -> DataFrame:
    """Lines joined to blocks: a gap of at most 2.5, centres within 22, at most 20 high."""

    def fits(g: Column, b: Column) -> Column:
        low = b["y"] + b["height"]
        gap = F.greatest(F.lit(0.0), b["y"] - g["bottom"], g["y"] - low)
        return (gap <= 2.5) & (F.abs(b["x"] + b["width"] / 2 - (g["x"] + g["right"]) / 2) <= 22) & (F.greatest(g["bottom"], low) - F.least(g["y"], b["y"]) <= 20)

    return _grouped(_pieces(line_boxes, ["video_id", "frame"], F.col("y"), F.col("y") + F.col("height"), 2.5), ["y", "x"], fits)


def clusters(block_boxes: DataFrame) -> DataFrame:
    """Centred blocks with ``cluster``, the first member's (y, x, frame, text): first-fit against the first members.

    A block's cluster depends on its centre alone, so only distinct centres are folded, and a video may have any number of
    frames.
    """
    centre = F.col("x") + F.col("width") / 2
    usable = (F.col("confidence") >= LEAST_CONFIDENCE) & is_meaningful(F.col("text")) & F.col("width").between(12, 82) & F.col("height").between(1, 20) & centre.between(25, 75) & (F.col("y") >= 0) & (F.col("y") + F.col("height") <= 100)
    placed = block_boxes.filter(usable).withColumn("across", centre).withColumn("down", F.col("y") + F.col("height") / 2)
    points = placed.groupBy("video_id", "across", "down").agg(F.min(F.struct("y", "x", "frame", "text")).alias("first"))
    items = _pieces(points, ["video_id"], F.col("down"), F.col("down"), 6).groupBy("video_id", "piece").agg(F.array_sort(F.collect_list(F.struct("first", "across", "down"))).alias("items"))
    kind = "array<struct<first:struct<y:double,x:double,frame:int,text:string>,across:double,down:double,points:array<struct<across:double,down:double>>>>"
    point = lambda b: F.array(F.struct(b["across"].alias("across"), b["down"].alias("down")))
    start = lambda b: F.struct(b["first"].alias("first"), b["across"].alias("across"), b["down"].alias("down"), point(b).alias("points"))
    near = lambda g, b: (F.abs(b["across"] - g["across"]) <= 10) & (F.abs(b["down"] - g["down"]) <= 6)
    joined = lambda g, b: g.withField("points", F.concat(g["points"], point(b)))
    made = items.select("video_id", F.explode(_first_fit(F.col("items"), kind, start, near, joined)).alias("g"))
    homes = made.select("video_id", F.col("g.first").alias("cluster"), F.explode("g.points").alias("p")).select("video_id", "cluster", "p.across", "p.down")
    return placed.join(homes, ["video_id", "across", "down"]).drop("across", "down")


def caption_regions(boxes: DataFrame, samples: int = 24) -> DataFrame:
    """One region a video: the cluster on most frames whose text changes, its widest block, and its 90th-percentile height."""
    line_boxes = written(lines(boxes))  # each step is read several times, and folding is what takes the time
    placed = clusters(written(blocks(line_boxes)))
    best = written(placed.withColumn("n", F.row_number().over(Window.partitionBy("video_id", "cluster", "frame").orderBy(F.desc("confidence"), "y", "x"))).filter("n = 1").drop("n"))
    key = ["video_id", "cluster"]
    labels = best.groupBy(*key, text_key(F.col("text")).alias("label")).count().groupBy(*key).agg(F.count("*").alias("labels"), F.max("count").alias("most"), F.sum("count").alias("frames"))
    rank = best.groupBy(*key).agg(F.avg("confidence").alias("mean")).join(labels, key).filter((F.col("frames") >= max(3, math.ceil(samples * 0.25))) & (F.col("labels") >= 2) & (F.col("most") / F.col("frames") <= 0.8))
    order = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("frames"), F.desc("mean"), "cluster"))
    chosen = rank.withColumn("n", order).filter("n = 1").select(*key, "mean", "frames")
    selected = best.join(chosen, key)
    p90 = lambda c: F.array_sort(F.collect_list(c))[F.bround((F.count(c) - 1) * 0.9).cast("int")]
    sizes = selected.groupBy("video_id").agg(p90(F.col("height")).alias("tall"), F.max_by(F.struct("x", "width"), F.struct("width", (-F.col("frame")).alias("f"))).alias("wide"), F.first("mean").alias("mean"), F.first("frames").alias("samples"))
    reference = selected.join(sizes.select("video_id", "tall"), "video_id").groupBy("video_id").agg(F.min_by(F.struct("y", "height"), F.struct(F.abs(F.col("height") - F.col("tall")).alias("d"), (-F.col("width")).alias("w"), "frame")).alias("ref"))
    b = selected.select("video_id", "frame", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("width").alias("bw"), F.col("height").alias("bh"))
    edge = 0.5
    inside = line_boxes.join(b, ["video_id", "frame"]).filter((F.col("x") >= F.col("bx") - edge) & (F.col("y") >= F.col("by") - edge) & (F.col("x") + F.col("width") <= F.col("bx") + F.col("bw") + edge) & (F.col("y") + F.col("height") <= F.col("by") + F.col("bh") + edge))
    rows = inside.groupBy("video_id").agg(p90(F.col("height")).alias("line_height"))
    all_of = sizes.join(reference, "video_id").join(rows, "video_id", "left")
    left, top = F.greatest(F.lit(0.0), F.col("wide.x")), F.greatest(F.lit(0.0), F.col("ref.y"))
    right, bottom = F.least(F.lit(100.0), F.col("wide.x") + F.col("wide.width")), F.least(F.lit(100.0), F.col("ref.y") + F.col("ref.height"))
    return all_of.select("video_id", F.round(left, 2).alias("x_percent"), F.round(top, 2).alias("y_percent"), F.round(F.greatest(F.lit(1.0), right - left), 2).alias("width_percent"), F.round(F.greatest(F.lit(1.0), bottom - top), 2).alias("height_percent"), F.round(F.greatest(F.lit(1.0), F.coalesce("line_height", "tall")), 2).alias("line_height_percent"), F.round("mean", 3).alias("confidence"), "samples")


def phrases(text: str | None, limit: int, strict: bool = False) -> list[str]:
    """The fewest parts that fit a line, most even in length; a long text without spaces is cut into equal pieces."""
    words = (text or "").split()
    if not words:
        return [""]
    if len(words) == 1 and len(words[0]) > limit:
        n = math.ceil(len(words[0]) / limit)
        cuts = [len(words[0]) // n * i + min(i, len(words[0]) % n) for i in range(n + 1)]
        return [words[0][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    size = [0]
    for w in words:
        size.append(size[-1] + len(w) + 1)
    total, n = size[-1] - 1, len(words)
    soft = limit if strict else max(max(map(len, words)), round(limit * 1.3))
    fewest, filled = 1, -1
    for w in words:  # filling lines greedily needs the fewest parts, so no smaller number can succeed
        if filled >= 0 and filled + 1 + len(w) > soft:
            fewest, filled = fewest + 1, len(w)
        else:
            filled += 1 + len(w)
    widths = []  # for 1, 2 ... words, the length of a part that starts at each word, and infinity where that is too long
    for k in range(1, n + 1):
        length = np.full(n, np.inf)
        length[: n - k + 1] = np.array(size[k:]) - np.array(size[: n - k + 1]) - 1
        if k > 1:
            length[length > soft] = np.inf
            if not np.isfinite(length).any():
                break
        widths.append(length)
    for parts in range(max(fewest, math.ceil(total / soft)), n + 1):
        mean = total / parts
        cost = [np.where(np.isfinite(w), (w - mean) ** 2 + (mean**2 if k == 0 and n >= 2 * parts else 0), np.inf) for k, w in enumerate(widths)]
        # best[i]: least cost of words[i:] in the parts that are left; ends: how many words the first of them takes
        best = np.full(n + len(widths) + 1, np.inf)
        best[n] = 0
        ends = []
        for _ in range(parts):
            every = np.stack([c + best[k + 1 : k + 1 + n] for k, c in enumerate(cost)])
            ends.append(every.argmin(axis=0) + 1)
            best = np.full(n + len(widths) + 1, np.inf)
            best[:n] = every.min(axis=0)
        if np.isfinite(best[0]):
            out, at = [], 0
            for taken in reversed(ends):
                out.append(" ".join(words[at : at + taken[at]]))
                at += int(taken[at])
            return out
    return words


def balanced_phrases(rows: DataFrame, text: str, limit: int, strict: bool = False, result: str = "phrases") -> DataFrame:
    """``rows`` with an array column of balanced phrases: dynamic programming over the words of one cue."""
    schema = T.StructType([*rows.schema.fields, T.StructField(result, T.ArrayType(T.StringType()))])

    def run(parts):
        for part in parts:
            made = {t: phrases(t, limit, strict) for t in part[text].unique()}
            yield part.assign(**{result: part[text].map(made)})

    return rows.mapInPandas(run, schema)
