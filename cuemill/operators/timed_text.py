"""Timed text: windows, ordered folds and interval joins over segments (start, end in seconds).

Every ordered operator takes its key and a total order. Where a result depends on what came before, windows first cut a key
into runs at places where no state is carried over (a long silence, a segment that can not be joined to anything); only
inside a run a fold goes over the sorted array, in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import alphanumerics, join_text, squeeze, wrap_lines

SHORT_SPAN, JOIN_GAP, SPLIT_GAP, GROUP_SPAN, OVERLAP = 0.45, 0.15, 3.0, 75.0, 0.05
CONTEXT_ROWS, CONTEXT_CHARACTERS = 3, 1200
TAIL_MARGIN_MS = 120


def voice_slots(rows: DataFrame, by: str, order: Sequence[str], tail_margin_ms: int = TAIL_MARGIN_MS) -> DataFrame:
    """``slot_end_ms`` of each line (start_ms, segment_end_ms, video_duration_ms): its own end, at most the next start; a
    broken end falls back on the next start, for the last line less a margin."""
    w = Window.partitionBy(by).orderBy(*order)
    duration = F.greatest(F.lit(0), F.col("video_duration_ms"))
    following, last = F.coalesce(F.lead("start_ms").over(w), F.col("video_duration_ms")), F.lead("start_ms").over(w).isNull()
    hard = F.when(following > F.col("start_ms"), F.least(duration, following)).otherwise(duration)
    fallback = F.least(duration, F.greatest("start_ms", following))
    trimmed = F.when(last & (fallback - F.col("start_ms") > 2 * tail_margin_ms), fallback - tail_margin_ms).otherwise(fallback)
    return rows.withColumn("slot_end_ms", F.when(F.col("segment_end_ms") > F.col("start_ms"), F.least(hard, F.col("segment_end_ms"))).otherwise(trimmed))


def context_window(rows: DataFrame, by: str, order: Sequence[str], text: str = "text") -> DataFrame:
    """``before`` and ``after``: how many of the three nearest lines on each side fit 1,200 characters together."""
    w = Window.partitionBy(by).orderBy(*order)
    size = F.length(F.coalesce(F.col(text), F.lit("")))

    def reach(step) -> Column:
        near = [step(size, k).over(w) for k in range(1, CONTEXT_ROWS + 1)]
        out, total = F.lit(0), F.lit(0)
        for n in near:
            total = total + n  # null beyond the edge, and from there on
            out = out + F.when(total <= CONTEXT_CHARACTERS, 1).otherwise(0)
        return out

    return rows.withColumn("before", reach(F.lag)).withColumn("after", reach(F.lead))


def batch_numbers(rows: DataFrame, by: str, order: Sequence[str], size: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("queue_position", at + 1).withColumn("batch", F.floor(at / size).cast("int"))


def proportional_times(rows: DataFrame, by: str, order: Sequence[str], weight: Column, start: Column, end: Column, least: float = 0.1) -> DataFrame:
    """``cue_start`` and ``cue_end`` in whole milliseconds: the span of a group shared out by weight, ``least`` seconds at
    least; the last end is the span's."""
    w = Window.partitionBy(by).orderBy(*order)
    share = F.greatest(F.lit(1), weight).cast("double")
    done = F.sum(share).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(share).over(Window.partitionBy(by))
    begins = start + (end - start) * (done - share) / total
    ends = F.when(F.lead(share).over(w).isNull(), end).otherwise(start + (end - start) * done / total)
    whole = lambda seconds: F.bround(seconds * 1000) / 1000  # noqa: E731  # rounds the milliseconds themselves: seconds printed as a tie may lie beside one
    return rows.withColumn("cue_start", whole(begins)).withColumn("cue_end", whole(F.greatest(begins + least, ends)))


def speech_weight(text: Column) -> Column:
    return F.greatest(F.lit(1), alphanumerics(F.coalesce(text, F.lit(""))))


def segment_faults(rows: DataFrame, by: str, order: Sequence[str], duration: Column) -> DataFrame:
    """``fault``: what is wrong with a segment, null if nothing: no text, a bad range, going back, overlap, or past the end."""
    w = Window.partitionBy(by).orderBy(*order)
    back = F.col("start") < F.lag("start", 1).over(w)
    overlap = F.col("start") < F.lag("end", 1).over(w) - OVERLAP
    fault = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no text").when((F.col("end") <= F.col("start")) | (F.col("start") < 0), "bad range").when(back, "not monotonic")
    return rows.withColumn("fault", fault.when(overlap, "overlap").when(F.col("end") > duration + 0.5, "outside"))


def _sorted(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key: ``seg``, its segments in order."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("seg"))


def _runs(rows: DataFrame, by: str, order: Sequence[str], starts: Column) -> DataFrame:
    """``rows`` with ``__run``: numbered up in each key where ``starts`` holds; a null starts a run."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = rows.withColumn("__starts", F.coalesce(starts, F.lit(True)).cast("int"))
    return marked.withColumn("__run", F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def span_groups(rows: DataFrame, by: str, order: Sequence[str], language: str = "language", gap: float = SPLIT_GAP, span: float = GROUP_SPAN) -> DataFrame:
    """``group_id`` from 1: a new group at a change of language, a silence of ``gap`` or when the span from the group's own
    start would be over ``span``. The first two end a run; the last depends on where the group began, so a run is folded."""
    w = Window.partitionBy(by).orderBy(*order)
    kind = F.coalesce(F.nullif(F.col(language), F.lit("")), F.lit("en"))
    cut = (kind != F.lag(kind).over(w)) | (F.col("start") - F.lag("end").over(w) >= gap)
    folded = _sorted(_runs(rows, by, order, cut), [by, "__run"], order, ["start", "end", language])
    zero = F.expr("named_struct('out', cast(array() as array<int>), 'id', 0, 'first', cast(0 as double))")

    def step(s: Column, x: Column) -> Column:
        new = (s["id"] == 0) | (x["end"] - s["first"] > span)
        number = F.when(new, s["id"] + 1).otherwise(s["id"])
        return F.struct(F.concat(s["out"], F.array(number)).alias("out"), number.alias("id"), F.when(new, x["start"]).otherwise(s["first"]).alias("first"))

    done = folded.withColumn("ids", F.aggregate("seg", zero, step, lambda s: s["out"]))
    before = F.coalesce(F.sum(F.try_element_at("ids", F.lit(-1))).over(Window.partitionBy(by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = done.withColumn("__before", before).select(by, "__before", F.explode(F.arrays_zip("seg", "ids")).alias("z"))
    return each.select(by, "z.seg.*", (F.col("__before") + F.col("z.ids")).cast("int").alias("group_id"))


def coalesce_short(rows: DataFrame, by: str, order: Sequence[str], text: str = "text") -> DataFrame:
    """Segments under 0.45 s joined to the one before where it is near; then a short first one to the second.

    A longer segment is never joined to the one before, so it starts a run.
    """
    folded = _sorted(_runs(rows, by, order, F.col("end") - F.col("start") >= SHORT_SPAN), [by, "__run"], order, ["start", "end", text])
    one = lambda x: F.struct(x["start"].cast("double").alias("start"), x["end"].cast("double").alias("end"), F.coalesce(x[text], F.lit("")).alias(text))
    spaced = lambda a, b: F.trim(F.concat(F.rtrim(a), F.lit(" "), F.ltrim(b)))

    def step(out: Column, raw: Column) -> Column:
        x, last = one(raw), F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & (x["end"] - x["start"] < SHORT_SPAN) & (x["start"] - last["end"] <= JOIN_GAP)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), spaced(last[text], x[text]).alias(text))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    done = F.aggregate("seg", F.expr(f"cast(array() as array<struct<start:double,end:double,{text}:string>>)"), step)
    each = folded.select(by, "__run", F.posexplode(done).alias("__at", "s")).select(by, "__run", "__at", "s.*")
    w = Window.partitionBy(by).orderBy("__run", "__at")
    each = each.withColumn("pos", F.row_number().over(w) - 1)
    head = (F.col("pos") == 0) & (F.col("end") - F.col("start") < SHORT_SPAN) & (F.lead("start").over(w) - F.col("end") <= JOIN_GAP)
    each = each.withColumn("__head", F.coalesce(head, F.lit(False)))
    first = Window.partitionBy(by)
    joined = F.coalesce(F.lag("__head").over(w), F.lit(False))
    out = each.withColumn("__joined", joined).withColumn("__start", F.when(joined, F.least(F.lag("start").over(w), "start")).otherwise(F.col("start"))).withColumn("__text", F.when(joined, spaced(F.lag(text).over(w), F.col(text))).otherwise(F.col(text)))
    out = out.withColumn("pos", F.col("pos") - F.max(F.col("__head").cast("int")).over(first)).filter("not __head")
    return out.select(by, "pos", F.col("__start").alias("start"), "end", F.col("__text").alias(text))


def repair_overlaps(rows: DataFrame, by: str, order: Sequence[str], duration: Column | None = None, least: float = 0.25) -> DataFrame:
    """Overlaps over 0.05 s cut at the middle, each side keeping ``least`` seconds or half its span; a pair sees what the pair
    before it has repaired, so chains of overlaps are folded. ``repaired`` counts the boundaries of the key."""
    w = Window.partitionBy(by).orderBy(*order)
    folded = _sorted(_runs(rows, by, order, F.lag("end").over(w) - F.col("start") <= OVERLAP), [by, "__run"], order, ["start", "end"])
    if duration is not None:
        folded = folded.join(rows.groupBy(by).agg(F.max(duration).alias("__duration")), by)
    limit = F.col("__duration") if duration is not None else F.lit(float("inf"))
    fields = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in folded.schema["seg"].dataType.elementType.fields)

    def step(s: Column, x: Column) -> Column:
        out, last = s["out"], F.try_element_at(s["out"], F.lit(-1))
        room = lambda y: F.least(F.lit(least), F.greatest(F.lit(0.001), (y["end"] - y["start"]) / 2))
        low, high = last["start"] + room(last), F.least(x["end"] - room(x), limit)
        cut = F.bround(F.least(F.greatest((last["end"] + x["start"]) / 2, low), high) * 1000) / 1000
        mends = (F.size(out) > 0) & (last["end"] - x["start"] > OVERLAP) & (low <= high)
        fixed = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(last.withField("end", cut), x.withField("start", cut)))
        return F.struct(F.when(mends, fixed).otherwise(F.concat(out, F.array(x))).alias("out"), (s["n"] + F.when(mends, 1).otherwise(0)).alias("n"))

    done = F.aggregate("seg", F.expr(f"named_struct('out', cast(array() as array<struct<{fields}>>), 'n', 0)"), step)
    done = folded.select(by, done.alias("d")).withColumn("repaired", F.sum("d.n").over(Window.partitionBy(by)).cast("int"))
    return done.select(by, "repaired", F.explode("d.out").alias("s")).select(by, "repaired", "s.*")


def merge_contiguous(rows: DataFrame, by: str, order: Sequence[str], text: str = "text") -> DataFrame:
    """Cues joined with the one before when it is within 0.12 s, ends no sentence, and both make at most 8 s and 180 characters.

    A cue after the end of a sentence, or over 0.12 s after all before it, starts a run.
    """
    w = Window.partitionBy(by).orderBy(*order)
    stop = "[.!?。！？…][\"'”’)]*$"
    plain = squeeze(F.coalesce(F.col(text), F.lit("")))
    late = F.round(F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 6) > 0.12
    folded = _sorted(_runs(rows, by, order, F.lag(plain).over(w).rlike(stop) | late), [by, "__run"], order, ["start", "end", text])

    def step(out: Column, raw: Column) -> Column:
        x = F.struct(raw["start"].cast("double").alias("start"), raw["end"].cast("double").alias("end"), squeeze(F.coalesce(raw[text], F.lit(""))).alias(text))
        last = F.try_element_at(out, F.lit(-1))
        near = F.abs(F.round(x["start"] - last["end"], 6)) <= 0.12
        joins = (F.size(out) > 0) & near & ~last[text].rlike(stop) & (x["end"] - last["start"] <= 8) & (F.length(last[text]) + 1 + F.length(x[text]) <= 180)
        merged = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.trim(F.concat_ws(" ", last[text], x[text])).alias(text))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(out, F.array(x)))

    done = F.aggregate("seg", F.expr(f"cast(array() as array<struct<start:double,end:double,{text}:string>>)"), step)
    each = folded.select(by, "__run", F.posexplode(done).alias("__at", "s")).select(by, "__run", "__at", "s.*")
    return each.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("__run", "__at")) - 1).drop("__run", "__at").select(by, "pos", "start", "end", text)


def transcripts(rows: DataFrame, by: str, order: Sequence[str], text: str = "text") -> DataFrame:
    """The text of a key's segments as one, joined as their scripts need."""
    return _sorted(rows, [by], order, [text]).select(by, F.aggregate("seg", F.lit(""), lambda s, x: join_text(s, x[text])).alias(text))


def cue_chunks(text: Column, limit: int) -> Column:
    """Array of cue texts: broken at 42 characters or two lines of ``limit``, at 8 words, and after punctuation."""
    line = max(12, limit)
    cue = min(42, 2 * line)
    most = max(3, min(8, cue // 5))
    words = F.filter(F.split(squeeze(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    zero = F.expr("named_struct('out', cast(array() as array<string>), 'now', '', 'n', 0, 'lines', 0, 'line', 0)")

    def step(s: Column, w: Column) -> Column:
        size, some = F.length(w), s["n"] > 0
        wraps = ~some | (s["line"] + 1 + size > line)  # the greedy wrap of the cue so far goes on with this word
        lines = s["lines"] + F.when(wraps, 1).otherwise(0)
        full = some & ((F.length(s["now"]) + 1 + size > cue) | (s["n"] >= most) | (lines >= 3))
        out = F.when(full, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"])
        alone = full | ~some
        now, n = F.when(alone, w).otherwise(F.concat(s["now"], F.lit(" "), w)), F.when(full, 1).otherwise(s["n"] + 1)
        ends = (n >= 3) & w.rlike("[.!?;:]$")
        return F.struct(
            F.when(ends, F.concat(out, F.array(now))).otherwise(out).alias("out"), F.when(ends, "").otherwise(now).alias("now"), F.when(ends, 0).otherwise(n).alias("n"),
            F.when(ends, 0).when(alone, 1).otherwise(lines).alias("lines"), F.when(alone | wraps, size).otherwise(s["line"] + 1 + size).alias("line"),
        )

    return F.aggregate(words, zero, step, lambda s: F.when(s["n"] > 0, F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"]))


def split_cues(rows: DataFrame, key: Sequence[str], limit: int) -> DataFrame:
    """Cues (pos, cue_start, cue_end, cue) of segments (``key``, start, end, text), timed by their lengths."""
    line = max(12, limit)
    each = rows.select(*key, "start", F.greatest("start", "end").alias("end"), F.posexplode(cue_chunks(F.col("text"), limit)).alias("pos", "chunk"))
    each = each.withColumn("__key", F.struct(*key)).withColumn("__end", F.greatest(F.col("end"), F.col("start") + 0.3))
    w = Window.partitionBy(*key).orderBy("pos")
    size = F.length("chunk").cast("double")
    done, total = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(size).over(Window.partitionBy(*key))
    begins = F.col("start") + (F.col("__end") - F.col("start")) * (done - size) / total
    ends = F.when(F.lead("pos").over(w).isNull(), F.col("end")).otherwise(F.col("start") + (F.col("__end") - F.col("start")) * done / total)
    return each.select(*key, "pos", F.round(begins, 3).alias("cue_start"), F.round(F.greatest(begins + 0.1, ends), 3).alias("cue_end"), wrap_lines(F.col("chunk"), line).alias("cue"))


def sentences(text: Column) -> Column:
    """Array of sentences: a stop ends one before a space or the end, a CJK stop anywhere; a point between digits does not."""
    stops, closers = ".!?…。！？", "\"'”’)\\]}」』"
    wide = "…。！？"
    marked = F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), f"((?!(?<=[0-9])\\.(?=[0-9]))(?:[{wide}][{stops}{closers}]*|[{stops}][{stops}{closers}]*(?= |$)))", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def _overlapping(left: DataFrame, right: DataFrame, by: str, seconds: float) -> DataFrame:
    """Rows of ``left`` (start, end) with those of ``right`` (__a, __b) of their key that they overlap, each pair once: both
    sides are dealt to the buckets of time that they touch, and a pair counts in the first bucket that both touch."""
    bucket = lambda c: F.floor(c / seconds)
    touched = lambda a, b: F.explode(F.sequence(bucket(a), F.greatest(bucket(a), bucket(b))))
    x, y = left.withColumn("__bucket", touched(F.col("start"), F.col("end"))), right.withColumn("__bucket", touched(F.col("__a"), F.col("__b")))
    met = x.join(y, [by, "__bucket"]).filter((F.least("end", "__b") > F.greatest("start", "__a")) & (F.col("__bucket") == F.greatest(bucket(F.col("start")), bucket(F.col("__a")))))
    return met.drop("__bucket")


def best_overlap(segments: DataFrame, sources: DataFrame, by: str, bucket_seconds: float = 300.0) -> DataFrame:
    """For each segment (``by``, seq, start, end) the source (same columns) with the greatest overlap: ties by nearer middle,
    then by order. A segment that overlaps no source gets the one with the nearest middle."""
    s = sources.select(by, F.col("seq").alias("source_seq"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    overlap = F.least("end", "__b") - F.greatest("start", "__a")
    apart = F.abs((F.col("start") + F.col("end")) / 2 - (F.col("__a") + F.col("__b")) / 2)
    best = F.min_by(F.struct("source_seq", F.round(overlap, 3).alias("overlap")), F.struct((-overlap).alias("o"), apart.alias("m"), F.col("source_seq").alias("q")))
    met = _overlapping(segments.select(by, "seq", "start", "end"), s, by, bucket_seconds).groupBy(by, "seq").agg(best.alias("b")).select(by, "seq", "b.*")

    lone = segments.select(by, "seq", "start", "end").join(met, [by, "seq"], "left_anti")
    return met.unionByName(_nearest(lone, sources.join(lone.select(by).distinct(), by, "left_semi"), by, bucket_seconds).withColumn("overlap", F.lit(0.0)))


def _nearest(segments: DataFrame, sources: DataFrame, by: str, seconds: float) -> DataFrame:
    """by, seq and source_seq: for each segment the source with the nearest middle, ties by order; none without a source.

    Windows look inside buckets of time; what lies nearest in other buckets is carried over from a row a bucket.
    """
    middle = (F.col("start") + F.col("end")) / 2
    both = segments.select(by, "seq", F.lit(None).cast("long").alias("source_seq"), middle.alias("m")).unionByName(sources.select(by, F.lit(None).cast(segments.schema["seq"].dataType).alias("seq"), F.col("seq").cast("long").alias("source_seq"), middle.alias("m")))
    both = both.withColumn("bucket", F.floor(F.col("m") / seconds))
    source = lambda sign: F.when(F.col("source_seq").isNotNull(), F.struct("m", (sign * F.col("source_seq")).alias("q")))
    w = Window.partitionBy(by, "bucket").orderBy("m")
    near = both.withColumn("__p", F.max(source(-1)).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.min(source(1)).over(w.rangeBetween(0, Window.unboundedFollowing)))
    ends = both.groupBy(by, "bucket").agg(F.max(source(-1)).alias("last"), F.min(source(1)).alias("first"))
    v = Window.partitionBy(by).orderBy("bucket")
    carried = ends.select(by, "bucket", F.max("last").over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("__cp"), F.min("first").over(v.rowsBetween(1, Window.unboundedFollowing)).alias("__cn"))
    near = near.filter("source_seq is null").join(carried, [by, "bucket"]).withColumn("__p", F.coalesce("__p", "__cp")).withColumn("__n", F.coalesce("__n", "__cn"))
    before = F.when(F.col("__p").isNotNull(), F.struct((F.col("m") - F.col("__p.m")).alias("d"), (-F.col("__p.q")).alias("q")))
    after = F.when(F.col("__n").isNotNull(), F.struct((F.col("__n.m") - F.col("m")).alias("d"), F.col("__n.q").alias("q")))
    return near.filter("__p is not null or __n is not null").select(by, "seq", F.least(before, after)["q"].alias("source_seq"))


def intrusions(aligned: DataFrame, sources: DataFrame, by: str, group: str, bucket_seconds: float = 300.0) -> DataFrame:
    """Aligned segments that overlap a source of another group by over 0.05 s more than their own source did: the first such."""
    own = sources.select(by, "seq", F.col("start").alias("__s"), F.col("end").alias("__e"), F.col(group).alias("__g"))
    other = sources.select(by, F.col("seq").alias("other_seq"), F.col("start").alias("__a"), F.col("end").alias("__b"), F.col(group).alias("__og"))
    met = _overlapping(aligned.select(by, "seq", "start", "end").join(own, [by, "seq"]), other, by, bucket_seconds).filter("__og <> __g")
    over = lambda a, b: F.greatest(F.lit(0.0), F.least(b, "__b") - F.greatest(a, "__a"))
    found = met.withColumn("overlap", over("start", "end")).withColumn("before", over("__s", "__e")).filter(F.col("overlap") > F.col("before") + OVERLAP)
    return found.groupBy(by, "seq").agg(F.min_by(F.struct("other_seq", F.round("overlap", 3).alias("overlap")), "other_seq").alias("f")).select(by, "seq", "f.*")


def alignment_quality(sources: DataFrame, aligned: DataFrame, key: str, least_coverage: float = 0.6, least_score: float = 0.35) -> DataFrame:
    """``reason`` why the aligned words of a source are not usable, null if they are."""
    spans = aligned.groupBy(key).agg(F.min("start").alias("a"), F.max("end").alias("b"), F.median("score").alias("score"))
    both = sources.join(spans, key, "left")
    length, coverage = F.col("end") - F.col("start"), (F.col("b") - F.col("a")) / (F.col("end") - F.col("start"))
    reason = F.when(F.col("a").isNull(), "no aligned sentences").when((length <= 0) | (F.col("b") <= F.col("a")), "non-positive duration")
    reason = reason.when((F.col("a") < F.col("start") - 0.25) | (F.col("b") > F.col("end") + 0.25), "outside the source").when(coverage < least_coverage, "low coverage").when(F.col("score") < least_score, "low score")
    return both.select(key, F.round(coverage, 2).alias("coverage"), "score", reason.alias("reason"))


def words_to_sentences(words: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """Words (``by``, at from 0) given to sentences (``by``, seq, n) by running counts."""
    w = Window.partitionBy(by).orderBy("seq")
    low = counts.withColumn("__low", F.sum("n").over(w) - F.col("n")).filter("n > 0")
    places = low.select(by, "seq", F.explode(F.sequence(F.col("__low"), F.col("__low") + F.col("n") - 1)).alias("at"))
    return words.join(places, [by, "at"])


def loud_bounds(chunks: DataFrame, by: str, level: Column) -> DataFrame:
    """First and last chunk that is not silent."""
    return chunks.groupBy(by).agg(F.min(F.when(level, F.col("at"))).alias("first"), F.max(F.when(level, F.col("at"))).alias("last"))
