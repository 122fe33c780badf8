"""Resolution of not-modified revisits in web archives.

A revisit record (a 304 answer) has no body; it stands for the latest earlier full response of the same canonical URL.
That is an as-of join by URL and capture time. It runs on time buckets: inside a bucket a window finds the latest earlier
response, and one summary row per URL and bucket carries the latest response over from earlier buckets. So a URL that
holds a third of all captures is spread over as many groups as it has buckets. Bodies never enter the windows: only the
validators and headers do, and the body is fetched by record id for the revisits that resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import spread_join, written

#: Fields that a 304 answer may replace in the stored response.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning", "set-cookie", "x-cache")
URL_PATTERN = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def _escapes(text: Column) -> Column:
    """Percent escapes with upper-case digits; those of letters, digits and ``-._~`` decoded."""
    parts = F.split(text, "%")

    def mend(p: Column) -> Column:
        digits = F.upper(F.left(p, F.lit(2)))
        letter = F.chr(F.conv(digits, 16, 10).cast("int"))
        whole = F.when(letter.rlike("^[A-Za-z0-9._~-]$"), letter).otherwise(F.concat(F.lit("%"), digits))
        return F.when(digits.rlike("^[0-9A-F]{2}$"), F.concat(whole, F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), p))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), mend), ""))


def _without_dots(path: Column) -> Column:
    """The path with its "." and ".." parts resolved."""
    empty = F.array().cast("array<string>")
    step = lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.concat(done, F.array(p)))
    parts = F.filter(F.split(path, "/"), lambda p, i: (i > 0) | (p != ""))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(F.aggregate(parts, empty, step), "/"))).otherwise(path)


def canonical_url(url: Column) -> Column:
    """Host in lower case without user and the scheme's default port, path without dot parts and closing slashes, query
    without ``utm_`` fields, escapes in one form; scheme and fragment dropped. A string that is no such URL stays as it is."""
    part = lambda i: F.regexp_extract(url, URL_PATTERN, i)
    scheme, host = F.lower(part(1)), F.lower(F.regexp_replace(part(2), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(_without_dots(_escapes(part(3))), "/+$", "")
    fields = F.filter(F.split(F.regexp_replace(_escapes(part(4)), r"^\?", ""), "&"), lambda f: ~f.startswith("utm_") & (f != ""))
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.when(url.rlike(URL_PATTERN), F.concat(host, path, query)).otherwise(url)


def strong_etag(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3_600) -> DataFrame:
    """For each revisit of ``records`` (record_id, type, url, captured, headers, body): record_id, url_key, captured,
    state, original_id, headers, body.

    ``type`` is "response" or "revisit"; other and null types are ignored. With a column ``status``, a response of another
    status than 200 (or null) is no full response. ``headers`` is a map with names in lower case.
    state: "resolved"; "no_original" (no response of that URL was captured strictly earlier); "mismatch" (entity tags,
    or without both tags the last-modified dates, differ); "unverified" (no validator that both have). Only a resolved
    revisit gets a body and merged headers: those of the response, replaced and extended by the permitted ones of the
    revisit. Of responses captured at the same time the greatest record_id counts. A revisit without URL or time has no
    original. Repeated revisits are each resolved; of repeated response ids the first body by value is used. Empty
    tables give no rows; extra columns are ignored.
    """
    seconds = F.unix_micros(F.col("captured").cast("timestamp"))
    if "status" in records.columns:
        records = records.filter("type is null or type <> 'response' or status is null or status = 200")
    keyed = records.select("record_id", "type", canonical_url(F.col("url")).alias("url_key"), "captured", seconds.alias("at"), "headers").filter(F.col("type").isin("response", "revisit"))
    keyed = keyed.withColumn("bucket", F.floor(F.col("at") / (bucket_seconds * 1_000_000)))
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    full = F.when((F.col("type") == "response") & F.col("at").isNotNull() & F.col("url_key").isNotNull(), F.struct("at", "record_id", F.to_json(headers).alias("headers")))
    keyed = keyed.withColumn("headers", headers).withColumn("full", full)

    known = keyed.filter("url_key is not null and at is not null")
    inside = Window.partitionBy("url_key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = known.groupBy("url_key", "bucket").agg(F.max("full").alias("last"))
    earlier = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.max("last").over(earlier)).filter("carried is not null").select("url_key", "bucket", "carried")
    met = known.withColumn("near", F.max("full").over(inside)).filter("type = 'revisit'").join(carried, ["url_key", "bucket"], "left")
    met = met.withColumn("original", F.coalesce("near", "carried")).select("record_id", "url_key", "captured", "headers", "original")
    lost = keyed.filter("type = 'revisit' and (url_key is null or at is null)").select("record_id", "url_key", "captured", "headers", F.lit(None).cast(met.schema["original"].dataType).alias("original"))
    met = met.unionAll(lost)

    old = F.from_json(F.col("original")["headers"], "map<string,string>")
    met = met.withColumn("old", old)
    tag, old_tag = strong_etag(F.col("headers")["etag"]), strong_etag(F.col("old")["etag"])
    changed, old_changed = F.col("headers")["last-modified"], F.col("old")["last-modified"]
    both_tags, both_dates = tag.isNotNull() & old_tag.isNotNull(), changed.isNotNull() & old_changed.isNotNull()
    state = F.when(F.col("original").isNull(), "no_original").when(both_tags, F.when(tag == old_tag, "resolved").otherwise("mismatch"))
    state = state.when(both_dates, F.when(changed == old_changed, "resolved").otherwise("mismatch")).otherwise("unverified")
    allowed = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED_HEADERS))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    met = met.withColumn("state", state).withColumn("ok", F.col("state") == "resolved")
    met = met.select("record_id", "url_key", "captured", "state", F.when(F.col("ok"), F.col("original")["record_id"]).alias("original_id"), F.when(F.col("ok"), merged).alias("headers"))

    met = written(met, "revisits")
    resolved = met.filter("original_id is not null")  # the others would all meet under one key
    bodies = records.filter("type = 'response'").select(F.col("record_id").alias("original_id"), "body").join(resolved.select("original_id").distinct(), "original_id", "left_semi")
    found = spread_join(resolved, bodies.groupBy("original_id").agg(F.min("body").alias("body")), "original_id", ["record_id", "captured"])
    names = ["record_id", "url_key", "captured", "state", "original_id", "headers"]
    return found.select(*names, "body").unionByName(met.filter("original_id is null").select(*names, F.lit(None).cast(records.schema["body"].dataType).alias("body")))
