"""Catalogues read from damaged files, and rows replaced or deleted so that nothing is lost half way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.geometry import is_inside
from cuemill.operators.dedup import first_accepted
from cuemill.sources.shared import written

BAD = "_corrupt_record"


def read_records(spark: SparkSession, path: str, schema: str, needed: list[str], name: str = r"([^/]+?)(?:\.[^./]*)?$") -> tuple[DataFrame, DataFrame]:
    """(records, bad) of JSON-lines files below a folder, with ``catalogue``, the first group of ``name`` in the
    file's path (its name without extension).

    A line that is no record of the schema, or lacks one of the ``needed`` fields, is bad: its text goes to the second table
    as ``raw``, with a reason, so nothing is overwritten unseen. Columns of the records are those of the schema.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).filter("trim(value) <> ''").select(F.regexp_extract("_metadata.file_path", name, 1).alias("catalogue"), F.col("value").alias("raw"))
    parsed = lines.withColumn("r", F.from_json("raw", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    lacking = F.exists(F.array(*[F.col("r")[c].cast("string") for c in needed]), lambda v: F.coalesce(v, F.lit("")) == "")
    reason = F.when(F.col("r")[BAD].isNotNull() | F.col("r").isNull(), "corrupt").when(lacking, "incomplete")
    judged = parsed.withColumn("reason", reason)
    names = spark.createDataFrame([], schema).columns
    return judged.filter("reason is null").select("catalogue", *[F.col("r")[c].alias(c) for c in names]), judged.filter("reason is not null").select("catalogue", "raw", "reason")


def first_manifests(manifests: DataFrame, key: str, root: str, order: list[str], catalogue: str = "catalogue") -> DataFrame:
    """Manifests in order, without those whose key or root one taken before has, catalogue by catalogue."""
    return first_accepted(manifests, [[catalogue, key], [catalogue, root]], order)


def merge_manifests(records: DataFrame, manifests: DataFrame, key: str, root: str, order: str, catalogue: str = "catalogue") -> DataFrame:
    """``records`` with the rows of ``manifests`` (of one row a key and a root), taken in order of ``order``, put in by key.

    A manifest is left out if at its turn a record of another key has its root. A record whose own manifest came before has
    moved, so whether it still stands in the way depends on that manifest: those that wait for others are decided in rounds.
    """
    m = written(manifests)
    by = [catalogue, key]
    held = records.select(F.col(catalogue).alias("c"), F.col(key).alias("holder"), F.col(root).alias("r"))
    own = m.select(F.col(catalogue).alias("c2"), F.col(key).alias("holder2"), F.col(order).alias("moved_at"))
    blocked = m.join(held, (m[catalogue] == F.col("c")) & (m[root] == F.col("r")) & (m[key] != F.col("holder")))
    blocked = blocked.join(own, (F.col("c") == F.col("c2")) & (F.col("holder") == F.col("holder2")), "left")
    fixed = F.col("moved_at").isNull() | (F.col("moved_at") > F.col(order))
    waits = written(blocked.select(*by, "holder", fixed.alias("fixed")))
    refused = written(waits.filter("fixed").select(*by).distinct())
    taken = written(m.join(waits.select(*by).distinct(), by, "left_anti").select(*by))
    open_ = waits.join(refused, by, "left_anti").select(*by, "holder")
    while True:
        open_ = written(open_)
        if open_.isEmpty():
            break
        state = refused.select(F.col(catalogue), F.col(key).alias("holder"), F.lit(True).alias("no")).unionByName(taken.select(F.col(catalogue), F.col(key).alias("holder"), F.lit(False).alias("no")))
        judged = open_.join(state, [catalogue, "holder"], "left").groupBy(*by).agg(F.bool_or("no").alias("any_no"), F.count_if(F.col("no").isNull()).alias("waiting"))
        judged = written(judged)
        refused = written(refused.unionByName(judged.filter("any_no").select(*by)))
        taken = written(taken.unionByName(judged.filter("waiting = 0 and not any_no").select(*by)))
        open_ = open_.join(judged.filter("any_no or waiting = 0").select(*by), by, "left_anti")
    accepted = m.join(taken, by, "left_semi")
    return records.join(taken, by, "left_anti").unionByName(accepted.select(*records.columns))


def recover_catalogues(primary: tuple[DataFrame, DataFrame], backup: tuple[DataFrame, DataFrame], manifests: DataFrame, key: str, root: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(records, states) of all catalogues, each from the first source that serves.

    ``primary`` and ``backup`` are (records, bad) of ``read_records``, ``manifests`` are single records with an ``order``. An intact
    primary is taken as it is. Else an intact backup, with the manifests merged into it. Else the manifests alone. Intact means
    that a file has records or is empty of bad ones. ``states`` has catalogue and source: "primary", "backup",
    "manifests", or "lost" where the primary is damaged and nothing else is left (it has no records then).
    """
    has = lambda pair, name: pair[0].groupBy("catalogue").agg(F.lit(True).alias(name)).join(pair[1].groupBy("catalogue").agg(F.lit(True).alias(f"{name}_bad")), "catalogue", "full")
    found = has(primary, "primary").join(has(backup, "backup"), "catalogue", "full").join(manifests.groupBy("catalogue").agg(F.lit(True).alias("manifests")), "catalogue", "full")
    intact = lambda name: F.col(name).isNotNull() & F.col(f"{name}_bad").isNull()
    states = written(found.select("catalogue", F.when(intact("primary"), "primary").when(intact("backup"), "backup").when(F.col("manifests"), "manifests").otherwise("lost").alias("source")))
    of = lambda rows, source: rows.join(states.filter(F.col("source") == source), "catalogue", "left_semi")
    names = primary[0].columns
    first = written(first_manifests(manifests.join(states.filter("source in ('backup', 'manifests')"), "catalogue", "left_semi"), key, root, [order]))
    merged = merge_manifests(of(backup[0], "backup"), of(first, "backup"), key, root, order)
    return of(primary[0], "primary").select(*names).unionByName(merged.select(*names)).unionByName(of(first, "manifests").select(*names)), states


def replace_inputs(table, replacements: DataFrame, key: str, reset: dict, check: Callable[[DataFrame], None], finish: Callable[[DataFrame], None] = lambda rows: None) -> tuple[str, DataFrame]:
    """Puts new sources into the rows of a ``BucketTable``: ("replaced" or "rolled back", the refused replacements).

    ``replacements`` (key, order and the new columns) of rows that are being processed or unknown are refused. All columns in
    ``reset`` get their values, since what was derived from the old source is void. The new version is staged and given to ``check``; if
    that raises, it is not published. ``finish`` is the second half, after publishing; if that raises, the version is taken back, and
    readers see the old one again.
    """
    now = table.read()
    given = [c for c in replacements.columns if c != key]
    busy = replacements.join(now.select(key, "status"), key, "left").filter("status is null or status = 'processing'").select(key)
    refused = written(replacements.join(busy, key, "left_semi"))
    accepted = replacements.join(refused.select(key), key, "left_anti")
    rows = now.drop(*given).join(accepted, key)
    for name, value in reset.items():
        rows = rows.withColumn(name, F.lit(value).cast(now.schema[name].dataType))
    version = (table.versions() or [-1])[-1] + 1
    try:
        table.patch(rows.select(*now.columns), version, check=check)
        finish(table.read())
    except Exception as e:
        table.roll_back(version)
        return f"rolled back: {str(e).splitlines()[0]}", refused
    return "replaced", refused


def deletable(projects: DataFrame, wanted: DataFrame, key: str, root: str, directory: str) -> DataFrame:
    """key, root and ``reason`` of the ``wanted`` projects: null if the project may be deleted with its files.

    Reasons: "unknown", "outside" (its root is not below its directory), "shared" (another project, also a wanted one, has the
    root, or a root below it).
    """
    rows = wanted.select(key).distinct().join(projects, key, "left")
    place = lambda c: F.regexp_replace(F.lower(F.replace(c, F.lit("\\"), F.lit("/"))), "/+$", "")
    parts = F.split(place(F.col(root)), "/")
    above = projects.select(F.col(key).alias("__other"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("__place"))
    counted = above.groupBy("__place").agg(F.count("*").alias("__n"))  # a root counts for itself and for each root below
    judged = rows.withColumn("__place", place(F.col(root))).join(counted, "__place", "left")
    reason = F.when(F.col(root).isNull(), "unknown").when(~is_inside(F.col(root), F.col(directory)), "outside").when(F.col("__n") > 1, "shared")
    return judged.select(key, root, reason.alias("reason"))
