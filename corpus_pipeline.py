"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm import decontaminate, forest, packing, pii, toxicity
from cuemill.llm.queries import is_held_out, vocabulary
from cuemill.llm.shared import free_name, written


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a machine trained on the labelled ones, the held-out fold left aside.

    Every row is judged from its own whole text: repeated rows go or stay together, a null, empty or wordless text and a
    row without id stay (they score near 0). Without labels nothing goes; an empty table stays empty.
    """
    machine = toxicity.train_machine(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~is_held_out(F.col("doc_id")))
    score = free_name(docs, "score")
    return toxicity.score_toxicity(docs, machine, score_col=score).filter(F.col(score) < 0.5).select(*_all(docs))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class linked by five-word shingles and a similarity of 0.8.

    Rows that share an id are one document: that of the least text by hash stays, a null only if
    there is no other. A null, empty
    or wordless text and a row without id are linked with nothing and stay. An empty table stays empty.
    """
    gone = written(forest.near_duplicates(docs, k=5, percent=80).filter("not kept").select("doc_id").distinct(), "pipeline-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*_all(docs))
    again = written(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"), "pipeline-repeated")
    row = F.struct(*_all(docs))
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("row")).select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(*_all(docs)).unionByName(one.select(*_all(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in windows of benchmark items.

    Rows are judged one by one; a null, empty or wordless text stays. An empty benchmark lets everything stay.
    """
    name = free_name(docs, "found")
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), result_col=name)
    return found.filter(~decontaminate.is_contaminated(name)).select(*_all(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the name of its kind; n_chars follows the text.

    Every row stays; a null text stays null with its n_chars null, an empty one empty.
    """
    out = pii.redact_pii(docs)
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*_all(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, neighbours along the curve together.

    A null or empty text is its end id alone; repeated rows are packed once each. An empty table gives no pieces.
    """
    return packing.pack_along_curve(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

#: Scores, candidate search and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
