"""A corpus pipeline of five stages over `documents`: toxicity, exact dedup, n-gram Jaccard join, suffix-array
dedup, packing. Each stage is written as Parquet and read again as the next one's input; all but the last return
the columns of documents.

Every stage decides by row, told apart by id and text: null ids and ids that several texts share are judged like any other. Of rows
that repeat an id and a text one stays from the exact dedup on. Extra columns are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.llm._common import ASCII_LOWER, ASCII_UPPER, NULL_ID, bound_batches
from shoebox.llm.exact_dedup import exact_dedup
from shoebox.llm.ngram_join import jaccard_components, sieve
from shoebox.llm.packing import packed_digests
from shoebox.llm.suffix_dedup import remove_repeats
from shoebox.llm.toxicity import fit, score_column
from shoebox.operators.scratch import drop_but_last, materialise, noted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _known_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    docs = docs.select(*COLUMNS)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bound_batches(spark)
    return docs.withColumn("toxicity", score_column(spark, model)).where("toxicity < 0.5").drop("toxicity")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest doc_id stays."""
    found = exact_dedup(docs.select("doc_id", "text"), keep="largest").where("kept")
    found = found.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("kept_id"), F.unhex("text_sha256").alias("kept_text"))
    text = F.unhex(F.sha2(F.translate(F.coalesce("text", F.lit("")), ASCII_UPPER, ASCII_LOWER), 256))
    keyed = docs.withColumns({"_id": _known_id(), "_text": text})
    # the join has dealt the rows by id and text: what drops repeated rows needs no further shuffle
    kept = keyed.join(found.hint("merge"), (F.col("_id") == F.col("kept_id")) & (F.col("_text") == F.col("kept_text")), "left_semi")
    return kept.dropDuplicates(["_id", "_text"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the first, by doc_id, stays. Only rows that a sieve takes for one of those that go are
    shuffled, to be joined exactly; the others, nearly all, stay where they are."""
    gone = jaccard_components(docs.select("doc_id", "text")).where("NOT first").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("gone_id"), F.col("row").alias("gone_row"))
    gone = materialise(gone, "pipeline-gone")
    keyed = docs.withColumns({"_id": _known_id(), "row": F.xxhash64(_known_id(), F.coalesce("text", F.lit("")))})
    suspect = sieve(gone.select(F.col("gone_row").alias("row")))
    judged = keyed.where(suspect).join(gone.hint("merge"), (F.col("_id") == F.col("gone_id")) & (F.col("row") == F.col("gone_row")), "left_anti")
    return keyed.where(~suspect).unionByName(judged).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 100-byte strings that start earlier go; so do documents of which nothing is left."""
    marked = docs.select(*COLUMNS, F.col("text").isNull().alias("no_text"))
    found = remove_repeats(marked, as_text=True, carry=("lang", "source", "n_chars", "no_text")).where("n_bytes = 0 OR n_removed < n_bytes")
    size = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long")
    return found.select("doc_id", F.when(~F.col("no_text"), F.col("kept")).alias("text"), "lang", "source", size.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digests(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("ngram_join", near_copies), ("suffix_dedup", repeated_passages), ("packing", packing)]

#: SQL can't express the learned, suffix and packing stages; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with noted() as made:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop_but_last(spark, made)
    return STAGES[-1][1](spark, docs, sf_dir)
