"""The corpus pipeline: toxic documents out, one of each group of near duplicates, benchmark leaks out, personal data
replaced, texts encoded.

Each stage takes what its predecessor kept and, but for the last, returns the columns it was given. Decisions on single
texts are keyed by the text, so they also reach rows without an id; such rows are no candidates in the near-duplicate
stage, which names documents by id, and pass it. Of rows that repeat id and text one stays there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, decontaminate, jaccard, pii, toxicity
from canopy.llm.common import pinned, prepare, table
from canopy.llm.queries import tokenizer_path


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of the n-gram Jaccard join the document with the smallest id stays."""
    found = jaccard.near_duplicates(docs)
    keepers = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(keepers, "doc_id", "left_semi").select(*docs.columns)
    digest = free_name(docs, "_digest")
    named = named.withColumn(digest, F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", digest]).drop(digest)
    return named.union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    prepare(spark)
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontaminate.decontaminate(by_text, table(spark, sf_dir, "benchmark"))
    leak = free_name(docs, "_leak")
    leaks = found.where("contaminated").select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, F.xxhash64("text") == F.col(leak), "left_anti")


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars is counted anew, as some of a full format are longer."""
    before = free_name(docs, "_before")
    done = pii.pseudonymized(docs.withColumn(before, F.length("text")))
    if "n_chars" in docs.columns:
        grown = F.coalesce(F.length("text") - F.col(before), F.lit(0))
        done = done.withColumn("n_chars", (F.col("n_chars") + grown).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with the offsets that decode them, and the digest of the decoded bytes.

    Token ids are written first: a task that encodes and decodes at once needs two Python workers, which then stay.
    """
    path = tokenizer_path()
    encoded = pinned(bpe.encode(docs, path)).withColumns({"tokens": F.col("ids"), "starts": F.col("offsets")})
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens", "starts", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", replace_private),
    ("bpe", encode),
]

#: The first stage is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = pinned(docs)
    return docs
