"""The registered queries of the operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import bpe, chunk_bpe, decontaminate, html, jaccard, merkle, periodic, pii, quality, spelling, sql, substrings, toxicity, warc
from canopy.llm.common import pinned, table


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, tagger).select("doc_id", "held_out", "score", "predicted", "n_toxic")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents").select("doc_id", "text"), counter="n_entities")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A file of the installed public tokenizers, by default the ranks, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pinned(spelling.vocabulary(table(spark, sf_dir, "documents"), misspell=True))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def register(catalog) -> None:
    catalog.add("op1_decontaminate", op1_decontaminate, sql.DECONTAMINATE)
    catalog.add("op2_substrings", op2_substrings)
    catalog.add("op3_toxicity", op3_toxicity)
    catalog.add("op4_jaccard", op4_jaccard, sql.JACCARD)
    catalog.add("op5_fingerprints", op5_fingerprints)
    catalog.add("op6_pii", op6_pii)
    catalog.add("op7_quality", op7_quality)
    catalog.add("op8_bpe", op8_bpe)
    catalog.add("op9_html", op9_html)
    catalog.add("op10_warc", op10_warc, sql.WARC)
    catalog.add("op11_chunk_bpe", op11_chunk_bpe)
    catalog.add("op12_periodic", op12_periodic, sql.PERIODIC)
    catalog.add("op13_spelling", op13_spelling, sql.SPELLING)
