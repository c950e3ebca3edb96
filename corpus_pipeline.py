"""The training-data pipeline: documents through the stages of STAGES, each written as Parquet and read again.

Quality rules and contaminated documents go, one document of each near-duplicate group stays, personal data is replaced,
and what remains is encoded. Every stage works on all that the one before it kept; all but the last return the columns of
documents, whatever those are named.

Defined results: a null or empty text fails the quality rules; of rows that repeat both doc_id and text one stays, rows
of one doc_id with different texts are one document and stay or go together; rows of a null doc_id go only if they
repeat another's text, as nothing names them; null values in other columns and extra columns are carried; an empty table
gives an empty one. Pseudonyms are keyed by the setting spark.skyweave.pii.key (see pii.key_of).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm import bpe_codec, common, decontaminate, near_dedup, pii, quality_rules

#: No SQL engine expresses the keyed pseudonyms and the merges; the stages are tested one by one.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """(row, text): all other columns as one, so that no operator's output meets a column of the same name."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest, F.lit(True).alias("__some")).alias("row"), F.col("text"))


def _unpacked(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs` again, those in `new` replaced."""
    new = {"text": F.col("text"), **(new or {})}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return _unpacked(quality_rules.judge(_packed(docs)).where("kept"), docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group (five-word shingles, similarity 0.8), and one of repeated rows."""
    groups = common.materialize(near_dedup.near_duplicates(docs.select("doc_id", "text"), memory=200_000).select("doc_id", "kept"), "groups")
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= near_dedup.MOST_IDS else gone
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = common.materialize(groups.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        return kept
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").union(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    judged = decontaminate.decontaminate(_packed(docs), common.table(spark, sf_dir, "benchmark"))
    return _unpacked(judged.where(~F.col("contaminated")), docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and their length."""
    out = pii.pseudonymize(_packed(docs), pii.key_of(spark))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return _unpacked(out, docs, {"n_chars": F.length("text").cast(kind)} if kind else {})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, packed, with the digests of ids and of the bytes they decode to."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_codec.recode(docs.select("doc_id", "text"), ranks, pattern, memory=150_000, chunk=100_000)
    return both.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_personal_data),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
